"""op12: weights and ranks against plain counting, with runs of one and of several words."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from histofold.llm import resampling
from histofold.llm.common import Scratch
from tests.llm import helpers as H

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, max_run, buckets):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    grams = [" ".join(w[i:i + k]) for k in range(1, max_run + 1) for i in range(len(w) - k + 1)]
    return len(w), Counter(zlib.crc32(g.encode()) % buckets for g in grams)


def plain(rows, target, max_run, buckets, percent, min_words, seed):
    found = [features(t, max_run, buckets) for _, t in rows]
    s, t = sum((c for _, c in found), Counter()), sum((features(x, max_run, buckets)[1] for x in target), Counter())
    of_s, of_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * of_s / ((s[b] + 1) * of_t))) for b in s}
    out = []
    for (i, _), (n, c) in zip(rows, found):
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(k * gain[b] for b, k in c.items())
        out.append([i, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    ready = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(ready[:percent * len(ready) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("max_run, buckets", [(1, 10_000), (1, 7), (2, 500), (3, 10_000)])
def test_against_plain_counting(spark, max_run, buckets):
    hot = "The same line Everywhere, 3 times"
    texts = [*H.AWKWARD, *["\n".join([hot, H.prose(k, 12), hot, H.prose(k % 3, 9), "", "é Ünï 42"]) for k in range(40)], "a\nb\nc", "\n", "--"]
    ids = [*H.IDS, *range(100, 140), 200, 201, 202]
    target = [H.prose(1, 60), None, "", "é ünï\n42 the"]
    docs = H.docs(spark, texts, ids)
    goal = spark.createDataFrame([(k, t, "x") for k, t in enumerate(target)], "item_id long, text string, weight string")
    out = resampling.ranked(docs, goal, percent=30, min_words=5, max_run=max_run, buckets=buckets, seed=7)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert got == plain(list(zip(ids, texts)), target, max_run, buckets, 30, 5, 7)
    kept = {r.doc_id for r in resampling.drawn(docs, out).collect()}
    assert kept == {r[0] for r in got if r[4] is not None} - {None}


def test_lines_are_counted_once(spark):
    """A line that many texts hold is one row of the counted table, with all its occurrences."""
    docs = spark.createDataFrame([(k, "same  Line here\nown line w%d\nSame line, here" % k) for k in range(50)], "id long, text string")
    _, lines, hits = resampling._segments(docs, resampling.Features(), Scratch(spark, "test"), "corpus")
    rows = lines.collect()
    assert len(rows) == 51 and sorted(r.times for r in rows)[-2:] == [1, 100]
    assert hits.sum() == 50 * 9 and hits[zlib.crc32(b"line") % 10_000] >= 150


def test_empty_tables(spark):
    docs, none = H.docs(spark, ["a b c d"] * 3), H.docs(spark, [])
    assert resampling.ranked(none, docs).count() == 0
    out = resampling.ranked(docs, none, percent=100, min_words=1).collect()
    assert {r.rank for r in out} == {1, 2, 3} and {r.n_features for r in out} == {4}
    with pytest.raises(ValueError, match="score"):
        resampling.ranked(docs.withColumn("score", docs.doc_id), docs, id_col="score")
