"""op11: runs of words against a search over all periods, awkward inputs, the registered query."""

import hashlib
import os
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from histofold.llm import runs
from histofold.llm.queries import QUERIES
from tests.llm import helpers as H

SF = "/root/testdata/sf0.001"


def searched(w, least_words=6, least_turns=4):
    """Runs by trying every period at every place."""
    out = []
    for q in range(1, len(w) // least_turns + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least_words, least_turns * q) and all(
                    any(w[k] != w[k + d] for k in range(i, i + size - d)) for d in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out)


def collapse(w, found):
    drop = {k for s, n, q in found for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in drop)


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=70), st.integers(1, 9), st.integers(0, 40), st.sampled_from([(6, 4), (2, 2), (3, 2), (4, 3), (12, 4)]))
def test_against_search(base, period, at, limits):
    w = [c.encode() for c in base]
    for turned in (w, [w[k] if k < at or at + (k - at) % period >= len(w) else w[at + (k - at) % period] for k in range(len(w))]):
        assert runs.runs_of(turned, *limits) == searched(turned, *limits)


def test_long_texts():
    for size, cycle in ((60_000, 1), (60_000, 7), (30_000, 4_000)):
        w = [b"w%d" % (k % cycle) for k in range(size)]
        assert runs.runs_of(w) == [(0, size, cycle)]
    rng = random.Random(5)
    w = [b"w%d" % (rng.random() ** 3 * 400) for _ in range(20_000)] + [b"x", b"y"] * 900 + [b"z"] + [b"x", b"y"] * 900
    assert [r for r in runs.runs_of(w) if r[0] >= 19_999] == [(20_000, 1800, 2), (21_801, 1800, 2)]


def test_awkward_rows(spark):
    texts = [*H.AWKWARD, "a b " * 9 + "c", "no  run \x0b here", "             "]
    docs = H.docs(spark, texts, [*H.IDS, 20, 21, None])
    out = runs.collapsed(docs).collect()
    assert len(out) == len(texts) and out[0].asDict().keys() >= set(docs.columns)
    for row in out:
        w = re.findall(r"[^\x20\x09-\x0D]+", row.text or "")
        if len(w) < 3000:
            want = searched(w)
            assert [tuple(r) for r in row.runs] == want
            assert row.collapsed == collapse(w, want)
    assert sum(len(r.runs) for r in out) >= 2
    assert runs.collapsed(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="runs"):
        runs.collapsed(docs.withColumnRenamed("hash", "runs"))
    assert "runs" in runs.collapsed(docs.withColumnRenamed("hash", "runs"), runs_col="found").columns


@pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")
def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        if n > 2500:
            continue
        own = searched(w)
        best = min(own, key=lambda r: (-r[1] / r[2], r[0], r[2])) if own else (None,) * 3
        want = (doc_id, len(own), *best, 1000 * best[1] // best[2] if own else None,
                hashlib.sha256("".join("%d,%d,%d\n" % r for r in own).encode()).hexdigest(),
                hashlib.sha256(collapse(w, own).encode()).hexdigest())
        assert tuple(got[doc_id]) == want
