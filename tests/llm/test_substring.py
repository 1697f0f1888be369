"""Substring dedup as a whole against brute force over words, without hashes of runs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from histofold.llm import substring

from .helpers import docs, prose

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def segments(closes, n):
    """(first word, word after the last) of the units that the closing words make."""
    ends = [k + 1 for k in range(n) if closes[k] or k == n - 1]
    return list(zip([0, *ends[:-1]], ends))


def parse(raw):
    """Words, units, units without line breaks, sentences of a text."""
    import xxhash

    found = list(WORD.finditer(raw))
    words, n = [m.group().lower() for m in found], len(found)
    stop = [w[-1:] in (b".", b"!", b"?") for w in words]
    broken = [k + 1 < n and b"\n" in raw[found[k].end():found[k + 1].start()] for k in range(n)]
    rank = [0 if s else (xxhash.xxh3_64_intdigest(w) >> 1) + 1 for w, s in zip(words, stop)]
    closes = list(stop)
    for k in range(n - substring.WINDOW + 1):
        window = range(k, k + substring.WINDOW)
        least = min(rank[j] for j in window)
        for j in window:
            closes[j] = closes[j] or rank[j] == least
    both = [c or b for c, b in zip(closes, broken)]
    sentence = [s or b for s, b in zip(stop, broken)]
    return found, words, segments(both, n), segments(closes, n), segments(sentence, n)


def brute(rows):
    """{id: (text, ids that keep what repeats, units removed)}"""
    parsed, first, runs = {}, {}, []
    for i, t in sorted(rows):
        parsed[i] = parse((t or "").encode())
        _, words, units, firm, _ = parsed[i]
        seen = set()
        for kind, cut in enumerate((units, firm)):
            for u in range(len(cut)):
                for s in range(u + substring.UNITS - 1, len(cut)):
                    if cut[s][1] - cut[u][0] >= substring.LEAST_WORDS:
                        if (cut[u][0], cut[s][1]) not in seen:
                            seen.add((cut[u][0], cut[s][1]))
                            runs.append((i, cut[u][0], kind, cut[s][1], tuple(words[cut[u][0]:cut[s][1]])))
                        break
    gone, keepers = {}, {}
    for i, a, kind, b, run in sorted(runs):
        if run not in first:
            first[run] = i
        else:
            gone.setdefault(i, set()).update(range(a, b))
            keepers.setdefault(i, set()).add(first[run])
    out = {}
    for i, t in rows:
        raw = (t or "").encode()
        found, words, units, _, sentences = parsed[i]
        drop = set()
        for a, b in sentences:
            covered = [k for k in range(a, b) if k in gone.get(i, ())]
            if len(covered) == b - a or b - a > substring.LONG_SENTENCE:
                drop.update(covered)
        edges = [found[a].start() for a, _ in units] + [len(raw)]
        kept = b"".join(raw[edges[k]:edges[k + 1]] for k, (a, _) in enumerate(units) if a not in drop)
        removed = sum(a in drop for a, _ in units)
        out[i] = (t if t is None else (raw[:edges[0]] + kept).decode(), keepers[i] if removed else None, removed)
    return out


def corpus(seed):
    """Texts that share whole sentences, parts of them, long lines without stops, and passages broken into other lines."""
    rnd = random.Random(seed)
    shared = [prose(900 + k, rnd.choice([18, 40, 70])) for k in range(8)]
    flat = [" ".join(f"w{rnd.randrange(400)}" for _ in range(rnd.choice([30, 60, 120]))) for _ in range(5)]
    texts = []
    for k in range(70):
        parts = []
        for _ in range(rnd.randrange(1, 5)):
            source = rnd.choice(shared + flat).split()
            a = rnd.randrange(max(1, len(source) - 20))
            piece = source[a:a + rnd.randrange(10, 90)] if rnd.random() < 0.6 else source
            parts.append(rnd.choice([" ", "  ", "\n"]).join(piece) if rnd.random() < 0.3 else " ".join(piece))
            parts.append(prose(10_000 * seed + 10 * k + len(parts), rnd.randrange(1, 40)))
        texts.append(rnd.choice([" ", "\n", ". "]).join(parts))
    return [*texts, "", None, " \n ", "a. b. c.", texts[3], ("again and " * 40 + "\n") * 3]


@pytest.mark.parametrize("seed", [1, 2])
def test_whole_operator_against_brute_force(spark, seed):
    texts = corpus(seed)
    ids = random.Random(seed).sample(range(1000), len(texts))
    want = brute(list(zip(ids, texts)))
    got = {r["doc_id"]: r for r in substring.cut(docs(spark, texts, ids).repartition(5)).collect()}
    assert sum(w[2] > 0 for w in want.values()) > 20
    for i, (text, keepers, removed) in want.items():
        r = got[i]
        assert (r["text"], r["first_ids"] and set(r["first_ids"]), r["n_removed"]) == (text, keepers, removed), i


def test_sentences_go_whole_or_stay(spark):
    passage = prose(77, 60)
    inside = " ".join(passage.split()[4:50])  # from the middle of a sentence to the middle of another
    texts = [f"{prose(1, 18)} {passage}", f"one two three {inside} four five six.", f"{prose(3, 27)} {passage} {prose(4, 20)}"]
    rows = {r["doc_id"]: r["text"] for r in substring.cut(docs(spark, texts, [1, 2, 3])).collect()}
    for i, t in ((2, texts[1]), (3, texts[2])):
        sentences = set(re.split(r"(?<=\.)\s+", t))
        assert rows[i] != t and set(filter(None, re.split(r"(?<=\.)\s+", rows[i]))) <= sentences
    assert rows[2].startswith("one two three") and rows[2].endswith("four five six.") and rows[1] == texts[0]


def test_ids_of_any_type(spark):
    passage = prose(5, 60)
    given = docs(spark, [passage, f"{prose(6, 30)} {passage}", passage, None], [1, 2, 3, 4]).withColumn(
        "doc_id", F.expr("CASE doc_id WHEN 1 THEN 'https://b/9' WHEN 2 THEN 'https://a/10' END"))
    rows = {(r["doc_id"], r["text"] is None): r for r in substring.cut(given).collect() if r["n_units"] or r["text"] is None}
    assert rows["https://a/10", False]["n_removed"] == 0 and rows["https://b/9", False]["first_ids"] == ["https://a/10"]
    # the cuts at the very start of a text are its own, so its first run stands in the other copy alone
    assert set(rows[None, False]["first_ids"]) == {"https://a/10", "https://b/9"} and rows[None, True]["n_removed"] == 0
