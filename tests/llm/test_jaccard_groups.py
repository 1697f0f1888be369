"""op8: groups whose classes the first round leaves apart."""

import itertools
import random

from histofold.llm import jaccard
from tests.llm import helpers as H


def words(seed, n):
    rnd = random.Random(seed)
    return ["".join(rnd.choices("bcdfgklmnprst", k=6)) for _ in range(n)]


def brute(texts, ids):
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = list(range(len(texts)))

    def root(k):
        while comp[k] != k:
            k = comp[k]
        return k

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            comp[root(a)] = root(b)
    least = {}
    for k in range(len(texts)):
        least[root(k)] = min(ids[k], least.get(root(k), ids[k]))
    return {ids[k]: least[root(k)] for k in range(len(texts))}


def test_classes_of_one_group_in_different_components(spark):
    """Documents with the same rare shingles and size: one rare head, then frequent blocks chosen by a code.  Codes one
    block apart link, others do not, and missing codes tear the group into several components."""
    rare_head, joint, tail = words(1, 40), words(2, 8), words(3, 30)
    blocks = [[words(10 * k + j, 7) for j in range(2)] for k in range(6)]
    for seed in range(2):
        rnd = random.Random(seed)
        codes = rnd.sample(list(itertools.product((0, 1), repeat=6)), 22)
        texts, wide = [], []
        for code in codes:
            body = joint + [w for k, c in enumerate(code) for w in blocks[k][c]] + tail
            texts.append(" ".join(rare_head + body))
            wide += [" ".join(words(1000 + 50 * len(wide) + r, 300) + body) for r in range(12)]  # makes the body frequent
        texts += wide
        ids = list(range(len(texts)))
        rnd.shuffle(ids)
        got = {r.doc_id: r.component_id for r in jaccard.linked(H.docs(spark, texts, ids)).collect()}
        want = brute(texts[:22], ids[:22]) | {i: i for i in ids[22:]}
        assert got == want
        assert 1 < len({want[i] for i in ids[:22]}) < 22


def test_order_is_by_whole_corpus_counts(spark):
    """A passage that few documents of every task hold is known as frequent, however the rows are spread."""
    passage = " ".join(words(5, 60))
    texts = [" ".join(words(100 + k, 50)) + (" " + passage if k % 5 == 0 else "") for k in range(400)]
    found = jaccard.sets(H.docs(spark, texts).repartition(40), "doc_id", "text")
    level = jaccard.levels(found)
    slots = [int(h) & (jaccard.SLOTS - 1) for h in jaccard.shingles(passage)]
    assert all(level[s] >= int(8 * 6.3) for s in slots) and (level > 0).sum() < 200
    assert (level == jaccard.levels(found.repartition(3))).all()
