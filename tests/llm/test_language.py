"""op13: forward-backward against all label sequences, code-switched texts, held-out accuracy, awkward rows."""

import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from histofold.llm import language, toxicity
from tests.llm import helpers as H

SF = "/root/testdata/sf0.01"
SYLLABLES = {"aa": "ka to mi ru sha no".split(), "bb": "schr ung ein tz ober ast".split(), "cc": "eaux ille oui tre que ment".split()}


def text(lang, seed, n):
    rng = random.Random(f"{lang}{seed}")
    return [("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4)))).capitalize() for _ in range(n)]


@pytest.mark.parametrize("chunk", [1, 2, 3, 64])
def test_forward_backward_against_all_sequences(monkeypatch, chunk):
    monkeypatch.setattr(language, "CHUNK", chunk)
    rng = np.random.default_rng(chunk)
    sizes = np.array([1, 7, 2, 3, 6, 1])
    e, a = rng.random((sizes.sum(), 3)) + 1e-3, rng.random((3, 3)) + 1e-2
    fwd, bwd = language.forward_backward(e, a, sizes)
    got = fwd * bwd
    got /= got.sum(1, keepdims=True)
    at = 0
    for n in sizes:
        want = np.zeros((n, 3))
        for seq in itertools.product(range(3), repeat=int(n)):
            p = np.prod([e[at + k, y] for k, y in enumerate(seq)]) * np.prod([a[x, y] for x, y in zip(seq, seq[1:])])
            for k, y in enumerate(seq):
                want[k, y] += p
        assert np.allclose(got[at:at + n], want / want.sum(1, keepdims=True))
        at += n


def model():
    return language.learned([(lang, [w.lower() for w in text(lang, k, 40)]) for k in range(60) for lang in SYLLABLES])


def test_code_switched_text(spark):
    m = model()
    assert m.languages == ("aa", "bb", "cc") and all(m.transitions[k, k] > m.transitions[k, (k + 1) % 3] for k in range(3))
    parts = [("aa", 200), ("cc", 15), ("bb", 90), ("aa", 40)]
    words = [w for k, (lang, n) in enumerate(parts) for w in text(lang, 1000 + k, n)]
    row = language.labelled(H.docs(spark, [" 12, ".join(words)]), m).collect()[0]
    spans = [(s.lang, s.start, s.words) for s in row.spans]
    assert [s[0] for s in spans] == [p[0] for p in parts] and sum(s[2] for s in spans) == len(words)
    for (_, start, _), want in zip(spans, (0, 200, 215, 305)):
        assert abs(start - want) <= 2
    assert row.lang_pred == "aa" and abs(row.score - 240 / 345) < 0.03


def test_long_text_in_one_piece(spark):
    m = model()
    words = text("bb", 5, 30_000) + text("aa", 6, 10_000)
    row = language.labelled(H.docs(spark, [" ".join(words)]), m).collect()[0]
    assert row.lang_pred == "bb" and [s.lang for s in row.spans] == ["bb", "aa"] and abs(row.spans[1].start - 30_000) <= 2


def test_awkward_rows(spark):
    docs = H.docs(spark, [*H.AWKWARD, "12 34 ½ ?!", "Résumé"], [*H.IDS, 30, 31])
    out = language.labelled(docs, model()).collect()
    assert len(out) == len(H.AWKWARD) + 2
    for r in out:
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
        assert sum(s.words for s in r.spans) == len(language.words_of(r.text or ""))
    assert len({(r.lang_pred, r.score) for r in out if r.text == "one"}) == 1
    assert language.labelled(docs.limit(0), model()).count() == 0
    with pytest.raises(ValueError, match="score"):
        language.labelled(docs.withColumnRenamed("hash", "score"), model())


def test_fit_uses_training_rows_with_a_language_only(spark):
    rows = [(k, " ".join(text(lang, k, 50)), lang) for k in range(40) for lang in SYLLABLES]
    rows = [(10 * i + j, t, lang) for j, (i, t, lang) in enumerate(rows)] + [(None, "x y z", "zz"), (5_000, "x y z", None), (5_001, None, "yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = language.fit(docs, F.col("doc_id") % 2 == 0)
    assert set(m.languages) <= {"aa", "bb", "cc"}
    held = language.labelled(docs.where("doc_id % 2 = 1 AND doc_id < 5000"), m).collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    again = docs.unionByName(docs).repartition(7)
    assert language.fit(again, F.col("doc_id") % 2 == 0).lexicon == m.lexicon  # repeated rows count once
    none = language.fit(docs.limit(0), F.lit(True))
    assert {(r.lang_pred, r.score) for r in language.labelled(docs, none).collect()} == {("und", 0.0)}


@pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    training = toxicity.is_training(F.col("doc_id"))
    m = language.fit(docs, training)
    out = language.labelled(docs, m).where(~training).collect()
    assert len(out) > 200 and sum(r.lang == r.lang_pred for r in out) >= 0.98 * len(out)
