"""Cases in which an operator once did less than its whole job."""

import random
import zlib

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from histofold.llm import packing, substring, toxicity

from .helpers import docs, prose

PATTERN, VOCAB = public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json")


def test_toxicity_learns_every_kind_of_toxic_text(spark):
    """Words that are frequent in one kind of text do not hide the word beginnings of another, whose words are all rare."""
    rnd = random.Random(4)
    first = [a + b for a in "bcdfghk" for b in ("a", "e", "i", "an", "er")]
    second = [a + b for a in "lmnprst" for b in ("o", "u", "öl", "eux", "ich")]
    texts, kinds = [], []
    for k in range(1200):
        syllables, toxic = (first, second)[k % 2], k % 8 < 2
        words = ["".join(rnd.choices(syllables, k=rnd.choice((1, 2, 3)))) for _ in range(rnd.randrange(60, 200))]
        for _ in range(5 * toxic):
            words.insert(rnd.randrange(len(words)), "wolgan" + "".join(rnd.choices(syllables, k=2)) if k % 2
                         else rnd.choice(["scoundrel", "blockhead", "nincompoop"]))
        texts.append(" ".join(words))
        kinds.append((k % 2, int(toxic)))
    labels = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(kinds)], "doc_id long, toxic int")
    given = docs(spark, texts)
    model = toxicity.fit(given, labels, toxicity.is_training(F.col("doc_id")))
    score = {r["doc_id"]: r["score"] for r in toxicity.scored(given, model).collect()}
    for kind in (0, 1):
        held = [k for k in range(1200) if kinds[k][0] == kind and zlib.crc32(str(k).encode()) % 4 == 2]
        found = [score[k] >= toxicity.REJECT for k in held if kinds[k][1]]
        wrong = [score[k] >= toxicity.REJECT for k in held if not kinds[k][1]]
        assert sum(found) >= 0.8 * len(found) and sum(wrong) <= 0.1 * len(wrong), kind


def test_packing_gives_added_tokens_their_own_ids():
    """As the tokenizers library does by default."""
    theirs, ours, added = Tokenizer.from_file(VOCAB), packing._encoding(VOCAB, PATTERN), packing.added_tokens(VOCAB)
    end = "<|endoftext|>"
    texts = [f"hello {end} world", end, end * 3, f"  {end}  \n{end}x", f"{end[:-1]} {end}> <{end}", "plain  text", "", f"é{end}'s", prose(9, 300) + end]
    for t in texts:
        assert list(packing.encode_text(ours, PATTERN, added, t)) == theirs.encode(t, add_special_tokens=False).ids, t
    assert list(packing.encode_text(ours, PATTERN, added, texts[0])) == [31373, 220, 50256, 995]


def test_packing_table_holds_added_tokens(spark):
    rows = packing.pack(docs(spark, ["hello <|endoftext|> world"]), VOCAB, PATTERN).collect()
    assert [packing.ids_of(bytes(r["ids"])) for r in rows] == [[31373, 220, 50256, 995, 1]]


def rare(seed, n):
    rnd = random.Random(seed)
    return ["".join(rnd.choices("abcdefghijklmnop", k=7)) for _ in range(n)]


def holds(words, earlier, size=50):
    seen = {tuple(earlier[k:k + size]) for k in range(len(earlier) - size + 1)}
    return any(tuple(words[k:k + size]) in seen for k in range(len(words) - size + 1))


def test_substring_sees_any_fifty_shared_words(spark):
    """Passages without stops, of words that the old anchors did not cut, of one word, and broken into other lines."""
    import xxhash

    plain = [w for w in rare(1, 3000) if xxhash.xxh3_64_intdigest(w) % 8]
    passages = [plain[50 * k:50 * k + 50] for k in range(40)] + [["and"] * 120, ["der"] * 50]
    texts, ids = [], []
    for k, p in enumerate(passages):
        texts += [" ".join([*rare(100 + k, 7 + k % 5), *p, *rare(200 + k, 9)]), " ".join([*rare(300 + k, 11), *p, *rare(400 + k, 6 + k % 7)])]
        ids += [2 * k, 2 * k + 1]
    lines = plain[2100:2150]
    texts += [" ".join(lines), "\n".join(" ".join(lines[k:k + 4]) for k in range(0, 50, 4))]
    ids += [900, 901]
    rows = {r["doc_id"]: r["text"] for r in substring.cut(docs(spark, texts, ids)).collect()}
    for k in range(len(passages)):
        assert holds(texts[2 * k + 1].split(), texts[2 * k].split()) and not holds(rows[2 * k + 1].split(), texts[2 * k].split()), k
        assert k >= 40 or rows[2 * k] == texts[2 * k]
    assert rows[900] == texts[-2] and len(rows[901].split()) < 50
