"""Language of every word, and of the text, by a linear-chain conditional random field.

Words are the runs of letters of a text, in lower case.  A word's score for a language is the sum of learned
weights of its features: affixes (1 to ``AFFIX`` letters), n-grams of letters, and lexicon features (how large
the language's share of that word was in the sample, in ``LEVELS`` levels, or that the word is unknown).  Learned
transition weights join neighbouring words.  Forward-backward gives the probability of every language for
every word, in the light of the whole text; a text's languages are the spans of its words, and its language is
the one with the largest mean probability, which is its score.

Fitting: at most ``PER_LANGUAGE`` rows (smallest hash of the id) of each of the ``LANGUAGES`` most frequent
languages, of each a stretch of ``STRETCH`` words at a hashed place of the whole text.  Half of the stretches are
spliced with one of another row, so that the transitions see texts that switch language.  The lexicon
features of a stretch come from the other half of the sample, as those of an unseen text will.  The
likelihood is climbed with Adam; gradients are the differences of observed and expected counts.

The texts of a batch run together: words are cut into chunks of ``CHUNK``, each chunk's product of transfer
matrices is formed for all chunks at once, the vectors at the chunk borders are carried along each text, then all
chunks run forward and backward at once.  That is exact for texts of any length; memory is bounded by
``BATCH_WORDS``.

Defined cases: null text, or a text without a letter: ``und``, score 0, no spans; the same for every text where no
row can be learned from; rows with a null id or a null language are not learned from; repeated rows get equal
results, and rows that share an id count once; an empty table gives an empty result; other columns are
carried along, and one that has a name of the results is refused.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histofold.llm.common import plain, refuse, ship

#: Rows of a language that are learned from, at most; languages at most; words of a row.
PER_LANGUAGE, LANGUAGES, STRETCH = 600, 64, 60
#: Rounds of the climb, its step, and the weight of the squares of the weights.
ROUNDS, STEP, RIDGE = 60, 0.1, 1e-3
#: Letters of the longest affix, n-grams, hashed features, levels of the lexicon, least occurrences of its words.
AFFIX, GRAMS, HASHED, LEVELS, LEXICON_MIN = 4, (2, 3), 1 << 16, 5, 3
#: Least log weight of a transition next to the largest: a chunk's products stay inside doubles.
LEAST_TRANSITION = -8.0
#: Words of a chunk, words that run together, words whose scores a task remembers.
CHUNK, BATCH_WORDS, HELD_WORDS = 64, 400_000, 300_000
UNDETERMINED = "und"

_WORD = re.compile(r"[^\W\d_]+")
SPAN = T.StructType([T.StructField("lang", T.StringType()), T.StructField("start", T.LongType()), T.StructField("words", T.LongType())])
_SPANS_ARROW = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("words", pa.int64())]))


@dataclass(frozen=True)
class Model:
    """Weights by feature and language, transitions, and the lexicon's level of every word and language."""

    languages: tuple[str, ...] = ()
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    lexicon: dict[str, tuple[int, ...]] = field(default_factory=dict)


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case; letters and their marks as one."""
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    found = _WORD.findall(text.lower())
    # numbers like a half are word characters without being letters
    return found if all(map(str.isalpha, found)) else [w for w in found if any(map(str.isalpha, w))]


def features_of(word: str) -> set[int]:
    """Hashed affixes and n-grams of a word."""
    pieces = {f"{n}:{word[k:k + n]}" for n in GRAMS for k in range(len(word) - n + 1)}
    for n in range(1, min(AFFIX, len(word)) + 1):
        pieces.add(f"^{word[:n]}")
        pieces.add(f"{word[-n:]}$")
    return {zlib.crc32(p.encode("utf-8", "replace")) % HASHED for p in pieces}


def _lexical(levels: tuple[int, ...] | None, languages: int) -> list[int]:
    """Features of a word's entry in the lexicon, or of its absence."""
    if levels is None:
        return [HASHED]
    return [HASHED + 1 + LEVELS * k + level for k, level in enumerate(levels)]


def forward_backward(e: np.ndarray, a: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward vectors (each scaled to sum 1) of every word.

    ``e``: positive scores of the words of all texts, one after the other; ``a``: positive transition scores;
    ``sizes``: words of each text, all above 0.
    """
    n_chunks = -(-sizes // CHUNK)
    text = np.repeat(np.arange(len(sizes)), n_chunks)
    number = np.arange(len(text)) - np.repeat(np.cumsum(n_chunks) - n_chunks, n_chunks)
    start = (np.cumsum(sizes) - sizes)[text] + number * CHUNK
    size = np.minimum(CHUNK, sizes[text] - number * CHUNK)
    # longest chunks first: those that still run are always the first ones
    order = np.argsort(-size, kind="stable")
    start, size, number = start[order], size[order], number[order]
    where = np.empty(len(order), np.int64)
    where[order] = np.arange(len(order))
    running = [int(np.searchsorted(-size, -k, "left")) for k in range(int(size.max(initial=0)))]  # chunks with more than k words
    n_lang, first = e.shape[1], number == 0

    product = np.broadcast_to(np.eye(n_lang), (len(order), n_lang, n_lang)).copy()
    for k, m in enumerate(running):
        here = product[:m] @ a
        if k == 0:
            here[first] = product[first]  # nothing comes before the first word of a text
        product[:m] = here * e[start[:m] + k][:, None, :]

    # vectors at the borders of the chunks, carried along each text
    begin, end = np.ones((len(order), n_lang)), np.ones((len(order), n_lang))
    base = np.cumsum(n_chunks) - n_chunks
    longest = int(n_chunks.max(initial=0))
    texts = np.argsort(-n_chunks, kind="stable")
    falling = -n_chunks[texts]
    for j in range(1, longest):
        own = base[texts[:np.searchsorted(falling, -j, "left")]] + j
        before = where[own - 1]
        v = np.einsum("ml,mlk->mk", begin[before], product[before])
        begin[where[own]] = v / v.sum(1, keepdims=True)
    for j in range(longest - 1, 0, -1):
        own = base[texts[:np.searchsorted(falling, -j, "left")]] + j
        after = where[own]
        v = np.einsum("mlk,mk->ml", product[after], end[after])
        end[where[own - 1]] = v / v.sum(1, keepdims=True)

    forward, backward = np.empty(e.shape), np.empty(e.shape)
    v = begin
    for k, m in enumerate(running):
        here = v[:m] @ a
        if k == 0:
            here[first] = v[first]
        here *= e[start[:m] + k]
        here /= here.sum(1, keepdims=True)
        forward[start[:m] + k] = v[:m] = here
    v = end
    backward[start + size - 1] = v / v.sum(1, keepdims=True)
    for k in range(len(running) - 1, 0, -1):
        m = running[k]
        here = (e[start[:m] + k] * backward[start[:m] + k]) @ a.T
        backward[start[:m] + k - 1] = here / here.sum(1, keepdims=True)
    return forward, backward


def _scores(weights: np.ndarray, features: list[list[int]]) -> np.ndarray:
    """Sums of the weights of each word's features (every word has one at least)."""
    at = np.cumsum([0, *map(len, features[:-1])])
    return np.add.reduceat(weights[np.fromiter((f for fs in features for f in fs), np.int64)], at, axis=0)


def _positive(scores: np.ndarray) -> np.ndarray:
    return np.exp(np.maximum(scores - scores.max(1, keepdims=True), -30.0))


def _transition_scores(transitions: np.ndarray) -> np.ndarray:
    return np.exp(np.maximum(transitions - (transitions.max() if transitions.size else 0.0), LEAST_TRANSITION))


def _lexicon(stretches: list[tuple[int, list[str]]], languages: int) -> dict[str, tuple[int, ...]]:
    """Level of each language's share of every word that occurs often enough (rates, so that sizes do not matter)."""
    counts: dict[str, np.ndarray] = {}
    for label, words in stretches:
        for w in words:
            counts.setdefault(w, np.zeros(languages))[label] += 1
    total = np.zeros(languages)
    for c in counts.values():
        total += c
    out = {}
    for w, c in counts.items():
        if c.sum() >= LEXICON_MIN:
            rate = c / np.maximum(total, 1)
            out[w] = tuple(int(v) for v in np.minimum(LEVELS - 1, np.ceil(rate / rate.sum() * (LEVELS - 1))))
    return out


def _spliced(stretches: list[tuple[int, list[str]]]) -> list[list[tuple[int, int, str]]]:
    """Training sequences of (half, label, word): every second one goes over into another stretch of its half."""
    rng = np.random.default_rng(20)
    out = []
    for half in (0, 1):
        own = stretches[half::2]
        other = rng.permutation(len(own))
        for k, (label, words) in enumerate(own):
            seq = [(half, label, w) for w in words]
            if k % 2:
                label2, words2 = own[other[k]]
                cut = int(rng.integers(0, min(len(words), len(words2)) + 1))
                seq = seq[:cut] + [(half, label2, w) for w in words2[cut:]]
            if seq:
                out.append(seq)
    return out


def learned(stretches: list[tuple[str, list[str]]]) -> Model:
    """Fit on (language, words) pairs; their order decides the halves, so hand them over sorted."""
    languages = tuple(sorted({lang for lang, words in stretches if words}))
    if not languages:
        return Model()
    n_lang = len(languages)
    label_of = {lang: k for k, lang in enumerate(languages)}
    known = [(label_of[lang], words) for lang, words in stretches if words]
    other_half = [_lexicon(known[1::2], n_lang), _lexicon(known[0::2], n_lang)]
    seqs = _spliced(known)
    sizes = np.array([len(s) for s in seqs])
    index: dict[tuple[int, str], int] = {}
    word = np.array([index.setdefault((half, w), len(index)) for s in seqs for half, _, w in s])
    gold = np.array([label for s in seqs for _, label, _ in s])
    feats = [sorted(features_of(w)) + _lexical(other_half[half].get(w), n_lang) for half, w in index]
    flat = np.fromiter((f for fs in feats for f in fs), np.int64)
    owner = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    # only features that occur have a weight to learn
    seen, flat_at = np.unique(flat, return_inverse=True)
    at = np.cumsum([0, *map(len, feats[:-1])])
    follows = np.ones(len(word), bool)
    follows[np.cumsum(sizes) - sizes] = False
    follows = np.flatnonzero(follows)
    gold_pairs = np.bincount(gold[follows - 1] * n_lang + gold[follows], minlength=n_lang * n_lang).reshape(n_lang, n_lang)
    w, trans = np.zeros((len(seen), n_lang)), np.zeros((n_lang, n_lang))
    params = [w, trans]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, ROUNDS + 1):
        e = _positive(np.add.reduceat(w[flat_at], at, axis=0))[word]
        a = _transition_scores(trans)
        fwd, bwd = forward_backward(e, a, sizes)
        post = fwd * bwd
        post /= post.sum(1, keepdims=True)
        # expected transitions: forward of the word before, this word's score and backward vector
        right = e[follows] * bwd[follows]
        norm = np.einsum("ml,lk,mk->m", fwd[follows - 1], a, right)
        pairs = (fwd[follows - 1] / norm[:, None]).T @ right * a
        post[np.arange(len(gold)), gold] -= 1
        by_word = np.stack([np.bincount(word, post[:, k], len(feats)) for k in range(n_lang)], 1)
        grad_w = np.stack([np.bincount(flat_at, by_word[owner, k], len(seen)) for k in range(n_lang)], 1)
        for k, (p, g) in enumerate(((w, grad_w + RIDGE * len(gold) / len(seen) * w), (trans, pairs - gold_pairs + RIDGE * trans))):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            p -= STEP * (first[k] / (1 - 0.9 ** t)) / (np.sqrt(second[k] / (1 - 0.99 ** t)) + 1e-8)
    weights = np.zeros((HASHED + 1 + LEVELS * n_lang, n_lang), np.float32)
    weights[seen] = w
    return Model(languages, weights, trans, _lexicon(known, n_lang))


def _stretches(text_col: str, id_col: str, stretch: int):
    """A stretch of words at a hashed place of every text."""
    def run(batches):
        for batch in batches:
            text, ids = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (text_col, id_col))
            out = []
            for t, i in zip(text, ids):
                words = words_of(t)
                at = zlib.crc32(f"place:{i}".encode()) % max(1, len(words) - stretch + 1)
                out.append(" ".join(words[at:at + stretch]))
            kept = [c for c in batch.schema.names if c != text_col]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.string())], [*kept, "stretch"])

    return run


def fit(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_language: int = PER_LANGUAGE, max_languages: int = LANGUAGES, stretch: int = STRETCH) -> Model:
    """Fit on at most ``per_language`` rows of each language for which ``training`` (over the id) holds."""
    ship(docs.sparkSession)
    rows = docs.where(training & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), plain(F.col(text_col)).alias("text"))
    frequent = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    # at most per_language rows of (id, language) leave a task and reach a window
    wanted = (rows.select("id", "lang").withColumn("place", place).where(F.col("place") <= per_language)
              .join(F.broadcast(frequent), "lang", "left_semi").select("id", "lang").distinct())
    # the bound of this broadcast is per_language * max_languages rows
    sample = (rows.join(F.broadcast(wanted), ["id", "lang"], "left_semi")
              .select(F.col("id").cast("string").alias("id"), "lang", "text")
              .mapInArrow(_stretches("text", "id", stretch), "id string, lang string, stretch string")
              .groupBy("id", "lang").agg(F.min("stretch").alias("stretch")))
    found = sorted((zlib.crc32(r["id"].encode()), r["id"], r["lang"], r["stretch"]) for r in sample.collect())
    return learned([(lang, words.split()) for _, _, lang, words in found])


class _Labeller:
    """Scores of words by a model, remembered by word."""

    def __init__(self, model: Model):
        self.model, self.a = model, _transition_scores(model.transitions)
        self.known: dict[str, int] = {}
        self.e = np.empty((0, len(model.languages)))

    def words(self, words: list[str]) -> np.ndarray:
        """Positive scores of the words."""
        if len(self.known) > HELD_WORDS:
            self.known, self.e = {}, self.e[:0]
        known, n = self.known, len(self.known)
        at = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        if len(known) > n:
            new = list(known)[n:]
            lexicon, n_lang = self.model.lexicon, len(self.model.languages)
            feats = [[*features_of(w), *_lexical(lexicon.get(w), n_lang)] for w in new]
            self.e = np.concatenate([self.e, _positive(_scores(self.model.weights, feats).astype(float))])
        return self.e[at]

    def texts(self, texts: list[list[str]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(mean probability of each language, language number of each word) of texts that have words."""
        sizes = np.array([len(t) for t in texts])
        fwd, bwd = forward_backward(self.words([w for t in texts for w in t]), self.a, sizes)
        fwd *= bwd
        fwd /= fwd.sum(1, keepdims=True)
        ends = np.cumsum(sizes)
        means = np.add.reduceat(fwd, ends - sizes, axis=0) / sizes[:, None]
        best = fwd.argmax(1)
        for k, end in enumerate(ends.tolist()):
            yield means[k], best[end - sizes[k]:end]


def _spans(languages: tuple[str, ...], best: np.ndarray) -> list[dict]:
    start = np.flatnonzero(np.diff(best, prepend=-1))
    return [{"lang": languages[best[s]], "start": s, "words": e - s} for s, e in zip(start.tolist(), [*start[1:].tolist(), len(best)])]


def labelled(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score",
             spans_col: str = "spans") -> DataFrame:
    """``docs`` with the language of every whole text, its score, and the spans of words of one language."""
    refuse(docs, lang_col, score_col, spans_col)
    ship(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType()),
                           T.StructField(spans_col, T.ArrayType(SPAN))])
    names = [lang_col, score_col, spans_col]
    n_lang = max(1, len(model.languages))
    # the products of the chunks that run together take n_lang * n_lang doubles a chunk
    together = max(CHUNK, min(BATCH_WORDS, (1 << 22) // (n_lang * n_lang) * CHUNK))

    def results(labeller, texts):
        some = [t for t in texts if t] if model.languages else []
        found = labeller.texts(some) if some else iter(())
        lang, score, spans = [], [], []
        for t in texts:
            if not t or not model.languages:
                lang.append(UNDETERMINED), score.append(0.0), spans.append([])
                continue
            mean, best = next(found)
            top = int(mean.argmax())
            lang.append(model.languages[top]), score.append(min(1.0, float(mean[top]))), spans.append(_spans(model.languages, best))
        return [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(spans, _SPANS_ARROW)]

    def run(batches):
        labeller = _Labeller(model)
        for batch in batches:
            column, begin, held, size = batch.column(batch.schema.get_field_index(text_col)), 0, [], 0
            for k in range(len(column)):
                held.append(words_of(column[k].as_py() or ""))
                size += len(held[-1])
                if size >= together or k == len(column) - 1:
                    part = batch.slice(begin, k + 1 - begin)
                    yield pa.RecordBatch.from_arrays([*part.columns, *results(labeller, held)], [*part.schema.names, *names])
                    begin, held, size = k + 1, [], 0

    return docs.mapInArrow(run, schema)
