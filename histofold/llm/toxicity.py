"""Toxicity by compression distance: zstandard dictionaries trained on toxic and on ordinary text.

A text is lower-cased, stripped to words and cut into windows of ``WINDOW`` bytes at word
ends.  Each window is compressed with both dictionaries; the difference of the lengths
says which kind of text it repeats.  Literals stay uncompressed (fast strategy), and a
constant tail makes every window worth compressing, so a length counts matches with the
dictionary only.  The gains of all windows of the whole text (largest, mean, sum, number of
windows above steps, and their share) are calibrated to a probability by logistic regression.

The classifier is fitted on a bounded sample of labelled rows: the ``SAMPLE_ROWS`` rows
with the smallest hash of their id among the training rows.  The ordinary dictionary is
trained by zstandard on windows of ordinary rows.  Most text of a toxic row is ordinary,
too, and a dictionary trained on all of it holds the same as the other one.  So the toxic
dictionary is trained on the *toxic stretches* of toxic rows, each stretch a sample, and has the
ordinary dictionary in front: what both hold cancels out in the difference.  A stretch is the
part of a word covered by pieces (``GRAMS`` characters, with the blanks around the word) whose
document frequency in toxic rows exceeds that in ordinary ones by ``SIGNIFICANT``, a limit that
does not depend on the other pieces.  At most ``SAMPLES`` windows and as many stretches are
trained on, those with the smallest hash of row and place.  Only texts and labels of training rows
are learned from.

Defined cases: null text is empty; an empty text has one empty window; a document with
several labels is toxic if one says so; null ids and null labels are not learned from;
without training rows of both classes, or where no stretch is toxic, every score is 0; too few samples for
zstandard's training are the dictionary themselves; repeated rows get equal scores;
an empty table gives an empty result; other columns are carried along, a column named as the result is refused.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histofold.llm.common import Scratch, plain, refuse, ship

#: Labelled rows that the classifier is fitted on, at most.
SAMPLE_ROWS = 12_000
#: Bytes of a window; of the ordinary dictionary; of what the toxic one has beyond it, at most.
WINDOW, ORDINARY, TOXIC = 64, 16_384, 1_024
#: Windows and stretches that a dictionary is trained on, at most.
SAMPLES = 30_000
#: Piece size of the dictionary training, and shortest match, in bytes; segment sizes that the training tries.
PIECE, STEPS_TRIED = 6, 20
#: Blanks around a stretch, so that segments end with it.
PAD = b" " * 6
#: Characters of the pieces of words that are counted.
GRAMS = (5, 6, 7, 8)
#: Pieces that a task sums before it hands them on.
HELD = 200_000
#: Root of the likelihood ratio (a z-score that holds for rare pieces too) from which a piece is distinctive.
SIGNIFICANT = 5.0
#: Pieces whose hashes reach the driver and the tasks, at most, the most significant ones.
MAX_GRAMS = 20_000
#: Scores from here on count as toxic.
REJECT = 0.3
#: Gains of a window, in bytes, from which windows are counted.
STEPS = (2, 4, 6, 8)
TAIL = b"." * 48
_OTHER = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class Model:
    """Dictionaries and calibration; ``weights`` is empty where nothing could be learned."""

    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]
    #: Range of each feature in the sample: texts outside it count as its ends.
    low: tuple[float, ...] = ()
    high: tuple[float, ...] = ()

    @property
    def fitted(self) -> bool:
        return bool(self.weights)


def windows(text: str) -> list[bytes]:
    """Windows of at most ``WINDOW`` bytes over the words of a text, cut at word ends."""
    raw = _OTHER.sub(" ", text.lower()).strip().encode("utf-8", "replace")
    out, at, end = [], 0, len(raw)
    while at < end:
        stop = min(end, at + WINDOW)
        if stop < end:
            space = raw.rfind(b" ", at, stop + 1)
            stop = space if space > at else stop
        out.append(b" " + raw[at:stop] + b" " + TAIL)
        at = stop + (raw[stop:stop + 1] == b" ")
    return out or [b"  " + TAIL]


@lru_cache(maxsize=4)
def _compressors(toxic: bytes, ordinary: bytes):
    import zstandard as z

    made = []
    for content in (ordinary, toxic):
        params = z.ZstdCompressionParameters.from_level(
            1, strategy=z.STRATEGY_FAST, target_length=1, hash_log=17, min_match=PIECE, write_content_size=0,
            write_dict_id=0, write_checksum=0)
        kind = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
        kind.precompute_compress(compression_params=params)
        made.append(z.ZstdCompressor(compression_params=params, dict_data=kind).compress)
    return made


def gains(text: str, toxic: bytes, ordinary: bytes) -> list[float]:
    """Features of a text: bytes that the dictionaries save, by window, and the toxic over the ordinary one."""
    ordinary_of, toxic_of = _compressors(toxic, ordinary)
    own = windows(text)
    size = np.array([len(w) - len(TAIL) for w in own], float)
    t = size - [len(toxic_of(w)) for w in own]
    o = size - [len(ordinary_of(w)) for w in own]
    up = np.maximum(t - o, 0)
    out = [np.log1p(up.max()), up.mean(), np.log1p(up.sum()), np.log(len(own)), t.max(), t.mean(), o.mean(), (t - o).mean(), up.std()]
    for least in STEPS:
        n = (up >= least).sum()
        out += [np.log1p(n), n / len(own), np.log((n + 0.5) / (len(own) + 5))]
    return out


def _design(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x])


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1.0) -> tuple[float, ...]:
    """Weights of a ridge logistic regression (Newton steps on standardised features)."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = _design((x - mean) / scale)
    w = np.zeros(a.shape[1])
    keep = ridge * np.r_[0, np.ones(len(w) - 1)]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag(keep + 1e-6)
        w = w - np.linalg.solve(hess, a.T @ (p - y) + keep * w)
    slope = w[1:] / scale
    return tuple(float(v) for v in np.r_[w[0] - (slope * mean).sum(), slope])


def trained(samples: list[bytes], size: int) -> bytes:
    """zstandard dictionary of at most ``size`` bytes; where the samples are too few to train on, their distinct bytes."""
    import zstandard as z

    try:
        return z.train_dictionary(size, samples, d=PIECE, steps=STEPS_TRIED).as_bytes()
    except z.ZstdError:
        return b"".join(dict.fromkeys(samples))[:size].rjust(8, b" ")


def grams(text: str) -> set[str]:
    """Pieces of the words of a text, with the blanks around each word."""
    words = (f" {w} " for w in set(_OTHER.sub(" ", text.lower()).split()))
    return {w[k:k + n] for w in words for n in GRAMS for k in range(len(w) - n + 1)}


def _hashes(pieces: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(g.encode("utf-8", "replace")) for g in pieces), np.uint64, len(pieces)).view(np.int64)


def stretches(word: str, toxic: set[int]) -> list[str]:
    """Parts of a word covered by pieces whose hash is in ``toxic``, merged where they touch, in order."""
    w = f" {word} "
    at = [(k, k + n) for k in range(len(w)) for n in GRAMS if k + n <= len(w)]
    out: list[tuple[int, int]] = []
    for (a, b), h in zip(at, _hashes([w[a:b] for a, b in at]).tolist()):
        if h in toxic and out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        elif h in toxic:
            out.append((a, b))
    return [w[a:b] for a, b in out]


def _samples(hashes: list[int]):
    """(toxic, order, sample): stretches of toxic rows and windows of ordinary ones."""
    import xxhash

    toxic = set(hashes)

    def run(batches):
        known: dict[str, list[str]] = {}
        for batch in batches:
            y, key, text = (batch.column(batch.schema.get_field_index(c)) for c in ("y", "id", "text"))
            for label, i, t in zip(y.to_pylist(), key.to_pylist(), text):
                if label > 0:
                    own = []
                    for w in _OTHER.sub(" ", t.as_py().lower()).split():
                        if w not in known:
                            known = {} if len(known) >= HELD else known
                            known[w] = stretches(w, toxic)
                        own += [p.encode("utf-8", "replace") for p in known[w]]
                else:
                    own = [w[:-len(TAIL)] for w in windows(t.as_py())]
                # one row's samples by the hash of their place: no more than the whole sample keeps
                order = [xxhash.xxh3_64_intdigest(f"{i}|{k}") >> 1 for k in range(len(own))]
                best = sorted(range(len(own)), key=order.__getitem__)[:SAMPLES]
                if best:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([label > 0] * len(best)), pa.array([order[k] for k in best], pa.int64()),
                         pa.array([own[k] for k in best], pa.binary())], ["toxic", "place", "sample"])

    return run


def _counted(batches):
    """(hash of the gram, toxic rows, ordinary rows), summed in the task until ``HELD`` grams are held."""
    held = {}

    def out(at_least):
        if len(held) > at_least:
            names = list(held)
            for at in range(0, len(names), 1 << 14):
                part = names[at:at + (1 << 14)]
                n = np.array([held[g] for g in part], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(_hashes(part)), pa.array(n & 0xFFFFFFFF), pa.array(n >> 32)],
                                                 ["gram", "toxic", "ordinary"])
            held.clear()

    for batch in batches:
        y, text = (batch.column(batch.schema.get_field_index(c)) for c in ("y", "text"))
        for label, t in zip(y, text):
            one = 1 if label.as_py() > 0 else 1 << 32  # toxic rows in the low half, ordinary ones in the high half
            for g in grams(t.as_py()):
                held[g] = held.get(g, 0) + one
            yield from out(HELD)
    yield from out(0)


def _root(sizes: dict[int, int]) -> Column:
    """Root of the likelihood ratio of a gram's counts, negative where it is commoner in ordinary text."""
    n1, n0 = float(sizes[1]), float(sizes[0])
    a, b = F.col("toxic"), F.col("ordinary")

    def log(k, n, share):
        hit = F.when(k > 0, k * F.log(share)).otherwise(0.0)
        return hit + F.when(k < n, (n - k) * F.log(1 - share)).otherwise(0.0)

    pooled = (a + b) / (n0 + n1)
    ratio = 2 * (log(a, n1, a / n1) + log(b, n0, b / n0) - log(a, n1, pooled) - log(b, n0, pooled))
    return F.sqrt(F.greatest(ratio, F.lit(0.0))) * F.when(a / n1 > b / n0, 1.0).otherwise(-1.0)


def is_training(id_col: Column) -> Column:
    """Rows whose crc32 of the id as text is not 2 modulo 4."""
    return F.crc32(id_col.cast("string")) % 4 != 2


def fit(docs: DataFrame, labels: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` rows of ``labels`` for which ``training`` (over its id) holds."""
    spark = docs.sparkSession
    ship(spark)
    store = Scratch(spark, "toxicity")
    wanted = (labels.where(training & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
              .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
              .orderBy(F.xxhash64("id"), "id").limit(sample_rows))
    texts = docs.select(F.col(id_col).alias("id"), plain(F.col(text_col)).alias("text"))
    # the bound of this broadcast is sample_rows rows of (id, label)
    sample = store.save(texts.join(F.broadcast(wanted), "id").select("id", "y", "text"), "sample")
    size = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not size.get(0) or not size.get(1):
        return Model(b"", b"", ())

    # counted by hash: rows of three numbers
    counts = store.save(sample.mapInArrow(_counted, "gram long, toxic long, ordinary long")
                        .groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
                        .withColumn("root", _root(size)).where(F.col("root") >= SIGNIFICANT), "grams")
    top = counts.orderBy(F.desc("root"), "gram").limit(MAX_GRAMS).select("gram").collect()
    parts = store.save(sample.mapInArrow(_samples([r["gram"] for r in top]), "toxic boolean, place long, sample binary"), "parts")
    made = dict(parts.groupBy("toxic").agg(F.count(F.lit(1))).collect())
    # places are even hashes: the first limit leaves half as many again as are wanted, whatever the number of tasks
    own = {kind: [bytes(r["sample"]) for r in parts.where(F.col("toxic") == kind)
                  .where(F.col("place") <= int(min(1.0, 1.5 * SAMPLES / made.get(kind, 1)) * (2**63 - 1024)))
                  .orderBy("place", "sample").limit(SAMPLES).collect()] for kind in (False, True)}
    if not own[True]:
        return Model(b"", b"", ())
    ordinary = trained(own[False], ORDINARY)
    toxic = ordinary + trained([PAD + s + PAD for s in own[True]], TOXIC)
    bare = Model(toxic, ordinary, (0.0,))
    found = scored(sample, bare, features=True).select("y", "features").collect()
    x = np.array([r["features"] for r in found], float)
    y = np.array([r["y"] for r in found], float)
    store.drop("sample", "grams", "parts")
    low, high = (tuple(map(float, v)) for v in (x.min(0), x.max(0)))
    return Model(toxic, ordinary, _logistic(x, y), low, high)


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score",
           features: bool = False) -> DataFrame:
    """``docs`` with a score from 0 to 1 of every whole text (or its ``features``)."""
    refuse(docs, "features" if features else score_col)
    ship(docs.sparkSession)
    name, kind = ("features", T.ArrayType(T.DoubleType())) if features else (score_col, T.DoubleType())
    schema = T.StructType([*docs.schema.fields, T.StructField(name, kind)])
    toxic, ordinary, weights, low, high = model.toxic, model.ordinary, model.weights, model.low, model.high

    def run(batches):
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(text_col))
            if not weights:
                out = pa.array(np.zeros(len(col)))
            else:
                x = [gains(t.as_py() or "", toxic, ordinary) for t in col]
                if features:
                    out = pa.array([list(map(float, v)) for v in x], pa.list_(pa.float64()))
                else:
                    x = np.clip(np.array(x, float).reshape(len(x), len(low)), low, high)
                    logit = _design(x) @ np.array(weights)
                    out = pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30))))
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)
