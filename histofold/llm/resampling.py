"""Importance resampling towards a target distribution, with the segments of the corpus counted once.

Texts are lower-cased (A-Z only) and cut into words; features are the runs of 1 to ``max_run`` consecutive
words, hashed into ``buckets``.  A bucket's *gain* is the log ratio of its smoothed shares in the target and
in the corpus, in thousandths; a document's weight is the sum of the gains of its features; weight plus
Gumbel noise keyed by the id is its score, and the highest scores are drawn, which is sampling without
replacement in proportion to the importance weights.

Line breaks separate segments: no word holds one.  A text is cut into its lines, each kept as its words and
how often the text holds it.  The distinct lines of the whole corpus are gathered by one aggregation (partial
sums in the tasks, so a line that stands everywhere moves once a task); features are hashed and counted **once
for each distinct line**.  Corpus counts are those counts times the line's occurrences, and the weight of a
line is computed once and joined back to the texts.  Features that run over a line break belong to no line;
they are counted with their text and added separately (none where ``max_run`` is 1).

Scale: the bucket totals (``buckets`` rows) reach the driver.  A line that has at least one in ``HOT_LINES``
of all occurrences is joined by a broadcast of at most ``HOT_LINES`` rows, the others by a shuffle on 128 bits
of the line's hash.  Ranks come from one global sort: places within its partitions plus prefix sums over
the partitions' sizes.

Defined cases: null or empty texts have no features, weight 0 and are never drawn; every row is a document,
repeated rows and null ids too (a null id stands for the empty text in the noise and comes last among ties);
equal score and id: any order; an empty target leaves the smoothed shares, an empty corpus gives an empty
result; of the caller's columns only the id and the text are read, so no name can clash but that of the id
column, which is refused where it is a name of the results.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histofold.llm.common import Scratch, ship

#: One in so many occurrences makes a line hot; there are at most so many such lines.
HOT_LINES = 512
#: Words whose buckets a task remembers.
HELD_WORDS = 500_000
#: Bytes of lines in a batch handed on.
BATCH_BYTES = 8 << 20

# A-Z to a-z; the ASCII characters that are no letter or digit to a blank.
_PLAIN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
               for b in range(256))


@dataclass(frozen=True)
class Features:
    """Runs of 1 to ``max_run`` words, by the crc32 of their UTF-8 bytes modulo ``buckets``."""

    max_run: int = 1
    buckets: int = 10_000

    def number(self, words: int) -> int:
        return sum(max(0, words - k) for k in range(self.max_run))

    def counted(self, words: list[bytes], memory: dict[bytes, int]) -> Counter:
        """Bucket counts of all runs inside ``words``."""
        if len(memory) > HELD_WORDS:
            memory.clear()
        out: Counter = Counter()
        for w, n in Counter(words).items():
            at = memory.get(w)
            if at is None:
                at = memory[w] = zlib.crc32(w) % self.buckets
            out[at] += n
        for k in range(2, self.max_run + 1):
            out.update(zlib.crc32(b" ".join(words[i:i + k])) % self.buckets for i in range(len(words) - k + 1))
        return out

    def crossing(self, lines: list[list[bytes]]) -> Counter:
        """Bucket counts of the runs that hold words of two or more lines."""
        out: Counter = Counter()
        if self.max_run < 2:
            return out
        words = [w for line in lines for w in line]
        first, at = [0] * len(words), 0
        for line in lines:
            first[at:at + len(line)] = [at + len(line)] * len(line)  # where the next line begins
            at += len(line)
        for k in range(2, self.max_run + 1):
            out.update(zlib.crc32(b" ".join(words[i:i + k])) % self.buckets
                       for i in range(len(words) - k + 1) if i + k > first[i])
        return out


def lines_of(raw: bytes) -> list[list[bytes]]:
    """The words of every line of a text that has any."""
    lines = (line.translate(_PLAIN).split() for line in raw.split(b"\n"))
    return [line for line in lines if line]


def _key(line: bytes) -> bytes:
    return hashlib.md5(line, usedforsecurity=False).digest()


_CUT = [("row", T.LongType()), ("words", T.LongType()), ("line", T.BinaryType()), ("key", T.BinaryType()), ("times", T.LongType()),
        ("buckets", T.ArrayType(T.IntegerType())), ("counts", T.ArrayType(T.IntegerType()))]
_CUT_ARROW = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]


def _cut(features: Features):
    """One head row for each text (id, words, crossing features), one row for each of its distinct lines."""
    def out(ids, at, cut):
        made = [pa.array(v, t) for v, t in zip(zip(*cut), _CUT_ARROW)]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *made], ["id", *(c for c, _ in _CUT)])

    def run(batches):
        for batch in batches:
            row, ids, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("row", "id", "text"))
            at, cut, held = [], [], 0
            for k, (r, text) in enumerate(zip(row.to_pylist(), texts.cast(pa.binary()))):
                lines = lines_of(text.as_py() or b"")
                cross = features.crossing(lines)
                joined = Counter(b" ".join(line) for line in lines)
                cut.append((r, sum(map(len, lines)), None, None, None, list(cross), list(cross.values())))
                cut.extend((r, None, line, _key(line), n, None, None) for line, n in joined.items())
                at += [k, *[None] * len(joined)]
                held += sum(map(len, joined))
                if held > BATCH_BYTES:
                    yield out(ids, at, cut)
                    at, cut, held = [], [], 0
            if at:
                yield out(ids, at, cut)

    return run


def _hashed(features: Features):
    """Bucket counts of distinct lines, each once."""
    def run(batches):
        memory: dict[bytes, int] = {}
        for batch in batches:
            lines = batch.column(batch.schema.get_field_index("line")).to_pylist()
            found = [features.counted(line.split(), memory) for line in lines]
            yield pa.RecordBatch.from_arrays(
                [pa.array(map(_key, lines), pa.binary()), batch.column(batch.schema.get_field_index("times")),
                 pa.array([list(c) for c in found], pa.list_(pa.int32())),
                 pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))], ["key", "times", "buckets", "counts"])

    return run


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the batch, bucket, count) of every entry of the lists."""
    buckets, counts = (batch.column(batch.schema.get_field_index(c)) for c in ("buckets", "counts"))
    sizes = np.asarray(buckets.value_lengths().fill_null(0))
    return np.repeat(np.arange(len(batch)), sizes), np.asarray(buckets.flatten()), np.asarray(counts.flatten())


def _totals(buckets: int):
    """Occurrences by bucket, summed in the task."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            row, bucket, count = _lists(batch)
            times = np.asarray(batch.column(batch.schema.get_field_index("times")))
            np.add.at(total, bucket, times[row] * count)
        hit = np.flatnonzero(total)
        if len(hit):
            yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["bucket", "hits"])

    return run


def _weighed(gains: np.ndarray, *names: str):
    """Sum of the gains of a row's features, next to the columns ``names``."""
    def run(batches):
        for batch in batches:
            row, bucket, count = _lists(batch)
            total = np.zeros(len(batch), np.int64)
            np.add.at(total, row, gains[bucket] * count)
            kept = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(total)], [*names, "weight"])

    return run


def _segments(docs: DataFrame, features: Features, store: Scratch, name: str) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(cut texts, distinct lines with their counts, occurrences by bucket) of ``docs(id, text)``."""
    schema = T.StructType([docs.schema["id"], *(T.StructField(c, t) for c, t in _CUT)])
    numbered = docs.withColumn("row", F.monotonically_increasing_id())  # drawn once: the cut texts are written
    cut = store.save(numbered.mapInArrow(_cut(features), schema), f"{name}-cut")
    distinct = cut.where("line IS NOT NULL").groupBy("line").agg(F.sum("times").alias("times"))
    lines = store.save(distinct.mapInArrow(_hashed(features), "key binary, times long, buckets array<int>, counts array<int>"),
                       f"{name}-lines")
    parts = lines.select("times", "buckets", "counts")
    if features.max_run > 1:
        parts = parts.unionByName(cut.where("line IS NULL").select(F.lit(1).cast("long").alias("times"), "buckets", "counts"))
    hits = np.zeros(features.buckets, np.int64)
    for r in (parts.mapInArrow(_totals(features.buckets), "bucket long, hits long")
              .groupBy("bucket").agg(F.sum("hits").alias("hits")).collect()):  # at most ``buckets`` rows
        hits[r["bucket"]] = r["hits"]
    return cut, lines, hits


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of every bucket from its occurrences in the corpus and in the target, in thousandths."""
    of_corpus, of_target = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1) * of_corpus / ((s + 1) * of_target)))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(seed: int, id_col: Column) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a hash of the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _weights(cut: DataFrame, lines: DataFrame, gains: np.ndarray, store: Scratch) -> DataFrame:
    """(row, id, words, weight) of every text: its lines' weights times their occurrences in it, and its crossing features."""
    weighed = store.save(lines.mapInArrow(_weighed(gains, "key", "times"), "key binary, times long, weight long"), "weights")
    total = weighed.agg(F.sum("times")).first()[0] or 0
    frequent = F.col("times") * HOT_LINES >= total  # at most HOT_LINES lines reach that share
    own = cut.where("line IS NOT NULL").select("row", "key", F.col("times").alias("n"))
    hot = weighed.where(frequent).select("key", F.col("weight").alias("hot"))
    split = own.join(F.broadcast(hot), "key", "left")
    rest = split.where("hot IS NULL").join(weighed.where(~frequent).select("key", "weight"), "key")
    no_id = F.lit(None).cast(cut.schema["id"].dataType).alias("id")
    no_words = F.lit(None).cast("long").alias("words")
    of_lines = [part.select("row", no_id, no_words, (F.col("n") * F.col(w)).alias("weight"))
                for part, w in ((split.where("hot IS NOT NULL"), "hot"), (rest, "weight"))]
    heads = (cut.where("line IS NULL").select("row", "id", "words", "buckets", "counts")
             .mapInArrow(_weighed(gains, "row", "id", "words"), T.StructType([cut.schema[c] for c in ("row", "id", "words")]
                                                                             + [T.StructField("weight", T.LongType())])))
    return (heads.unionByName(of_lines[0]).unionByName(of_lines[1]).groupBy("row")
            .agg(F.max("id").alias("id"), F.max("words").alias("words"), F.sum("weight").alias("weight")))


def ranked(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, max_run: int = 1,
           buckets: int = 10_000, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text",
           target_text_col: str = "text") -> DataFrame:
    """Every row's id, ``n_features``, ``weight``, ``score`` and ``rank`` (1 for the highest score; null where not
    drawn): ``percent`` of the rows with ``min_words`` words or more are drawn towards ``target``'s texts."""
    if id_col.lower() in ("n_features", "weight", "score", "rank"):
        raise ValueError(f"the id column has the name of a result: {id_col}")
    spark = docs.sparkSession
    ship(spark)
    store, features = Scratch(spark, "resampling"), Features(max_run, buckets)
    goal = target.select(F.lit(None).cast("long").alias("id"), F.col(target_text_col).alias("text"))
    _, _, wanted = _segments(goal, features, store, "target")
    cut, lines, held = _segments(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), features, store, "corpus")
    weighed = _weights(cut, lines, gains_of(held, wanted), store)

    # one global sort, drawable rows first; a row's place is its place in its partition after those before it
    drawable = F.col("words") >= min_words
    scored = weighed.select(
        "row", "id", drawable.alias("drawable"), sum((F.greatest(F.col("words") - k, F.lit(0)) for k in range(max_run)), F.lit(0))
        .cast("long").alias("n_features"), "weight", (F.col("weight") + noise(seed, F.col("id"))).alias("score"))
    scored = store.save(scored, "scored")
    n = scored.where("drawable").count()
    order = scored.orderBy(F.desc("drawable"), F.desc("score"), F.asc_nulls_last("id"), "row")
    placed = store.save(order.withColumn("place", F.monotonically_increasing_id()), "placed")
    part, inside = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("size"))  # a row a partition
    before = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.col("before") + inside + 1
    return placed.join(F.broadcast(starts), part == F.col("part")).select(
        F.col("id").alias(id_col), "n_features", "weight", "score",
        F.when(F.col("drawable") & (rank <= percent * n // 100), rank).alias("rank"))


def drawn(docs: DataFrame, ranks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id was drawn in ``ranks``."""
    return docs.join(ranks.where("rank IS NOT NULL").select(id_col), id_col, "left_semi")
