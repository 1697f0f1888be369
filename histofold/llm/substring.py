"""Substring dedup: sliding sentence spans, joined globally; sentences that a later repeat covers are removed.

A text is cut into units: sentences (ending in ``.``, ``!``, ``?`` or a line break), and
inside them by winnowing: of every ``WINDOW`` words without a stop, those with the smallest
hash close a unit (all of them, if several are equal).  So a unit has at most ``WINDOW``
words, and a passage has the same cuts wherever it stands, but for ``WINDOW`` - 1 words at
either end: any ``LEAST_WORDS`` + 4 * ``WINDOW`` - 3 = 49 shared words hold a whole run.
From every unit on, the run of at least ``UNITS`` units and ``LEAST_WORDS`` words is hashed
(128 bits over the lower-cased words), and, where a line break lies in it, also the run
that takes no notice of line breaks, so that a passage broken into other lines is seen.  Runs are counted over the whole corpus; the first
occurrence of each, by (document id, place), stays.  The units are for finding: from the others, whole sentences
go, those that repeats cover from the first word to the last.  A sentence of more than ``LONG_SENTENCE`` words (text
without stops) is the one that is cut inside, at its units.

Scale: counting sends (hash, count, smallest id) merged map-side, so a passage held by a
third of all rows is one row per map task; the occurrences of repeated runs are found by a
join whose right side has one row a hash, which Spark splits where it is skewed.

Defined cases: null text counts as empty and comes back as null; texts of fewer words have
no run; ids of whole numbers are ordered as such, any others as text; null ids come after all others; rows that repeat both
id and text count as one document (both are cut alike); very long texts are runs of the same size; an empty table
gives an empty result; other columns are ignored by ``repeats`` and carried by ``cut``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histofold.llm.common import OWN, Scratch, plain, refuse, ship

UNITS, LEAST_WORDS = 3, 20
#: Words of a sentence up to which it goes as a whole or stays; no 49 repeated words fit into two that stay.
LONG_SENTENCE = 24
#: Words of which one at least closes a unit.
WINDOW = 8
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: What stands for a null id: whole numbers, text.
_LAST, _LAST_TEXT = 9223372036854775807, chr(0x10FFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _winnowed(stop: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Words that close a unit: stops, and the smallest hashes of every window (a stop is smaller than any hash)."""
    n = len(h) - WINDOW + 1
    if n < 1:
        return stop
    rank = np.where(stop, np.uint64(0), (h >> np.uint64(1)) + np.uint64(1))
    least = rank[:n].copy()
    for k in range(1, WINDOW):
        np.minimum(least, rank[k:k + n], out=least)
    # a word is the smallest of some window if it equals the largest minimum of the windows around it
    around = np.zeros(len(h), np.uint64)
    for k in range(WINDOW):
        np.maximum(around[k:k + n], least, out=around[k:k + n])
    return stop | (rank == around)


def _cuts(raw: bytes):
    """(byte starts of the units, their first words, those that line breaks alone do not make, word hashes, whether a
    unit begins a sentence) of a text."""
    import xxhash

    a = np.frombuffer(raw, np.uint8)
    space = _SPACE[a]
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return starts, starts, starts, np.empty(0, np.uint64), starts
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, raw.lower().split()), np.uint64, len(starts))
    lines = np.concatenate(([0], np.cumsum(a == 10)))
    stop = _STOP[a[ends - 1]]
    closes = _winnowed(stop, h)
    firm = np.concatenate(([0], np.flatnonzero(closes[:-1]) + 1))
    broken = lines[starts[1:]] > lines[ends[:-1]]
    closes[:-1] |= broken
    first = np.concatenate(([0], np.flatnonzero(closes[:-1]) + 1))
    return starts[first], first, firm, h, np.concatenate(([True], stop[:-1] | broken))[first]


def units(raw: bytes):
    """(byte starts of the units, their first words, word hashes) of a text."""
    starts, first, _, h, _ = _cuts(raw)
    return starts, first, h


def runs(first: np.ndarray, h: np.ndarray):
    """(unit, unit after the last, hash high, hash low) of the run from each unit that has one."""
    ends = np.concatenate((first[1:], [len(h)]))
    unit = np.arange(len(first))
    stop = np.maximum(unit + UNITS, np.searchsorted(ends, first + LEAST_WORDS) + 1)
    unit = unit[stop <= len(first)]
    stop = stop[:len(unit)] if len(unit) == len(stop) else stop[unit]
    out = []
    step = np.arange(len(h), dtype=np.uint64)
    power = np.concatenate(([np.uint64(1)], np.cumprod(np.full(len(h), _BASE))))[:len(h)] if len(h) else step
    back = np.concatenate(([np.uint64(1)], np.cumprod(np.full(len(h), _BACK)))) if len(h) else step
    for words in (h, _mix(h + np.uint64(1))):
        total = np.concatenate(([np.uint64(0)], np.cumsum(words * power, dtype=np.uint64)))
        lo, hi = first[unit], ends[stop - 1]
        out.append(_mix(((total[hi] - total[lo]) * back[lo]) ^ (hi - lo).astype(np.uint64)))
    return unit, stop, out[0], out[1]


def _placed(first: np.ndarray, firm: np.ndarray, h: np.ndarray):
    """(place, unit, unit after the last, hash high, hash low) of all runs, with and without line breaks; places are
    unique in a text and in its order."""
    unit, stop, x, y = runs(first, h)
    if len(firm) == len(first):
        return 2 * unit, unit, stop, x, y
    at = np.searchsorted(first, np.concatenate((firm, [len(h)])))
    unit2, stop2, x2, y2 = runs(firm, h)
    unit2, stop2 = at[unit2], at[stop2]
    ends = np.full(len(first) + 1, -1)
    ends[unit] = stop
    new = ends[unit2] != stop2
    both = [np.concatenate(p) for p in ((2 * unit, 2 * unit2[new] + 1), (unit, unit2[new]), (stop, stop2[new]), (x, x2[new]), (y, y2[new]))]
    return tuple(both)


def _whole(covered: np.ndarray, heads: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Units to remove: those of sentences (from one head to the next) covered as a whole, and covered ones of long sentences."""
    begin = np.flatnonzero(heads)
    units_of = np.diff(np.concatenate((begin, [len(heads)])))
    whole = np.repeat(np.logical_and.reduceat(covered, begin), units_of)
    long = np.repeat(np.add.reduceat(words, begin) > LONG_SENTENCE, units_of)
    return whole | (long & covered)


def _ident(docs: DataFrame, id_col: str) -> Column:
    """The id to order by, never null."""
    if isinstance(docs.schema[id_col].dataType, T.IntegralType):
        return F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))
    return F.coalesce(F.col(id_col).cast("string"), F.lit(_LAST_TEXT))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = plain(F.col(text_col))
    return docs.select(_ident(docs, id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h1, h2, id, key, unit) of every run (``unit``: its place); null ids as the largest long."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ident, key, text = batch.slice(at, 256).columns
                rows, parts = [], []
                for k, t in enumerate(text):
                    _, first, firm, h, _ = _cuts(t.as_py().encode("utf-8", "replace"))
                    if len(first):
                        unit, _, _, x, y = _placed(first, firm, h)
                        parts.append((x.view(np.int64), y.view(np.int64), unit))
                        rows.append((k, len(unit)))
                if not rows:
                    continue
                pick = np.repeat([k for k, _ in rows], [n for _, n in rows])
                x, y, unit = (np.concatenate(p) for p in zip(*parts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x), pa.array(y), ident.take(pa.array(pick)), key.take(pa.array(pick)), pa.array(unit.astype(np.int64))],
                    ["h1", "h2", "id", "key", "unit"])

    keyed = _keyed(docs, id_col, text_col)
    return keyed.mapInArrow(run, f"h1 long, h2 long, id {keyed.schema['id'].dataType.simpleString()}, key long, unit long")


def repeats(docs: DataFrame, store: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, units, firsts): runs to remove by document, and the ids that keep them."""
    found = spans(docs, id_col, text_col)
    counts = found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("times"), F.min("id").alias("first"))
    # written, so that both sides of the join are plain exchanges, which Spark splits where a run is hot
    again = store.save(counts.where("times > 1").select("h1", "h2", "first"), "again")
    seen = store.save(found.join(again, ["h1", "h2"]), "seen")
    origin = (seen.where("id = first").groupBy("h1", "h2")
              .agg(F.min(F.struct("key", "unit")).alias("origin")))
    origin = store.save(origin, "origin")
    later = seen.join(origin, ["h1", "h2"]).where(
        ~((F.col("id") == F.col("first")) & (F.struct("key", "unit") == F.col("origin"))))
    return store.save(later.groupBy("id", "key").agg(F.collect_set("unit").alias("units"), F.collect_set("first").alias("firsts")),
                      "repeats")


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated sentences removed from the text, and n_units, n_removed (units of the text, those removed),
    first_ids (documents that hold the first occurrence of runs repeated here; a null stands for a null id).

    ``first_ids`` is null for a text from which nothing goes.  Columns of these names in ``docs`` are refused.
    """
    refuse(docs, "first_ids", "n_units", "n_removed")
    spark = docs.sparkSession
    ship(spark)
    store = Scratch(spark, "substring")
    later = repeats(docs, store, id_col, text_col).select(
        F.col("id").alias(f"{OWN}id"), F.col("key").alias(f"{OWN}key"), F.col("units").alias(f"{OWN}units"),
        F.col("firsts").alias(f"{OWN}firsts"))
    text = F.col(text_col)
    kind = later.schema[f"{OWN}id"].dataType
    joined = docs.withColumns({f"{OWN}i": _ident(docs, id_col),
                               f"{OWN}k": F.xxhash64(plain(text))}).join(
        later, (F.col(f"{OWN}i") == F.col(f"{OWN}id")) & (F.col(f"{OWN}k") == F.col(f"{OWN}key")), "left")
    last = F.lit(_LAST if isinstance(kind, T.LongType) else _LAST_TEXT)
    joined = joined.select(*docs.columns, f"{OWN}units", F.transform(
        f"{OWN}firsts", lambda x: F.nullif(x, last)).alias("first_ids"))
    schema = T.StructType([*docs.schema.fields, T.StructField("first_ids", T.ArrayType(kind)),
                           T.StructField("n_units", T.LongType()), T.StructField("n_removed", T.LongType())])

    def run(batches):
        for batch in batches:
            place = batch.schema.get_field_index(text_col)
            wide = batch.column(batch.schema.get_field_index(f"{OWN}units"))
            texts, total, gone = [], [], []
            for t, marked in zip(batch.column(place), wide):
                raw = (t.as_py() or "").encode("utf-8", "replace")
                starts, first, firm, h, heads = _cuts(raw)
                total.append(len(starts))
                if not marked.is_valid:
                    texts.append(t.as_py())
                    gone.append(0)
                    continue
                place_of, unit, stop, _, _ = _placed(first, firm, h)
                edge = np.zeros(len(starts) + 1, np.int64)
                here = np.isin(place_of, marked.values.to_numpy())
                np.add.at(edge, unit[here], 1)
                np.add.at(edge, stop[here], -1)
                drop = _whole(np.cumsum(edge[:-1]) > 0, heads, np.diff(np.concatenate((first, [len(h)]))))
                ends = np.concatenate((starts[1:], [len(raw)]))
                texts.append((raw[:starts[0]] + b"".join(raw[a:b] for a, b, d in zip(starts, ends, drop) if not d)).decode())
                gone.append(int(drop.sum()))
            columns = {n: c for n, c in zip(batch.schema.names, batch.columns) if n != f"{OWN}units"}
            columns[text_col] = pa.array(texts, pa.string())
            kept = pa.array([not n for n in gone], pa.bool_())
            columns["first_ids"] = pc.if_else(kept, pa.scalar(None, columns["first_ids"].type), columns["first_ids"])
            columns |= {"n_units": pa.array(total, pa.int64()), "n_removed": pa.array(gone, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return joined.mapInArrow(run, schema)
