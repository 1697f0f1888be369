"""Packing: concatenate and cut, with global offsets from two-pass prefix sums.

Pass 1 tokenises each document once (a closing end id follows its ids), and writes
``part, local_start, n_tokens, ids`` to the shared scratch folder: ``local_start`` is
the running token total inside the writing partition.  Pass 2 sums the totals of the
partitions, turns them into offsets by a prefix sum over that small table (one row a
partition), and adds both: every document knows its place in the endless id stream.
Cutting the stream into fixed windows needs no shuffle of ids at all: a document
becomes the boundary records (sequence, offset, piece) of the windows it crosses.

All sequences but the last are full; the order is that of the written partitions, so
a retried task or lost executor reproduces it from the written table.

Defined cases: null text is empty (its only id is the end id); an added token of the file
that a text spells out is that one id, as in the ``tokenizers`` library's default; texts of any length are
cut over as many sequences as they need; repeated rows are packed each; an empty table
gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from histofold.llm import bpe
from histofold.llm.common import Scratch, ship

#: Partitions of the offset table summed in one window task.
BLOCK = 4096
#: Ids of one written row at most: longer documents are stored as several slices.
SLICE = 1 << 18


@lru_cache(maxsize=2)
def _encoding(vocab_path: str, pattern: str):
    """Encoder over the vocabulary of a tokenizers file: byte-level BPE whose ids are its merge ranks.

    The file is read by its fixed format (``model.vocab``); tokens are spelled in the
    printable byte alphabet of byte-level BPE.  Added tokens are left to ``added_tokens``.
    """
    import tiktoken

    with open(vocab_path, encoding="utf-8") as f:
        spec = json.load(f)
    added = {t["content"] for t in spec.get("added_tokens", [])}
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    return tiktoken.Encoding("vocab", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def added_tokens(vocab_path: str) -> tuple[re.Pattern | None, dict[str, int]]:
    """Pattern of the added tokens of a tokenizers file, longer ones first, and their ids."""
    with open(vocab_path, encoding="utf-8") as f:
        spec = json.load(f)
    found = spec.get("added_tokens", [])
    for t in found:
        if t.get("single_word") or t.get("lstrip") or t.get("rstrip"):
            raise ValueError(f"added token {t['content']!r}: single_word, lstrip and rstrip are not supported")
    ids = {t["content"]: t["id"] for t in found if t["content"]}
    names = "|".join(re.escape(c) for c in sorted(ids, key=len, reverse=True))
    return (re.compile(f"({names})") if ids else None), ids


def encode_text(enc, pattern: str, added: tuple[re.Pattern | None, dict[str, int]], text: str) -> array:
    """Ids of one whole text: added tokens by their own ids, the text between them by ``bpe``."""
    split, special = added
    if not any(c in text for c in special):
        return bpe.encode_text(enc, pattern, text)
    ids = array("I")
    for k, part in enumerate(split.split(text)):
        if k % 2:
            ids.append(special[part])
        elif part:
            ids.extend(bpe.encode_text(enc, pattern, part))
    return ids


def tokenise(docs: DataFrame, vocab_path: str, pattern: str, end_id: int, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """Rows (id, part, local_start, slice_start, n_ids, doc_tokens, ids) with running totals per partition."""
    ship(docs.sparkSession)
    source = docs.select(F.spark_partition_id().cast("long").alias("part"), F.col(id_col).alias("id"),
                         F.col(text_col).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()

    def run(batches):
        enc, added = _encoding(vocab_path, pattern), added_tokens(vocab_path)
        total = 0
        for batch in batches:
            parts, ids_in, texts = batch.columns
            for at in range(0, batch.num_rows, 256):
                rows = {"pick": [], "start": [], "slice": [], "n": [], "doc": [], "ids": []}
                for k in range(at, min(at + 256, batch.num_rows)):
                    ids = encode_text(enc, pattern, added, texts[k].as_py() or "")
                    ids.append(end_id)
                    for cut in range(0, len(ids), SLICE):
                        piece = ids[cut:cut + SLICE]
                        for name, v in (("pick", k), ("start", total), ("slice", cut), ("n", len(piece)),
                                        ("doc", len(ids)), ("ids", piece.tobytes())):
                            rows[name].append(v)
                        total += len(piece)
                pick = pa.array(rows["pick"], pa.int64())
                longs = [pa.array(rows[n], pa.int64()) for n in ("start", "slice", "n", "doc")]
                yield pa.RecordBatch.from_arrays([parts.take(pick), ids_in.take(pick), *longs, pa.array(rows["ids"], pa.binary())],
                                                 ["part", "id", "local_start", "slice_start", "n_ids", "doc_tokens", "ids"])

    return source.mapInArrow(run, f"part long, id {id_type}, local_start long, slice_start long, n_ids long, "
                                  "doc_tokens long, ids binary")


def part_offsets(tokens: DataFrame) -> DataFrame:
    """(part, offset): tokens before each partition, by a two-level prefix sum."""
    totals = tokens.groupBy("part").agg(F.max(F.col("local_start") + F.col("n_ids")).alias("n"))
    totals = totals.withColumn("block", F.floor(F.col("part") / BLOCK))
    within = Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = totals.groupBy("block").agg(F.sum("n").alias("m"))
    # one row per 4,096 partitions: the only rows that meet in one task
    before = Window.partitionBy(F.lit(0)).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    return (totals.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0))).join(blocks, "block")
            .select("part", (F.col("base") + F.col("inner")).alias("offset")))


def pack(docs: DataFrame, vocab_path: str, pattern: str, end_id: int = 1, length: int = 2048,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Boundary records: (id, start, length, ids, doc_tokens, sequence_id, offset) per piece.

    ``ids`` are the piece's ids, little-endian unsigned 32-bit.
    """
    store = Scratch(docs.sparkSession, "packing")
    tokens = store.save(tokenise(docs, vocab_path, pattern, end_id, id_col, text_col), "tokens")
    # written, so that its size is known: Spark broadcasts it below its limit, joins by key above
    offsets = store.save(part_offsets(tokens), "offsets", files=1)
    placed = tokens.join(offsets, "part").withColumn("at", F.col("offset") + F.col("local_start"))
    first = F.expr(f"at div {length}")
    last = F.expr(f"(at + n_ids - 1) div {length}")

    def piece(w):
        lo = F.greatest(F.col("at"), w * length)
        hi = F.least(F.col("at") + F.col("n_ids"), (w + 1) * length)
        return F.struct(w.alias("sequence_id"), (lo - w * length).alias("offset"), (hi - lo).alias("length"),
                        (F.col("slice_start") + lo - F.col("at")).alias("start"),
                        F.substring(F.col("ids"), ((lo - F.col("at")) * 4 + 1).cast("int"),
                                    ((hi - lo) * 4).cast("int")).alias("ids"))

    cut = placed.select("id", "doc_tokens", F.explode(F.transform(F.sequence(first, last), piece)).alias("p"))
    return cut.select(F.col("id").alias(id_col), "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset")


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, input_ids): the ids of each window, gathered from its boundary records.

    A window holds at most its fixed length of ids, so no group is unbounded.
    """
    ordered = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return pieces.groupBy("sequence_id").agg(F.unhex(F.array_join(F.transform(ordered, lambda p: p["ids"]), "")).alias("input_ids"))


def ids_of(raw: bytes) -> list[int]:
    """Ids of a stored binary column value."""
    return list(array("I", raw))
