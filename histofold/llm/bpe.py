"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

``encode`` adds the ids of each whole text, ``decode`` turns ids back to raw bytes.
Long texts are cut at *safe boundaries* before encoding: between a letter or digit
and a following space every match of the pattern ends, and none looks back, so the
matches of the parts are the matches of the whole text.  A part that has no such
boundary (a run of one character class) is matched by the ``regex`` module, whose
matcher needs no stack for long runs, and each match is merged on its own.

Defined cases: null text is the empty text (no ids, empty bytes); texts of any length
are encoded whole; repeated rows give repeated results; an empty table gives an empty
result; other columns are carried along unchanged.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from histofold.llm.common import refuse, ship

#: Characters up to which a text is encoded in one call.
PART = 1 << 16
_BOUNDARY = re.compile(r"[^\W_](?= )")


@lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str):
    """tiktoken encoding of a rank file (one load per worker)."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _matcher(pattern: str):
    import regex

    return regex.compile(pattern)


def parts(text: str, size: int = PART) -> Iterator[str]:
    """Cut a text after ``size`` characters or more, only at safe boundaries."""
    start = 0
    while len(text) - start > size:
        m = _BOUNDARY.search(text, start + size)
        if m is None:
            break
        yield text[start:m.end()]
        start = m.end()
    yield text[start:] if start else text


def encode_text(enc, pattern: str, text: str, size: int = PART) -> array:
    """Ids of one whole text."""
    if len(text) <= size:
        return array("I", enc._core_bpe.encode_ordinary(text))
    ids = array("I")
    for part in parts(text, size):
        if len(part) <= 2 * size:
            ids.extend(enc._core_bpe.encode_ordinary(part))
        else:
            for m in _matcher(pattern).finditer(part):
                piece = m.group().encode("utf-8", "replace")
                known = enc._mergeable_ranks.get(piece)
                ids.extend([known] if known is not None else enc._core_bpe.encode_single_piece(piece))
    return ids


def _with(batch: pa.RecordBatch, extra: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *extra.values()], [*batch.schema.names, *extra])


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids",
           count_col: str = "n_tokens") -> DataFrame:
    """``docs`` without ``text_col``, with ids (little-endian unsigned 32-bit) and their number; other columns of these names are refused."""
    refuse(docs.drop(text_col), ids_col, count_col)
    ship(docs.sparkSession)
    schema = T.StructType([f for f in docs.schema.fields if f.name != text_col]
                          + [T.StructField(ids_col, T.BinaryType()), T.StructField(count_col, T.LongType())])

    def run(batches):
        enc = encoding(ranks_path, pattern)
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(text_col))
            rest = batch.drop_columns([text_col])
            for at in range(0, batch.num_rows, 256):  # bounds the ids held at once
                ids = [encode_text(enc, pattern, t.as_py() or "") for t in col.slice(at, 256)]
                yield _with(rest.slice(at, 256), {ids_col: pa.array([i.tobytes() for i in ids], pa.binary()),
                                                  count_col: pa.array([len(i) for i in ids], pa.int64())})

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids",
           bytes_col: str = "decoded") -> DataFrame:
    """``encoded`` with the raw bytes of its ids (not forced to be valid UTF-8); another column of the result's name is refused."""
    refuse(encoded, bytes_col)
    ship(encoded.sparkSession)
    schema = T.StructType([*encoded.schema.fields, T.StructField(bytes_col, T.BinaryType())])

    def run(batches):
        enc = encoding(ranks_path, pattern)
        table = {i: b for b, i in enc._mergeable_ranks.items()}
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(ids_col))
            for at in range(0, batch.num_rows, 256):
                out = [b"".join(map(table.__getitem__, array("I", v.as_py() or b""))) for v in col.slice(at, 256)]
                yield _with(batch.slice(at, 256), {bytes_col: pa.array(out, pa.binary())})

    return encoded.mapInArrow(run, schema)
