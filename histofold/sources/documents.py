"""The analysed tool's own result documents, written and read without holding a repository.

A document is one JSON file ``<owner>/<repo>.json`` of ``{metadata, repositories[commits[]]}``.  ``write_documents``
sorts the commits inside blocks of each repository, packs them and streams head, pieces and tail into the
repository's file; ``read_documents`` splits a document into one row per commit while it reads.  Both are Spark Python data
sources: Spark partitions, sorts and retries, a task holds a small batch of commits, whatever the size of a document.  Files are reached through ``pyarrow.fs``, so a path is a plain one on
a shared folder or a URI that Arrow knows (``file``, ``hdfs``, ``s3``, ``gs``); this package has to be importable on the
executors.
"""

from __future__ import annotations

import gzip
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from histofold.schemas import CHANGE, DOCUMENT_COMMIT, RESULT_DOCUMENT
from histofold.sources.results import PACKED_SUFFIX, RESULT_SUFFIX, safe_name

if TYPE_CHECKING:
    import pyarrow as pa

#: One row per commit of a document; a document that cannot be read is one row with its error.
DOCUMENT_ROW = T.StructType([
    T.StructField("file_path", T.StringType()), T.StructField("repository_id", T.LongType()), T.StructField("project_name", T.StringType()),
    T.StructField("pos", T.IntegerType()), *DOCUMENT_COMMIT.fields, T.StructField("error", T.StringType())])

#: Characters read at once; commits of a batch, characters of a batch at most (a larger commit is a batch).
CHUNK, BATCH_COMMITS, BATCH_CHARS = 1 << 20, 1_000, 4 << 20

#: Places of a block, which one task sorts; bytes of a piece at most (a larger commit is a piece).
BLOCK_COMMITS, PIECE_BYTES = 1_024, 1 << 20


def _filesystem(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


# ------------------------------------------------------------------- writing
def document_rows(facts: DataFrame, classified: DataFrame, files: DataFrame, metadata: DataFrame) -> DataFrame:
    """``(document, ord, body)``: the head of every repository's document (``ord`` -1) and one row per commit.

    ``facts``, ``classified`` and ``files`` as loaded from results (``jobs.load_results``, ``jobs.load_files``);
    ``metadata`` is the one-row record of the run (S11).  Lists are gathered per commit, never per repository.
    Ids may be of any type that the three share: tables bucketed on them are joined where they lie.
    """
    key = ["repo_id", "commit_id"]
    entry = F.struct("pos", *CHANGE.names)
    lists = classified.groupBy(*key).agg(*[F.array_sort(F.collect_list(F.when(c, entry))).alias(n) for n, c in (
        ("pac_changes", F.col("is_pac")), ("other_changes", ~F.col("is_pac")))])
    touched = (files.select(F.col("repository_id").alias("repo_id"), "commit_id", "pos", "file").groupBy(*key)
               .agg(F.array_sort(F.collect_list(F.struct("pos", "file"))).alias("files")))
    commits = facts.join(lists, key, "left").join(touched, key, "left")
    changes = [F.coalesce(F.transform(n, lambda c: F.struct(*[c[f].alias(f) for f in CHANGE.names])),
                          F.array().cast(T.ArrayType(CHANGE))).alias(n) for n in ("pac_changes", "other_changes")]
    names = F.coalesce(F.transform("files", lambda f: f["file"]), F.array().cast("array<string>")).alias("files")
    made = {"commit_id": F.col("commit_id").cast("string").alias("commit_id"), "files": names, "pac_changes": changes[0], "other_changes": changes[1]}
    body = F.to_json(F.struct(*[made.get(c, F.col(c)) for c in DOCUMENT_COMMIT.names]), {"ignoreNullFields": "false"})
    owner, repo = F.split("project_name", "/").getItem(0), F.split("project_name", "/").getItem(1)
    document = F.concat(safe_name(owner), F.lit("/"), safe_name(repo), F.lit(RESULT_SUFFIX)).alias("document")
    ordered = commits.select(document, F.col("pos").cast("long").alias("ord"), body.alias("body"))

    totals = facts.groupBy("repo_id", "project_name").agg(
        F.count(F.lit(1)).alias("total_commits"), F.sum("pac_files_count").cast("long").alias("pac_changes_count"),
        F.count(F.when(F.col("has_pac_changes"), 1)).alias("pac_commits_count"))
    about = F.to_json(F.struct(
        F.col("repo_id").alias("repository_id"), "project_name", repo.alias("repository_name"), owner.alias("owner_name"),
        "total_commits", "pac_changes_count", "pac_commits_count",
        (F.col("pac_changes_count") / F.col("total_commits")).alias("pac_change_ratio")), {"ignoreNullFields": "false"})
    run = metadata.select(F.to_json(F.struct(*RESULT_DOCUMENT["metadata"].dataType.names), {"ignoreNullFields": "false"})).scalar()
    head = F.concat(F.lit('{"metadata": '), run, F.lit(',\n"repositories": [\n'), F.expr("substring(about, 1, length(about) - 1)"), F.lit(', "commits": [\n'))
    heads = totals.select(document, about.alias("about")).select("document", F.lit(-1).cast("long").alias("ord"), head.alias("body"))
    return ordered.unionByName(heads)


def pack_rows(rows: DataFrame) -> DataFrame:
    """``document_rows`` as ``(document, ord, piece)``: gzipped runs of neighbouring commits, ``ord`` of the first one.

    Only here the text itself is moved and sorted, in blocks of ``BLOCK_COMMITS`` places, so a document of any size
    is spread over the tasks.
    """
    size = PIECE_BYTES

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        def piece():
            body = gzip.compress(b",\n".join(held), 6, mtime=0)
            return pa.RecordBatch.from_pydict({"document": [block[0]], "ord": pa.array([first], pa.int64()), "piece": pa.array([body], pa.binary())})

        block, first, held, length = None, 0, [], 0
        for batch in batches:
            for document, number, ord_, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (block != (document, number) or length + len(body) > size):
                    yield piece()
                    held, length = [], 0
                if not held:
                    block, first = (document, number), ord_
                held.append(body)
                length += len(body)
        if held:
            yield piece()

    block = F.floor(F.col("ord") / BLOCK_COMMITS).alias("block")
    return (rows.select("document", block, "ord", F.col("body").cast("binary").alias("body")).repartition("document", "block")
            .sortWithinPartitions("document", "ord").mapInArrow(pack, "document string, ord long, piece binary"))


def write_documents(rows: DataFrame, root: str, packed: bool = False) -> None:
    """Write ``document_rows`` as files below ``root``: one task writes a document, piece after piece; ``packed``: gzipped
    ``<repo>.json.gz``.

    A file appears under its name when it is whole; a repeated task writes the same bytes again.
    """
    rows.sparkSession.dataSource.register(ResultDocuments)
    (pack_rows(rows).repartition("document").sortWithinPartitions("document", "ord")
     .write.format(ResultDocuments.name()).option("path", root).option("packed", str(packed)).mode("append").save())


class ResultDocuments(DataSource):
    """Result documents as a Spark data source."""

    @classmethod
    def name(cls) -> str:
        return "result-documents"

    def schema(self):
        return DOCUMENT_ROW

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options["files"]))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options["packed"] == "True")


class _Writer(DataSourceWriter):
    def __init__(self, root: str, packed: bool):
        self.root, self.packed = root.rstrip("/"), packed

    def write(self, rows) -> WriterCommitMessage:
        files, base = _filesystem(self.root)
        document, out, unfinished, first = None, None, None, True
        for row in rows:
            if row.document != document:
                if out is not None:
                    self._finish(files, out, unfinished, f"{base}/{document}")
                document, first = row.document, True
                files.create_dir(f"{base}/{document.rsplit('/', 1)[0]}", recursive=True)
                unfinished = f"{base}/{document}.{uuid.uuid4().hex}"
                out = files.open_output_stream(unfinished, compression=None)
            elif not first:
                out.write(self._text(b",\n"))
            else:
                first = False
            # pieces are gzip members, and members one after the other are a gzip file
            out.write(row.piece if self.packed else gzip.decompress(row.piece))
        if out is not None:
            self._finish(files, out, unfinished, f"{base}/{document}")
        return WriterCommitMessage()

    def _text(self, text: bytes) -> bytes:
        return gzip.compress(text, 6, mtime=0) if self.packed else text

    def _finish(self, files, out, unfinished: str, path: str) -> None:
        out.write(self._text(b"\n]}\n]}\n"))
        out.close()
        files.move(unfinished, path.removesuffix(RESULT_SUFFIX) + PACKED_SUFFIX if self.packed else path)


# ------------------------------------------------------------------- reading
def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """One row per commit (``DOCUMENT_ROW``) of every ``*.json`` and ``*.json.gz`` below ``root``; ``pos`` is the place in its list.

    A document that is not whole JSON of the expected form gives one row with its ``error`` and no commit.
    """
    spark.dataSource.register(ResultDocuments)
    listing = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
               .option("pathGlobFilter", f"*{{{RESULT_SUFFIX},{PACKED_SUFFIX}}}").load(root).select("path"))
    # paths only, as any file source lists them
    files = sorted(r["path"] for r in listing.collect())
    return spark.read.format(ResultDocuments.name()).option("files", json.dumps(files)).load()


@dataclass
class _Document(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, files: list[str]):
        self.files = files

    def partitions(self):
        return [_Document(f) for f in self.files]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        held, chars = [], 0
        for size, row in commit_rows(partition.path):
            if held and (len(held) >= BATCH_COMMITS or chars + size > BATCH_CHARS):
                yield _batch(held)
                held, chars = [], 0
            held.append(row)
            chars += size
        if held:
            yield _batch(held)


class _Json:
    """JSON values read one by one from a stream; holds the value being read and a chunk."""

    def __init__(self, stream):
        import codecs

        self.stream, self.decode = stream, codecs.getincrementaldecoder("utf-8")().decode
        self.text, self.at, self.done = "", 0, False
        self.parse = json.JSONDecoder().raw_decode

    def more(self, size: int = CHUNK) -> bool:
        if self.done:
            return False
        raw = self.stream.read(size)
        self.done = not raw
        self.text, self.at = self.text[self.at:] + self.decode(raw, self.done), 0
        return True

    def peek(self) -> str:
        """The next character that is no white space; '' at the end."""
        while True:
            while self.at < len(self.text):
                if self.text[self.at] not in " \t\r\n":
                    return self.text[self.at]
                self.at += 1
            if not self.more():
                return ""

    def take(self, wanted: str) -> None:
        if self.peek() != wanted:
            raise ValueError(f"{wanted!r} expected, {self.peek()!r} found")
        self.at += 1

    def value(self):
        """The next whole value."""
        self.peek()
        size = CHUNK
        while True:
            try:
                out, end = self.parse(self.text, self.at)
                if end < len(self.text) or self.done:  # a number may go on in the next chunk
                    self.at = end
                    return out
            except ValueError:
                if self.done:
                    raise
            self.more(size)
            size *= 2  # a long value is tried again a few times only

    def members(self) -> Iterator[str]:
        """Keys of the object ahead; the caller reads each value."""
        self.take("{")
        while self.peek() != "}":
            key = self.value()
            self.take(":")
            yield key
            if self.peek() != "}":
                self.take(",")
                if self.peek() == "}":
                    raise ValueError("'}' after ','")
        self.at += 1

    def items(self) -> Iterator[None]:
        """Once for each item of the array ahead; the caller reads it."""
        self.take("[")
        while self.peek() != "]":
            yield
            if self.peek() != "]":
                self.take(",")
                if self.peek() == "]":
                    raise ValueError("']' after ','")
        self.at += 1


def _repositories(path: str):
    """(number of the repository, key, value) of a document's repositories; a commit comes under the key ``commits``."""
    files, inside = _filesystem(path)
    with files.open_input_stream(inside, compression=None) as stream:
        doc = _Json(gzip.open(stream) if path.endswith(PACKED_SUFFIX) else stream)
        for key in doc.members():
            if key != "repositories" or doc.peek() == "n":
                doc.value()
                continue
            for number, _ in enumerate(doc.items()):
                for field in doc.members():
                    if field == "commits" and doc.peek() == "[":
                        for _ in doc.items():
                            before = len(doc.text) - doc.at
                            yield number, field, doc.value(), max(0, before - len(doc.text) + doc.at)
                    else:
                        yield number, field, doc.value(), 0
        if doc.peek():
            raise ValueError("text after the document")


def commit_rows(path: str) -> Iterator[tuple[int, dict]]:
    """(characters, row) of every commit of a document: read once to check it and to learn the repositories' names,
    which may stand behind their commits, then once more for the commits."""
    about: dict[int, dict] = {}
    try:
        for number, key, value, _ in _repositories(path):
            if key in ("repository_id", "project_name"):
                about.setdefault(number, {})[key] = value
    except (ValueError, EOFError, gzip.BadGzipFile, zlib.error) as e:
        yield 0, {"file_path": path, "error": f"{type(e).__name__}: {e}"[:500]}
        return
    pos: dict[int, int] = {}
    for number, key, value, size in _repositories(path):
        if key == "commits":
            own = about.get(number, {})
            at = pos[number] = pos.get(number, -1) + 1
            if isinstance(value, dict):
                yield size, {**_typed(value, DOCUMENT_COMMIT), "file_path": path, "pos": at,
                             "repository_id": _plain(own.get("repository_id"), T.LongType()),
                             "project_name": _plain(own.get("project_name"), T.StringType())}


def _typed(value: dict, schema: T.StructType) -> dict:
    return {f.name: _plain(value.get(f.name), f.dataType) for f in schema.fields}


def _plain(v, kind: T.DataType):
    """``v`` if it has the declared type, else null; numbers and booleans may stand for a string."""
    if isinstance(kind, T.StructType):
        return _typed(v, kind) if isinstance(v, dict) else None
    if isinstance(kind, T.ArrayType):
        return [_plain(x, kind.elementType) for x in v] if isinstance(v, list) else None
    if isinstance(kind, T.StringType):
        return v if isinstance(v, str) or v is None else json.dumps(v, ensure_ascii=False)
    if isinstance(kind, T.BooleanType):
        return v if isinstance(v, bool) else None
    return v if isinstance(v, int) and not isinstance(v, bool) else None


def _batch(rows: list[dict]) -> pa.RecordBatch:
    import pyarrow as pa

    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.RecordBatch.from_pylist(rows, to_arrow_schema(DOCUMENT_ROW))
