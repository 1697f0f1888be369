"""Shared pieces of the llm operators: input columns, scratch tables, shipping code."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from histofold.session import scratch_dir

#: Prefix of every column an operator adds next to the caller's own columns.
OWN = "__llm_"
#: White space of the text contracts, as a regex class body.
SPACES = r"\x20\x09-\x0D"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def plain(text: Column) -> Column:
    """Text with null read as the empty text."""
    return F.coalesce(text, F.lit(""))


def refuse(df: DataFrame, *names: str) -> None:
    """Fail at once where ``df`` has a column that an operator is about to add (names in any case)."""
    own = {c.lower() for c in df.columns}
    taken = [n for n in names if n.lower() in own]
    if taken:
        raise ValueError(f"the input has columns that are results here: {taken}; rename them or name the results otherwise")


#: Rows of a batch handed to Python while a table is written: whole texts and sets are wide.
BATCH_ROWS = "1024"


@contextmanager
def small_batches(spark: SparkSession):
    """Bound the Arrow batches of the jobs run inside; the session's setting comes back after."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Written intermediate tables below the shared folder (``spark.checkpoint.dir``).

    ``save`` cuts the lineage: later stages, and recomputation after a lost
    executor, start from the Parquet files.  Each run has a folder of its own.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, files: int | None = None) -> DataFrame:
        """Write ``df`` and return it as read from the files."""
        path = f"{self.root}/{name}"
        with small_batches(self.spark):
            self._write(df, path, files)
        return self.spark.read.schema(df.schema).parquet(path)

    @staticmethod
    def _write(df: DataFrame, path: str, files: int | None) -> None:
        (df if files is None else df.coalesce(files)).write.option("compression", "zstd").parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables of this run that no later result reads."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, wherever they start."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="histofold-zip-"), "histofold_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(path)  # Spark's file server hands it to every executor
    _SHIPPED.add(sc.applicationId)
