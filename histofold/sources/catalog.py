"""Repository catalog and PaC list files.

The catalog is a CSV with a header whose first column is an unnamed index,
quoted descriptions that contain commas, quotes and line breaks; the PaC list
is a CSV of ``repo_id`` and ``path``.  Both are read by header name.
"""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histofold.functions.ordinal import file_row_number
from histofold.schemas import CATALOG_CSV

# Columns that the collection step needs.
REQUIRED_CATALOG_COLUMNS = ("id", "full_name")
REQUIRED_PAC_COLUMNS = ("repo_id", "path")


def _by_name(spark: SparkSession, path: str, required) -> list[DataFrame]:
    """CSV files with a header line, all columns as text under their header names: one scan for each distinct header.

    Files of a folder may differ in columns and their order; Spark names the columns of a scan by one of its files,
    so files are grouped by their first line and each group is read by its own names.  A file that lacks a required
    column fails with its name.  Only (header, file names) reach the driver, which lists the files of a scan anyway.
    """
    csv = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "FAILFAST")
    lines = (spark.read.text(path)
             .where("_metadata.file_block_start = 0")
             .select(F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("at")))
    groups = (lines.groupBy("file").agg(F.min_by("value", "at").alias("header"))
              .groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("files").collect())
    if len(groups) < 2:
        scans = [(path, csv.csv(path))]
    else:
        scans = [(g.files[0], csv.csv([unquote(f) for f in g.files])) for g in groups]
    for where, scan in scans:
        check_required_columns(scan.columns, where, required)
    return [scan for _, scan in scans]


def check_required_columns(names, path: str, required) -> None:
    """Fail when the header lacks a required column."""
    missing = sorted(set(required) - set(names))
    if missing:
        raise ValueError(f"{path} lacks required columns: {missing}")


def scan_repo_catalog(spark: SparkSession, path: str) -> DataFrame:
    """``repos(repo_id, full_name, sha, idx)`` with ``idx`` the 1-based row in file order.

    Columns are found by header name, file by file; others, and their order, do not matter.
    A file without pinned revisions reads with null ``sha``.  ``id`` is required beside ``full_name``:
    the PaC list and the histories name repositories by it.
    """
    def rows(raw: DataFrame) -> DataFrame:
        sha = F.col("last_commit_sha") if "last_commit_sha" in raw.columns else F.lit(None).cast("string")
        return raw.select(F.col("id").cast("long").alias("repo_id"), "full_name", sha.alias("sha"), "_metadata")

    scans = _by_name(spark, path, REQUIRED_CATALOG_COLUMNS)
    return file_row_number([rows(raw) for raw in scans]).select("repo_id", "full_name", "sha", "idx")


def select_repo_by_number(repos: DataFrame, number: int) -> DataFrame:
    """S3: the catalog row with 1-based number ``number``."""
    return repos.filter(F.col("idx") == number)


def write_repo_catalog(repos: DataFrame, path: str) -> None:
    """Write ``repos`` in the catalog CSV layout, in ``idx`` order (test/fixture export)."""
    fn = F.col("full_name")
    out = repos.orderBy("idx").select(
        (F.col("idx") - 1).cast("int").alias("_c0"), F.col("repo_id").cast("long").alias("id"), fn.alias("full_name"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in CATALOG_CSV.fields[3:7]],
        F.col("sha").alias("last_commit_sha"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in CATALOG_CSV.fields[8:15]],
        F.concat(F.lit('Policies for "'), fn, F.lit('", mirrored,\nsee notes')).alias("description"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in CATALOG_CSV.fields[16:]])
    header = ["" if c == "_c0" else c for c in out.columns]
    (out.toDF(*header).write.mode("overwrite").option("header", True)
     .option("quote", '"').option("escape", '"').csv(path))


def scan_pac_files(spark: SparkSession, path: str) -> DataFrame:
    """The PaC list, de-duplicated (membership is existence, Q7); columns by header name."""
    scans = [raw.select(F.col("repo_id").cast("long").alias("repo_id"), "path")
             for raw in _by_name(spark, path, REQUIRED_PAC_COLUMNS)]
    return reduce(DataFrame.unionByName, scans).distinct()


def write_pac_files(pac_files: DataFrame, path: str) -> None:
    (pac_files.select("path", F.col("repo_id").cast("long")).write.mode("overwrite")
     .option("header", True).option("quote", '"').option("escape", '"').csv(path))
