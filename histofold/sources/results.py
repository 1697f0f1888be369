"""Collected results: nested JSON sink, discovery, permissive read, flattening
(S7-S12).

Layout written here, each partitioned ``owner_name=<o>/repository_name=<r>/``:
``<root>/repositories`` (one JSON line per repository), ``<root>/commits``
(one line per commit: the persisted commit projection with counts and line
sums), ``<root>/changes`` (one line per ``pac_changes`` / ``other_changes``
entry) and ``<root>/files`` (one line per touched file).  Neither a repository's
history nor a commit's list is ever gathered into one record, so no single task
or row has to hold them.  Below ``run=<id>`` folders (``plans.jobs.collect``) the
same datasets hold one run each.  The analysed tool's own
format -- one ``{metadata, repositories[commits[]]}`` document per file at
``<owner>/<repo>.json`` -- is read by ``read_result_documents``.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histofold.schemas import RESULT_CHANGE, RESULT_COMMIT, RESULT_DOCUMENT, RESULT_FILE, RESULT_REPOSITORY

# File skipped by discovery, result file suffix.
AGGREGATED_RESULTS_FILE = "aggregated_results.json"
RESULT_SUFFIX = ".json"
# Commits, changes and files repeat their keys line by line: written gzipped, in files of at most this many lines.
PACKED_SUFFIX = RESULT_SUFFIX + ".gz"
LINES_PER_FILE = 1_000_000

_SAFE_RE = r"[^\p{L}\p{N}_.\-]"


def safe_name(c) -> F.Column:
    """Every character other than a letter, digit, ``_``, ``-`` or ``.`` -> ``_``."""
    return F.regexp_replace(c, _SAFE_RE, "_")


def output_file_name(owner, repo) -> F.Column:
    """``outputs/<safe owner>/<safe repo>.json``; empty owner or repo fails."""
    ok = F.coalesce((owner != "") & (repo != ""), F.lit(False))
    return F.when(ok, F.concat(F.lit("outputs/"), safe_name(owner), F.lit("/"), safe_name(repo),
                               F.lit(RESULT_SUFFIX))) \
        .otherwise(F.raise_error(F.lit("Owner name and repository name are required")))


def _keys(project: F.Column) -> list[F.Column]:
    parts = F.split(project, "/")
    return [parts.getItem(0).alias("owner_name"), parts.getItem(1).alias("repository_name")]


def result_commits(facts: DataFrame) -> DataFrame:
    """Persisted commit rows (change lists live in ``result_changes``), plus
    ``owner_name`` / ``repository_name`` partition keys."""
    return facts.select(
        F.col("repo_id").cast("long").alias("repository_id"), "project_name",
        F.col("commit_id").cast("string").alias("commit_id"), "author",
        (F.col("author_email") if "author_email" in facts.columns else F.lit(None).cast("string")).alias("author_email"),
        "message", F.col("date").cast("long"), "pos",
        "has_pac_changes", "pac_files_count", "other_files_count", "pac_added_lines", "pac_deleted_lines",
        "total_added_lines", "total_deleted_lines", *_keys(F.col("project_name")))


def result_changes(classified: DataFrame, repos: DataFrame) -> DataFrame:
    """The ``pac_changes`` / ``other_changes`` entries as one row each (``is_pac``
    tells the list, ``pos`` the file order).  Kept long so that no commit's
    changes -- however many -- are gathered into one record."""
    names = repos.select("repo_id", F.col("full_name").alias("project_name"))
    return classified.join(names, "repo_id", "inner").select(
        F.col("repo_id").cast("long").alias("repository_id"), "project_name",
        F.col("commit_id").cast("string").alias("commit_id"), "is_pac", "pos", "file",
        F.col("additions").cast("long").alias("additions"), F.col("deletions").cast("long").alias("deletions"),
        F.col("total_changes").cast("long").alias("total_changes"), "status",
        *_keys(F.col("project_name")))


def result_files(files: DataFrame, commits: DataFrame, repos: DataFrame, saved_keys: bool = True) -> DataFrame:
    """The touched files of each non-merge commit, one row each in file order.

    Without ``saved_keys`` the ids keep their types, and so files bucketed on them need no shuffle behind this."""
    key = lambda c, kind: F.col(c).cast(kind) if saved_keys else F.col(c)
    names = repos.select("repo_id", F.col("full_name").alias("project_name"))
    keyed = files.join(commits.select("commit_id", "repo_id"), "commit_id") if "repo_id" not in files.columns else files
    return keyed.join(names, "repo_id").select(
        key("repo_id", "long").alias("repository_id"), "project_name",
        key("commit_id", "string").alias("commit_id"), F.col("pos").cast("int").alias("pos"), "file",
        *_keys(F.col("project_name")))


def result_repositories(facts: DataFrame) -> DataFrame:
    """Repository rows as saved (statistics dropped)."""
    g = facts.groupBy("repo_id", "project_name").agg(
        F.count(F.lit(1)).alias("total_commits"),
        F.sum("pac_files_count").cast("long").alias("pac_changes_count"),
        F.count(F.when(F.col("has_pac_changes"), 1)).alias("pac_commits_count"))
    parts = F.split(F.col("project_name"), "/")
    return g.select(F.col("repo_id").cast("long").alias("repository_id"), "project_name", "total_commits",
                    "pac_changes_count", "pac_commits_count",
                    F.when(F.col("total_commits") > 0, F.col("pac_changes_count") / F.col("total_commits"))
                    .otherwise(F.lit(0.0)).alias("pac_change_ratio"),
                    parts.getItem(0).alias("owner_name"), parts.getItem(1).alias("repository_name"))


def write_results(commits: DataFrame, repositories: DataFrame, root: str,
                  changes: DataFrame | None = None, replace_only_written: bool = False,
                  layout: str = "partitioned", files: DataFrame | None = None, run: str | None = None) -> None:
    """JSON (UTF-8, unescaped), one dataset each for repositories, commits, changes, files.

    ``layout="partitioned"``: a folder per owner / repository (the analysed
    tool's one-file-per-repository shape).  ``rebalance`` groups a
    repository's rows into few files while AQE splits a partition that grows
    past the advisory size -- a repository holding a third of all commits is
    written by many tasks.  With ``replace_only_written`` (incremental runs)
    only the repositories in this write are replaced.

    ``layout="sorted"``: for corpora of very many small repositories, few
    large files range-partitioned and sorted by (owner, repository, commit);
    the commit in the range key splits one huge repository over several
    files.  Keys are then ordinary columns (discover with ``discover_results``
    on the ``repositories`` dataset, which reads them from the data).

    Commits, changes and files are gzipped (a tenth of the plain text); a file is bounded by
    ``LINES_PER_FILE``, as a gzipped one is read whole by one task.
    """
    parts = [("repositories", repositories), ("commits", commits)]
    if changes is not None:
        parts.append(("changes", changes))
    if files is not None:
        parts.append(("files", files))
    for name, df in parts:
        options = {} if df is repositories else {"compression": "gzip", "maxRecordsPerFile": LINES_PER_FILE}
        if run:
            name = f"{name}/run={run}"
        if layout == "sorted":
            keys = ["owner_name", "repository_name"] + (["commit_id"] if "commit_id" in df.columns else [])
            (df.repartitionByRange(*keys).sortWithinPartitions(*keys)
             .write.mode("overwrite").options(**options).json(f"{root}/{name}"))
            continue
        w = df.hint("rebalance", "owner_name", "repository_name").write.mode("overwrite").options(**options)
        if replace_only_written:
            w = w.option("partitionOverwriteMode", "dynamic")
        w.partitionBy("owner_name", "repository_name").json(f"{root}/{name}")


def run_metadata(spark: SparkSession, start: float, end: float | None = None, repository_no=None,
                 use_test_mode: bool = False, csv_path: str | None = None,
                 pac_file_names_csv: str | None = None) -> DataFrame:
    """One run record (start, end, duration, configuration)."""
    end = time.time() if end is None else end
    schema = RESULT_DOCUMENT["metadata"].dataType
    row = (start, end, end - start, (repository_no, use_test_mode, csv_path, pac_file_names_csv))
    return spark.createDataFrame([row], schema)


def _with_partition_keys(schema: T.StructType, run: bool = False) -> T.StructType:
    """Partition folders read as strings whatever they look like."""
    return T.StructType(list(schema.fields) + ([T.StructField("run", T.StringType())] if run else []) + [T.StructField("owner_name", T.StringType()),
                                               T.StructField("repository_name", T.StringType())])


def _unescape(c: F.Column) -> F.Column:
    """Undo partition-folder escaping (``%XX`` only; a literal ``+`` stays)."""
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def discover_results(spark: SparkSession, root: str) -> DataFrame:
    """Result files under ``root`` with their (owner, repository) key.

    Keys come from ``owner_name=/repository_name=`` folders when present, else
    from parent folder and file stem; ``aggregated_results.json`` is skipped;
    for a repeated key the last path (in path order) wins.
    """
    listing = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
               .option("pathGlobFilter", f"*{{{RESULT_SUFFIX},{PACKED_SUFFIX}}}").load(root).select("path"))
    p = F.col("path")
    part_owner = F.regexp_extract(p, r"owner_name=([^/]+)/repository_name=([^/]+)/[^/]+$", 1)
    part_repo = F.regexp_extract(p, r"owner_name=([^/]+)/repository_name=([^/]+)/[^/]+$", 2)
    parent = F.regexp_extract(p, r"([^/]+)/([^/]+)\.json$", 1)
    stem = F.regexp_extract(p, r"([^/]+)/([^/]+)\.json$", 2)
    # Spark's own part files only carry keys in partition folders or in the data.
    spark_part = F.regexp_extract(p, r"/(part-\d{5}-[^/]*)$", 1) != ""
    files = (listing.filter(~p.endswith("/" + AGGREGATED_RESULTS_FILE))
             .filter((part_owner != "") | (~spark_part & p.endswith(RESULT_SUFFIX)))
             .select(F.when(part_owner != "", _unescape(part_owner)).otherwise(parent).alias("owner_name"),
                     F.when(part_repo != "", _unescape(part_repo)).otherwise(stem).alias("repository_name"),
                     p.alias("file_path")))
    found = files.groupBy("owner_name", "repository_name").agg(
        F.max("file_path").alias("file_path"), F.count(F.lit(1)).alias("files"))
    if root.rstrip("/").endswith("/repositories"):
        # A sorted layout keeps the keys in the data instead of folder names.
        sorted_keys = (spark.read.schema(_with_partition_keys(RESULT_REPOSITORY)).json(root)
                       .filter(F.col("owner_name").isNotNull())
                       .select("owner_name", "repository_name", F.col("_metadata.file_path").alias("file_path"))
                       .groupBy("owner_name", "repository_name")
                       .agg(F.max("file_path").alias("file_path"), F.countDistinct("file_path").alias("files")))
        found = found.unionByName(
            sorted_keys.join(found.select("owner_name", "repository_name"),
                             ["owner_name", "repository_name"], "left_anti"))
    return found


def write_manifest(spark: SparkSession, root: str, run: str) -> None:
    """List run ``run`` in the manifest below ``root``: (owner, repository, file) of each of its repositories.

    The folders of one run are listed once, when it is published; discovery then reads the manifest.
    """
    (spark.read.schema(_with_partition_keys(RESULT_REPOSITORY)).json(f"{root}/repositories/run={run}")
     .groupBy("owner_name", "repository_name").agg(F.max(F.col("_metadata.file_path")).alias("file_path"))
     .write.parquet(f"{root}/manifest/run={run}"))


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """(owner_name, repository_name, file_path, run) of all listed runs, published or not."""
    return spark.read.schema("owner_name string, repository_name string, file_path string, run string").parquet(f"{root}/manifest")


def read_results(spark: SparkSession, root: str, runs: bool = False) -> tuple[DataFrame, DataFrame]:
    """Read result commits; returns ``(good, quarantined)``.

    Good rows come from a ``DROPMALFORMED`` read; unreadable lines are not lost
    silently but returned by a second, ``PERMISSIVE`` read as the quarantine
    (raw line in ``_corrupt_record`` plus its ``file_path``).  Spark refuses a
    scan that needs only the corrupt column, so inspect the quarantine with
    ``collect()`` / a write, or ``cache()`` it before ``count()``.
    """
    schema = _with_partition_keys(RESULT_COMMIT, runs)
    good_schema = T.StructType([f for f in schema.fields if f.name != "_corrupt_record"])
    good = spark.read.schema(good_schema).option("mode", "DROPMALFORMED").json(f"{root}/commits")
    raw = (spark.read.schema(schema).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_corrupt_record").json(f"{root}/commits"))
    bad = (raw.filter(F.col("_corrupt_record").isNotNull())
           .withColumn("file_path", F.col("_metadata.file_path")))
    return good, bad


def read_result_repositories(spark: SparkSession, root: str) -> DataFrame:
    """S8 on the repository rows of a result folder."""
    schema = _with_partition_keys(RESULT_REPOSITORY)
    return spark.read.schema(schema).json(f"{root}/repositories")


def read_result_documents(spark: SparkSession, paths, recursive: bool = False) -> DataFrame:
    """S8 for the analysed tool's own files: one multi-line document per file."""
    return (spark.read.schema(RESULT_DOCUMENT).option("multiLine", True).option("mode", "PERMISSIVE")
            .option("recursiveFileLookup", recursive).option("pathGlobFilter", "*" + RESULT_SUFFIX)
            .option("columnNameOfCorruptRecord", "_corrupt_record").json(paths)
            .withColumn("file_path", F.col("_metadata.file_path")))


def name_of_file(path: F.Column) -> F.Column:
    """``owner/stem`` of a document's path."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)/([^/]+)\.json$", 0), r"\.json$", "")


def flatten_documents(docs: DataFrame) -> DataFrame:
    """S9 for documents: ``repositories[] -> commits[]`` with the list position as ``pos``.

    The project name falls back to the file-derived ``owner/stem`` when the
    key is absent (P18; a null name also falls back).
    """
    repos = docs.filter(F.col("_corrupt_record").isNull()).select(
        "file_path", F.explode("repositories").alias("r"))
    commits = repos.select("file_path", "r.repository_id",
                           F.coalesce(F.col("r.project_name"), name_of_file(F.col("file_path"))).alias("project_name"),
                           F.posexplode("r.commits").alias("pos", "c"))
    return commits.select("repository_id", "project_name", "pos", "c.*")


def read_result_changes(spark: SparkSession, root: str, runs: bool = False) -> DataFrame:
    """S9 on the change rows of a result folder (already flat)."""
    return spark.read.schema(_with_partition_keys(RESULT_CHANGE, runs)).json(f"{root}/changes")


def read_result_files(spark: SparkSession, root: str, runs: bool = False) -> DataFrame:
    """The touched-file rows of a result folder."""
    return spark.read.schema(_with_partition_keys(RESULT_FILE, runs)).json(f"{root}/files")


def unreadable_documents(docs: DataFrame) -> DataFrame:
    """(file_path, reason, record) of the documents that cannot be read."""
    # a second column is read along: Spark refuses a scan of the corrupt column alone
    return docs.filter(F.col("_corrupt_record").isNotNull()).select(
        "file_path", F.lit("unreadable document").alias("reason"),
        F.coalesce("_corrupt_record", F.to_json("repositories")).alias("record"))


def flatten_document_changes(flat_commits: DataFrame) -> DataFrame:
    """S9 for documents: nested ``pac_changes`` / ``other_changes`` to long form."""
    keys = ["repository_id", "project_name", "commit_id"]
    pac = (flat_commits.select(*keys, F.posexplode("pac_changes").alias("list_pos", "c"))
           .select(*keys, F.lit(True).alias("is_pac"), "list_pos", "c.*"))
    other = (flat_commits.select(*keys, F.posexplode("other_changes").alias("list_pos", "c"))
             .select(*keys, F.lit(False).alias("is_pac"), "list_pos", "c.*"))
    return pac.unionByName(other)


def fold_result_commits(result_commits_df: DataFrame) -> DataFrame:
    """Commit facts back from read result rows (for round trips)."""
    return result_commits_df.select(
        F.col("repository_id").alias("repo_id"), "project_name", "commit_id", "author", "author_email", "message", "date", "pos",
        "pac_files_count", "other_files_count", "pac_added_lines", "pac_deleted_lines", "total_added_lines",
        "total_deleted_lines", "has_pac_changes")


