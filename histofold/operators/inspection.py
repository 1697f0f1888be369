"""Flat PaC-commit table for manual reading.

Uses the full history of every repository (no first-PaC slice).  The
reproducible sample orders by ``md5(seed:project:sha)`` and takes the first
``n``: an exact size, stable under any partitioning, and a
``TakeOrderedAndProject`` (per-partition top-n, then a merge of ``n`` rows
per partition) rather than a global sort.  It cannot reproduce Python's
Mersenne-Twister draw; equal size, seed stability and uniformity are the
contract.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histofold.functions.text import one_line

# Commit URL pattern, sampling defaults, CSV column order.
COMMIT_URL_PREFIX = "https://github.com/"
COMMIT_URL_INFIX = "/commit/"
DEFAULT_SAMPLE_SIZE = 362
DEFAULT_SEED = 42
EXTRA_SAMPLE_SIZE = 100
TOP_PROJECTS = 10
CSV_COLUMNS = ("project_name", "commit_sha", "commit_message", "author", "date", "github_url",
               "pac_files_count", "other_files_count", "pac_added_lines", "pac_deleted_lines",
               "total_added_lines", "total_deleted_lines", "pac_files", "pac_files_detailed")


def commit_url(project: Column, sha: Column) -> Column:
    """``https://github.com/{project}/commit/{sha}``; '' unless project has '/' and sha is set."""
    ok = (F.coalesce(project.contains("/"), F.lit(False))
          & F.coalesce(sha != "", F.lit(False)))
    return F.when(ok, F.concat(F.lit(COMMIT_URL_PREFIX), project, F.lit(COMMIT_URL_INFIX), sha)) \
        .otherwise(F.lit(""))


def pac_file_lists(classified: DataFrame) -> DataFrame:
    """F4 + F5: per commit, its PaC files in file order, plain and with ``(+a/-d)``."""
    recs = (classified.filter("is_pac")
            .groupBy("repo_id", "commit_id")
            .agg(F.array_sort(F.collect_list(F.struct("pos", "file", "additions", "deletions"))).alias("r")))
    return recs.select(
        "repo_id", "commit_id",
        F.array_join(F.transform("r", lambda s: s["file"]), "; ").alias("pac_files"),
        F.array_join(F.transform("r", lambda s: F.format_string("%s (+%d/-%d)", s["file"], s["additions"],
                                                                s["deletions"])), "; ")
        .alias("pac_files_detailed"))


def inspection_rows(facts: DataFrame, classified: DataFrame) -> DataFrame:
    """One row per PaC commit with the 14 inspection columns (+ ``repo_id``)."""
    pac = facts.filter("has_pac_changes")
    sha = F.col("commit_id").cast("string")
    j = pac.join(pac_file_lists(classified), ["repo_id", "commit_id"], "left")
    return j.select(
        "repo_id", "project_name", sha.alias("commit_sha"),
        one_line(F.col("message")).alias("commit_message"),
        F.coalesce(F.col("author"), F.lit("")).alias("author"), "date",
        commit_url(F.col("project_name"), sha).alias("github_url"),
        "pac_files_count", "other_files_count", "pac_added_lines", "pac_deleted_lines",
        "total_added_lines", "total_deleted_lines",
        F.coalesce(F.col("pac_files"), F.lit("")).alias("pac_files"),
        F.coalesce(F.col("pac_files_detailed"), F.lit("")).alias("pac_files_detailed"))


def pac_commit_stats(facts: DataFrame) -> DataFrame:
    """A10 + A12: totals, averages and composition over all PaC commits; no row if none."""
    p = facts.filter("has_pac_changes")
    n = F.count(F.lit(1))
    s = p.agg(
        n.alias("total_commits"),
        F.countDistinct("project_name").alias("unique_projects"),
        (F.sum("pac_files_count") / n).alias("avg_pac_files_per_commit"),
        (F.sum("other_files_count") / n).alias("avg_other_files_per_commit"),
        (F.sum(F.col("pac_added_lines") + F.col("pac_deleted_lines")) / n).alias("avg_pac_line_changes"),
        (F.sum(F.col("total_added_lines") + F.col("total_deleted_lines")) / n).alias("avg_total_line_changes"),
        F.count(F.when(F.col("other_files_count") == 0, 1)).alias("commits_with_only_pac"),
        F.count(F.when(F.col("other_files_count") > 0, 1)).alias("commits_with_mixed_changes"))
    return (s.filter(F.col("total_commits") > 0)
            .withColumn("only_pac_pct", F.col("commits_with_only_pac") / F.col("total_commits") * 100)
            .withColumn("mixed_pct", F.col("commits_with_mixed_changes") / F.col("total_commits") * 100))


def commits_by_project(facts: DataFrame) -> DataFrame:
    """PaC commits per project."""
    return (facts.filter("has_pac_changes").groupBy("project_name")
            .agg(F.count(F.lit(1)).alias("pac_commits")))


def top_projects(facts: DataFrame, k: int = TOP_PROJECTS) -> DataFrame:
    """T4: the ``k`` projects with most PaC commits; ties by name (stable order, W3)."""
    return commits_by_project(facts).orderBy(F.col("pac_commits").desc(), F.col("project_name")).limit(k)


def sample_key(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("project_name"), F.col("commit_id").cast("string")))


def seeded_sample(facts: DataFrame, classified: DataFrame, n: int | None = DEFAULT_SAMPLE_SIZE,
                  seed: int = DEFAULT_SEED) -> DataFrame:
    """Inspection rows of ``n`` PaC commits without replacement, reproducible for a seed;
    ``None`` -> all rows.

    The commits are drawn from the facts first; only their change rows are
    read on (a broadcast of at most ``n`` keys) and made into file lists.
    With ``n`` at least the row count every row is returned.
    """
    if n is None:
        return inspection_rows(facts, classified)
    drawn = facts.filter("has_pac_changes").orderBy(
        sample_key(seed), "project_name", F.col("commit_id").cast("string")).limit(n)
    keys = F.broadcast(drawn.select("repo_id", "commit_id"))
    return inspection_rows(drawn, classified.filter("is_pac").join(keys, ["repo_id", "commit_id"], "left_semi"))


def inspection_sorted(rows: DataFrame) -> DataFrame:
    """CSV order -- project, then date, then sha for a total order."""
    return rows.orderBy("project_name", "date", "commit_sha")


def extra_sample(facts: DataFrame, classified: DataFrame, sample_size: int | None = None,
                 n: int = EXTRA_SAMPLE_SIZE, seed: int = DEFAULT_SEED) -> DataFrame:
    """When no size was asked for and there are more than ``n`` rows, a sample of ``n``.

    The row-count condition is a scalar subquery over the PaC commits.
    """
    if sample_size is not None:
        return seeded_sample(facts.limit(0), classified, n, seed)
    more_than_n = facts.filter("has_pac_changes").agg(F.count(F.lit(1))).scalar() > n
    return seeded_sample(facts, classified, n, seed).filter(more_than_n)
