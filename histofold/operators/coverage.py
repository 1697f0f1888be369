"""Coverage of the catalog by collected results, retry and increment lists,
suffix lookup and pinned-revision choice (J5-J7, A19, U1, U2, S13, S15).

All of these are joins of the catalog (one row per repository) with other
per-repository tables; only the revision check touches the commit table,
which is streamed while the catalog side is broadcast after a size check.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Repositories that no longer exist and repositories that are
# always analysed at HEAD in the analysed study's configuration.
NO_LONGER_EXIST_REPOSITORIES = (
    "anza-labs/manifests",
    "aws-cloudformation/community-registry-extensions",
    "Azure/AzureDefender-K8S-InClusterDefense",
)
REPOSITORIES_THAT_SHOULD_USE_HEAD = (
    "litmuschaos/chaos-charts",
    "Azure/AzureDefender-K8S-InClusterDefense",
    "elastisys/compliantkubernetes-kubespray",
    "anza-labs/manifests",
    "soulwhisper/homelab-ops",
    "aws-cloudformation/community-registry-extensions",
    "valitydev/bouncer-policies",
    "controlplaneio/threat-modelling-labs",
)


def catalog_names(repos: DataFrame) -> DataFrame:
    """Distinct catalog names."""
    return repos.select("full_name").distinct()


def coverage_missing(repos: DataFrame, done: DataFrame) -> DataFrame:
    """J5 (anti): catalog repositories without a collected result."""
    return catalog_names(repos).join(done.select("full_name"), "full_name", "left_anti")


def coverage_collected(repos: DataFrame, done: DataFrame) -> DataFrame:
    """J5 (semi): catalog repositories with a collected result."""
    return catalog_names(repos).join(done.select("full_name"), "full_name", "left_semi")


def coverage_except(repos: DataFrame, done: DataFrame) -> DataFrame:
    """``all EXCEPT collected`` as a set operation."""
    return catalog_names(repos).subtract(done.select("full_name"))


def coverage_summary(repos: DataFrame, done: DataFrame) -> DataFrame:
    """All, collected, missing and the two fractions (fractions, not x100: Q18)."""
    names = catalog_names(repos)
    flagged = names.join(done.select("full_name").distinct().withColumn("__d", F.lit(1)), "full_name", "left")
    s = flagged.agg(F.count(F.lit(1)).alias("all_repositories"),
                    F.count("__d").alias("collected_repositories"))
    s = s.withColumn("missed_repositories", F.col("all_repositories") - F.col("collected_repositories"))
    return (s.withColumn("collected_fraction", F.col("collected_repositories") / F.col("all_repositories"))
            .withColumn("missed_fraction", F.col("missed_repositories") / F.col("all_repositories")))


def retry_worklist(repos: DataFrame, done: DataFrame, gone: DataFrame | Iterable[str] | None = None) -> DataFrame:
    """Missing repositories minus those that no longer exist, with their first
    1-based catalog position."""
    spark = repos.sparkSession
    if gone is None or not isinstance(gone, DataFrame):
        names = list(gone) if gone is not None else list(NO_LONGER_EXIST_REPOSITORIES)
        gone = spark.createDataFrame([(n,) for n in names], "full_name string")
    missing = repos.select("full_name", "idx").join(done.select("full_name"), "full_name", "left_anti")
    return (missing.join(gone.select("full_name"), "full_name", "left_anti")
            .groupBy("full_name").agg(F.min("idx").alias("idx")))


def incremental_todo(repos: DataFrame, done: DataFrame) -> DataFrame:
    """Catalog rows still to collect (no existing result), for every repository."""
    return repos.join(done.select("full_name"), "full_name", "left_anti")


def suffix_lookup(names: DataFrame, repos: DataFrame) -> DataFrame:
    """For each name, the first catalog row (lowest ``idx``) whose ``full_name``
    ends with it; nulls when none.

    ``endswith`` is turned into an equi-join: every catalog name is expanded
    to all its suffixes (bounded by the name length, plus the empty suffix),
    which are then matched by equality -- no nested-loop join.
    """
    fn = F.col("full_name")
    suffixes = repos.select(
        "repo_id", "full_name", "idx",
        F.explode(F.array_union(
            F.transform(F.sequence(F.lit(1), F.greatest(F.length(fn), F.lit(1))),
                        lambda i: F.substring(fn, i, F.length(fn))),
            F.array(F.lit("")))).alias("name"))
    # Only names that are asked for matter: semi-join first, then the lowest
    # catalog position per name (hash aggregate), then the catalog row by idx.
    wanted = suffixes.join(names.select("name").distinct(), "name", "left_semi")
    best = wanted.groupBy("name").agg(F.min("idx").alias("idx"))
    rows = best.join(repos.select("idx", "repo_id", "full_name"), "idx", "inner")
    return (names.select("name").join(rows, "name", "left")
            .select("name", "repo_id", "full_name", "idx"))


def resolve_revision(repos: DataFrame, commits: DataFrame,
                     use_head: DataFrame | Iterable[str] | None = None, need_pin: bool = True) -> DataFrame:
    """The revision to analyse: the pinned sha if the history has it, else
    HEAD; listed repositories always use HEAD.  A missing or empty pinned sha fails,
    or means HEAD where ``need_pin`` is off.
    """
    spark = repos.sparkSession
    if use_head is None or not isinstance(use_head, DataFrame):
        names = list(use_head) if use_head is not None else list(REPOSITORIES_THAT_SHOULD_USE_HEAD)
        use_head = spark.createDataFrame([(n,) for n in names], "full_name string")
    pins = repos.select("repo_id", "sha")
    found = (commits.select("repo_id", F.col("commit_id").cast("string").alias("sha"))
             .join(pins, ["repo_id", "sha"], "left_semi")
             .select("repo_id", "sha").distinct().withColumn("in_history", F.lit(True)))
    forced = use_head.select("full_name").distinct().withColumn("forced_head", F.lit(True))
    r = (repos.join(found, ["repo_id", "sha"], "left").join(forced, "full_name", "left"))
    use = F.coalesce(F.col("forced_head"), F.lit(False)) | F.col("in_history").isNull()
    no_pin = F.coalesce(F.col("sha"), F.lit("")) == ""
    sha = F.when(no_pin, F.raise_error(F.lit("repository without a pinned revision"))).otherwise(F.col("sha"))
    return r.select(
        "repo_id", "full_name", (sha if need_pin else F.col("sha")).alias("sha"),
        F.when(use, F.col("head_sha")).otherwise(F.col("sha")).alias("revision"),
        use.alias("uses_head"))
