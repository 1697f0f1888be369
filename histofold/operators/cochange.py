"""Extension co-change statistics and PaC -> other association rules
(P14, P19, P20, J8, J9, A13-A18, T3, T5-T7).

A *transaction* is a commit with PaC changes (full history, no first-PaC
slice); its items are the distinct extensions of its PaC files and of its
other files.  Counting is done on the long form ``(repo_id, commit_id,
is_pac, ext)`` after a distinct (map-side partial dedupe, so a commit with a
huge file list shrinks to its few distinct extensions before any shuffle).

Pair counts (J8/A15) never enumerate pairs per commit: transactions are first
grouped by their *signature* (sorted PaC set, sorted other set) and weighted
by how many commits share it; only distinct signatures are expanded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Label for files without an extension, ".tar" compound prefix,
# default thresholds of the miner and of the main run, report sizes.
NO_EXTENSION = "no_extension"
TAR = ".tar"
DEFAULT_MIN_SUPPORT = 0.01
DEFAULT_MIN_CONFIDENCE = 0.1
MAIN_MIN_SUPPORT = 0.1
MAIN_MIN_CONFIDENCE = 0.8
TOP_EXTENSIONS = 10
TOP_RULES = 20
TOP_RULES_BY_LIFT = 3
GRID_SIZE = 5

_NAME_RE = r"(?s)(?:^|/)([^/]+?)(?:/|/\.(?=/|$))*$"
_SUFFIX_RE = r"(?s)^(.+)(\.[^.]+)$"


def file_extension(path: Column) -> Column:
    """Last suffix of the base name, lower-cased; ``.tar`` prefixed when the
    stem ends with ``.tar`` (case-sensitive); dotfiles and bare names have none.

    Base name and suffix follow POSIX pure-path rules: empty and ``.``
    components are ignored, a suffix needs a dot that is neither the first nor
    the last character of the name.
    """
    # the last component that is neither empty nor ".": what follows the last "/" but such tails
    name = F.regexp_extract(path, _NAME_RE, 1)
    suffix = F.regexp_extract(name, _SUFFIX_RE, 2)
    stem = F.when(suffix != "", F.regexp_extract(name, _SUFFIX_RE, 1)).otherwise(name)
    ext = F.lower(suffix)
    ext = F.when((stem != "") & stem.endswith(TAR), F.concat(F.lit(TAR), ext)).otherwise(ext)
    return F.when(ext == "", F.lit(NO_EXTENSION)).otherwise(ext)


def extension_rows(classified: DataFrame, facts: DataFrame) -> DataFrame:
    """Distinct ``(repo_id, commit_id, is_pac, ext)`` of PaC commits (A13 long form).

    PaC commits first (both tables are bucketed on the commit key: no shuffle),
    then extensions and the distinct, so other commits never reach either.
    """
    pac_commits = facts.filter("has_pac_changes").select("repo_id", "commit_id")
    rows = classified.select("repo_id", "commit_id", "is_pac", "file").join(
        pac_commits, ["repo_id", "commit_id"], "left_semi")
    return rows.select("repo_id", "commit_id", "is_pac", file_extension(F.col("file")).alias("ext")).distinct()


def cochange_transactions(classified: DataFrame, facts: DataFrame) -> DataFrame:
    """A13 + P20: one row per PaC commit: sorted extension sets per side, their
    union and the file counts."""
    ext = extension_rows(classified, facts)
    pac = F.col("is_pac")
    sets = (ext.groupBy("repo_id", "commit_id")
            .agg(F.sort_array(F.collect_set(F.when(pac, F.col("ext")))).alias("pac_extensions"),
                 F.sort_array(F.collect_set(F.when(~pac, F.col("ext")))).alias("other_extensions")))
    counts = facts.filter("has_pac_changes").select(
        "repo_id", "commit_id", F.col("project_name").alias("repository"),
        F.col("pac_files_count").alias("num_pac_files"), F.col("other_files_count").alias("num_other_files"))
    return (counts.join(sets, ["repo_id", "commit_id"], "inner")
            .withColumn("all_extensions", F.array_sort(F.array_union("pac_extensions", "other_extensions")))
            .filter(F.size("pac_extensions") > 0))


def _sides(ext_rows: DataFrame) -> DataFrame:
    return ext_rows.withColumn("side", F.when(F.col("is_pac"), F.lit("pac")).otherwise(F.lit("other")))


def extension_counts(ext_rows: DataFrame) -> DataFrame:
    """Number of PaC commits containing each extension, per side."""
    return _sides(ext_rows).groupBy("side", "ext").agg(F.count(F.lit(1)).alias("commits"))


def side_totals(ext_rows: DataFrame) -> DataFrame:
    """Commits with at least one extension on each side: ``pac`` -> all PaC
    commits, ``other`` -> commits with other files."""
    return (_sides(ext_rows).select("side", "repo_id", "commit_id").distinct()
            .groupBy("side").agg(F.count(F.lit(1)).alias("side_commits")))


def cochange_totals(ext_rows: DataFrame) -> DataFrame:
    """PaC commits, commits with other files, co-change rate (null if no commits),
    and the number of distinct extensions per side."""
    # one group per commit (no further shuffle on the commit key), then a sum;
    # the extensions per side come from their counts: nothing is expanded
    commits = ext_rows.groupBy("repo_id", "commit_id").agg(F.max((~F.col("is_pac")).cast("int")).alias("__other"))
    t = commits.agg(F.count(F.lit(1)).alias("total_commits"),
                    F.coalesce(F.sum("__other"), F.lit(0)).cast("long").alias("commits_with_other_files"))
    kinds = ext_rows.select("is_pac", "ext").distinct().agg(
        F.count(F.when(F.col("is_pac"), 1)).alias("unique_pac_extensions"),
        F.count(F.when(~F.col("is_pac"), 1)).alias("unique_other_extensions"))
    t = t.select("*", kinds.select("unique_pac_extensions").scalar().alias("unique_pac_extensions"),
                 kinds.select("unique_other_extensions").scalar().alias("unique_other_extensions"))
    return t.withColumn("cochange_rate", F.when(F.col("total_commits") > 0,
                                                F.col("commits_with_other_files") / F.col("total_commits") * 100))


def extension_share(ext_rows: DataFrame) -> DataFrame:
    """Per side, the share of commits containing the extension, in percent.

    Denominators: all PaC commits (pac side), commits with other files
    (other side); joined on ``side`` (two rows).
    """
    c = extension_counts(ext_rows)
    d = F.broadcast(side_totals(ext_rows))  # at most two rows: one per side
    return (c.join(d, "side", "left")
            .withColumn("percentage",
                        F.when(F.col("side_commits") > 0, F.col("commits") / F.col("side_commits") * 100)
                        .otherwise(F.lit(0.0)))
            .drop("side_commits"))


def top_extensions(ext_rows: DataFrame, k: int = TOP_EXTENSIONS) -> DataFrame:
    """T5 (T7 with ``k=5``): ``k`` most frequent extensions per side; ties by name."""
    w = Window.partitionBy("side").orderBy(F.col("commits").desc(), F.col("ext"))
    return (extension_counts(ext_rows).withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k))


def signatures(transactions: DataFrame) -> DataFrame:
    """Two-sided transactions grouped by their (PaC set, other set), weighted."""
    two = transactions.filter((F.size("pac_extensions") > 0) & (F.size("other_extensions") > 0))
    return two.groupBy("pac_extensions", "other_extensions").agg(F.count(F.lit(1)).alias("w"))


def cochange_pairs(transactions: DataFrame) -> DataFrame:
    """J8 + A15: commits in which PaC extension ``a`` changes with other extension ``b``."""
    return _pairs(signatures(transactions))


def _pairs(sig: DataFrame) -> DataFrame:
    return (sig.select(F.explode("pac_extensions").alias("pac_extension"), "other_extensions", "w")
            .select("pac_extension", F.explode("other_extensions").alias("other_extension"), "w")
            .groupBy("pac_extension", "other_extension").agg(F.sum("w").cast("long").alias("count")))


def frequent_signatures(sig: DataFrame, ant: DataFrame, con: DataFrame, min_count: Column) -> DataFrame:
    """Signatures with the frequent extensions only (first columns of ``ant`` and ``con``).

    With ``min_count`` at a share of all transactions, the items above it are at most the mean number of items
    of a transaction over that share, so each list is one small value; a threshold of 1 or less prunes nothing.
    """
    for side, items in (("pac_extensions", ant), ("other_extensions", con)):
        kept = items.filter(min_count > 1).agg(F.collect_list(items.columns[0])).scalar()
        sig = sig.withColumn(side, F.when(min_count > 1, F.array_intersect(side, kept)).otherwise(F.col(side))).filter(F.size(side) > 0)
    return sig


def association_rules(transactions: DataFrame, min_support: float = DEFAULT_MIN_SUPPORT,
                      min_confidence: float = DEFAULT_MIN_CONFIDENCE) -> DataFrame:
    """Rules ``PaC ext -> other ext`` over two-sided transactions only (Q20).

    ``min_support_count = floor(min_support * n)`` in double arithmetic (Q19,
    F8), kept with ``>=``; lift is ``confidence / (consequent count / n)``.
    ``n`` is one number, a scalar subquery of the same plan.

    A pair is at most as frequent as each of its items, so items below the threshold leave the signatures before
    pairs are made: a signature of ten thousand extensions makes pairs of its frequent ones only.
    """
    sig = signatures(transactions)
    # n as a scalar subquery: evaluated once inside the same plan (no driver
    # round trip); with no two-sided transaction there are no pairs either.
    n_lit = sig.agg(F.sum("w").cast("long")).scalar()
    ant = (sig.select(F.explode("pac_extensions").alias("antecedent"), "w")
           .groupBy("antecedent").agg(F.sum("w").cast("long").alias("antecedent_count")))
    con = (sig.select(F.explode("other_extensions").alias("consequent"), "w")
           .groupBy("consequent").agg(F.sum("w").cast("long").alias("consequent_count")))
    min_count = F.floor(F.lit(float(min_support)) * n_lit)
    ant, con = ant.filter(F.col("antecedent_count") >= min_count), con.filter(F.col("consequent_count") >= min_count)
    pairs = _pairs(frequent_signatures(sig, ant, con, min_count)).select(
        F.col("pac_extension").alias("antecedent"), F.col("other_extension").alias("consequent"), "count")
    r = (pairs.filter(F.col("count") >= min_count)
         .join(ant, "antecedent").join(con, "consequent")
         .withColumn("support", F.col("count") / n_lit)
         .withColumn("confidence", F.col("count") / F.col("antecedent_count"))
         .filter(F.col("confidence") >= F.lit(float(min_confidence))))
    cons_support = F.col("consequent_count") / n_lit
    r = r.withColumn("lift", F.when(cons_support > 0, F.col("confidence") / cons_support).otherwise(F.lit(0.0)))
    return r.select("antecedent", "consequent", "support", "confidence", "lift", "count",
                    "antecedent_count", "consequent_count")


def top_rules(rules: DataFrame, k: int = TOP_RULES) -> DataFrame:
    """T3 + T6: rules by confidence, then support (descending); ties by name."""
    return rules.orderBy(F.col("confidence").desc(), F.col("support").desc(),
                         "antecedent", "consequent").limit(k)


def top_rules_by_lift(rules: DataFrame, k: int = TOP_RULES_BY_LIFT) -> DataFrame:
    """Highest lift; ties keep the confidence/support order."""
    return rules.orderBy(F.col("lift").desc(), F.col("confidence").desc(), F.col("support").desc(),
                         "antecedent", "consequent").limit(k)


def cochange_grid(ext_rows: DataFrame, transactions: DataFrame, k: int = GRID_SIZE) -> DataFrame:
    """Pair counts of the top-``k`` PaC x top-``k`` other extensions, zeros filled.

    The two top-``k`` lists (at most ``2k`` rows) are gathered into one row and
    exploded twice, giving the ``k x k`` cells without a join.
    """
    top = top_extensions(ext_rows, k)
    lists = top.agg(
        F.sort_array(F.collect_list(F.when(F.col("side") == "pac", F.struct("rank", "ext")))).alias("p"),
        F.sort_array(F.collect_list(F.when(F.col("side") == "other", F.struct("rank", "ext")))).alias("o"))
    cells = (lists.select(F.explode("p").alias("pa"), "o")
             .select("pa", F.explode("o").alias("ob"))
             .select(F.col("pa.rank").alias("pac_rank"), F.col("pa.ext").alias("pac_extension"),
                     F.col("ob.rank").alias("other_rank"), F.col("ob.ext").alias("other_extension")))
    pairs = cochange_pairs(transactions)
    return (cells.join(pairs, ["pac_extension", "other_extension"], "left")
            .withColumn("count", F.coalesce(F.col("count"), F.lit(0).cast("long"))))
