"""Per-repository maintenance metrics.

The analysed pipeline sorts every repository's commits by ``(date, walk
position)``, finds the first commit with a PaC change and slices from there.
Here no repository is sorted: the first PaC commit is the minimum of
``(date, pos)`` over PaC commits (two partial hash aggregates over primitive
columns, so any 64-bit date works), it is joined back (one row per
repository) and the slice is a comparison of the two columns.  Its index is the count of
commits strictly before it.  A5 and the counts of A6 and A8 are one aggregation; A7 needs a
second level for distinct authors.

Repositories without commits or without any PaC commit give no row (Q12).
Empty medians are 0 in repository rows (Q13); medians are exact, by counts and
ranks (``functions.quantile``): no repository's values meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histofold.functions.quantile import exact_quantiles


def order_date() -> Column:
    """Date of the stable order (missing -> 0, Q10); ties go by walk position (Q9)."""
    return F.coalesce(F.col("date").cast("long"), F.lit(0).cast("long"))


def first_pac(facts: DataFrame, with_name: bool = False) -> DataFrame:
    """Per repository: ``first_date`` and ``first_pos`` of its first PaC commit.

    The smallest position of each date first, then the smallest date with its
    position: both are hash aggregates with map-side combine.
    """
    keys = ["repo_id", "project_name"] if with_name else ["repo_id"]
    by_date = (facts.filter("has_pac_changes").groupBy(*keys, order_date().alias("__d"))
               .agg(F.min("pos").alias("__p")))
    return by_date.groupBy(*keys).agg(F.min("__d").alias("first_date"), F.min_by("__p", "__d").alias("first_pos"))


def _with_first(facts: DataFrame) -> DataFrame:
    """Inner join with the first PaC commit: repositories without one drop out."""
    return facts.join(first_pac(facts), "repo_id", "inner")


def _after() -> Column:
    d = order_date()
    return (d > F.col("first_date")) | ((d == F.col("first_date")) & (F.col("pos") >= F.col("first_pos")))


def since_first_pac(facts: DataFrame) -> DataFrame:
    """The commits of each repository from its first PaC commit on (inclusive, Q11)."""
    return _with_first(facts).filter(_after()).drop("first_date", "first_pos")


# Commits numbered together: those of one hour, and of one date in blocks of
# this many walk positions (a bulk import, or all commits without a date).
HOUR = 3_600
POS_BLOCK = 65_536


def commit_index(facts: DataFrame, width: int = HOUR) -> DataFrame:
    """W1 + T1: each commit's 0-based index in its repository's stable date order.

    Computed with ``functions.ordinal`` over buckets that follow the order, so
    no repository is sorted in one task.  A date held by commits more than a
    block of positions apart (a bulk import, missing dates) is a bucket
    sequence of its own, cut by walk position.
    """
    from histofold.functions.ordinal import ordinal
    k = facts.select("repo_id", "commit_id", "date", "pos", order_date().alias("__d"))
    wide = (k.groupBy("repo_id", "__d").agg((F.max("pos") - F.min("pos") >= POS_BLOCK).alias("__wide"))
            .filter("__wide"))
    k = k.join(wide, ["repo_id", "__d"], "left")
    slot = F.floor(F.col("__d") / F.lit(width))
    hot = F.coalesce(F.col("__wide"), F.lit(False))
    # within an hour: every other commit's place relative to the hot dates is its own date
    bucket = F.struct(slot.alias("hour"), F.when(F.col("__any"), F.col("__d")).otherwise(F.lit(0).cast("long")).alias("date"),
                      F.when(hot, F.floor(F.col("pos") / F.lit(POS_BLOCK))).otherwise(F.lit(0)).alias("block"))
    hours = wide.select("repo_id", slot.alias("__h")).distinct().withColumn("__any", F.lit(True))
    k = (k.withColumn("__h", slot).join(hours, ["repo_id", "__h"], "left")
         .withColumn("__any", F.coalesce("__any", F.lit(False))))
    return (ordinal(k, ["repo_id"], [F.col("__d"), F.col("pos")], bucket=bucket, name="idx")
            .select("repo_id", "commit_id", "date", "pos", F.col("idx").cast("long").alias("idx")))


def first_pac_index(facts: DataFrame) -> DataFrame:
    """0-based index of the first PaC commit in date order, -1 if none."""
    f = facts.join(first_pac(facts), "repo_id", "left")
    before = F.col("first_date").isNotNull() & ~_after()
    return (f.groupBy("repo_id", "project_name")
            .agg(F.count(F.lit(1)).alias("total_commits"),
                 F.count(F.when(before, 1)).alias("__before"),
                 F.max(F.col("first_date").isNotNull().cast("int")).alias("__has"))
            .select("repo_id", F.col("project_name").alias("repository"), "total_commits",
                    F.when(F.col("__has") == 1, F.col("__before")).otherwise(F.lit(-1))
                    .cast("long").alias("first_pac_commit_index")))


def _ratio_pct(num: str, den: str) -> Column:
    return F.when(F.col(den) > 0, F.col(num) / F.col(den) * 100).otherwise(F.lit(0.0))


# Relative accuracy of the optional approximate medians (1 / accuracy).
APPROX_ACCURACY = 10_000


def _medians(long: DataFrame, keys: list[str], series: str, value: str, exact: bool = True) -> DataFrame:
    """``(keys, series, n, q)`` with ``q[0]`` the median: exact by counts and ranks (``functions.quantile``) or, only
    when asked, ``percentile_approx``."""
    if exact:
        return exact_quantiles(long, [*keys, series], value)
    return (long.where(F.col(value).isNotNull()).groupBy(*keys, series)
            .agg(F.count(F.lit(1)).alias("n"),
                 F.array(F.percentile_approx(value, 0.5, APPROX_ACCURACY).cast("double")).alias("q")))


def _agg0(fn, c: Column) -> Column:
    return F.coalesce(fn(c).cast("long"), F.lit(0).cast("long"))


def _sizes() -> dict[str, Column]:
    """Line counts by series, null where a commit is not part of it (A6: all commits of the slice; A8: positive ones)."""
    after, has = _after(), F.col("has_pac_changes")
    size = F.col("total_added_lines") + F.col("total_deleted_lines")
    pac_size = F.col("pac_added_lines") + F.col("pac_deleted_lines")
    non_pac = size - pac_size
    return {"pac_commit_median_size": F.when(after & has, size),
            "non_pac_commit_median_size": F.when(after & ~has, size),
            "pac_code_median_changes": F.when(after & has & (pac_size > 0), pac_size),
            "non_pac_code_median_changes": F.when(after & has & (non_pac > 0), non_pac),
            "non_pac_only_median_changes": F.when(after & ~has & (size > 0), size)}


# Medians of A6 and of A8.
SIZE_MEDIANS = ("pac_commit_median_size", "non_pac_commit_median_size")
CHANGE_MEDIANS = ("pac_code_median_changes", "non_pac_code_median_changes", "non_pac_only_median_changes")


def slice_metrics(facts: DataFrame, exact: bool = True,
                  medians: tuple[str, ...] = SIZE_MEDIANS + CHANGE_MEDIANS) -> DataFrame:
    """A5 + A6 + A8 over the since-first-PaC slice: one aggregation for counts, minima and maxima, one for ``medians``."""
    f = _with_first(facts)
    after, has = _after(), F.col("has_pac_changes")
    sizes = _sizes()
    pv, nv, ov = (sizes[c] for c in CHANGE_MEDIANS)
    g = f.groupBy("repo_id", "project_name").agg(
        F.count(F.when(after, 1)).alias("total_commits"),
        F.count(F.when(after & has, 1)).alias("pac_commits"),
        F.count(F.when(~after, 1)).alias("first_pac_commit_index"),
        F.count(pv).alias("pac_commits_with_changes"),
        _agg0(F.min, pv).alias("pac_changes_min"),
        _agg0(F.max, pv).alias("pac_changes_max"),
        F.count(nv).alias("non_pac_commits_with_changes"),
        _agg0(F.min, nv).alias("non_pac_changes_min"),
        _agg0(F.max, nv).alias("non_pac_changes_max"),
        F.count(ov).alias("non_pac_only_commits_count"),
        _agg0(F.min, ov).alias("non_pac_only_changes_min"),
        _agg0(F.max, ov).alias("non_pac_only_changes_max"))
    if medians:
        long = _stacked(f.select("repo_id", *[sizes[c].alias(c) for c in medians]), "__series", "__size",
                        {c: c for c in medians}, "repo_id")
        found = _medians(long, ["repo_id"], "__series", "__size", exact).groupBy("repo_id").agg(
            *[F.max(F.when(F.col("__series") == c, F.col("q")[0])).alias(c) for c in medians])
        g = g.join(found, "repo_id", "left").fillna(0.0, list(medians))
    return (g.withColumn("non_pac_commits", F.col("total_commits") - F.col("pac_commits"))
            .withColumn("pac_maintenance_frequency", _ratio_pct("pac_commits", "total_commits"))
            .withColumnRenamed("project_name", "repository"))


def pac_frequency(facts: DataFrame) -> DataFrame:
    """A5: share of commits that change PaC files after the first one, in percent."""
    return slice_metrics(facts, medians=()).select("repo_id", "repository", "total_commits", "pac_commits",
                                                   "pac_maintenance_frequency", "first_pac_commit_index")


def commit_size_medians(facts: DataFrame, exact: bool = True) -> DataFrame:
    """Median commit size (all lines) of PaC and non-PaC commits in the slice."""
    return slice_metrics(facts, exact, SIZE_MEDIANS).select(
        "repo_id", "repository", F.col("pac_commits").alias("pac_commits_count"),
        F.col("non_pac_commits").alias("non_pac_commits_count"), *SIZE_MEDIANS)


def code_change_sizes(facts: DataFrame, exact: bool = True) -> DataFrame:
    """Count / median / min / max of positive PaC, non-PaC-in-PaC and non-PaC-only sizes."""
    return slice_metrics(facts, exact, CHANGE_MEDIANS).select(
        "repo_id", "repository",
        "pac_commits_with_changes", "pac_code_median_changes", "pac_changes_min", "pac_changes_max",
        "non_pac_commits_with_changes", "non_pac_code_median_changes", "non_pac_changes_min",
        "non_pac_changes_max", "non_pac_only_commits_count", "non_pac_only_median_changes",
        "non_pac_only_changes_min", "non_pac_only_changes_max")


def maintainer_share(facts: DataFrame) -> DataFrame:
    """Distinct non-empty authors with a PaC commit / distinct non-empty authors (Q15)."""
    s = since_first_pac(facts).filter(F.col("author") != "")
    per_author = (s.groupBy("repo_id", "project_name", "author")
                  .agg(F.max(F.col("has_pac_changes").cast("int")).alias("__pac")))
    per_repo = (per_author.groupBy("repo_id", "project_name")
                .agg(F.count(F.lit(1)).alias("total_authors"),
                     F.sum("__pac").cast("long").alias("pac_authors")))
    # Repositories in the slice whose authors are all empty still get a row.
    repos_in_slice = first_pac(facts, with_name=True).select("repo_id", "project_name")
    out = (repos_in_slice.join(per_repo, ["repo_id", "project_name"], "left")
           .select("repo_id", F.col("project_name").alias("repository"),
                   F.coalesce("total_authors", F.lit(0)).cast("long").alias("total_authors"),
                   F.coalesce("pac_authors", F.lit(0)).cast("long").alias("pac_authors")))
    return out.withColumn("pac_maintainer_percentage", _ratio_pct("pac_authors", "total_authors"))


def repo_metrics(facts: DataFrame, exact: bool = True,
                 medians: tuple[str, ...] = SIZE_MEDIANS + CHANGE_MEDIANS) -> DataFrame:
    """A5-A8 side by side, one row per repository with a PaC commit."""
    a7 = maintainer_share(facts).drop("repository")
    return slice_metrics(facts, exact, medians).join(a7, "repo_id", "inner")


# Median over the repositories (A9) -> metric; those of the second table skip zeros (Q17).
CORPUS_MEDIANS = {
    "median_pac_maintenance_frequency": "pac_maintenance_frequency", "median_pac_commits": "pac_commits",
    "median_total_commits": "total_commits", "median_pac_maintainer_percentage": "pac_maintainer_percentage",
    "median_pac_authors": "pac_authors", "median_total_authors": "total_authors",
    "median_pac_commit_size": "pac_commit_median_size", "median_non_pac_commit_size": "non_pac_commit_median_size",
    "median_pac_code_changes": "pac_code_median_changes"}
CORPUS_MEDIANS_POSITIVE = {
    "median_non_pac_code_changes": "non_pac_code_median_changes",
    "median_non_pac_only_changes": "non_pac_only_median_changes"}
# Numbers of repositories whose metric is positive.
CORPUS_COUNTS = {"repos_with_pac_changes": "pac_commits_with_changes", "repos_with_non_pac_only": "non_pac_only_commits_count"}


def corpus_medians(facts: DataFrame, exact: bool = True) -> DataFrame:
    """Cross-repository medians; the two non-PaC code medians skip zeros (Q17).

    The metrics are computed once and stacked; every number is the count or the median of one series."""
    m = repo_metrics(facts, exact)
    values = {name: F.col(c).cast("double") for name, c in CORPUS_MEDIANS.items()}
    values |= {name: F.when(F.col(c) > 0, F.col(c).cast("double")) for name, c in CORPUS_MEDIANS_POSITIVE.items()}
    values |= {name: F.when(F.col(c) > 0, F.lit(1.0)) for name, c in CORPUS_COUNTS.items()}
    long = _stacked(m.select(*[v.alias(name) for name, v in values.items()]), "__series", "__x", {c: c for c in values})
    found = _medians(long, [], "__series", "__x", exact)

    def of(series: str, c: Column) -> Column:
        return F.max(F.when(F.col("__series") == series, c))

    def count_of(series: str) -> Column:
        return F.coalesce(of(series, F.col("n")), F.lit(0).cast("long"))

    return found.agg(
        count_of("median_total_commits").alias("repositories"),
        *[of(name, F.col("q")[0]).alias(name) for name in (*CORPUS_MEDIANS, *CORPUS_MEDIANS_POSITIVE)],
        *[count_of(name).alias(name) for name in CORPUS_COUNTS])


def split_full_name(df: DataFrame, col: str = "project_name") -> DataFrame:
    """P10: owner / repository of ``owner/repo`` (only segments 0 and 1, Q25)."""
    parts = F.split(F.col(col), "/")
    ok = F.col(col).contains("/")
    return (df.withColumn("owner_name", F.when(ok, parts.getItem(0)))
            .withColumn("repository_name", F.when(ok, parts.getItem(1))))


def repo_fold(facts: DataFrame) -> DataFrame:
    """A3: repository totals over all non-merge commits."""
    g = facts.groupBy("repo_id", "project_name").agg(
        F.count(F.lit(1)).alias("total_commits"),
        F.sum("pac_files_count").cast("long").alias("pac_changes_count"),
        F.count(F.when(F.col("has_pac_changes"), 1)).alias("pac_commits_count"),
        F.sum("total_added_lines").cast("long").alias("total_added_lines"),
        F.sum("total_deleted_lines").cast("long").alias("total_deleted_lines"),
        F.sum("pac_added_lines").cast("long").alias("pac_added_lines"),
        F.sum("pac_deleted_lines").cast("long").alias("pac_deleted_lines"))
    g = (g.withColumn("pac_change_ratio",
                      F.when(F.col("total_commits") > 0,
                             F.col("pac_changes_count") / F.col("total_commits")).otherwise(F.lit(0.0)))
         .withColumn("total_modified_lines", F.col("total_added_lines") + F.col("total_deleted_lines"))
         .withColumn("pac_modified_lines", F.col("pac_added_lines") + F.col("pac_deleted_lines")))
    return split_full_name(g).withColumnRenamed("repo_id", "repository_id")


def corpus_summary(facts: DataFrame) -> DataFrame:
    """A4: corpus totals and the two ratios (null when there are no commits)."""
    r = repo_fold(facts)
    s = r.agg(F.count(F.lit(1)).alias("repositories"),
              F.sum("total_commits").cast("long").alias("total_commits"),
              F.sum("pac_changes_count").cast("long").alias("total_pac_changes"),
              F.sum("pac_commits_count").cast("long").alias("pac_commits"))
    return (s.withColumn("pac_change_ratio", F.when(F.col("total_commits") > 0,
                                                    F.col("total_pac_changes") / F.col("total_commits")))
            .withColumn("pac_commit_ratio", F.when(F.col("total_commits") > 0,
                                                   F.col("pac_commits") / F.col("total_commits"))))


# Labels of the three code-change series.
CODE_TYPE_PAC = "PAC Code\n(in PAC commits)"
CODE_TYPE_NON_PAC_IN_PAC = "Non-PAC Code\n(in PAC commits)"
CODE_TYPE_NON_PAC_ONLY = "Non-PAC Code\n(in non-PAC commits)"


def code_changes_long(facts: DataFrame) -> DataFrame:
    """U4: the three positive median series tagged and stacked into long form."""
    return (_stacked(code_change_sizes(facts), "code_type", "median_lines_changed", {
        CODE_TYPE_PAC: "pac_code_median_changes", CODE_TYPE_NON_PAC_IN_PAC: "non_pac_code_median_changes",
        CODE_TYPE_NON_PAC_ONLY: "non_pac_only_median_changes"}, "repository")
        .filter(F.col("median_lines_changed") > 0))


def _stacked(m: DataFrame, tag: str, value: str, series: dict[str, str], *keys: str) -> DataFrame:
    """Columns of ``series`` (label -> column) as rows, in one pass over ``m``."""
    one = [F.struct(F.lit(label).alias(tag), F.col(c).alias(value)) for label, c in series.items()]
    return m.select(*keys, F.explode(F.array(*one)).alias("__s")).select(*keys, f"__s.{tag}", f"__s.{value}")


def boxplot_summary(facts: DataFrame) -> DataFrame:
    """Box-plot numbers of the positive PaC / non-PaC code-change medians.

    Quartiles are exact with linear interpolation; whiskers are the most
    extreme values within 1.5 IQR of the box; outliers lie beyond.
    """
    m = code_change_sizes(facts)
    long = _stacked(m, "series", "v", {"PaC Files": "pac_code_median_changes",
                                       "Non-PaC Files": "non_pac_code_median_changes"}).filter(F.col("v") > 0)
    q = exact_quantiles(long, ["series"], "v", (0.25, 0.5, 0.75)).select(
        "series", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    q = (q.withColumn("lo_fence", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")))
         .withColumn("hi_fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))))
    j = long.join(F.broadcast(q), "series")  # q has one row per series (two rows)
    inside = (F.col("v") >= F.col("lo_fence")) & (F.col("v") <= F.col("hi_fence"))
    return j.groupBy("series", "q1", "median", "q3").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("v").alias("min"), F.max("v").alias("max"),
        F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        F.count(F.when(~inside, 1)).alias("outliers"))


def share_histogram(facts: DataFrame, width: float = 5.0) -> DataFrame:
    """Fixed-width histogram of the two percentage metrics (data behind the violins)."""
    m = repo_metrics(facts, medians=())
    long = _stacked(m, "metric", "x", {c: c for c in ("pac_maintenance_frequency", "pac_maintainer_percentage")})
    return (long.groupBy("metric", (F.floor(F.col("x") / width) * width).cast("double").alias("bin_start"))
            .agg(F.count(F.lit(1)).alias("repositories")))
