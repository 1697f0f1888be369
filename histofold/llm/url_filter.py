"""URL filters: dated list entries become validity intervals, joined as of each capture's fetch time.

``intervals`` turns events (list, pattern, time, active) into [from, to) intervals, one per
change; ``judge`` looks up every capture under its host, each parent domain of the host, and
each of these with the first path segment, and keeps the entries active at fetch time.

The as-of condition rides on an equi-join by pattern: intervals of one (list, pattern) do not
overlap, so a capture meets at most one active interval per list and pattern, whatever the
history.  A domain that holds a third of all captures is a skewed partition of the capture
side only, which Spark splits; no window over captures, no cross join.

Defined cases: of several events of a list and pattern at one time, activation wins; events
without list, pattern, time or state say nothing; a capture without a valid host or time
matches nothing and passes; empty texts likewise; repeated captures are judged each;
patterns are compared in lower case without a trailing dot; empty tables give an empty or
unfiltered result; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histofold.llm.common import OWN, refuse


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without user, port and trailing dot; empty where there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"(:\d*)?$|\.(:\d*)?$", ""))


def segment_of(url: Column) -> Column:
    """First path segment, empty where there is none."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)", 1)


def patterns_of(url: Column) -> Column:
    """Host, parent domains of two labels or more, and each with the first path segment; longest first."""
    labels = F.split(host_of(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
                          lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segment = F.lower(segment_of(url))
    deep = F.when(segment != "", F.transform(domains, lambda d: F.concat(d, F.lit("/"), segment))).otherwise(
        F.array().cast("array<string>"))
    return F.filter(F.array_distinct(F.concat(deep, domains)), lambda p: (p != "") & ~p.startswith("/"))


def intervals(events: DataFrame, list_col: str = "list", pattern_col: str = "pattern", time_col: str = "time",
              active_col: str = "active") -> DataFrame:
    """(list, pattern, valid_from, valid_to) of the active periods; an open end is null."""
    e = events.select(F.col(list_col).alias("list"), F.rtrim(F.lower(F.col(pattern_col)), F.lit(".")).alias("pattern"),
                      F.col(time_col).alias("time"), F.col(active_col).cast("boolean").alias("active")).dropna()
    e = e.groupBy("list", "pattern", "time").agg(F.max("active").alias("active"))
    w = Window.partitionBy("list", "pattern").orderBy("time")  # the history of one entry
    return (e.withColumn("until", F.lead("time").over(w)).where("active")
            .select("list", "pattern", F.col("time").alias("valid_from"), F.col("until").alias("valid_to")))


def judge(captures: DataFrame, events: DataFrame, url_col: str = "url", time_col: str = "fetched",
          **names: str) -> DataFrame:
    """``captures`` with blocked, n_lists, lists (sorted) and matched (its most specific active pattern).

    Columns of these names in ``captures`` are refused, and so are map columns (rows are grouped by all columns).
    """
    refuse(captures, "blocked", "n_lists", "lists", "matched")
    valid = intervals(events, **names)
    rows = captures.withColumn(f"{OWN}row", F.monotonically_increasing_id())
    keyed = rows.withColumn(f"{OWN}pattern", F.explode_outer(patterns_of(F.col(url_col))))
    v = valid.select(F.col("list").alias(f"{OWN}list"), F.col("pattern").alias(f"{OWN}entry"),
                     F.col("valid_from").alias(f"{OWN}from"), F.col("valid_to").alias(f"{OWN}to"))
    at = F.col(time_col)
    active = (F.col(f"{OWN}pattern") == F.col(f"{OWN}entry")) & (at >= F.col(f"{OWN}from")) & (
        F.col(f"{OWN}to").isNull() | (at < F.col(f"{OWN}to")))
    joined = keyed.join(v, active, "left")
    longest = F.max(F.struct(F.length(f"{OWN}entry"), F.col(f"{OWN}entry")))
    out = joined.groupBy(f"{OWN}row", *captures.columns).agg(
        F.sort_array(F.collect_set(f"{OWN}list")).alias(f"{OWN}lists"), longest.alias(f"{OWN}longest"))
    return out.select(*captures.columns, (F.size(f"{OWN}lists") > 0).alias("blocked"),
                      F.size(f"{OWN}lists").cast("long").alias("n_lists"), F.col(f"{OWN}lists").alias("lists"),
                      F.col(f"{OWN}longest.{OWN}entry").alias("matched"))


def allowed(captures: DataFrame, events: DataFrame, **names: str) -> DataFrame:
    """The captures that no active entry blocks."""
    return judge(captures, events, **names).where(~F.col("blocked")).select(*captures.columns)
