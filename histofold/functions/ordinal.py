"""Exact 0-based ordinals within a group without sorting a whole group in one task.

``row_number().over(Window.partitionBy(g).orderBy(k))`` sends every row of a
group to one task; with one repository holding a third of all commits that
task sorts a third of the data.  Instead:

1. cut the order into coarse buckets ``b = bucket(k)`` that are monotone in the
   order (``floor(k / width)`` for a numeric key);
2. count rows per ``(g, b)`` -- a partial (map-side) aggregate, tiny output;
3. prefix-sum those counts per group over the buckets -- a window over the
   small count table only;
4. join the offsets back and number rows inside ``(g, b)``, whose size is
   bounded by the bucket width, so the window's hash partitioning on
   ``(g, b)`` spreads a hot group over many tasks.

The result equals ``row_number() - 1`` over the full order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordinal(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[Column],
            bucket: Column, bucket_descending: bool = False, name: str = "pos") -> DataFrame:
    """Add ``name`` = 0-based position of each row in ``order_cols`` within ``group_cols``.

    ``bucket`` must be non-decreasing along ``order_cols`` (non-increasing when
    ``bucket_descending``).  ``order_cols`` must be a total order inside a group.
    """
    g = list(group_cols)
    b = "__bucket"
    with_b = df.withColumn(b, bucket)
    counts = with_b.groupBy(*g, b).agg(F.count(F.lit(1)).alias("__n"))
    border = F.col(b).desc() if bucket_descending else F.col(b).asc()
    w = Window.partitionBy(*g).orderBy(border).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*g, b, F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    inner = Window.partitionBy(*g, b).orderBy(*order_cols)
    return (with_b.join(offsets, on=[*g, b], how="inner")
            .withColumn(name, (F.col("__off") + F.row_number().over(inner) - 1).cast("int"))
            .drop(b, "__off"))


def file_row_number(scans: DataFrame | Sequence[DataFrame], name: str = "idx") -> DataFrame:
    """1-based row number in file order (file path, then position in the file).

    ``scans`` must come straight from file scans (several are stacked; a file belongs to one of
    them).  Every scan split (a file, or a block of a splittable file) is read by one task in order, so
    ``monotonically_increasing_id`` is consecutive inside a split.  A split
    table (one row per split: first id and row count) gets prefix sums in
    split order; rows add their offset inside the split.  Only the split table,
    whose size is the number of splits, passes through one task.
    """
    tagged = [d.withColumns({"__file": F.col("_metadata.file_path"), "__block": F.col("_metadata.file_block_start"),
                             "__mid": F.monotonically_increasing_id()})
              for d in ([scans] if isinstance(scans, DataFrame) else scans)]
    d = reduce(DataFrame.unionByName, tagged)
    splits = d.groupBy("__file", "__block").agg(F.min("__mid").alias("__m0"),
                                                F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("__file", "__block", "__m0",
                            F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    return (d.join(offsets, ["__file", "__block"], "inner")
            .withColumn(name, (F.col("__off") + F.col("__mid") - F.col("__m0") + 1).cast("int"))
            .drop("__file", "__block", "__mid", "__m0", "__off"))
