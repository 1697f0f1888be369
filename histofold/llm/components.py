"""Connected components of an edge table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histofold.llm.common import Scratch


def components(edges: DataFrame, store: Scratch, name: str) -> DataFrame:
    """(node, comp) of every node of edges(a, b); comp is the smallest node reachable.

    Each round takes the smallest label among the neighbours (a partial aggregate, so a
    hub with many neighbours is merged map-side) and then the label of that label, which
    halves the distance left.  Every round is written, which cuts the lineage.
    """
    both = store.save(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
                      f"{name}-edges")
    labels = store.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")),
                        f"{name}-0")
    done, turn = False, 0
    while not done:
        turn += 1
        near = (both.join(labels.select(F.col("node").alias("b"), "comp"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near")))
        lower = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("comp").alias("next"))
        after = lower.join(jump, "to", "left").select("node", "was", F.least("to", "next").alias("comp"))
        after = store.save(after, f"{name}-{turn}")
        done = after.where("was <> comp").isEmpty()
        store.drop(f"{name}-{turn - 1}")
        labels = after.select("node", "comp")
    return labels
