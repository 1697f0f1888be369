"""Walk positions by the place of the record: which rows, and what reaches the driver for them."""

import os

from pyspark.sql import functions as F

from histofold.operators import records as rec
from histofold.plans.queries import QUERIES

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")

# (repo_id, commit_id, pos, file_path, block, line_id): line ids rise along a split, not from file to file
RECORDS = [
    (1, "a", None, "x", 0, 500), (2, "b", 7, "x", 0, 501), (1, "c", None, "x", 0, 503), (3, "d", None, "x", 0, 504), (1, "e", None, "x", 0, 507),
    (1, "f", None, "x", 64, 20), (3, "g", 4, "x", 64, 21), (1, "h", None, "y", 0, 300), (2, "i", 3, "y", 0, 301), (3, "j", 0, "y", 0, 302),
]


def _nodes(plan):
    """Nodes of an executed plan, through the query stages."""
    yield plan
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        yield from _nodes(plan.executedPlan())
    elif kind.endswith("QueryStageExec"):
        yield from _nodes(plan.plan())
    for i in range(plan.children().size()):
        yield from _nodes(plan.children().apply(i))


def broadcast_rows(df):
    """Rows that the driver collected to broadcast them; ``df`` has run."""
    found = [n for n in _nodes(df._jdf.queryExecution().executedPlan()) if n.getClass().getSimpleName() == "BroadcastExchangeExec"]
    return sum(n.metrics().apply("numOutputRows").value() for n in found)


def test_positions_of_repositories_that_lack_some(spark):
    records = spark.createDataFrame(RECORDS, "repo_id long, commit_id string, pos int, file_path string, block long, line_id long").withColumn(
        "message", F.concat(F.lit("m "), "commit_id"))
    got = rec.walk_positions(records, rec.walks(records.withColumns({"parents": F.lit(None), "parent_count": F.lit(1)})).filter("lacks_pos"))
    assert sorted(got.dtypes) == sorted(records.dtypes)
    want = {"a": 0, "c": 1, "e": 2, "f": 3, "h": 4, "d": 0, "g": 1, "j": 2, "b": 7, "i": 3}
    rows = got.collect()
    assert len(rows) == len(RECORDS) and {r.commit_id: r.pos for r in rows} == want
    origin = {(r.repo_id, r.commit_id, r.file_path, r.block, r.line_id, r.message) for r in rows}
    assert origin == {(repo, c, path, block, line, f"m {c}") for repo, c, _, path, block, line in RECORDS}


def test_no_records_reach_the_driver(spark):
    """The records' places were broadcast: by their packed size they look small, in the driver's memory they are not."""
    df = QUERIES["walk_positions"](spark, SF)
    n = len(df.collect())
    assert n == spark.read.parquet(f"{SF}/orders.parquet").count()
    assert broadcast_rows(df) < n / 5
