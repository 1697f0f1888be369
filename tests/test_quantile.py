"""Exact quantiles by counts and ranks against ``percentile`` and plain Python."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from histofold.functions.quantile import PER_OCTAVE, block, exact_quantiles

QS = (0.0, 0.25, 0.5, 0.9, 1.0)


def _values():
    rnd = random.Random(7)
    rows = [("hot", float(int(rnd.lognormvariate(4, 3)))) for _ in range(4000)]
    rows += [("shares", rnd.randrange(1, 60) / rnd.randrange(60, 99) * 100) for _ in range(1500)]
    rows += [("signed", rnd.choice([-1, 1]) * 2.0 ** rnd.randrange(-40, 50) * rnd.choice([1, 1 - 2**-53, 1 + 2**-52])) for _ in range(900)]
    rows += [("one", 3.5), ("two", -1.0), ("two", 4.0), ("same", 9.0), ("same", 9.0), ("zero", 0.0), ("zero", None)]
    return rows + [("none", None)]


def test_equal_to_percentile(spark):
    d = spark.createDataFrame(_values(), "k string, v double").repartition(5)
    want = {r.k: r for r in d.where("v IS NOT NULL").groupBy("k").agg(
        F.count("v").alias("n"), F.percentile("v", F.array(*map(F.lit, QS))).alias("q")).collect()}
    got = {r.k: r for r in exact_quantiles(d, ["k"], "v", QS).collect()}
    assert set(got) == set(want) and "none" not in got
    for k, w in want.items():
        assert got[k].n == w.n and got[k].q == w.q, k
        assert got[k].q[2] == pytest.approx(statistics.median([v for x, v in _values() if x == k and v is not None]))


def test_blocks_follow_the_values(spark):
    ordered = [r.b for r in spark.createDataFrame([(v,) for _, v in _values() if v is not None], "v double")
               .select("v", block(F.col("v")).alias("b")).orderBy("v").collect()]
    assert ordered == sorted(ordered)
    # whole numbers below PER_OCTAVE have a block each; no block of a hot group is wider than its share of an octave
    whole = spark.range(1, 1 << 16).select(block(F.col("id")).alias("b")).groupBy("b").count()
    assert whole.agg(F.max("count")).first()[0] == (1 << 15) // PER_OCTAVE


def test_integers_and_two_keys_and_empty(spark):
    d = spark.range(10_001).select((F.col("id") % 2).alias("a"), (F.col("id") % 3).cast("string").alias("b"), "id")
    for r in exact_quantiles(d, ["a", "b"], "id").collect():
        assert r.q[0] == statistics.median([i for i in range(10_001) if i % 2 == r.a and str(i % 3) == r.b])
    assert exact_quantiles(d.limit(0), ["a"], "id").count() == 0
