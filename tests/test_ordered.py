"""Running sums, places and quantiles of groups that lie in many parts."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quirespark.operators import events, ordered, stats


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = [(rng.choice(["a", "a", "a", "b", None]), i, float(rng.randrange(40)) if rng.random() < 0.9 else None) for i in range(900)]
    return spark.createDataFrame(data + [("one", 9999, 5.0)], "k string, i int, v double").repartition(7)


def test_running_sums_cross_parts(spark, rows):
    got = ordered.before(rows, ["k"], [F.desc("i")], F.col("v"), "sum")
    w = Window.partitionBy("k").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)
    want = rows.withColumn("sum", F.coalesce(F.sum(F.coalesce("v", F.lit(0.0))).over(w), F.lit(0.0)))
    assert sorted((r.i, r["sum"]) for r in got.collect()) == sorted((r.i, r["sum"]) for r in want.collect())
    places = ordered.numbered(rows, ["k"], [F.asc("i")], "n").groupBy("k").agg(F.sort_array(F.collect_list("n")).alias("ns")).collect()
    assert all(r.ns == list(range(len(r.ns))) for r in places) and got.columns == ["k", "i", "v", "sum"]


def test_quantiles_are_those_of_percentile(spark, rows):
    shares = [0.0, 0.03, 0.25, 0.5, 0.97, 1.0]
    got = {r.k: (r.n, r.q) for r in ordered.quantiles(rows, ["k"], "v", shares).collect()}
    want = {r.k: (r.n, r.q) for r in rows.groupBy("k").agg(F.count("v").alias("n"), F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)
    assert ordered.quantiles(rows.limit(0), ["k"], "v", shares).count() == 0


def test_mean_ranks(spark):
    frame = spark.createDataFrame([("a", 1, 3.0), ("a", 2, 1.0), ("a", 3, 3.0), ("a", 4, None), (None, 5, 2.0)], "k string, i int, v double")
    assert {r.i: r.rank for r in ordered.mean_ranks(frame, ["k"], "v", "rank").collect()} == {1: 2.5, 2: 1.0, 3: 2.5, 4: None, 5: 1.0}
    both = spark.createDataFrame([("a", float(i), float(i * i)) for i in range(30)], "k string, x double, y double")
    assert stats.spearman(both, "k", "x", "y").first().rho == pytest.approx(1.0)


def test_trailing_pace_at_the_edges_of_stretches(spark):
    rng = random.Random(8)
    data = [(i, rng.choice(["a", "b"]), rng.randrange(60 * 60 * 5)) for i in range(600)] + [(1000 + j, "a", s) for j, s in enumerate((2399, 2400, 2401, 1800, 1801, 4799, 4800, 0))]
    frame = spark.createDataFrame(data, "event_id int, k string, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.event_id: (r.n, r.peak) for r in events.trailing_pace(frame, "k", "ts", 10, 20, 0.25).collect()}
    for i, k, s in data:
        assert got[i][0] == sum(1 for _, q, t in data if q == k and s - 599 <= t <= s)
        assert got[i][1] == max(got[j][0] for j, q, t in data if q == k and (t, j) <= (s, i))
