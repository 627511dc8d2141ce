"""Outputs per key without an array of the key's rows."""

import random

from pyspark.sql import functions as F

from labelforge.operators import reconcile
from labelforge.plans.queries import QUERIES
from labelforge.streaming import events as feed

SF = "/root/testdata/sf0.001"


def test_no_query_gathers_a_key(spark):
    for name in ("review_stage", "nest_findings", "best_reading_fold"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert "collect_list" not in plan and "collect_set" not in plan, name


def test_best_readings_is_the_fold_of_better(spark):
    pick = random.Random(3)
    rows = [(pick.randrange(40), k, pick.choice([None, 0.5, 0.55, 0.6, 0.7, float("nan")]), pick.choice([None, "a", "bb", "cc", "😀d", "eeee"])) for k in range(3000)]
    rows += [(1000, k, 0.5, None) for k in range(3)] + [(None, 1, 0.5, "x"), (None, 2, 0.7, "y")]
    df = spark.createDataFrame(rows, "k int, turn int, confidence double, value string")
    pair = lambda r: F.struct(r["confidence"].alias("confidence"), r["value"].alias("value"))
    every = df.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("turn", "confidence", "value"))).alias("a"))
    folded = every.select("k", F.aggregate(F.slice("a", 2, F.size("a")), pair(F.element_at("a", 1)), lambda a, r: reconcile.better(a, pair(r))).alias("b"), F.size("a").alias("n"))
    want = {repr(tuple(r)) for r in folded.select("k", "b.value", "b.confidence", "n").collect()}
    got = reconcile.best_readings(df, ["k"], ["turn"])
    assert {repr(tuple(r)) for r in got.collect()} == want
    assert got.where("k = 1000 and value is null and n_readings = 3").count() == 1


def test_stages_as_the_fold(spark):
    rows = [(k, n, d) for k in range(30) for n, d in enumerate(random.Random(k).choices([None, "NOTE", "CLOSE"], [3, 2, 1], k=k % 4))] + [(99, 0, None)]
    df = spark.createDataFrame(rows, "k int, n int, d string")
    # An array of structs keeps null decisions.
    want = df.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("n", "d"))).alias("a")).select("k", feed.stage_of(F.transform("a", lambda x: x["d"])).alias("stage"))
    assert sorted(map(tuple, feed.stages(df, "k", F.col("d")).collect())) == sorted(map(tuple, want.collect()))
