"""Joins in time against plain loops; sketches' error; published tables; checksums and gluing by hand."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from labelforge.functions.text import checksum64
from labelforge.operators import layout, temporal
from labelforge.sources import published

START = datetime(2024, 1, 1)


def rows(seed, n):
    """One key has two thirds; null keys and times; several rows at one time."""
    rng = random.Random(seed)
    return [(i, rng.choice([1, 1, 2, 3, None, 1, 1]), rng.choice([None, *[START + timedelta(minutes=rng.randrange(9000))] * 9]), rng.choice([None, rng.random()])) for i in range(n)]


def test_as_of(spark):
    a, b = rows(1, 300), rows(2, 300)
    schema = "id long, k long, at timestamp_ntz, v double"
    left, right = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    got = {(r.id, r.last_id, r.last_v) for r in temporal.as_of(left, right, "k", "at", "id", ["id", "v"], seconds=3600).collect()}
    want = set()
    for i, k, at, _ in a:
        own = [(t, j, v) for j, x, t, v in b if k is not None and x == k and at is not None and t is not None and t <= at]
        last = max(own, key=lambda x: x[:2], default=None)
        want.add((i, last and last[1], last and last[2]))
    assert got == want


def test_within(spark):
    a, b = rows(3, 200), rows(4, 200)
    schema = "id long, k long, at timestamp_ntz, v double"
    found = temporal.within(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "k", "at", 3600)
    want = {(i, j) for i, k, at, _ in a for j, x, t, _ in b if None not in (k, x, at, t) and k == x and timedelta(0) <= at - t <= timedelta(hours=1)}
    got = [(r.l_id, r.r_id) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_sketches_unite(spark):
    days = spark.range(60_000).select((F.col("id") % 30).alias("day"), (F.col("id") * 7919 % 20_011).alias("user"))
    stored = temporal.distinct_sketches(days, ["day"], "user")
    total = temporal.united(stored.withColumn("all", F.lit(1)), ["all"]).first().estimate
    assert abs(total / 20_011 - 1) < 4 * 1.04 / 64
    assert temporal.united(stored.limit(0), ["day"]).count() == 0


def test_tables_appear_together(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    one, two = spark.range(3), spark.range(5).withColumnRenamed("id", "x")
    assert published.current(spark, root) is None
    with pytest.raises(LookupError):
        published.published(spark, root, "one")
    assert published.publish({"one": one, "two": two}, root) == 1
    # A crash between the writes: one table of version 2 is there, its manifest isn't.
    spark.range(99).write.parquet(f"{root}/one/version=2")
    assert published.current(spark, root) == 1 and published.published(spark, root, "one").count() == 3
    assert published.publish({"one": two, "two": one}, root) == 3
    assert published.published(spark, root, "one").count() == 5 and published.published(spark, root, "two").count() == 3


def plain_checksum(text):
    units = [int.from_bytes(text.encode("utf-16-le")[i : i + 2], "little") for i in range(0, 2 * (len(text.encode("utf-16-le")) // 2), 2)]
    low = 0xFFFFFFFF
    a, b = 0xDEADBEEF ^ len(units), 0x41C6CE57 ^ len(units)
    for u in units:
        a, b = (a ^ u) * 2654435761 & low, (b ^ u) * 1597334677 & low
    a = ((a ^ a >> 16) * 2246822507 & low) ^ ((b ^ b >> 13) * 3266489909 & low)
    b = ((b ^ b >> 16) * 2246822507 & low) ^ ((a ^ a >> 13) * 3266489909 & low)
    return f"{b:08x}{a:08x}" * 4


def test_checksums(spark):
    texts = ["", "a", "seed-17", "ünïcode 漢字", "😀 astral", "x" * 500]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", checksum64(F.col("t")).alias("c")).collect()
    assert {r.i: r.c for r in got} == dict(enumerate(map(plain_checksum, texts)))


@pytest.mark.parametrize(("words", "want"), [
    ([("20.", 0, 30), ("00", 33, 50)], ["20.00"]),
    ([("Rs", 0, 20), ("20:", 40, 70), ("00", 73, 90), ("/-", 91, 99)], ["Rs", "20.00/-"]),
    ([("at", 0, 20), ("20:", 40, 70), ("00", 73, 90)], ["at", "20:00"]),
    ([("MRP", 0, 20), ("20:", 40, 70), ("00", 73, 90)], ["MRP", "20.00"]),
    ([("info@", 0, 50), ("shop.", 52, 90), ("com", 92, 120), (".", 121, 124)], ["info@shop.com."]),
    ([("Ltd.", 0, 40), ("7th", 42, 60)], ["Ltd.", "7th"]),
    ([("1800-", 0, 40), ("208", 70, 90)], ["1800-", "208"]),
    ([], []),
])
def test_gluing(spark, words, want):
    kind = "array<struct<text: string, confidence: double, x0: double, y0: double, x1: double, y1: double>>"
    line = spark.createDataFrame([([(t, 0.9, float(a), 0.0, float(b), 20.0) for t, a, b in words],)], f"w {kind}")
    assert [w.text for w in line.select(layout.glued(F.col("w")).alias("w")).first().w] == want
