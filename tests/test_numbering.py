"""Numbering against a plain count."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelforge.operators.mutate import number_on


def test_numbers_are_consecutive_with_columns_that_are_no_keys(spark):
    rows = spark.range(0, 2_000_000, numPartitions=8).select((F.col("id") * 7919 % 2_000_003).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("other"))
    got = number_on(rows, 10, [F.col("k")], "n")
    assert got.agg(F.countDistinct("n"), F.min("n"), F.max("n")).first()[:] == (2_000_000, 11, 2_000_010)
    ordered = got.where("n < 2000").orderBy("n").select("k").collect()
    assert [r.k for r in ordered] == sorted(r.k for r in ordered)


def test_numbering_of_no_rows(spark):
    assert number_on(spark.range(0).withColumn("x", F.lit(1)), 5, [F.col("id")], "n").count() == 0
