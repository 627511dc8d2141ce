"""Joins in time: the latest earlier row (as-of), and pairs that lie within an interval. Both deal rows by key and time bucket,
so a key that holds most rows is split by time, and neither compares rows of different buckets that can't meet.

Defined cases: rows with a null key or time match nothing (left rows of `as_of` stay, with nulls); of right rows at one
time that with the greatest `order` counts; repeated left rows stay; empty tables give what joins give.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_of(time: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(time.cast("timestamp")) / (seconds * 1_000_000)).cast("long")


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, order: str, values: Sequence[str], seconds: int = 86_400) -> DataFrame:
    """Left rows with the `values` of the key's last right row at or before their time. Both have key, time and order.

    Within a bucket a window carries the last right row on; what earlier buckets leave is carried over one row a key and
    bucket, which is all that a key's own window has to read."""
    seen = F.struct(*[F.col(v) for v in values])
    a = left.withColumns({"_bucket": bucket_of(F.col(time), seconds), "_side": F.lit(1), "_row": F.lit(None).cast(right.select(seen).schema[0].dataType), "_left": F.struct(*left.columns)})
    b = right.select(key, time, order, seen.alias("_row")).withColumns({"_bucket": bucket_of(F.col(time), seconds), "_side": F.lit(0)}).where(F.col(key).isNotNull() & F.col(time).isNotNull())
    rows = b.unionByName(a.select(key, time, order, "_row", "_bucket", "_side", "_left"), allowMissingColumns=True)
    within = Window.partitionBy(key, "_bucket").orderBy(time, "_side", order)
    rows = rows.withColumn("_last", F.last("_row", True).over(within)).where("_side = 1")
    ends = b.groupBy(key, "_bucket").agg(F.max_by("_row", F.struct(time, order)).alias("_end"))
    marks = ends.unionByName(a.where(F.col(key).isNotNull() & F.col("_bucket").isNotNull()).select(key, "_bucket").distinct(), allowMissingColumns=True).groupBy(key, "_bucket").agg(F.first("_end", True).alias("_end"))
    along = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = marks.withColumn("_before", F.last("_end", True).over(along)).select(key, "_bucket", "_before")
    out = rows.join(before, [key, "_bucket"], "left").withColumn("_hit", F.when(F.col(key).isNotNull() & F.col(time).isNotNull(), F.coalesce("_last", "_before")))
    return out.select("_left.*", *[F.col(f"_hit.{v}").alias(f"last_{v}") for v in values])


def within(left: DataFrame, right: DataFrame, key: str, time: str, seconds: int) -> DataFrame:
    """Pairs (columns l_..., r_...) of a key whose right row lies in the `seconds` up to the left row's time, ends included."""
    a = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns], F.explode(F.array(*[bucket_of(F.col(time), seconds) - k for k in (0, 1)])).alias("_bucket"))
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns], bucket_of(F.col(time), seconds).alias("_bucket"))
    pairs = a.join(b, (F.col(f"l_{key}") == F.col(f"r_{key}")) & (a["_bucket"] == b["_bucket"]))
    apart = F.unix_micros(F.col(f"l_{time}").cast("timestamp")) - F.unix_micros(F.col(f"r_{time}").cast("timestamp"))
    return pairs.where(apart.between(0, seconds * 1_000_000)).drop("_bucket")


def distinct_sketches(rows: DataFrame, by: Sequence[str], column: str, log2_k: int = 12) -> DataFrame:
    """One mergeable sketch of the column's distinct values for each group: a table to store and unite later."""
    return rows.groupBy(*by).agg(F.hll_sketch_agg(column, log2_k).alias("sketch"))


def united(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """The estimated number of distinct values of coarser groups, from stored sketches alone; it is off by some
    1.04 / sqrt(2 ** log2_k) as a standard error."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
