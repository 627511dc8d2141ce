"""Changes to tables as new tables: merges, partial updates, deletions, numbering. Each result is a complete table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelforge.sources.scratch import written


def upsert(old: DataFrame, new: DataFrame, key: str, update: Sequence[str] | None = None) -> DataFrame:
    """Rows of both; where a key is in both, the columns of `update` (all if None) come from the new row, others stay."""
    there = F.lit(True).alias("_there")
    joined = old.select("*", there).alias("o").join(new.select("*", there).alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    take = set(old.columns) if update is None else set(update)

    def value(c: str) -> Column:
        if c == key:
            return F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}"))
        fresh = F.col("n._there").isNotNull() if c in take else F.col("o._there").isNull()
        return F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return joined.select(*[value(c).alias(c) for c in old.columns])


def insert_new(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Adds the rows whose key isn't there yet."""
    return old.unionByName(new.select(*old.columns).dropDuplicates([key]).join(old.select(key), key, "left_anti").select(*old.columns))


def fill_missing(df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    return df.withColumns({k: F.coalesce(F.col(k), v) for k, v in values.items()})


def patch(df: DataFrame, where: Column, values: Mapping[str, Column]) -> DataFrame:
    """Only the given columns of the rows that the condition holds for."""
    return df.withColumns({k: F.when(where, v).otherwise(F.col(k)) for k, v in values.items()})


def delete(df: DataFrame, key: str, gone: DataFrame, gone_key: str) -> DataFrame:
    """Rows whose key isn't among the deleted ones: the deletion itself and its cascade into child tables."""
    return df.join(gone.select(F.col(gone_key).alias(key)), key, "left_anti").select(*df.columns)


def clear_reference(df: DataFrame, key: str, gone: DataFrame, gone_key: str) -> DataFrame:
    """The reference becomes null where its target is deleted."""
    marks = gone.select(F.col(gone_key).alias(key)).distinct().withColumn("_gone", F.lit(True))
    return df.join(marks, key, "left").withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).select(*df.columns)


def number_on(df: DataFrame, last: int, order: Sequence[Column], into: str) -> DataFrame:
    """Consecutive numbers after `last`. Ranges are numbered apart and shifted by the counts before them, so no task
    sees all rows. The ranges are written once: dealt twice, they would be cut at other places."""
    dealt = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    own = Window.partitionBy("_part").orderBy(*order)
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("_before", before).select("_part", "_before")
    return dealt.join(F.broadcast(starts), "_part").withColumn(into, F.row_number().over(own) + F.col("_before") + last).drop("_part", "_before")


def set_param(params: Column, key: str, value: str) -> Column:
    return F.map_concat(F.map_filter(params, lambda k, _: k != key), F.create_map(F.lit(key), F.lit(value)))
