"""Dashboard figures kept by applying changes: a batch costs as much as its changes and the figures, not as the table.

A change holds a row's image before and after it: structs `before` and `after` with the columns of the figures' groups and
`cents`; a null `before` is a new row, a null `after` a deleted one. Figures: the groups' columns, n and cents.

Defined cases: a null is a group like any other; null cents count as 0; groups that have no row left go; a change with
neither image changes nothing; an empty batch leaves the figures as they are, and a batch that is repeated after a failure
is applied once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelforge.sources import published


def images(rows: DataFrame, key: str, order: Sequence[str], image: Column) -> DataFrame:
    """The rows with `before` and `after`, where each row of a key replaces the one before it (one pass over sorted rows)."""
    out = rows.withColumn("after", image)
    return out.withColumn("before", F.lag("after").over(Window.partitionBy(key).orderBy(*order)))


def figures(current: DataFrame, by: Sequence[str]) -> DataFrame:
    """The figures of a whole table of rows, for a start."""
    return current.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.coalesce("cents", F.lit(0))).cast("long").alias("cents"))


def apply(kept: DataFrame, changes: DataFrame, by: Sequence[str]) -> DataFrame:
    """The figures after the changes, in any order: images taken off and put on are summed before they are shuffled."""
    signed = changes.select(F.inline(F.array(F.struct(F.lit(-1).alias("n"), F.col("before").alias("i")), F.struct(F.lit(1).alias("n"), F.col("after").alias("i"))))).where("i is not null")
    signed = signed.select(*[F.col(f"i.{c}").alias(c) for c in by], F.col("n").cast("long").alias("n"), (F.col("n") * F.coalesce("i.cents", F.lit(0))).cast("long").alias("cents"))
    return kept.select(*by, "n", "cents").unionByName(signed).groupBy(*by).agg(F.sum("n").alias("n"), F.sum("cents").alias("cents")).where("n <> 0")


def keep(root: str, by: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: publishes the figures and the number of the batch that they include as one version. A crash before
    the version is complete leaves the old one, and the batch is applied when it is repeated; a batch that a visible
    version includes is left alone."""

    def run(changes: DataFrame, batch: int) -> None:
        spark: SparkSession = changes.sparkSession
        if published.current(spark, root) is None:
            fields = changes.schema["after"].dataType
            kept = spark.createDataFrame([], ", ".join([*(f"{c} {fields[c].dataType.simpleString()}" for c in by), "n long", "cents long"]))
        elif published.published(spark, root, "batch").first().number >= batch:
            return
        else:
            kept = published.published(spark, root, "figures")
        published.publish({"figures": apply(kept, changes, by), "batch": spark.range(1).select(F.lit(batch).cast("long").alias("number"))}, root)

    return run
