"""Competing readings of one declaration become one: an ordered fold, ranks of passes, quality ladders."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def better(a: Column, b: Column, band: float = 0.08) -> Column:
    """Of readings (confidence, value): by confidence if that differs by more than the band, else the longer value, else a."""
    apart = F.abs(a["confidence"] - b["confidence"]) > band
    b_wins = F.when(apart, b["confidence"] > a["confidence"]).otherwise(F.length(b["value"]) > F.length(a["value"]))
    return F.when(a["value"].isNull(), b).when(b["value"].isNull(), a).when(b_wins, b).otherwise(a)


def best_readings(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str = "value", confidence: str = "confidence", band: float = 0.08) -> DataFrame:
    """Left fold of better() in order. It isn't transitive, so the order is part of the input and one task folds a key's
    readings. It reads them sorted, batch by batch, and holds one: a key of any size takes bounded memory. A key with null
    values only stays, with a null value."""
    keys = [f"_k{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], F.col(confidence).cast("double").alias("confidence"), F.col(value).alias("value"))
    dealt = rows.repartition(*keys).sortWithinPartitions(*rows.columns).select(*keys, "value", "confidence")
    schema = StructType([*dealt.schema.fields, StructField("n_readings", LongType())])

    def greater(a: float, b: float) -> bool:  # as in Spark, NaN is above all numbers
        return a > b or (a != a and b == b)

    def wins(a: tuple, b: tuple) -> bool:
        if a[0] is None or b[0] is None:
            return a[0] is None
        if a[1] is not None and b[1] is not None and greater(abs(a[1] - b[1]), band):
            return greater(b[1], a[1])
        return len(b[0]) > len(a[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, best, n = None, None, 0
        done = []
        shape = None

        def out() -> pa.RecordBatch:
            columns = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, shape.types, strict=True)], shape.names)

        for batch in batches:
            shape = shape or pa.schema([*batch.schema, pa.field("n_readings", pa.int64())])
            values = [c.to_pylist() for c in batch.columns]
            for *at, v, c in zip(*values, strict=True):
                if at != key:
                    if key is not None:
                        done.append((*key, *best, n))
                    key, best, n = at, (v, c), 1
                else:
                    best, n = (v, c) if wins(best, (v, c)) else best, n + 1
            if len(done) >= 1000:
                yield out()
                done = []
        if key is not None:
            done.append((*key, *best, n))
        if done:
            yield out()

    folded = dealt.mapInArrow(run, schema)
    return folded.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], "value", "confidence", "n_readings")


def pass_score(fields: Column, words: Column, mean: Column, by_fields: bool = True) -> Column:
    return fields * 100 + words + mean * 10 if by_fields else words * 10 + mean * 100 + fields


def rank_passes(df: DataFrame, by: Sequence[str], score: Column, order: Sequence[str]) -> DataFrame:
    """Adds `place`: 1 for the highest score, the earlier of equals first."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(score.desc(), *order)))


def quality_level(found: Column, good: Column) -> Column:
    return F.when((found >= 8) & good, "GOOD").when(found >= 4, "MARGINAL").otherwise("POOR")


def image_quality(cap_px: Column, mean: Column, found: Column) -> tuple[Column, Column]:
    """Level and reasons of one image."""
    reasons = F.array_compact(F.array(
        F.when(cap_px < 18, "SMALL_PRINT"), F.when(mean < 0.6, "UNREADABLE").when(mean < 0.75, "UNCERTAIN"), F.when(found < 4, "FEW_FIELDS").when(found < 8, "SOME_FIELDS")
    ))
    level = F.when((mean < 0.6) | (found < 4), "POOR").when((cap_px < 18) | (mean < 0.75) | (found < 8), "MARGINAL").otherwise("GOOD")
    return level, reasons


def label_present(best_words: Column, strong_fields: Column) -> Column:
    return (best_words >= 6) | (strong_fields >= 2)


def importer_not_applicable(origin: Column, importer: Column) -> Column:
    """Why no importer is due: the goods are domestic."""
    return F.when(importer.isNull() & origin.rlike("(?i)india"), "Domestic product")
