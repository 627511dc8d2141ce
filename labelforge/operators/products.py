"""Products and what their inspections add up to; single-use codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelforge.operators.registers import matching


def product_counters(inspections: DataFrame, key: str, when: str, tie: str, verdict: str, bad: str, open_findings: str) -> DataFrame:
    """Counters of each product that has inspections; as a stream the same counters as state."""
    latest = F.struct(when, tie)
    return inspections.groupBy(key).agg(
        F.count("*").alias("inspection_count"), F.min(when).alias("created_at"), F.max(when).alias("last_inspected_at"), F.max_by(verdict, latest).alias("latest_status"),
        F.sum(open_findings).alias("open_findings"), (F.count_if(F.col(verdict) == bad) >= 2).alias("repeat_offender"),
    )


def with_counters(products: DataFrame, counters: DataFrame, key: str) -> DataFrame:
    """Products without inspections keep zeros; their dates and status are null."""
    zero = {"inspection_count": F.lit(0).cast("long"), "open_findings": F.lit(0).cast("long"), "repeat_offender": F.lit(False)}
    return products.join(counters, key, "left").withColumns({c: F.coalesce(c, v) for c, v in zero.items()})


def open_findings(findings: DataFrame, key: str, is_open: Column) -> DataFrame:
    """Findings that are open after all decisions, per key; keys without open ones have 0."""
    return findings.groupBy(key).agg(F.count_if(is_open).alias("open_findings"))


def listed_products(df: DataFrame, only_repeat_offenders: bool = False, **wanted) -> DataFrame:
    """Products by equal values and flag, last inspected first, those never inspected at the end."""
    rows = matching(df, **wanted)
    rows = rows.where("repeat_offender") if only_repeat_offenders else rows
    return rows.orderBy(F.desc_nulls_last("last_inspected_at"))


def history(inspections: DataFrame, key: str, when: str, tie: str, score: str) -> DataFrame:
    """Inspections of each product from the oldest, numbered, with the mean score so far (our addition)."""
    along = Window.partitionBy(key).orderBy(when, tie)
    return inspections.withColumns({"place": F.row_number().over(along), "mean_so_far": F.avg(score).over(along.rowsBetween(Window.unboundedPreceding, 0))})


def with_default(rows: DataFrame, other: DataFrame, key: str, order: str, field: str) -> DataFrame:
    """rows with a field of `other` by key; rows without a partner get that of the first row of `other` in order."""
    first = other.select(field).orderBy(order).first()
    default = F.lit(first[0] if first else None).cast(other.schema[field].dataType)
    return rows.join(other.select(key, field), key, "left").withColumn(field, F.coalesce(field, default))


def conflicts(new: DataFrame, old: DataFrame, official: str, email: str) -> DataFrame:
    """`conflict` of each new row: the first of the two unique fields that an old row has already, in any case; else null."""
    norm = lambda c: F.lower(F.trim(c))
    out = new
    for c in (official, email):
        taken = old.select(norm(c).alias(f"_{c}")).distinct().withColumn(f"_has_{c}", F.lit(True))
        out = out.withColumn(f"_{c}", norm(c)).join(taken, f"_{c}", "left").drop(f"_{c}")
    return out.withColumn("conflict", F.when(F.col(f"_has_{official}"), official).when(F.col(f"_has_{email}"), email)).drop(f"_has_{official}", f"_has_{email}")


def code_attempts(events: DataFrame, key: str, order: list[str], time: str, issued: Column, right: Column, lifetime: str = "10 minutes", most: int = 5) -> DataFrame:
    """Tries of single-use codes: events are issues or tries. ACCEPTED, WRONG, or EXPIRED where the code is absent, used,
    older than its lifetime or tried `most` times. A new issue replaces the old code. A key's events are read in order."""
    along = Window.partitionBy(key).orderBy(*order)
    x = events.withColumns({"_issue": F.coalesce(issued, F.lit(False)), "_right": F.coalesce(right, F.lit(False))})
    x = x.withColumns({"_code": F.count_if("_issue").over(along), "_since": F.last(F.when(F.col("_issue"), F.col(time)), True).over(along)})
    earlier = Window.partitionBy(key, "_code").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumns({"_used": F.count_if(~F.col("_issue") & F.col("_right")).over(earlier), "_tries": F.count_if(~F.col("_issue")).over(earlier)})
    gone = (F.col("_code") == 0) | (F.col("_used") > 0) | (F.col("_tries") >= most) | (F.col(time) > F.col("_since") + F.expr(f"INTERVAL '{lifetime.split()[0]}' {lifetime.split()[1]}"))
    status = F.when(gone, "EXPIRED").when(F.col("_right"), "ACCEPTED").otherwise("WRONG")
    return x.where(~F.col("_issue")).withColumn("status", status).drop("_issue", "_right", "_code", "_since", "_used", "_tries")
