"""Register queries: filters, search, nesting, paging and lists over inspections, findings and products."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALL = "ALL"


def matching(df: DataFrame, **wanted) -> DataFrame:
    """Rows equal to every given value; None and 'ALL' mean no condition."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), ((k, v) for k, v in wanted.items() if v is not None and v != ALL), df)


def between_days(df: DataFrame, column: str, first=None, last=None) -> DataFrame:
    """From the beginning of the first day to the end of the last; either may be missing. The column stays bare, so that
    the condition reaches the scan."""
    if first is not None:
        df = df.where(F.col(column) >= F.to_timestamp_ntz(F.lit(f"{first} 00:00:00")))
    if last is not None:
        df = df.where(F.col(column) <= F.to_timestamp_ntz(F.lit(f"{last} 23:59:59")))
    return df


def searching(df: DataFrame, keyword: str | None, *columns: str) -> DataFrame:
    """Rows whose columns, joined by spaces, hold the keyword in any case."""
    word = (keyword or "").strip().lower()
    return df.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(word))) if word else df


def having_child(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, test: Column | None = None) -> DataFrame:
    own = children if test is None else children.where(test)
    return parents.join(own.select(F.col(child_key).alias(parent_key)), parent_key, "left_semi")


def without_child(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    return parents.join(children.select(F.col(child_key).alias(parent_key)), parent_key, "left_anti")


def nest(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, order: Sequence[str], fields: Sequence[str], into: str) -> DataFrame:
    """Each parent with the array of its children in order; childless ones get an empty array. Children are grouped before
    the join, so that a parent's row is sent once."""
    one = F.struct(*dict.fromkeys([*order, *fields]))
    grouped = children.groupBy(F.col(child_key).alias(parent_key)).agg(F.array_sort(F.collect_list(one)).alias(into))
    return parents.join(grouped, parent_key, "left").withColumn(into, F.coalesce(into, F.array().cast(grouped.schema[into].dataType)))


def ends(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, order: Sequence[str], field: str) -> DataFrame:
    """Each parent with the number of its children and a field of the first and the last in order, without gathering them."""
    by = F.struct(*order)
    grouped = children.groupBy(F.col(child_key).alias(parent_key)).agg(F.count("*").alias("n"), F.min_by(field, by).alias("first"), F.max_by(field, by).alias("last"))
    return parents.join(grouped, parent_key, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def page(df: DataFrame, order: Sequence[Column], number: int, size: int = 10) -> DataFrame:
    """Page `number` from 0 in a total order. Spark keeps only the first (number + 1) * size rows of each task."""
    return df.orderBy(*order).offset(max(0, number) * size).limit(size)


def newest(df: DataFrame, keep: int, order: Sequence[Column]) -> DataFrame:
    return df.orderBy(*order).limit(keep)


def latest_per(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def first_seen(df: DataFrame, column: str, order: str) -> DataFrame:
    """Distinct values in the order of their first row."""
    return df.groupBy(column).agg(F.min(order).alias("first_seen")).orderBy("first_seen")


def global_search(sources: Mapping[str, tuple[DataFrame, Column, Column, Sequence[str]]], keyword: str, most: int = 12) -> DataFrame:
    """sources: name -> (rows, id, title, searched columns). The first hits, by source and id; under two characters none."""
    parts = []
    for n, (name, (df, key, title, columns)) in enumerate(sources.items()):
        hits = searching(df, keyword, *columns) if len(keyword.strip()) >= 2 else df.where(F.lit(False))
        hit = hits.select(F.lit(n).alias("source_seq"), F.lit(name).alias("kind"), key.cast("long").alias("id"), title.alias("title"))
        parts.append(hit.orderBy("id").limit(most))
    return reduce(DataFrame.unionByName, parts).orderBy("source_seq", "id").limit(most)


# What each role may do.
CAPABILITIES = {
    "INSPECTOR": ("inspection:create", "report:generate", "analytics:region"),
    "SUPERVISOR": ("inspection:create", "inspection:verify", "inspection:close", "report:generate", "analytics:region", "analytics:state"),
    "ADMIN": ("inspection:create", "inspection:verify", "inspection:close", "report:generate", "rules:manage", "users:manage", "analytics:region", "analytics:state"),
}


def may(role: Column, capability: str) -> Column:
    table = F.create_map(*[x for r, c in CAPABILITIES.items() for x in (F.lit(r), F.array(*map(F.lit, c)))])
    return F.coalesce(F.array_contains(F.try_element_at(table, role), capability), F.lit(False))


def failed_fields(checks: Mapping[str, Column]) -> Column:
    """Names of the fields whose check isn't true."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(test, F.lit(False)), name) for name, test in checks.items()]))
