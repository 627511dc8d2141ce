"""Dashboard figures: counts and rates by group, distributions over fixed domains, periods, repeat offenders, statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelforge.functions.num import percent

VERDICTS = {"F": "COMPLIANT", "O": "NEEDS_REVIEW", "P": "NON_COMPLIANT"}
SEVERITIES = {"R": "HIGH", "A": "MEDIUM", "N": "LOW"}


def recode(column: Column, names: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[column]


def counts_of(df: DataFrame, by: Sequence[str], tests: Mapping[str, Column], total: str = "n") -> DataFrame:
    """Rows and rows that pass each test, per group, in one pass."""
    return df.groupBy(*by).agg(F.count("*").alias(total), *[F.count_if(t).alias(name) for name, t in tests.items()])


def rate_by(df: DataFrame, by: Sequence[str], test: Column) -> DataFrame:
    """Per group: rows, those that pass, and the rate in per cent to one decimal."""
    return counts_of(df, by, {"passed": test}).withColumn("rate", percent(F.col("passed"), F.col("n")))


def over_domain(df: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    """Counts for every value of a fixed domain, 0 where there is none, in the domain's order."""
    one = df.agg(*[F.count_if(F.col(column) == v).alias(f"c{i}") for i, v in enumerate(domain)])
    rows = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(v).alias(column), F.col(f"c{i}").alias("n")) for i, v in enumerate(domain)])
    return one.select(F.inline(rows))


def period_change(counts: DataFrame, by: Sequence[str], period: str, value: str = "n") -> DataFrame:
    """counts with the value of the period before (per `by`) and the change in per cent."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(period))
    return counts.withColumn("before", before).withColumn("change_pct", F.when(F.col("before") > 0, F.floor((F.col(value) - F.col("before")) * 1000.0 / F.col("before") + 0.5) / 10.0))


def rollup_per_key(df: DataFrame, key: str, when: str, tie: str, verdict: str, bad: str, at_least: int = 2) -> DataFrame:
    """Per key: count, latest verdict, bad ones, and whether it is a repeat offender."""
    out = df.groupBy(key).agg(F.count("*").alias("n"), F.max_by(verdict, F.struct(when, tie)).alias("latest"), F.count_if(F.col(verdict) == bad).alias("n_bad"))
    return out.withColumn("repeat_offender", F.col("n_bad") >= at_least)


def index_quantiles(df: DataFrame, by: Sequence[str], value: str, order_bits: int = 2) -> DataFrame:
    """Per group the upper median a[n div 2] and the lower 30th percentile a[floor(.3 (n - 1))]: values, not
    interpolations. Counts per distinct value come first, so a group is as large as its distinct values."""
    per_value = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    along = Window.partitionBy(*by).orderBy(value)
    ranked = per_value.withColumn("_upto", F.sum("_n").over(along)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*by)))
    at = lambda place: F.min(F.when(F.col("_upto") > place, F.col(value)))
    return ranked.groupBy(*by).agg(at(F.floor(F.col("_all") / 2)).alias("upper_median"), at(F.floor((F.col("_all") - 1) * 0.3)).alias("p30"), F.first("_all").alias("n"))


def trimmed(df: DataFrame, by: Sequence[str], value: str, factor: float = 2.5) -> DataFrame:
    """Rows within `factor` median absolute deviations of their group's median. Two aggregations and two joins on the group."""
    middle = df.groupBy(*by).agg(F.median(value).alias("_middle"))
    off = df.join(middle, list(by)).withColumn("_off", F.abs(F.col(value) - F.col("_middle")))
    spread = off.groupBy(*by).agg(F.median("_off").alias("_mad"))
    return off.join(spread, list(by)).where(F.col("_off") <= F.col("_mad") * factor).drop("_middle", "_off", "_mad")


def slope(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.count("*").alias("n"))


def vote(df: DataFrame, by: Sequence[str], choice: str, weight: Column) -> DataFrame:
    """Per group the choice with the largest summed weight, the least one at a tie."""
    sums = df.groupBy(*by, choice).agg(F.sum(weight).alias("votes"))
    best = Window.partitionBy(*by).orderBy(F.desc("votes"), choice)
    return sums.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def islands(df: DataFrame, by: Sequence[str], order: Sequence[str], gap: Column) -> DataFrame:
    """Adds `island`: rises by one wherever `gap` (which may use lag columns) is true, in order within the group."""
    along = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_new", F.when(F.coalesce(gap, F.lit(False)), 1).otherwise(0)).withColumn("island", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def changes_only(df: DataFrame, by: Sequence[str], order: Sequence[str], key: str) -> DataFrame:
    """Rows whose key differs from that of the row before."""
    before = F.lag(key).over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_before", before).where(~F.col("_before").eqNullSafe(F.col(key))).drop("_before")


def confusion(df: DataFrame, predicted: Column, actual: Column, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn and recall in per cent."""
    p, a = F.coalesce(predicted, F.lit(False)), F.coalesce(actual, F.lit(False))
    out = counts_of(df, by, {"tp": p & a, "fp": p & ~a, "fn": ~p & a, "tn": ~p & ~a})
    return out.withColumn("recall_pct", percent(F.col("tp"), F.col("tp") + F.col("fn")))


def field_confusion(df: DataFrame, expected: str, got: str, by: Sequence[str] = ()) -> DataFrame:
    """For values: a wrong value for a printed field is a miss (fn), a value where nothing is printed is an invention (fp)."""
    printed, read = F.nullif(F.col(expected), F.lit("")).isNotNull(), F.nullif(F.col(got), F.lit("")).isNotNull()
    right = printed & read & (F.lower(F.trim(expected)) == F.lower(F.trim(got)))
    return counts_of(df, by, {"tp": right, "fn": printed & ~F.coalesce(right, F.lit(False)), "fp": ~printed & read, "tn": ~printed & ~read})


def off_diagonal(df: DataFrame, actual: str, predicted: str, most: int = 8) -> DataFrame:
    """The most frequent confusions."""
    wrong = df.where(F.col(actual) != F.col(predicted)).groupBy(actual, predicted).agg(F.count("*").alias("n"))
    return wrong.orderBy(F.desc("n"), actual, predicted).limit(most)
