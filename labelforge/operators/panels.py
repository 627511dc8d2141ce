"""Several photographs of one label: their declarations merged, their qualities summed up, hosted and local passes weighed."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.functions.num import to_fixed
from labelforge.operators.reconcile import best_readings


def merge_panels(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str = "value", confidence: str = "confidence", reason: str = "not_applicable") -> DataFrame:
    """Per key the best reading of all panels. Where no panel has a value: the mean confidence of the misses, to two
    decimals, and the first reason in order why none is due."""
    found = F.length(F.coalesce(F.col(value), F.lit(""))) > 0
    best = best_readings(df.where(found), by, order, value, confidence).select(*[F.col(c).alias(f"_b_{c}") for c in by], F.col("value").alias("_value"), F.col("confidence").alias("_confidence"))
    because = F.min_by(reason, F.when(~found & F.col(reason).isNotNull(), F.struct(*order)))
    keys = df.groupBy(*by).agg(F.avg(F.when(~found, F.col(confidence))).alias("_miss"), because.alias("_reason"))
    none = F.col("_value").isNull()
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in by])  # a null key is a key, as in groupBy
    return keys.join(best, same, "left").select(
        *by, F.col("_value").alias(value), F.when(none, to_fixed(F.coalesce("_miss", F.lit(0.0)), 2)).otherwise(F.col("_confidence")).alias(confidence), F.when(none, F.col("_reason")).alias(reason)
    )


def mean_or_zero(value: Column, test: Column, digits: int = 3) -> Column:
    """The mean of the rows that pass, 0 where none does."""
    return to_fixed(F.coalesce(F.avg(F.when(test, value)), F.lit(0.0)), digits)


def panel_summary(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df: one row per panel with name, found, words, ms, cap_px, refocused. Per label: sums, least print size, whether any
    panel was refocused, and found/found/... and the panels' headings in order."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, "found", "name")))
    out = df.groupBy(*by).agg(
        F.count("*").alias("n_panels"), F.sum("words").alias("words"), F.sum("ms").alias("ms"), F.min("cap_px").alias("cap_px"), F.bool_or("refocused").alias("refocused"), ordered.alias("_panels")
    )
    title = lambda p, i: F.concat(F.lit("--- Image "), (i + 1).cast("string"), F.lit(" of "), F.col("n_panels").cast("string"), F.lit(": "), p["name"], F.lit(" ---"))
    return out.withColumns({
        "best_of": F.array_join(F.transform("_panels", lambda p: p["found"].cast("string")), "/"),
        "headings": F.array_join(F.transform("_panels", title), "\n"),
    }).drop("_panels")


def all_lines(panels: Sequence[DataFrame]) -> DataFrame:
    """The lines of all panels with the panel's number from 0; (panel, ord) is their order."""
    return reduce(DataFrame.unionByName, [p.withColumn("panel", F.lit(i)) for i, p in enumerate(panels)])


def keys_seen(df: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """The distinct keys of all images of a group, sorted."""
    return df.select(*by, key).distinct().groupBy(*by).agg(F.sort_array(F.collect_list(key)).alias("keys"))


def tilt(words: DataFrame, by: Sequence[str], line: str, width: Column, least_confidence: float = 50, least_words: int = 3, least_lines: int = 3) -> DataFrame:
    """Degrees by which an image is tilted: the median over its lines of the slope through their words' centres, to one
    decimal, upwards from a tie. Null where fewer than least_lines lines count. words: by, line, x, y, confidence."""
    w = words.where(F.col("confidence") >= least_confidence).withColumn("_w", width)
    n, sx, sy = F.count("*"), F.sum("x"), F.sum("y")
    lines = w.groupBy(*by, line).agg(
        n.alias("n"), (n * F.sum(F.col("x") * F.col("y")) - sx * sy).alias("num"), (n * F.sum(F.col("x") * F.col("x")) - sx * sx).alias("den"), (F.max("x") - F.min("x")).alias("across"), F.max("_w").alias("_w")
    )
    good = (F.col("n") >= least_words) & (F.col("den") > 0) & (F.col("across") > F.col("_w") * 0.05)
    angle = F.when(good, F.degrees(F.atan2("num", "den")))
    out = lines.withColumn("_angle", angle).groupBy(*by).agg(F.count("_angle").alias("n_lines"), F.median("_angle").alias("_m"))
    return out.select(*by, "n_lines", F.when(F.col("n_lines") >= least_lines, F.floor(F.col("_m") * 10 + 0.5) / 10.0).alias("tilt"))


def leading_pass(passes: DataFrame, by: Sequence[str], hosted: Column, found: Column, score: Column, number: str, enough: int = 8) -> DataFrame:
    """A hosted reading with `enough` fields stands alone; else the best pass of both leads, the hosted one at a tie, and the
    earlier of equal passes. One aggregation, whatever the number of passes."""
    place = F.struct(score, -F.col(number))
    p = passes.groupBy(*by).agg(
        F.max(F.when(hosted, found)).alias("_found"), F.max(F.when(hosted, place)).alias("_h"), F.max(F.when(~hosted, place)).alias("_l")
    )
    alone = F.coalesce(F.col("_found") >= enough, F.lit(False))
    from_hosted = F.col("_h").isNotNull() & (alone | F.col("_l").isNull() | (F.col("_h.col1") >= F.col("_l.col1")))
    best = F.when(from_hosted, F.col("_h")).otherwise(F.col("_l"))
    return p.select(*by, alone.alias("stands_alone"), from_hosted.alias("hosted"), (-best["col2"]).alias(number), best["col1"].alias("score"))


def region_verdicts(results: DataFrame, region: Sequence[str], status: str, order: Sequence[str], detail: str) -> DataFrame:
    """Per region the most serious status and its detail, the first in order of equal ones."""
    rank = F.when(F.col(status) == "FAIL", 0).when(F.col(status) == "REVIEW", 1).otherwise(2)
    worst = F.min(F.struct(rank.alias("rank"), *order, F.col(detail).alias("_detail")))
    tone = F.element_at(F.array(F.lit("violation"), F.lit("review"), F.lit("valid")), F.col("_worst.rank") + 1)
    return results.groupBy(*region).agg(worst.alias("_worst")).select(*region, tone.alias("tone"), F.col("_worst._detail").alias(detail))
