"""Does a value that was read agree with the one printed? Labels meet predictions by file name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBERS = ("MRP", "DATE_OF_PACKING", "BEST_BEFORE", "FSSAI_LICENSE")
AMOUNT = r"(?i)(\d+(?:\.\d+)?)\s*([a-z]+)"
# Spellings of one unit.
UNITS = {"g": "gm|gms|grams?", "l": "ltr|litres?|liters?", "n": "pcs|pieces|nos"}


def plain(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def holds(whole: Column, part: Column) -> Column:
    return F.contains(whole, part)


def unit(s: Column) -> Column:
    out = F.lower(s)
    for name, spellings in UNITS.items():
        out = F.regexp_replace(out, f"^(?:{spellings})$", name)
    return F.regexp_replace(out, "s$", "")


def _amounts(s: Column) -> Column:
    both = F.arrays_zip(F.regexp_extract_all(s, F.lit(AMOUNT), F.lit(1)).alias("n"), F.regexp_extract_all(s, F.lit(AMOUNT), F.lit(2)).alias("u"))
    return F.transform(both, lambda x: F.struct(x["n"].cast("double").alias("n"), unit(x["u"]).alias("u")))


def same_number(expected: Column, got: Column) -> Column:
    e, g = digits(expected), digits(got)
    return (F.length(e) > 0) & (holds(g, e) | (holds(e, g) & (F.length(g) >= F.least(F.lit(4), F.length(e)))))


def same_quantity(expected: Column, got: Column) -> Column:
    """Contained but for spaces, or an amount of the same unit within a half per cent (0.05 at least)."""
    squeezed = lambda s: F.replace(plain(s), F.lit(" "), F.lit(""))
    want = F.get(_amounts(expected), F.lit(0))
    near = F.exists(_amounts(got), lambda x: (x["u"] == want["u"]) & (F.abs(x["n"] - want["n"]) <= F.greatest(F.lit(0.05), want["n"] * 0.005)))
    return holds(squeezed(got), squeezed(expected)) | F.coalesce(near, F.lit(False))


def same_contact(expected: Column, got: Column) -> Column:
    """The printed phone number in any spacing, or the mail address."""
    phones = F.transform(F.regexp_extract_all(expected, F.lit(r"[+\d][\d\s\-]{7,}"), F.lit(0)), digits)
    mail = plain(F.regexp_extract(expected, r"[\w.+-]+@[\w.-]+", 0))
    return F.exists(phones, lambda p: (F.length(p) >= 8) & holds(digits(got), p)) | ((mail != "") & holds(plain(got), mail))


def same_words(expected: Column, got: Column) -> Column:
    """One contains the other, or they share three fifths of the shorter one's words (of three letters or more)."""
    e, g = plain(expected), plain(got)
    et, gt = F.array_distinct(F.split(e, " ")), F.array_distinct(F.split(g, " "))
    shared = F.size(F.filter(F.array_intersect(et, gt), lambda t: F.length(t) > 2))
    return (e != "") & (holds(g, e) | holds(e, g) | (shared / F.greatest(F.lit(1), F.least(F.size(et), F.size(gt))) >= 0.6))


def agrees(key: Column, expected: Column, got: Column) -> Column:
    """Nothing printed agrees only with nothing read."""
    printed = F.coalesce(expected, F.lit(""))
    test = (
        F.when(key.isin(*NUMBERS), same_number(printed, got)).when(key == "NET_QUANTITY", same_quantity(printed, got))
        .when(key == "CONSUMER_CARE", same_contact(printed, got) | same_words(printed, got)).otherwise(same_words(printed, got))
    )
    return F.when(printed == "", got.isNull()).when(got.isNull(), F.lit(False)).otherwise(test)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]+$", 0)


def judged(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """labels (file, key, expected) with the prediction (file, key, got) of the same base name, and `ok`."""
    p = predictions.select(basename(F.col("file")).alias("_base"), "key", "got")
    found = labels.withColumn("_base", basename(F.col("file"))).join(p, ["_base", "key"], "left").drop("_base")
    return found.withColumn("ok", agrees(F.col("key"), F.col("expected"), F.col("got")))
