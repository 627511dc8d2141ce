"""Features of lines, worked out by hand."""

import pytest
from pyspark.sql import functions as F

from labelforge.operators import classify

SHAPES_OF = {
    "": set(), "Mfg. Date: 07/2026": {"#date", "#colon", "#digits-heavy"}, "JAN 2026": {"#date", "#allcaps", "#short", "#code"}, "Best before 18 months": {"#months"}, "Toll free 1800-123-4567": {"#phone", "#digits-heavy"},
    "care@acme.in": {"#email", "#web", "#short"}, "500ml": {"#unit", "#short"}, "2 N x 150 g": {"#count", "#unit", "#short"}, "AB-1234 X9": {"#code", "#allcaps", "#short"}, "Acme Foods Pvt. Ltd.": {"#corp"},
    "12 Main Road": {"#addr", "#short"}, "Surat, Gujarat 395 003": {"#state", "#pin", "#digits-heavy"}, "Made in Sri Lanka": {"#country"}, "éindia of old times": {"#country"}, "Indiana and beyond": set(),
    "Lic 10012345678901": {"#long14", "#digits-heavy"}, "100% (new)": {"#pct", "#paren", "#short"}, "x" * 61: {"#long"}, "₹ 20": {"#currency", "#short"},
}


def named(spark, lines):
    df = spark.createDataFrame([*enumerate(lines)], "k int, line string")
    rows = df.select("k", F.inline(classify.feature_names(F.col("line")))).collect()
    return df, [[(r.name, r.weight) for r in rows if r.k == k] for k in range(len(lines))]


def test_all_features_of_a_line(spark):
    _, (got, none) = named(spark, ["MRP Rs. 45.00", None])
    words = [("w:mrp", 1), ("w:rs.", 1), ("w:00.00", 1), ("b:mrp_rs.", 1), ("b:rs._00.00", 1), ("first:mrp", 1.5), ("last:00.00", 1)]
    trigrams = [(f"c:{t}", 0.5) for t in (" mr", "mrp", "rp ", "p r", " rs", "rs.", "s. ", ". 0", " 00", "00.", "0.0", ".00", "00 ")]
    # 11 characters without spaces: 4 digits and 5 letters are 1.8 and 2.3 fifths.
    rest = [("#currency", 2), ("#price", 2), ("#short", 2), ("#digit-ratio:1", 1.5), ("#letter-ratio:2", 1.5), ("#words:3", 1), ("#bias", 1)]
    assert sorted(got) == sorted(words + trigrams + rest)
    assert sorted(none) == sorted([("#digit-ratio:0", 1.5), ("#letter-ratio:0", 1.5), ("#words:0", 1), ("#bias", 1)])


def test_shapes_and_length(spark):
    lines = list(SHAPES_OF)
    df, got = named(spark, lines)
    for line, own in zip(lines, got, strict=True):
        assert {n for n, _ in own if n in classify.SHAPES} == SHAPES_OF[line], line
    assert set().union(*SHAPES_OF.values()) | {"#price"} == set(classify.SHAPES)
    weights = classify.features(df, "k", "line").groupBy("k").agg(F.sum(F.col("weight") * F.col("weight")).alias("s")).collect()
    assert len(weights) == len(lines) and all(r.s == pytest.approx(1) for r in weights)


def test_characters_of_two_units_and_the_ninth_word(spark):
    _, (smile, nine) = named(spark, ["😀 12", "one two three four five six seven eight nine"])
    assert ("#digit-ratio:2", 1.5) in smile and ("#words:8", 1) in nine
