"""Fields read from lines, worked by hand."""

import pytest
from pyspark.sql import functions as F

from labelforge.operators import readers

LINES = "image_id long, ord int, text string, confidence double, x0 double, y0 double, x1 double, y1 double"


def read(spark, *labels, batches=None):
    rows = [(i, n, t, 0.9, 0.0, n * 30.0, 200.0, n * 30.0 + 20) for i, own in enumerate(labels) for n, t in enumerate(own)]
    out = readers.fields(spark.createDataFrame(rows, LINES), batches=batches).collect()
    assert len({(r.image_id, r.key) for r in out}) == len(out)
    return [{r.key: (r.value, r.ord, round(r.confidence, 2)) for r in out if r.image_id == i} for i in range(len(labels))]


def test_fields(spark):
    beside, below, plain, empty = read(
        spark,
        ["MRP: Rs. 65.00", "(Incl. of all taxes)", "Mfg. Date: 02/2025", "Best before 18 months", "Country of origin: Nepal", "FSSAI Lic. No. 10018043002915"],
        ["Maximum Retail Price", "Rs. 120.00", "Packed on", "see cap for details", "Importer: Blue Hill Foods"],
        ["Rs. 0.73 per g", "92/-", "24/06/2025", "JUL 2026", "Made in Sri Lanka", "A) Plant one", "Mfg. Lic. No.: UK.AY-191/2010"],
        [None, ""],
    )
    assert beside[readers.MRP] == ("Rs. 65.00 (Incl. of all taxes)", 0, 0.9)
    assert beside[readers.PACKED] == ("02/2025", 2, 0.9) and beside[readers.BEST] == ("18 months", 3, 0.9)
    assert beside[readers.COUNTRY][0] == "Nepal" and beside[readers.LICENCE][0] == "10018043002915"
    assert below == {readers.MRP: ("Maximum Retail Price Rs. 120.00", 1, 0.9), readers.IMPORTER: ("Blue Hill Foods", 4, 0.9)}
    assert plain[readers.MRP] == ("92/-", 1, 0.9) and plain[readers.PACKED] == ("24/06/2025", 2, 0.8) and plain[readers.BEST] == ("JUL 2026", 3, 0.8)
    assert plain[readers.COUNTRY][0] == "Sri Lanka" and plain[readers.LICENCE] == ("UK.AY-191/2010", 6, 0.8)
    assert empty == {}


def test_licence_of_the_batch_plant(spark):
    batches = spark.createDataFrame([(0, "BD3743")], "image_id long, batch string")
    (got,) = read(spark, ["A) Plant one", "Lic. No.: AUS-782", "x", "BD) Plant two", "Lic. No.: 106-ISM(HR)"], batches=batches)
    assert got[readers.LICENCE] == ("106-ISM(HR)", 4, 0.85)


@pytest.mark.parametrize(("text", "want"), [("₹150", [150]), ("Rs 9", []), ("?150.00", [150]), ("?150", []), ("₹12.50 per g", []), ("132/-", [132]), ("Rs. 5 g", [])])
def test_amounts(spark, text, want):
    got = spark.range(1).select(readers.amounts(F.lit(text), F.lit(False)).alias("a")).first().a
    assert [x.amount for x in got] == want


@pytest.mark.parametrize(("text", "want"), [("02/2025", [2025 * 12 + 2]), ("24/06/2026", [2026 * 12 + 6.75]), ("02JUN2026", [2026 * 12 + 6]), ("1800-10-22-221", []), ("12.24 g", []), ("03/2040", [])])
def test_dates(spark, text, want):
    got = spark.range(1).select(readers.date_tokens(F.lit(text)).alias("d")).first().d
    assert [x.key for x in got] == want


def test_nutrition_is_left_out(spark):
    texts = ["Nutritional information", "Energy 486 kcal", "12.3 g  0.41 g  2%", "38 g", "Net quantity 100 g"]
    rows = [(0, n, t, 0.9, 0.0, n * 30.0, 200.0, n * 30.0 + 20) for n, t in enumerate(texts)]
    left = readers.without_nutrition(spark.createDataFrame(rows, LINES), ["image_id"]).collect()
    assert sorted(r.text for r in left) == ["38 g", "Net quantity 100 g"]
