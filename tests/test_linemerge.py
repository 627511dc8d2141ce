"""Merging the lines of several readings."""

from labelforge.operators.linemerge import merged

SCHEMA = "image_id long, pass_no int, lead boolean, ord int, text string, confidence double, x0 double, y0 double, x1 double, y1 double"


def run(spark, *rows):
    out = merged(spark.createDataFrame(list(rows), SCHEMA)).orderBy("image_id", "position").collect()
    return [(r.image_id, r.text, r.added) for r in out]


def test_merge(spark):
    lead = [(1, 0, True, 0, "weak", 0.6, 0.0, 0.0, 100.0, 20.0), (1, 0, True, 1, "sure", 0.9, 0.0, 40.0, 100.0, 60.0)]
    other = [
        (1, 1, False, 0, "low", 0.5, 0.0, 300.0, 100.0, 320.0), (1, 1, False, 1, "far", 0.7, 0.0, 200.0, 100.0, 220.0), (1, 1, False, 2, "better", 0.8, 0.0, 2.0, 100.0, 22.0),
        (1, 1, False, 3, "worse", 0.8, 0.0, 41.0, 100.0, 61.0), (1, 2, False, 0, "late", 0.99, 0.0, 3.0, 100.0, 23.0), (1, 2, False, 1, None, 0.99, 0.0, 500.0, 100.0, 520.0),
    ]
    assert run(spark, *lead, *other) == [(1, "sure", False), (1, "better", True), (1, "far", True)]


def test_ties_nulls_and_images(spark):
    rows = [(1, 0, True, 0, None, None, None, None, None, None), (1, 0, True, 1, "a", 0.8, 0.0, 0.0, 10.0, 10.0), (1, 1, False, 0, "same", 0.8, 0.0, 0.0, 10.0, 10.0), (2, 1, False, 0, "alone", 0.8, 0.0, 0.0, 10.0, 10.0)]
    assert run(spark, *rows) == [(1, None, False), (1, "a", False), (2, "alone", True)]
    assert run(spark, *[(1, 0, True, 0, "x", 0.9, 0.0, 0.0, 1.0, 1.0)]) == [(1, "x", False)]


def test_empty(spark):
    assert merged(spark.createDataFrame([], SCHEMA)).collect() == []
