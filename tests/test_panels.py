"""Panels, products, agreement and providers' answers against plain Python."""

from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from labelforge.functions import text
from labelforge.operators import agreement, layout, panels, products
from tests.test_streams import run

CASES = [
    ("MRP", "Rs. 45.00", "MRP 45.00 incl", True), ("MRP", "Rs. 45.00", "MRP 46.00", False), ("MRP", "4500", "450", False), ("MRP", "45001", "4500", True), ("MRP", "none", "45", False),
    ("NET_QUANTITY", "100 g", "Net 100g", True), ("NET_QUANTITY", "100 gm", "Net 100.4 grams", True), ("NET_QUANTITY", "100 g", "Net 101 g", False), ("NET_QUANTITY", "1 ltr", "1 litres", True),
    ("NET_QUANTITY", "2 pcs", "2 N", True), ("NET_QUANTITY", "2 pcs", "2 ml", False), ("NET_QUANTITY", "some", "100 g", False),
    ("CONSUMER_CARE", "Call +91 98765 43210", "9876543210 / 919876543210", True), ("CONSUMER_CARE", "care@abc.in", "write to CARE@ABC.IN now", True), ("CONSUMER_CARE", "Call 98765 43210", "11111", False),
    ("PRODUCT_NAME", "Toor Dal", "SHAKTI Toor-Dal", True), ("PRODUCT_NAME", "Fine Gold Wheat Flour", "gold wheat rice", True), ("PRODUCT_NAME", "Toor Dal", "Moong", False), ("PRODUCT_NAME", "!!", "Moong", False),
    ("PRODUCT_NAME", "", None, True), ("PRODUCT_NAME", None, None, True), ("PRODUCT_NAME", "", "Moong", False), ("PRODUCT_NAME", "Toor", None, False), ("PRODUCT_NAME", "Toor", "", True),
]


def test_agreement(spark):
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, key string, expected string, got string, want boolean")
    out = rows.withColumn("ok", agreement.agrees(F.col("key"), F.col("expected"), F.col("got"))).collect()
    assert [r for r in out if r["ok"] != r["want"]] == []


def test_labels_meet_predictions_by_base_name(spark):
    labels = spark.createDataFrame([("a/b/one.jpg", "MRP", "45"), ("two.jpg", "MRP", "9"), ("three.jpg", "MRP", "")], "file string, key string, expected string")
    read = spark.createDataFrame([("one.jpg", "MRP", "Rs 45"), ("x/two.jpg", "MRP", "8")], "file string, key string, got string")
    assert {r["file"]: r["ok"] for r in agreement.judged(labels, read).collect()} == {"a/b/one.jpg": True, "two.jpg": False, "three.jpg": True}


def test_vision_lines_and_blank_words(spark):
    def word(letters, x, end=None, vertices=True, confidence=0.8):
        symbols = [{"text": c} for c in letters[:-1]] + [{"text": letters[-1], **({"property": {"detectedBreak": {"type": end}}} if end else {})}]
        box = {"vertices": [{"x": x, "y": 1}, {"x": x + 9, "y": 1}, {"x": x + 9, "y": 7}, {"x": x, "y": 7}]} if vertices else {"vertices": []}
        return {"symbols": symbols, "boundingBox": box, **({"confidence": confidence} if confidence else {})}

    one = [word("Net", 0, "SPACE"), word("wt", 20, "LINE_BREAK"), word(" ", 30, "EOL_SURE_SPACE"), word("100g", 40, None, True, None), word("lost", 50, None, False)]
    answer = {"responses": [{"fullTextAnnotation": {"pages": [{"blocks": [{"paragraphs": [{"words": one}]}, {"paragraphs": [{"words": [word("MRP", 3)]}]}]}]}}]}
    df = spark.createDataFrame([(1, json.dumps(answer)), (2, "{}"), (3, None), (4, "not json")], "image long, json string")
    got = sorted(tuple(r) for r in layout.words_of_vision(df, "json", ["image"]).select("image", "block", "line", "text", "confidence", "x0", "x1").collect())
    assert got == [(1, 0, 0, "Net", 80.0, 0.0, 9.0), (1, 0, 0, "wt", 80.0, 20.0, 29.0), (1, 0, 2, "100g", 90.0, 40.0, 49.0), (1, 1, 0, "MRP", 80.0, 3.0, 12.0)]


def test_overlay_lines(spark):
    answer = {"ParsedResults": [{"TextOverlay": {"Lines": [{"Words": [{"WordText": " Net ", "Left": 1, "Top": 2, "Width": 3, "Height": 4}, {"WordText": " "}]}, {"Words": [{"WordText": "wt"}]}]}}]}
    df = spark.createDataFrame([(1, json.dumps(answer)), (2, '{"ParsedResults": []}'), (3, None)], "image long, json string")
    got = sorted(tuple(r) for r in layout.words_of_overlay(df, "json", ["image"]).collect())
    assert got == [(1, 0, 0, "Net", 85.0, 1.0, 2.0, 4.0, 6.0), (1, 1, 0, "wt", 85.0, 0.0, 0.0, 0.0, 0.0)]


def test_merged_panels_without_a_value(spark):
    rows = [(1, 0, None, 0.5, None), (1, 1, "", 0.25, "second"), (1, 2, None, 0.75, "third"), (2, 0, None, 0.1, "not due"), (2, 1, "x", 0.2, None), (None, 0, "y", 0.5, None)]
    df = spark.createDataFrame(rows, "key int, n int, value string, confidence double, not_applicable string")
    got = {r["key"]: tuple(r)[1:] for r in panels.merge_panels(df, ["key"], ["n"]).collect()}
    assert got == {1: (None, 0.5, "second"), 2: ("x", 0.2, None), None: ("y", 0.5, None)}
    assert panels.merge_panels(df.where("key > 9"), ["key"], ["n"]).count() == 0


def test_lines_of_all_panels(spark):
    one, two = (spark.createDataFrame([(i, f"{t}{i}") for i in range(2)], "ord int, text string") for t in "ab")
    assert [r["text"] for r in panels.all_lines([one, two]).orderBy("panel", "ord").collect()] == ["a0", "a1", "b0", "b1"]


@pytest.mark.parametrize("phone, want", [("98765 43210", "+919876543210"), ("+98765 43210", "+9876543210"), ("919876543210", "+919876543210"), ("12", "+12"), ("", "+"), (None, None)])
def test_phone(spark, phone, want):
    assert spark.createDataFrame([(phone,)], "p string").select(text.e164(F.col("p"))).first()[0] == want


def test_codes(spark):
    t0 = datetime.datetime(2024, 1, 1)
    at = lambda m: t0 + datetime.timedelta(minutes=m)
    rows = [
        (1, 0, at(0), "try", True), (1, 1, at(1), "issue", None), (1, 2, at(2), "try", False), (1, 3, at(3), "try", True), (1, 4, at(4), "try", True),
        (2, 0, at(0), "issue", None), (2, 1, at(11), "try", True), (2, 2, at(12), "issue", None), (2, 3, at(22), "try", True),
        (3, 0, at(0), "issue", None), *[(3, i, at(i), "try", False) for i in range(1, 6)], (3, 6, at(6), "try", True), (None, 0, at(0), "try", None),
    ]
    df = spark.createDataFrame(rows, "user int, n int, at timestamp, kind string, right boolean")
    out = products.code_attempts(df, "user", ["n"], "at", F.col("kind") == "issue", F.col("right"))
    got = {(r["user"], r["n"]): r["status"] for r in out.collect()}
    assert got == {(1, 0): "EXPIRED", (1, 2): "WRONG", (1, 3): "ACCEPTED", (1, 4): "EXPIRED", (2, 1): "EXPIRED", (2, 3): "ACCEPTED", **{(3, i): "WRONG" for i in range(1, 6)}, (3, 6): "EXPIRED", (None, 0): "EXPIRED"}


def test_counters_as_state_of_a_stream(spark, tmp_path):
    folder = f"{tmp_path}/inspections"
    schema = "id long, product long, at timestamp, verdict string, open_findings long"
    t0 = datetime.datetime(2024, 5, 1)
    rows = [(i, i % 7, t0 + datetime.timedelta(hours=i * 5 % 60), ["COMPLIANT", "NON_COMPLIANT"][i % 2], i % 3) for i in range(60)]
    for k in range(3):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], schema).coalesce(1).write.mode("append").parquet(folder)
    made = lambda df: products.product_counters(df, "product", "at", "id", "verdict", "NON_COMPLIANT", "open_findings")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = run(spark, made(stream), tmp_path, "complete")
    assert sorted(got) == sorted(tuple(r) for r in made(spark.read.parquet(folder)).collect()) and len(got) == 7


def test_tilt_needs_three_lines(spark):
    rows = [(1, i, 10.0 * x, 2.0 * x, 90.0) for i in range(3) for x in range(4)] + [(2, i, 10.0 * x, 0.0, 90.0) for i in range(2) for x in range(4)] + [(3, i, 5.0, float(x), 90.0) for i in range(3) for x in range(4)]
    df = spark.createDataFrame(rows, "image int, line int, x double, y double, confidence double")
    assert {r["image"]: r["tilt"] for r in panels.tilt(df, ["image"], "line", F.lit(100.0)).collect()} == {1: 11.3, 2: None, 3: None}
