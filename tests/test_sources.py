"""Readers and sinks against small files."""

from __future__ import annotations

import base64

from pyspark.sql import functions as F

from labelforge.sources import tables


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note\n1," plain "\n2,"says ""yes"", twice"\n,\n3,"two\nlines"\n')
    got = [tuple(r) for r in tables.read_csv(spark, f"file://{tmp_path}/a.csv").collect()]
    assert got == [("1", "plain"), ("2", 'says "yes", twice'), ("3", "two\nlines")]
    tables.write_csv(spark.createDataFrame([("1", 'a "b", c')], "id string, note string"), f"file://{tmp_path}/out")
    assert [tuple(r) for r in tables.read_csv(spark, f"file://{tmp_path}/out").collect()] == [("1", 'a "b", c')]


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "name": "x"}\n{"id": 1, "name": "x"}\n{"id": 2}\n')
    path = f"file://{tmp_path}/a.jsonl"
    assert tables.read_jsonl(spark, path, "id long, name string").count() == 3
    assert sorted(map(tuple, tables.read_jsonl(spark, path, "id long, name string", ["id"]).collect())) == [(1, "x"), (2, None)]
    tables.write_json(spark.createDataFrame([(7, "y")], "id long, name string"), f"file://{tmp_path}/out")
    assert [tuple(r) for r in tables.read_jsonl(spark, f"file://{tmp_path}/out", "id long, name string").collect()] == [(7, "y")]


def test_images(spark, tmp_path):
    heads = {"front.jpg": b"\xff\xd8\xff\xe0", "back.png": b"\x89PNG\r\n\x1a\n", "side.webp": b"RIFF\x10\x00\x00\x00WEBP", "note.txt": b"no image"}
    for name, head in heads.items():
        (tmp_path / name).write_bytes(head + b"\0" * 20)
    images = tables.read_images(spark, f"file://{tmp_path}")
    got = {r.p.rsplit("/", 1)[1]: r.mime for r in images.select(F.col("path").alias("p"), tables.mime_of(F.col("content")).alias("mime")).collect()}
    assert got == {"front.jpg": "image/jpeg", "back.png": "image/png", "side.webp": "image/webp"}
    assert tables.read_images(spark, f"file://{tmp_path}", name_part="front").count() == 1


def test_data_url_and_rows_of_reports(spark):
    url = "data:image/png;base64," + base64.b64encode(b"abc").decode()
    row = spark.range(1).select(tables.data_url_bytes(F.lit(url)).alias("b"), tables.mime_of(F.lit(b"%PDF-1.7")).alias("pdf"), tables.mime_of(F.lit(b"?")).alias("other")).first()
    assert bytes(row.b) == b"abc" and (row.pdf, row.other) == ("application/pdf", "application/octet-stream")
    df = spark.createDataFrame([("a<b", None)], "x string, y string")
    assert tables.html_rows(df, "x", "y").first().value == "<tr><td>a&lt;b</td><td></td></tr>"
    assert tables.markdown_rows(df, "x", "y").first().value == "| a<b |  |"
