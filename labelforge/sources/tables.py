"""Sources and sinks: Parquet tables, CSV with quotes, JSON lines, images, text reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header, quotes doubled inside quotes, newlines in quotes, cells trimmed, all columns text, blank rows dropped."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    rows = rows.select(*[F.trim(F.col(f"`{c}`")).alias(c.strip()) for c in rows.columns])  # the reader trims bare cells only
    return rows.where(F.coalesce(*[F.nullif(F.col(f"`{c}`"), F.lit("")) for c in rows.columns]).isNotNull())


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, quote='"', escape='"', quoteAll=False, mode="overwrite")


def read_jsonl(spark: SparkSession, path: str, schema: str, distinct_by: list[str] | None = None) -> DataFrame:
    rows = spark.read.schema(schema).json(path)
    return rows.dropDuplicates(distinct_by) if distinct_by else rows


def read_images(spark: SparkSession, folder: str, extensions: str = "{jpg,jpeg,png,webp}", name_part: str = "") -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{extensions}").load(folder)
    return files.where(F.contains(F.regexp_extract("path", "[^/]+$", 0), F.lit(name_part))) if name_part else files


def data_url_bytes(url: Column) -> Column:
    return F.unbase64(F.substring_index(url, ",", -1))


def mime_of(content: Column) -> Column:
    """By the first bytes."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("89504E47"), "image/png")
        .when(head.startswith("52494646") & F.substring(head, 17, 8).eqNullSafe("57454250"), "image/webp").when(head.startswith("25504446"), "application/pdf")
        .otherwise("application/octet-stream")
    )


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path, mode="overwrite")


def html_rows(df: DataFrame, *columns: str) -> DataFrame:
    """One HTML table row per row, escaped; write with df.write.text()."""
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    cells = F.concat(*[F.concat(F.lit("<td>"), safe(c), F.lit("</td>")) for c in columns])
    return df.select(F.concat(F.lit("<tr>"), cells, F.lit("</tr>")).alias("value"))


def markdown_rows(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |")).alias("value"))
