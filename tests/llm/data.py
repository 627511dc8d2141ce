"""Small tables with every awkward case, and the driver's smallest tables."""

from __future__ import annotations

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, bit long, label string, score string"

BASE = " ".join(f"w{i}" for i in range(60))
LONG = " ".join(f"v{i % 4001}x{i % 17}" for i in range(30_000))
TEXTS = [
    None, "", "   \n\t ", "a", "a b c d", "A b c d", "one two three four five", BASE, BASE, BASE + " tail", "x " + BASE, BASE.replace("w3 ", "q3 "),
    BASE.upper(), LONG, LONG + " end", "\x1c not a break \x85", "line one\nline one\n\nline two\n \n \n", "é ü ñ ▁ 😀 \x00 <0x0A>",
    "mail bob@example.com or +1 (017) 555-7713, 10.0.0.1", " ".join(["same eight words again and again and again"] * 9),
]


def awkward(spark):
    """Nulls in every column, repeated rows, clashing extra columns."""
    rows = [(i, t, ["en", None, "de"][i % 3], [None, "src0", "src5", "other"][i % 4], None if t is None else len(t), "k", 1, "l", "s") for i, t in enumerate(TEXTS)]
    rows += [rows[7], rows[7], (None, BASE, "en", "src1", len(BASE), None, None, None, None), (None, None, None, None, None, None, None, None, None), (7, "another text under the same id as one before", "en", "src1", 44, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark):
    return spark.createDataFrame([(i, 1 if i % 4 else 0, 1 if i % 5 == 0 else 0) for i in range(20)] + [(None, 1, None), (3, None, None)], "doc_id long, quality int, toxic int")


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
