"""Words with places become lines of text, and lines find the lines they belong to.

Joins are on the image (an equi-join with a residual condition), so each image's lines meet only each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelforge.functions.geom import span_overlap
from labelforge.operators.analytics import islands


def words_of_provider(df: DataFrame, json: str, by: Sequence[str]) -> DataFrame:
    """A provider's answer (blocks of lines of words) as one row per word."""
    schema = "blocks array<struct<lines:array<struct<words:array<struct<text:string,confidence:double,x0:double,y0:double,x1:double,y1:double>>>>>>"
    x = df.select(*by, F.from_json(json, schema).alias("j")).select(*by, F.posexplode("j.blocks").alias("block", "b"))
    x = x.select(*by, "block", F.posexplode("b.lines").alias("line", "l"))
    return x.select(*by, "block", "line", F.posexplode("l.words").alias("word", "w")).select(*by, "block", "line", "word", "w.*")


def words_of_vision(df: DataFrame, json: str, by: Sequence[str]) -> DataFrame:
    """The answer of a service that gives blocks of paragraphs of words made of symbols, as one row per word: `block` counts
    its paragraphs, `word` the words of one. A line ends at a symbol with a line break and at a paragraph's end; words without a box or letters are left out."""
    symbol = "struct<text:string,property:struct<detectedBreak:struct<type:string>>>"
    word = f"struct<boundingBox:struct<vertices:array<struct<x:double,y:double>>>,confidence:double,symbols:array<{symbol}>>"
    schema = f"responses array<struct<fullTextAnnotation:struct<pages:array<struct<blocks:array<struct<paragraphs:array<struct<words:array<{word}>>>>>>>>>>"
    blocks = F.flatten(F.transform("j.responses", lambda r: F.flatten(F.transform(r["fullTextAnnotation"]["pages"], lambda p: p["blocks"]))))
    paragraphs = F.flatten(F.transform(blocks, lambda b: b["paragraphs"]))
    x = df.select(*by, F.from_json(json, schema).alias("j")).select(*by, F.posexplode(paragraphs).alias("block", "p"))
    ends = lambda w: F.coalesce(F.element_at(w["symbols"], -1)["property"]["detectedBreak"]["type"].isin("LINE_BREAK", "EOL_SURE_SPACE"), F.lit(False))
    x = x.withColumn("breaks", F.transform("p.words", lambda w: ends(w).cast("int"))).select(*by, "block", "breaks", F.posexplode("p.words").alias("word", "w"))
    line = F.aggregate(F.slice("breaks", F.lit(1), F.col("word")), F.lit(0), lambda a, b: a + b)
    corner = lambda f, axis: f(F.transform("w.boundingBox.vertices", lambda v: F.coalesce(v[axis], F.lit(0.0))))
    box = [corner(F.array_min, "x").alias("x0"), corner(F.array_min, "y").alias("y0"), corner(F.array_max, "x").alias("x1"), corner(F.array_max, "y").alias("y1")]
    text = F.array_join(F.transform("w.symbols", lambda s: F.coalesce(s["text"], F.lit(""))), "")
    out = x.select(*by, "block", line.alias("line"), "word", text.alias("text"), F.floor(F.coalesce("w.confidence", F.lit(0.9)) * 100 + 0.5).cast("double").alias("confidence"), *box)
    return out.where((F.trim("text") != "") & F.col("x0").isNotNull())


def words_of_overlay(df: DataFrame, json: str, by: Sequence[str], confidence: float = 85.0) -> DataFrame:
    """The answer of a service that gives lines of words with left, top, width and height; it states no confidence."""
    schema = "ParsedResults array<struct<TextOverlay:struct<Lines:array<struct<Words:array<struct<WordText:string,Left:double,Top:double,Height:double,Width:double>>>>>>>"
    x = df.select(*by, F.from_json(json, schema).alias("j")).select(*by, F.posexplode(F.get("j.ParsedResults", F.lit(0))["TextOverlay"]["Lines"]).alias("line", "l"))
    x = x.select(*by, "line", F.posexplode("l.Words").alias("word", "w")).where(F.trim("w.WordText") != "")
    at = lambda c: F.coalesce(F.col(f"w.{c}"), F.lit(0.0))
    return x.select(*by, "line", "word", F.trim("w.WordText").alias("text"), F.lit(confidence).alias("confidence"), at("Left").alias("x0"), at("Top").alias("y0"), (at("Left") + at("Width")).alias("x1"), (at("Top") + at("Height")).alias("y1"))


def segments(words: DataFrame, by: Sequence[str] = ("image_id",), gap: float = 0.045, least: float = 8.0) -> DataFrame:
    """words: by, width, block, line, text, confidence (0..100) and box. Lines are split where the next word begins more
    than gap * width after the last; `ord` is the reading order, by y0 then x0."""
    held = words.where((F.col("confidence") > least) & (F.trim("text") != ""))
    line = [*by, "block", "line"]
    before = F.lag("x1").over(Window.partitionBy(*line).orderBy("x0", "word"))
    cut = islands(held.withColumn("_before", before), line, ["x0", "word"], F.col("x0") - F.col("_before") > F.col("width") * gap)
    one = F.struct("x0", "word", "text")
    out = cut.groupBy(*line, "island").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda w: F.trim(w["text"])), " ").alias("text"),
        (F.avg("confidence") / 100).alias("confidence"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.max(F.col("y1") - F.col("y0")).alias("cap_height"),
    )
    return out.withColumn("ord", F.row_number().over(Window.partitionBy(*by).orderBy("y0", "x0", *line, "island")))


def _sides(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    a = left.select(*by, *[F.col(c).alias(f"c_{c}") for c in left.columns if c not in by])
    b = right.select(*by, *[F.col(c).alias(f"v_{c}") for c in right.columns if c not in by])
    return a.join(b, list(by))


def _first(df: DataFrame, by: Sequence[str], order: Sequence[Column], also: Sequence[str] = ()) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "c_ord", *also).orderBy(*order))).where("_n = 1").drop("_n")


def nearest_below(captions: DataFrame, values: DataFrame, by: Sequence[str], max_gap: float, min_overlap: float = 0.25, test: Column | None = None, also: Sequence[str] = ()) -> DataFrame:
    """For each caption (and each value of `also`, columns c_...) the first value below it that passes the test: it starts at most max_gap under the caption's end (or overlaps that by
    at most 0.3 of its height) and shares at least min_overlap of the narrower width. Smallest y0, then reading order."""
    x = _sides(captions, values, by)
    high = F.col("c_y1") - F.col("c_y0")
    below = (F.col("v_ord") != F.col("c_ord")) & (F.col("v_y0") >= F.col("c_y1") - high * 0.3) & (F.col("v_y0") - F.col("c_y1") <= max_gap)
    wide = span_overlap(F.col("c_x0"), F.col("c_x1"), F.col("v_x0"), F.col("v_x1")) >= min_overlap
    found = x.where(below & wide)
    return _first(found if test is None else found.where(test), by, [F.col("v_y0"), F.col("v_ord")], also)


def same_row(captions: DataFrame, values: DataFrame, by: Sequence[str], test: Column | None = None) -> DataFrame:
    """For each caption the first value on its row: centres at most 0.75 heights apart, right of its middle, less than
    30 heights away."""
    x = _sides(captions, values, by)
    high = F.col("c_y1") - F.col("c_y0")
    centre = lambda p: (F.col(f"{p}_y0") + F.col(f"{p}_y1")) / 2
    near = (F.col("v_ord") != F.col("c_ord")) & (F.abs(centre("c") - centre("v")) <= high * 0.75)
    right = (F.col("v_x0") > (F.col("c_x0") + F.col("c_x1")) / 2) & (F.col("v_x0") - F.col("c_x1") < high * 30)
    found = x.where(near & right)
    return _first(found if test is None else found.where(test), by, [F.col("v_x0"), F.col("v_ord")])


def within_reach(captions: DataFrame, values: DataFrame, by: Sequence[str], up: float = 2, down: float = 4) -> DataFrame:
    """Values inside the captions' common box, which reaches some caption heights further up and down."""
    box = captions.groupBy(*by).agg(F.min("x0").alias("b_x0"), F.min("y0").alias("b_y0"), F.max("x1").alias("b_x1"), F.max("y1").alias("b_y1"), F.max(F.col("y1") - F.col("y0")).alias("b_h"))
    x = values.join(box, list(by))
    return x.where((F.col("y0") >= F.col("b_y0") - F.col("b_h") * up) & (F.col("y1") <= F.col("b_y1") + F.col("b_h") * down)).drop("b_x0", "b_y0", "b_x1", "b_y1", "b_h")


def legend_values(lines: DataFrame, by: Sequence[str], keys: dict[str, str]) -> DataFrame:
    """Definitions such as '*MFG DATE' on one line, values such as '*02/2025' on others: (by, key, value). `keys` maps a
    declaration key to the pattern of its caption."""
    mark = r"([*#@^†‡§])\s*"
    kind = F.coalesce(*[F.when(F.col("text").rlike(f"(?i){mark}{p}"), k) for k, p in keys.items()])
    symbol = F.coalesce(*[F.nullif(F.regexp_extract("text", f"(?i){mark}(?:{p})", 1), F.lit("")) for p in keys.values()])
    defined = lines.select(*by, kind.alias("key"), symbol.alias("symbol")).where("key is not null and symbol is not null").distinct()
    values = lines.where(kind.isNull()).select(*by, "ord", F.regexp_extract("text", "([*#@^†‡§])", 1).alias("symbol"), F.trim(F.regexp_extract("text", rf"{mark}:?\s*(.+)$", 2)).alias("value"))
    found = defined.join(values.where("symbol != '' and value != ''"), [*by, "symbol"])
    return found.groupBy(*by, "key").agg(F.min_by("value", "ord").alias("value"))


def glued(words: Column) -> Column:
    """Words of a line in order (structs of text, confidence, x0, y0, x1, y1) with torn punctuation, numbers, addresses and
    domains put together: a fold whose accumulator is the array that is being built, so a joined word can be joined again."""
    text = F.transform(words, lambda w: w["text"])
    priced = F.exists(text, lambda t: t.rlike(r"(?i)m\.?\s?r\.?\s?p|^rs\.?$|₹|taxes"))

    def step(done: Column, w: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        gap, high = w["x0"] - last["x1"], F.greatest(F.lit(8.0), last["y1"] - last["y0"])
        mark = w["text"].rlike(r"^[.,:;@/\-()]+$") & (gap < high * 0.7)
        number = last["text"].rlike(r"\d[.,:]$") & w["text"].rlike(r"^\d")
        address = last["text"].rlike(r"[@/\-]$") & w["text"].rlike("^[A-Za-z0-9]")
        domain = last["text"].endswith(".") & (last["text"].contains("@") | w["text"].rlike(r"(?i)^(?:com|in|org|net|co|biz|info)(?![A-Za-z0-9_])"))
        near = (gap < high * 0.45) & (number | address | domain)
        both = F.concat(last["text"], w["text"])
        # Between digits of a price a colon is a full stop that was misread.
        both = F.when(~mark & number & priced, F.regexp_replace(both, r"(\d):(\d)", "$1.$2")).otherwise(both)
        one = F.struct(
            both.alias("text"), F.least(last["confidence"], w["confidence"]).alias("confidence"), F.least(last["x0"], w["x0"]).alias("x0"), F.least(last["y0"], w["y0"]).alias("y0"),
            F.greatest(last["x1"], w["x1"]).alias("x1"), F.greatest(last["y1"], w["y1"]).alias("y1"),
        )
        return F.when(F.coalesce(mark | near, F.lit(False)), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(one))).otherwise(F.concat(done, F.array(w)))

    return F.aggregate(words, F.slice(words, 1, 0), step)
