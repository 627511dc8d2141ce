"""Fields of a label from its lines: by captions, beside or above their values, else by the look of the value.

Lines are rows of `by`, ord (reading order), text, confidence (0..1), x0, y0, x1, y1; nulls in text count as empty. All
captions of all fields meet the lines below them in one join on the image. Fields come as rows (by, key, value, ord,
confidence), at most one for each key; images without any have no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelforge.functions.text import repair_rupee
from labelforge.operators.layout import nearest_below
from labelforge.sources.scratch import written

MRP, PACKED, BEST, COUNTRY, IMPORTER, LICENCE = "MRP", "DATE_OF_PACKING", "BEST_BEFORE", "COUNTRY_OF_ORIGIN", "IMPORTER_DETAILS", "FSSAI_LICENSE"

# The captions, the grammar of dates, amounts and licences, what marks tables of nutrients and hints to other
# places of the pack, and the countries that a label may name.
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec"
_MONTH = rf"(?:{_MONTHS.replace(' ', '|')})[a-z]{{0,6}}\.?[\s/\-.,]*(?:20)?\d{{2}}"
DATE = rf"(?:(?:0?[1-9]|1[0-2])[/\-.](?:20)?\d{{2}}|(?:0?[1-9]|[12]\d|3[01])[/\-.](?:0?[1-9]|1[0-2])[/\-.](?:20)?\d{{2}}|(?:\d{{1,2}}\s*)?{_MONTH})"
SPAN = r"\d{1,2}\s*(?:months?|years?|days?)"
AMOUNT = r"(?:₹|rs\.?|inr|[?=€¥£])\s*(?!0\.)\d[\d,]*(?:\.\d{1,2})?|\b(?!0\.)\d{1,5}\.\d{2}\b(?![/\-.]\d)(?!\s*%)|\b\d{1,5}\s*/-"
_PER = r"\s*(?:\(?\s*(?:per|/)\s*(?:\d+\s*)?(?:g|gm|kg|ml|l|ltr|n|unit|pc|piece|tablet|teabag|sachet|pack|pull|sheet|each)\b|per\b)"
MARKED = rf"(?i)(?:(₹|\brs\.?|\binr|[?=€¥£])\s?(\d{{1,5}}+(?:[.,]\d{{1,2}}+)?+)(?![A-Za-z0-9])(?!\s*(?:g|kg|ml|l|mg|%)\b)|\b(\d{{1,5}}+(?:\.\d{{2}})?+)\s*/-)(?!{_PER})"
CAPTIONS = {
    MRP: r"\b(?:m\.?\s?r\.?\s?p\.?(?:\s?[R₹?=])?(?![A-Za-z])|maximum\s*retail\s*price|retail\s*sale\s*price|max\.?\s*retail\s*price)",
    PACKED: r"\b(?:month\s*(?:&|and)?\s*year\s*of\s*(?:packing|manufacture)|date\s*of\s*(?:packing|manufacture)|packed\s*on|mfg\.?\s*date|mfd\.?\s*date|pkd\.?\s*on|packing\s*date|mfd\.?|mfg\.?)(?![A-Za-z0-9_])",
    BEST: r"\b(?:best\s*before|use\s*by|use\s*before|expiry\s*date|exp\.?\s*date|best\s*before\s*end|expiry|exp\.?)(?![A-Za-z0-9_])",
    COUNTRY: r"\bcountry\s*of\s*origin\b",
    IMPORTER: r"\b(?:imported\s*(?:&|and)?\s*(?:marketed)?\s*by|importer)\b",
    LICENCE: r"\bfssai[a-z. ]*(?:lic\.?\s*no\.?)?",
}
ACCEPTS = {MRP: AMOUNT, PACKED: rf"\b{DATE}\b", BEST: rf"\b(?:{DATE}|{SPAN})\b", COUNTRY: "[a-z]{3,}", LICENCE: r"\d{8,}"}
CAPTION_LIKE = r"(?i)^(net|maximum|mrp|manufactured|packed|marketed|imported|consumer|customer|country|batch|lot|best|month|date|fssai|barcode|ingredients|nutritional)"
ELSEWHERE = r"(?i)\bsee\s+(?:below|bottom|side|neck|cap|lid|panel|back|pack)\b|\brefer\s+(?:to\s+)?(?:the\s+)?(?:cap|neck|bottom|batch|lot|code|side)\b|\bfor\s+details\b"
TABLE_HEAD = r"(?i)\bnutrition(?:al)?\s*(?:information|facts|values?)|\bnutrient|typical\s*values|amount\s*per\s*serv"
TABLE_ROW = (
    r"(?i)\b(?:kcal|kj|energy\s*(?:value|\(|:|\d)|protein|carbohydrates?|saturated|trans\s*fat|total\s*fat|cholesterol|dietary\s*fib(?:re|er)|(?:added|total)\s*sugars?|sodium|per\s*100\s*(?:g|ml|gm)"
    r"|per\s*serv(?:e|ing)|serving\s*size|servings?\s*per|%\s*rda|rda\b|amount\s*per|nutrients?|calories|vitamin\s*[a-e]?\d*|magnesium|phosphorus|monounsaturated|polyunsaturated|omega\s*[36])\b"
)
FIGURES = r"(?i)^(?=[^0-9]*[0-9])(?:[\s\d.,%()|:\-–—]|(?:g|gm|mg|mcg|µg|kcal|kj|ml)\b)*$"
NOT_A_ROW = r"(?i)\bnet\s*(?:qty|quantity|wt|weight|contents?|vol)|" + CAPTIONS[MRP]
MADE_IN = r"(?i)\b(?:made|manufactured|produced|product|packed)\s+(?:in|of)\s+([A-Za-z]+(?:\s+[A-Za-z]+)?)"
MAKERS_LICENCE = r"(?i)(?<!fssai\s)(?<!fssai)\b(?:(?:mfg\.?|mfd\.?|manufacturing|drug|d\s*&\s*c|ayur(?:veda|vedic)?)\s*)?lic(?:ence|ense)?\.?\s*(?:no\.?|number|#)\s*[:.\-–—]?\s*"
LICENCE_VALUE = r"(?-i:([A-Z0-9][A-Z0-9/\-.()]{2,}(?:\s?[A-Z0-9/\-.()]+){0,2}))"
UNIT_CODE = r"^\s*([A-Z0-9]{1,3})\)\s*"
COUNTRIES = (
    "india", "china", "usa", "uk", "uae", "sri lanka", "nepal", "bangladesh", "bhutan", "pakistan", "thailand", "malaysia", "indonesia", "vietnam", "singapore", "japan", "korea", "south korea",
    "taiwan", "italy", "germany", "france", "spain", "netherlands", "belgium", "switzerland", "austria", "poland", "turkey", "australia", "new zealand", "canada", "mexico", "brazil", "argentina",
    "chile", "egypt", "kenya", "south africa", "saudi arabia", "oman", "qatar", "iran", "russia", "ukraine", "ireland", "denmark", "sweden", "norway", "finland", "greece", "portugal",
    "philippines", "myanmar", "cambodia", "hong kong",
)
PHONE = r"\+?\d[\d\s-]{8,}"


def by_key(key: Column, patterns: dict[str, str], text: Column, otherwise: bool = True) -> Column:
    """Whether the text has the key's pattern."""
    return reduce(lambda c, k: c.when(key == k, text.rlike(f"(?i){patterns[k]}")), patterns, F.when(F.lit(False), F.lit(False))).otherwise(otherwise)


def captioned(lines: DataFrame, by: Sequence[str], max_gap: float = 90, captions: dict[str, str] = CAPTIONS, accepts: dict[str, str] = ACCEPTS) -> DataFrame:
    """Per key the first caption with a value: what its own line says after it, else the first line below. A line that
    names another caption and can't be the value is passed over."""
    after = []
    for key, p in captions.items():
        rest = F.regexp_extract("text", rf"(?i){p}(.*)$", 1)
        after.append(F.when(F.col("text").rlike(f"(?i){p}"), F.struct(F.lit(key).alias("key"), F.trim(F.regexp_replace(rest, r"^[\s:.\-–—]+", "")).alias("rest"), F.regexp_extract("text", f"(?i)({p})", 1).alias("caption"))))
    caption = lines.where(~F.col("text").rlike(ELSEWHERE)).select(*lines.columns, F.explode(F.array_compact(F.array(*after))).alias("f")).select(*lines.columns, "f.*")
    own = (F.col("rest") != "") & by_key(F.col("key"), accepts, F.col("rest"))
    beside = caption.where(own).select(*by, "key", "caption", F.col("rest").alias("value"), F.col("ord").alias("at"), "ord", "confidence", "y1")
    typed = F.col("c_key").isin(*accepts)
    fits = by_key(F.col("c_key"), accepts, F.col("v_text"))
    passed = typed & ~fits & F.col("v_text").rlike(CAPTION_LIKE)
    below = nearest_below(caption.where(~own), lines, by, max_gap, test=~passed, also=["c_key"]).where(fits)
    below = below.select(*by, F.col("c_key").alias("key"), F.col("c_caption").alias("caption"), F.col("v_text").alias("value"), F.col("c_ord").alias("at"), F.col("v_ord").alias("ord"), F.col("v_confidence").alias("confidence"), F.col("v_y1").alias("y1"))
    hit = F.struct("caption", "value", "ord", "confidence", "y1")
    return beside.unionByName(below).groupBy(*by, "key").agg(F.min_by(hit, "at").alias("h")).select(*by, "key", "h.*")


def amounts(text: Column, lenient: Column) -> Column:
    """Marked prices (text, amount), without those per unit. Misread marks count with two decimals, or leniently from 10."""
    fixed = repair_rupee(text)
    found = F.arrays_zip(*[F.regexp_extract_all(fixed, F.lit(MARKED), F.lit(k)).alias(f"g{k}") for k in range(4)])

    def one(m: Column) -> Column:
        digits = F.replace(F.coalesce(F.nullif(m["g2"], F.lit("")), m["g3"]), F.lit(","), F.lit("."))
        amount, paise, rupee = digits.try_cast("double"), digits.rlike(r"\.\d{2}$"), m["g1"].rlike("(?i)^(₹|rs|inr)")
        good = F.when(m["g1"] == "", True).when(paise, True).when(rupee, amount >= 10).otherwise(lenient & (amount >= 10))
        return F.struct(F.trim(m["g0"]).alias("text"), amount.alias("amount"), (good & (amount >= 1)).alias("good"))

    return F.filter(F.transform(found, one), lambda a: a["good"])


def prices(lines: DataFrame, by: Sequence[str], hits: DataFrame) -> DataFrame:
    """The captioned price, else the largest marked one; with its caption, and the tax note printed within 90 pixels."""
    has = F.max(F.col("text").rlike(f"(?i){CAPTIONS[MRP]}")).over(Window.partitionBy(*by))
    marked = lines.withColumn("has", has).select(*lines.columns, F.posexplode(amounts(F.col("text"), F.col("has"))).alias("n", "a"))
    top = marked.groupBy(*by).agg(F.max_by(F.struct(F.regexp_replace("a.text", r"^[?=€¥£]\s?", "₹").alias("value"), "ord", "confidence", "y1"), F.struct("a.amount", -F.col("ord"), -F.col("n"))).alias("h")).select(*by, "h.*")
    dated = F.col("value").rlike(rf"(?i)\b{DATE}\b") & ~F.col("value").rlike(r"(?i)₹|\brs\b|\binr\b")
    held = hits.where((F.col("key") == MRP) & ~dated).select(*by, "value", "ord", "confidence", "y1")
    best = held.unionByName(top.join(held.select(*by), list(by), "left_anti"))
    notes = lines.select(*by, F.col("ord").alias("n_ord"), F.col("text").alias("note"), F.col("confidence").alias("n_conf"), F.col("y0").alias("n_y0"), F.regexp_extract("text", f"(?i)({CAPTIONS[MRP]})", 1).alias("n_cap"))
    tax, cap = notes.where(F.col("note").rlike("(?i)incl.*tax|inclusive of all taxes")), notes.where("n_cap != ''").groupBy(*by).agg(F.min_by("n_cap", "n_ord").alias("cap"))
    near = best.join(tax, list(by)).where(F.abs(F.col("n_y0") - F.col("y1")) < 90).groupBy(*by).agg(F.min_by(F.struct("note", "n_cap", "n_conf"), "n_ord").alias("tax"))
    x = best.join(near, list(by), "left").join(cap, list(by), "left")
    bare, told = F.trim(F.regexp_replace("value", f"(?i){CAPTIONS[MRP]}", "")), F.col("tax").isNotNull() & ~F.col("value").rlike("(?i)incl")
    value = (
        F.when(told & (F.col("tax.n_cap") != ""), F.concat_ws(" ", "tax.n_cap", bare, F.lit("(incl. of all taxes)"))).when(told, F.concat_ws(" ", "value", "tax.note"))
        .when(F.col("cap").isNotNull() & ~F.col("value").rlike(f"(?i){CAPTIONS[MRP]}"), F.concat_ws(" ", "cap", "value")).otherwise(F.col("value"))
    )
    return x.select(*by, F.lit(MRP).alias("key"), F.trim(value).alias("value"), "ord", F.when(told, F.least("confidence", "tax.n_conf")).otherwise(F.col("confidence")).alias("confidence"))


def date_tokens(text: Column, first_year: int = 2015, last_year: int = 2036) -> Column:
    """(text, key) of all printed dates; key is year * 12 + month, and day / 32 where a day is printed in figures."""
    edge, end = r"(?<![\d\-/.])\b", r"\b(?![\d\-/.])"
    full = rf"{edge}(0?[1-9]|[12]\d|3[01])[/\-.](0?[1-9]|1[0-2])[/\-.](20\d{{2}}|\d{{2}}){end}"
    short = rf"(?i)(?<![(\d]\s{{0,4}}){edge}(?!\d\.\d{{2}}{end})(0?[1-9]|1[0-2])[/\-.](20\d{{2}}|\d{{2}}){end}(?!\s*(?:%|(?:g|gm|kg|ml|l|ltr|mg|pcs)(?![A-Za-z])))"
    named = rf"(?i)\b(?:\d{{1,2}}\s*)?({_MONTHS.replace(' ', '|')})[a-z]{{0,6}}\.?[\s/\-.,]*((?:20)?\d{{2}})\b"
    spare = F.when(text.rlike(PHONE) & ~F.regexp_replace(text, PHONE, "").rlike(rf"(?i)\b{DATE}\b"), "").otherwise(text)
    groups = lambda x, p, n: F.arrays_zip(*[F.regexp_extract_all(x, F.lit(p), F.lit(k)).alias(f"g{k}") for k in range(n + 1)])
    year = lambda y: F.when(F.length(y) == 2, y.cast("int") + 2000).otherwise(y.cast("int"))
    month = lambda m: (F.position(F.lower(m), F.lit(_MONTHS)) + 3) / 4
    out = lambda t, y, key: F.struct(F.trim(t).alias("text"), F.when(y.between(first_year, last_year), y * 12 + key).cast("double").alias("key"))
    found = F.concat(
        F.transform(groups(spare, full, 3), lambda m: out(m["g0"], year(m["g3"]), m["g2"].cast("int") + m["g1"].cast("int") / 32)),
        F.transform(groups(F.regexp_replace(spare, full, " / "), short, 2), lambda m: out(m["g0"], year(m["g2"]), m["g1"].cast("double"))),
        F.transform(groups(spare, named, 2), lambda m: out(m["g0"], year(m["g2"]), month(m["g1"]))),
    )
    return F.filter(found, lambda d: d["key"].isNotNull())


def dates(lines: DataFrame, by: Sequence[str], hits: DataFrame) -> DataFrame:
    """Captioned dates, cut to the date unless they are a range; else the earliest for packing, and the latest of two or
    more for best before, with a confidence of at most 0.8."""
    value = F.col("value")
    part = F.coalesce(*[F.nullif(F.regexp_extract(value, rf"(?i)\b({p})\b", 1), F.lit("")) for p in (DATE, SPAN)], value)
    only = F.when(value.rlike(rf"(?i){DATE}\s*(?:-|–|to)\s*{DATE}"), value).otherwise(part)
    held = hits.where(F.col("key").isin(PACKED, BEST)).select(*by, "key", only.alias("value"), "ord", "confidence")
    d = lines.select(*by, "ord", "confidence", F.posexplode(date_tokens(F.col("text"))).alias("n", "d")).select(*by, "ord", "confidence", "n", "d.*")
    hit = F.struct(F.col("text").alias("value"), "ord", F.least("confidence", F.lit(0.8)).alias("confidence"))
    ends = d.groupBy(*by).agg(F.min_by(hit, F.struct("key", "ord", "n")).alias("a"), F.max_by(hit, F.struct("key", -F.col("ord"), -F.col("n"))).alias("z"), (F.min("key") < F.max("key")).alias("two"))
    kinds = F.array(F.struct(F.lit(PACKED).alias("key"), F.col("a").alias("h")), F.struct(F.lit(BEST).alias("key"), F.when(F.col("two"), F.col("z")).alias("h")))
    guessed = ends.select(*by, F.explode(kinds).alias("k")).where("k.h is not null").select(*by, "k.key", "k.h.*")
    return held.unionByName(guessed.join(held.select(*by, "key"), [*by, "key"], "left_anti"))


def countries(lines: DataFrame, by: Sequence[str], hits: DataFrame) -> DataFrame:
    """The captioned country, else the first 'made in' with a country of the list, two words before one."""
    held = hits.where(F.col("key") == COUNTRY).select(*by, "key", "value", "ord", "confidence")
    two = F.regexp_replace(F.lower(F.regexp_extract("text", MADE_IN, 1)), r"\s+", " ")
    one = F.substring_index(two, " ", 1)
    name = F.when(two.isin(*COUNTRIES), two).when(one.isin(*COUNTRIES), one)
    shown = F.when(name.startswith("u") & (F.length(name) <= 3), F.upper(name)).otherwise(F.initcap(name))
    made = lines.select(*by, shown.alias("value"), "ord", "confidence").where("value is not null").groupBy(*by).agg(F.min_by(F.struct("value", "ord", "confidence"), "ord").alias("h")).select(*by, F.lit(COUNTRY).alias("key"), "h.*")
    return held.unionByName(made.join(held.select(*by), list(by), "left_anti"))


def licences(lines: DataFrame, by: Sequence[str], hits: DataFrame, batches: DataFrame | None = None) -> DataFrame:
    """The captioned food licence, else 14 digits, else a maker's licence: that of the plant whose code, on the line or the
    two before, starts the batch number (batches: by, batch), else the first."""
    held = hits.where(F.col("key") == LICENCE).select(*by, "value", "ord", "confidence")
    along = Window.partitionBy(*by).orderBy("ord").rowsBetween(-2, 0)
    x = lines.withColumn("codes", F.collect_set(F.nullif(F.upper(F.regexp_extract("text", UNIT_CODE, 1)), F.lit(""))).over(along))
    if batches is not None:
        x = x.join(batches.select(*by, F.upper(F.regexp_extract("batch", "(?i)^([A-Z]{1,3})", 1)).alias("prefix")), list(by), "left")
    else:
        x = x.withColumn("prefix", F.lit(None).cast("string"))
    plain = F.regexp_extract("text", r"\b(\d{14})\b", 1)
    maker = F.regexp_replace(F.regexp_extract("text", rf"{MAKERS_LICENCE}.*?{LICENCE_VALUE}", 1), "[.,]$", "")
    keyed = F.coalesce(F.array_contains("codes", F.col("prefix")), F.lit(False))
    rank = F.when(plain != "", 0).when(maker.rlike(r"\d"), F.when(keyed, 1).otherwise(2))
    most = F.element_at(F.array(F.lit(1.0), F.lit(0.85), F.lit(0.8)), rank + 1)
    x = x.withColumn("rank", rank).where("rank is not null")
    x = x.select(*by, "rank", "ord", F.when(plain != "", plain).otherwise(maker).alias("value"), F.least("confidence", most).alias("confidence"))
    found = x.groupBy(*by).agg(F.min_by(F.struct("value", "ord", "confidence"), F.struct("rank", "ord")).alias("h")).select(*by, "h.*")
    return held.unionByName(found.join(held.select(*by), list(by), "left_anti")).select(*by, F.lit(LICENCE).alias("key"), "value", "ord", "confidence")


def without_nutrition(lines: DataFrame, by: Sequence[str]) -> DataFrame:
    """Lines outside the nutrition table: no headings, no nutrients, and no rows of figures in the box of two or more."""
    row = F.col("text").rlike(TABLE_HEAD) | (F.col("text").rlike(TABLE_ROW) & ~F.col("text").rlike(NOT_A_ROW))
    x = lines.withColumn("_row", row)
    own = lambda f, c: f(F.when(F.col("_row"), c)).over(Window.partitionBy(*by))
    high = F.coalesce(F.nullif(own(F.median, F.col("y1") - F.col("y0")) * 1.6, F.lit(0.0)), F.lit(30.0))
    inside = (F.col("x1") > own(F.min, F.col("x0"))) & (F.col("x0") < own(F.max, F.col("x1"))) & (F.col("y1") > own(F.min, F.col("y0")) - high) & (F.col("y0") < own(F.max, F.col("y1")) + high * 2)
    figures = F.col("text").rlike(FIGURES) & ((F.size(F.regexp_extract_all("text", F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0))) >= 2) | F.col("text").contains("%"))
    table = (own(F.count, F.lit(1)) >= 2) & inside & figures
    return x.withColumn("_out", F.col("_row") | F.coalesce(table, F.lit(False))).where("not _out").drop("_row", "_out")


def fields(lines: DataFrame, by: Sequence[str] = ("image_id",), batches: DataFrame | None = None) -> DataFrame:
    """Price, dates, country, importer and licence of every image."""
    by = list(by)
    held = lines.select(*by, "ord", F.coalesce("text", F.lit("")).alias("text"), "confidence", "x0", "y0", "x1", "y1")
    held = written(without_nutrition(held, by).withColumn("text", repair_rupee(F.col("text"))), "lines-without-tables")
    hits = written(captioned(held, by), "hits")
    importer = hits.where(F.col("key") == IMPORTER).select(*by, "key", "value", "ord", "confidence")
    return prices(held, by, hits).unionByName(dates(held, by, hits)).unionByName(countries(held, by, hits)).unionByName(importer).unionByName(licences(held, by, hits, batches))
