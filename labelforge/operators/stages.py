"""A label's declarations as one state that passes through fixed stages: legends, repair, caption columns, repair, country.

The state has one row for each image: its lines in order, and one column for each declaration: a struct of value, ord,
confidence and text (that of the line it was read from), null where nothing was read. A stage fills or mends columns, so a later
one can draw on what an earlier one found in another field: the country of origin comes from the maker's address, a price is
weighed against quantity and unit price, dates are told apart by their order. Lines and fields meet in one shuffle by image; from
there on all stages, also those that look at lines again, are expressions over the row, without a join or another shuffle. The
state is written once, so the driver plans two queries whatever the number of stages or rows.

Defined cases: images without lines or fields, or with a null in `by`, have no rows; null texts are empty lines; of several values
of one key in `fields` the one of the first line counts, on one line the least; of several marked values on one line, and of dates
of one month on one line, the first; equal lines are told apart by ord; other columns of `lines` are not looked at; an image's
lines are one row, so they have to fit in a task's memory.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.functions.geom import span_overlap
from labelforge.functions.text import looks_like_words, repair_rupee
from labelforge.operators import declarations as d
from labelforge.operators import readers as r
from labelforge.sources.scratch import written

KEYS = (d.NAME, d.MAKER, d.ADDRESS, d.NET, r.MRP, d.CARE, r.PACKED, r.BEST, r.COUNTRY, r.IMPORTER, r.LICENCE, d.BATCH)
HIT = "struct<value: string, ord: int, confidence: double, text: string>"
# What a name or contact isn't, unit prices, marks of legends, captions and values of columns, caps on confidence.
NOT_A_MAKER = r"(?i)\b(?:incl?\.?\s*of|taxes|per\s*g|refer|scan|first\s*(?:two|three)|name\s*,?\s*address|see\s*(?:below|side|neck))\b"
CONTACT = rf"(?i){r.PHONE}|{d.EMAIL}|www\.|\.com\b|\.in\b|\.org\b|\b1800\b"
UNIT_PRICE = r"(?i)(\d+[.,]\d{1,3})\s*(?:per|/)\s*(?:100\s*)?(?:g|gm|ml|kg|l)\b"
GLUED = r"(?<![\d₹])7(\d{2,4}[.,]\d{2})\b"
YEARS = (2015, 2036)
LEGEND = {
    r.MRP: r"m\.?\s?r\.?\s?p\.?", r.PACKED: r"mf[dg]\.?(?:\s*date)?|manufactured|packed", r.BEST: r"exp\w*\.?(?:\s*date)?|best\s*before|use\s*b\w+", d.BATCH: r"batch(?:\s*no\.?)?",
}
MARK = r"[*#@^†‡§©®'‘’\"“”]"
MARKED_VALUE = {
    r.MRP: r"(?i)^((?:₹|rs\.?|[?=€¥£])\s*\d{1,5}(?:[.,]\d{1,2})?|\d{1,5}[.,]\d{2})(?!\s*[/-]\d)", r.PACKED: r"^((?:0?[1-9]|1[0-2])[/\-.](?:20)?\d{2})",
    r.BEST: r"^((?:0?[1-9]|1[0-2])[/\-.](?:20)?\d{2})", d.BATCH: r"(?i)^([A-Z0-9][A-Z0-9\-/]{1,12})",
}
COLUMNS = {
    r.MRP: (rf"(?i){r.CAPTIONS[r.MRP]}", r"(?i)(?:₹|rs\.?|inr|[?=€¥£])\s*(?!0\.)\d{1,5}(?:[.,]\d{1,2})?|\b(?!0\.)\d{1,5}[.,]\d{2}\b|\b\d{1,5}\s*/-"),
    r.PACKED: (r"(?i)\b(?:mfd\.?|mfg\.?(?:\s*date|\s*dt\.?)?|pkd\.?(?:\s*on|\s*date)?|packed(?:\s*on|\s*date)?|pkt\.?\s*dt\.?|date\s*of\s*(?:pkg\.?|packing|packaging|mfg\.?|manufacture)|dom|manufactured\s*on)(?![A-Za-z0-9_])", rf"(?i){r.DATE}"),
    r.BEST: (r"(?i)\b(?:use\s*by|used\s*by|use\s*before|best\s*before|expiry(?:\s*date)?|exp\.?(?:\s*date|\s*dt\.?)?|doe)(?![A-Za-z0-9_])", rf"(?i){r.DATE}"),
    d.BATCH: (r"(?i)\b(?:batch\s*(?:no\.?|number|code)?|lot\s*(?:no\.?|number)?|b\.?\s*no\.?|bn|code)(?![A-Za-z0-9_])", r"\b(?=[A-Z0-9\-/.:]*\d)(?=[A-Z0-9\-/.:]*(?:[A-Z\-/]|\d{4}))[A-Z0-9][A-Z0-9\-/.:]{2,14}\b"),
    d.NET: (rf"(?i){d.CAPTIONS[d.NET]}", rf"(?i){d.QUANTITY}"),
}
POINTS_ELSEWHERE = r"(?i)\b(?:see|refer(?:\s*to)?|read|check)\s+(?:the\s+)?(?:neck|bottle|cap|lid|bottom|top|base|side\s*panel|below|above|pack|carton|sleeve)\b"
LEGEND_CAP, ROW_CAP, BLOCK_CAP, COUNTRY_CAP, INDIA_CAP = 0.85, 0.85, 0.75, 0.7, 0.65


def _head(array: Column) -> Column:
    return F.try_element_at(array, F.lit(1))


def _first_of(array: str, key: str) -> Column:
    """The first of the array's structs (key, hit) with that key: its hit."""
    return _head(F.filter(array, lambda x: x["key"] == key))["hit"]


def gathered(fields: DataFrame, lines: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row for each image with lines: its lines and the fields that readers found, both in the order of ord."""
    line = F.struct("ord", F.coalesce("text", F.lit("")).alias("text"), "confidence", "x0", "y0", "x1", "y1")
    hit = F.struct(F.col("ord").cast("int").alias("ord"), "key", "value", F.col("confidence").cast("double").alias("confidence"))
    found = fields.where((F.trim("value") != "") & F.col("ord").isNotNull()).select(*by, hit.alias("hit"))
    both = lines.select(*by, line.alias("line")).unionByName(found, allowMissingColumns=True).dropna(subset=list(by))
    return both.groupBy(*by).agg(F.sort_array(F.collect_list("line")).alias("lines"), F.sort_array(F.collect_list("hit")).alias("hits")).where(F.size("lines") > 0)


def state_of(s: DataFrame, by: Sequence[str]) -> DataFrame:
    """Gathered rows as the state: each hit with the text of its line, and the first unit price printed."""
    text = lambda h: F.coalesce(_head(F.filter("lines", lambda x: x["ord"] == h["ord"]))["text"], F.lit(""))
    hits = F.transform("hits", lambda h: F.struct(h["key"].alias("key"), F.struct(h["value"].alias("value"), h["ord"].alias("ord"), h["confidence"].alias("confidence"), text(h).alias("text")).alias("hit")))
    priced = lambda t: F.replace(F.nullif(F.regexp_extract(t, UNIT_PRICE, 1), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    unit_price = _head(F.array_compact(F.transform("lines", lambda x: priced(x["text"]))))
    s = s.select(*by, "lines", unit_price.alias("unit_price"), hits.alias("hits"))
    return s.select(*by, "lines", "unit_price", *[_first_of("hits", k).alias(k) for k in KEYS])


def rows_of(state: DataFrame, by: Sequence[str]) -> DataFrame:
    held = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("h")) for k in KEYS]), lambda x: x["h"].isNotNull())
    return state.select(*by, F.explode(held).alias("x")).select(*by, "x.key", "x.h.value", "x.h.ord", "x.h.confidence")


def _value(key: str, value: Column) -> Column:
    """The hit with another value."""
    return F.when(F.col(key).isNotNull(), F.col(key).withField("value", value))


def _letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^A-Za-z]", ""))


def _country(text: Column) -> Column:
    """The last country that a text names, as a label prints it; a name that ends another one stands for it."""
    ends = [c for c in r.COUNTRIES if not any(c != x and c.endswith(" " + x) for x in r.COUNTRIES)]
    name = F.try_element_at(F.regexp_extract_all(F.lower(text), F.lit(rf"\b({'|'.join(ends)})\b"), F.lit(1)), F.lit(-1))
    return F.when(F.length(name) <= 3, F.upper(name)).otherwise(F.initcap(name))


def _plausible(date: Column) -> Column:
    """A span of months or days, or a year that a pack may bear."""
    months = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
    full = F.regexp_extract_all(date, F.lit(r"(?<!\d)(20\d{2})(?!\d)"), F.lit(1))
    short = F.concat(F.regexp_extract_all(date, F.lit(r"[/\-.](\d{2})(?!\d)"), F.lit(1)), F.regexp_extract_all(date, F.lit(rf"(?i)(?:{months})[a-z]{{0,6}}\.?[\s/\-.,]*(?:20)?(\d{{2}})(?!\d)"), F.lit(1)))
    years = F.concat(F.transform(full, lambda y: y.cast("int")), F.transform(short, lambda y: y.cast("int") + 2000))
    return date.rlike(r"(?i)\b\d{1,2}\s*(?:months?|years?|days?)\b") | F.exists(years, lambda y: y.between(*YEARS))


def repaired_names(s: DataFrame) -> DataFrame:
    """Makers, addresses and names that don't read as such go; a food licence loses its blanks."""
    v = lambda k: F.col(f"{k}.value")
    maker = looks_like_words(v(d.MAKER), 0.5) & (_letters(v(d.MAKER)) >= 5) & ~v(d.MAKER).rlike(NOT_A_MAKER)
    a = v(d.ADDRESS)
    placed = F.regexp_replace(a, r"\s", "").rlike(d.PIN) | a.rlike(d.PLACE) | a.rlike(d.ADDRESS_WORD) | a.rlike(r"\b\d{5,6}\b") | _country(a).isNotNull()
    address = placed & (_letters(a) >= 8) & looks_like_words(a, 0.5)
    n = F.trim(v(d.NAME))
    even = F.length(F.regexp_replace(n, r"[^(]", "")) == F.length(F.regexp_replace(n, r"[^)]", ""))
    name = even & ~n.rlike(r"[,\-–(|:;]$") & ~n.rlike(r"^[,\-–)|:;]")
    compact = F.regexp_replace(v(r.LICENCE), r"\s", "")
    kept = {k: F.when(test, F.col(k)) for k, test in ((d.MAKER, maker), (d.ADDRESS, address), (d.NAME, name))}
    return s.withColumns({**kept, r.LICENCE: _value(r.LICENCE, F.when(compact.rlike(r"^\d{14}$"), compact).otherwise(v(r.LICENCE)))})


def repaired_dates(s: DataFrame) -> DataFrame:
    """A range is both dates, that of best before if both have one; what can't be a date goes, and a best before equal to the
    packing; dates in the wrong order change places."""
    for k in (r.PACKED, r.BEST):
        ends = [F.regexp_extract(F.col(f"{k}.value"), rf"(?i)({r.DATE})\s*(?:-|–|to)\s*({r.DATE})", i) for i in (1, 2)]
        ranged = F.coalesce(ends[0] != "", F.lit(False))
        s = s.withColumn("_range", F.when(ranged, F.struct(F.col(k).withField("value", ends[0]).alias("a"), F.col(k).withField("value", ends[1]).alias("z"))))
        s = s.withColumns({r.PACKED: F.coalesce("_range.a", r.PACKED), r.BEST: F.coalesce("_range.z", r.BEST)}).drop("_range")
    s = s.withColumns({k: F.when(_plausible(F.col(f"{k}.value")), F.col(k)) for k in (r.PACKED, r.BEST)})
    digits = [F.regexp_replace(F.col(f"{k}.value"), r"\D", "") for k in (r.PACKED, r.BEST)]
    s = s.withColumn(r.BEST, F.when(F.col(r.PACKED).isNull() | (digits[0] != digits[1]), F.col(r.BEST)))
    key = [F.array_min(F.transform(r.date_tokens(F.col(f"{k}.value")), lambda t: t["key"])) for k in (r.PACKED, r.BEST)]
    s = s.withColumn("_late", F.coalesce(key[0] > key[1], F.lit(False)))
    return s.withColumns({r.PACKED: F.when(F.col("_late"), F.col(r.BEST)).otherwise(F.col(r.PACKED)), r.BEST: F.when(F.col("_late"), F.col(r.PACKED)).otherwise(F.col(r.BEST))}).drop("_late")


def repaired_amounts(s: DataFrame) -> DataFrame:
    """A price needs an amount of ten or with paise; a 7 that was a rupee sign goes where price and quantity say so; a
    quantity is cut to itself, and one below five grams needs its caption. Column unit_price: the first one printed."""
    v = repair_rupee(F.col(f"{r.MRP}.value"))
    patterns = (r"(?i)(?:₹|\brs\.?|\binr)\s*(\d{1,5})(?:[.,](\d{1,2}))?(?!\d)", r"(?i)^.*(?<!\d)(\d{1,5})[.,](\d{2})(?!\d)", r"(\d{1,5})(?:[.,](\d{1,2}))?(?!\d)")
    found = F.coalesce(*[F.when(v.rlike(p), F.struct(F.regexp_extract(v, p, 1).alias("a"), F.regexp_extract(v, p, 2).alias("p"))) for p in patterns])
    s = s.withColumn(r.MRP, F.when(found.isNotNull() & ((found["a"].cast("int") >= 10) | (found["p"] != "")), F.col(r.MRP).withField("value", v)))
    price, net = F.col(f"{r.MRP}.value"), F.col(f"{d.NET}.value")
    glued = F.regexp_extract(price, GLUED, 1)
    measure = r"(?i)(\d+(?:\.\d+)?)\s*(kg|g|gm|gms|ml|l|ltr|litres?)\b"
    amount = F.regexp_extract(net, measure, 1).try_cast("double") * F.when(F.regexp_extract(net, measure, 2).rlike("(?i)^(?:kg|l|ltr|litres?)$"), 1000).otherwise(1)
    expected, number = F.col("unit_price") * amount, F.replace(glued, F.lit(","), F.lit(".")).try_cast("double")
    whole = F.concat(F.lit("7"), F.replace(glued, F.lit(","), F.lit("."))).try_cast("double")
    better = F.coalesce((glued != "") & (expected > 0) & (F.abs(number - expected) < F.abs(whole - expected)), F.lit(False))
    s = s.withColumn(r.MRP, F.when(better, F.col(r.MRP).withField("value", F.regexp_replace(price, GLUED, "₹$1"))).otherwise(F.col(r.MRP)))
    told = (net.rlike(f"(?i){d.PACK}") | net.rlike(f"(?i){d.PACK_TURNED}")) & net.rlike(r"\(\s*\d")
    s = s.withColumn(d.NET, F.when(told, F.col(d.NET)).when(d.quantity_in(net).isNotNull(), F.col(d.NET).withField("value", d.quantity_in(net))))
    small = F.regexp_extract(F.col(f"{d.NET}.value"), r"(?i)(\d+(?:\.\d+)?)\s*(?:g|gm|gms|ml)\b", 1).try_cast("double") < 5
    return s.withColumn(d.NET, F.when(~F.coalesce(small, F.lit(False)) | F.col(f"{d.NET}.text").rlike(f"(?i){d.CAPTIONS[d.NET]}"), F.col(d.NET)))


def _below(at: Column, max_gap: float = 70, min_overlap: float = 0.2) -> Column:
    """The nearest line below, as `layout.nearest_below` and `declarations.walk` have it; null without one."""
    high = at["y1"] - at["y0"]
    under = lambda x: (x["ord"] != at["ord"]) & (x["y0"] >= at["y1"] - high * 0.3) & (x["y0"] - at["y1"] <= max_gap) & (span_overlap(at["x0"], at["x1"], x["x0"], x["x1"]) >= min_overlap)
    return F.array_min(F.transform(F.filter("lines", under), lambda x: F.struct(*[x[c].alias(c) for c in ("y0", "ord", "x0", "x1", "y1", "text", "confidence")])))


def repaired_care(s: DataFrame) -> DataFrame:
    """Care lines without a contact go on to the first one of the three lines below that has it, or go."""
    care = F.col(d.CARE)
    s = s.withColumn("_0", F.when(~care["value"].rlike(CONTACT), _head(F.filter("lines", lambda x: x["ord"] == care["ord"]))))
    for k in (1, 2, 3):
        s = s.withColumn(f"_{k}", _below(F.col(f"_{k - 1}")))
    down = F.coalesce(*[F.when(F.col(f"_{k}.text").rlike(CONTACT), F.array(*[f"_{i}" for i in range(1, k + 1)])) for k in (1, 2, 3)])
    s = s.withColumn("_down", down)
    sure = F.filter(F.transform("_down", lambda x: x["confidence"].cast("double")), lambda c: c.isNotNull())
    more = F.aggregate(sure, F.lit(0.0), lambda a, c: a + c) / F.nullif(F.size(sure), F.lit(0))
    value = d.joined(F.concat(F.array(care["text"]), F.transform("_down", lambda x: x["text"])))
    mended = care.withField("value", value).withField("confidence", (care["confidence"] + more) / 2)
    return s.withColumn(d.CARE, F.when(care["value"].rlike(CONTACT), care).when(F.col("_down").isNotNull(), mended)).drop("_0", "_1", "_2", "_3", "_down")


def repaired(s: DataFrame, care: bool = True) -> DataFrame:
    """One pass of all repairs over the state, which has unit_price."""
    s = repaired_amounts(repaired_dates(repaired_names(s)))
    return repaired_care(s) if care else s


def _hit(value: Column, x: Column, most: float) -> Column:
    """What a line says, with a confidence of at most so much."""
    return F.struct(value.alias("value"), x["ord"].cast("int").alias("ord"), F.least(x["confidence"], F.lit(most)).cast("double").alias("confidence"), x["text"].alias("text"))


def _fill(s: DataFrame, hits: Column) -> DataFrame:
    """Fills empty columns from an array of (key, hit), for each key with its first."""
    s = s.withColumn("_hits", hits)
    return s.withColumns({k: F.coalesce(k, _first_of("_hits", k)) for k in COLUMNS}).drop("_hits")


def legend_stage(s: DataFrame) -> DataFrame:
    """A legend defines marks ("*MFD. #EXP."); what stands after a mark on another line is the value of its key."""
    plain = lambda t: F.regexp_replace(F.regexp_replace(t, "['‘’\"“”]", "*"), "[©®]", "@")
    # Of the keys that a line gives to one mark the last of LEGEND counts, so these are told in turned order.
    defined = lambda t: F.array_compact(F.array(*[F.when(t.rlike(rf"(?i)[*#@^†‡§]\s*(?:{p})"), F.struct(F.lit(k).alias("key"), F.regexp_extract(t, rf"(?i)([*#@^†‡§])\s*(?:{p})", 1).alias("mark"))) for k, p in reversed(LEGEND.items())]))
    s = s.withColumn("_marks", F.transform("lines", lambda x: F.struct(x.alias("line"), plain(x["text"]).alias("plain"))))
    s = s.withColumn("_marks", F.transform("_marks", lambda x: F.struct(x["line"].alias("line"), x["plain"].alias("plain"), defined(x["plain"]).alias("defined"))))
    s = s.withColumn("_legend", F.flatten(F.transform("_marks", lambda x: x["defined"])))

    def told(x: Column) -> Column:
        """(key, tail, line) of a line's marked values; key is null for marks without a meaning."""
        part = lambda k: F.regexp_extract_all(x["plain"], F.lit(r"([*#@^†‡§])\s*([^*#@^†‡§]+)"), F.lit(k))
        key = lambda mark: _head(F.filter("_legend", lambda f: f["mark"] == mark))["key"]
        return F.zip_with(part(1), part(2), lambda mark, tail: F.struct(key(mark).alias("key"), tail.alias("tail"), x["line"].alias("line")))

    bare = F.filter("_marks", lambda x: (F.size("_legend") > 0) & (F.size(x["defined"]) == 0))
    value = lambda x: F.nullif(F.coalesce(*[F.when(x["key"] == k, F.regexp_extract(x["tail"], p, 1)) for k, p in MARKED_VALUE.items()]), F.lit(""))
    shown = lambda key, v: F.when(key == r.MRP, F.concat(F.lit("MRP ₹"), F.regexp_replace(v, r"(?i)^(?:₹|rs\.?|[?=€¥£])\s*", ""))).otherwise(v)
    hits = F.transform(F.flatten(F.transform(bare, told)), lambda x: F.struct(x["key"].alias("key"), _hit(shown(x["key"], value(x)), x["line"], LEGEND_CAP).alias("hit")))
    return _fill(s, F.filter(hits, lambda x: x["hit"]["value"].isNotNull())).drop("_marks", "_legend")


def _lone(text: Column, missing: Column) -> Column:
    """Those of the missing keys whose captions stand alone on the line."""
    kinds = []
    for k, (caption, value) in COLUMNS.items():
        rest = F.regexp_replace(F.regexp_extract(text, f"{caption}(.*)$", 1), r"(?i)\(?\s*(?:incl?\.?|inclusive)[^)]*\)?|₹|rs\.?|inr|[:.\-–—|]", "")
        kinds.append(F.when(F.array_contains(missing, k) & text.rlike(caption) & ~text.rlike(POINTS_ELSEWHERE) & ~F.trim(rest).rlike(value), F.lit(k)))
    return F.array_compact(F.array(*kinds))


def _shown(key: Column, value: Column) -> Column:
    amount = F.trim(F.regexp_replace(value, r"^[?=€¥£]\s?", "₹"))
    priced = F.when(amount.rlike("(?i)^(?:₹|rs|inr)"), F.concat(F.lit("MRP "), amount)).otherwise(F.concat(F.lit("MRP ₹"), F.regexp_replace(amount, r"\s*/-$", "")))
    return F.when(key == r.MRP, priced).otherwise(F.trim(value))


def _missing() -> Column:
    return F.array_compact(F.array(*[F.when(F.col(k).isNull(), F.lit(k)) for k in COLUMNS]))


def _beside(c: Column) -> Column:
    """The nearest value of the caption's type on its row (as in `layout.same_row`), with the value in its text; null without one."""
    at, high = c["line"], c["line"]["y1"] - c["line"]["y0"]
    centre = lambda x: (x["y0"] + x["y1"]) / 2
    row = lambda x: (x["ord"] != at["ord"]) & (F.abs(centre(at) - centre(x)) <= high * 0.75) & (x["x0"] > (at["x0"] + at["x1"]) / 2) & (x["x0"] - at["x1"] < high * 30)
    typed = lambda t: F.coalesce(*[F.when(c["key"] == k, F.regexp_extract(t, f"({p[1]})", 1)) for k, p in COLUMNS.items()])
    values = F.transform(F.filter("lines", row), lambda x: F.struct(x["x0"].alias("x0"), x["ord"].alias("ord"), x["text"].alias("text"), x["confidence"].alias("confidence"), typed(x["text"]).alias("value")))
    no_code = lambda x: (c["key"] == d.BATCH) & (x["value"].rlike(f"(?i){r.DATE}") | x["text"].rlike(d.PRICE))
    return F.array_min(F.filter(values, lambda x: (x["value"] != "") & ~no_code(x)))


def columns_stage(s: DataFrame) -> DataFrame:
    """Captions in one column, values in another or in the row below. First, of the values on a caption's row the nearest of
    its type, each value for one caption only (the nearest on its left); then, of what stands in reach of the captions that are
    left, by type: the first and last date, the largest price, the first code and quantity."""
    s = s.withColumn("_missing", _missing())
    # A caption line may hold several keys: each is a caption of its own, so line and key together name it.
    captions = F.transform("lines", lambda x: F.transform(_lone(x["text"], F.col("_missing")), lambda k: F.struct(x.alias("line"), k.alias("key"))))
    s = s.withColumn("_lone", F.flatten(captions))
    pairs = F.transform("_lone", lambda c: F.struct(F.struct((-c["line"]["x1"]).alias("x"), c["line"]["ord"].alias("line"), c["key"].alias("key")).alias("place"), _beside(c).alias("v")))
    s = s.withColumn("_pairs", F.filter(pairs, lambda p: p["v"].isNotNull()))
    nearer = lambda p: F.exists("_pairs", lambda q: (q["v"]["ord"] == p["v"]["ord"]) & (q["v"]["value"] == p["v"]["value"]) & (q["place"] < p["place"]))
    own = F.transform(F.filter("_pairs", lambda p: ~nearer(p)), lambda p: F.struct(p["v"]["ord"].alias("ord"), p["place"]["key"].alias("key"), _hit(_shown(p["place"]["key"], p["v"]["value"]), p["v"], ROW_CAP).alias("hit")))
    s = _fill(s.withColumn("_pairs", F.sort_array(own)), F.col("_pairs"))

    s = s.withColumn("_missing", _missing())
    s = s.withColumn("_lone", F.filter("_lone", lambda c: F.array_contains("_missing", c["key"])))
    of = lambda f: F.transform("_lone", lambda c: f(c["line"]))
    s = s.withColumn("_highs", F.sort_array(F.filter(of(lambda x: x["y1"] - x["y0"]), lambda h: h.isNotNull())))
    middle = lambda k: F.try_element_at("_highs", F.floor((F.size("_highs") + k) / 2).cast("int"))
    half = F.when(F.size("_highs") > 0, middle(1) * 0.5 + middle(2) * 0.5)
    box = {
        "top": F.array_min(of(lambda x: x["y0"])), "bottom": F.array_max(of(lambda x: x["y1"])), "left": F.array_min(of(lambda x: x["x0"])), "high": F.coalesce(F.nullif(half, F.lit(0.0)), F.lit(20.0)),
        "captions": F.size(F.array_distinct(of(lambda x: x["ord"]))), "wanted": F.array_distinct(F.transform("_lone", lambda c: c["key"])),
    }
    s = s.withColumn("_box", F.struct(*[c.alias(k) for k, c in box.items()]))
    b, any_caption = F.col("_box"), "|".join(f"(?:{p[0]})" for p in COLUMNS.values())
    reach = lambda x: (x["y1"] >= b["top"] - b["high"] * 2) & (x["y0"] <= b["bottom"] + b["high"] * F.when(b["captions"] == 1, 6).otherwise(4)) & (x["x1"] >= b["left"])
    used = lambda x: F.exists("_pairs", lambda p: p["ord"] == x["ord"])  # noqa: E731  a value serves once
    s = s.withColumn("_near", F.filter("lines", lambda x: reach(x) & ~used(x) & ~x["text"].rlike(any_caption) & ~x["text"].rlike(r.CAPTION_LIKE)))

    wants = lambda k: F.array_contains(b["wanted"], F.lit(k))
    # Each kind: what the lines hold, in an array of structs whose first fields are their order and whose last one is the hit.
    each = lambda found, one: F.flatten(F.transform("_near", lambda x: F.transform(found(x["text"]), lambda t, n: one(x, t, n))))
    dates = each(r.date_tokens, lambda x, t, n: F.struct(t["key"].alias("key"), (-x["ord"]).alias("ord"), (-n).alias("n"), _hit(t["text"], x, BLOCK_CAP).alias("hit")))
    number = lambda t: F.replace(t, F.lit(","), F.lit("."))
    bare = lambda text: F.transform(F.filter(F.regexp_extract_all(text, F.lit(r"(?i)\b(?!0\.)(\d{1,5}[.,]\d{2})\d?\b(?![/\-.]\d)(?!\s*(?:g|gm|kg|ml|l|mg|%|per)\b)"), F.lit(1)), lambda t: ~t.rlike(f"(?i)^{r.DATE}$")), lambda t: F.struct(F.concat(F.lit("₹"), number(t)).alias("text"), number(t).try_cast("double").alias("amount")))
    marked = lambda text: F.transform(r.amounts(text, F.lit(False)), lambda a: F.struct(a["text"].alias("text"), a["amount"].alias("amount")))
    prices = each(lambda text: F.concat(marked(text), bare(text)), lambda x, a, n: F.struct(a["amount"].alias("amount"), (-x["ord"]).alias("ord"), (-n).alias("n"), _hit(_shown(F.lit(r.MRP), a["text"]), x, BLOCK_CAP).alias("hit")))
    s = s.withColumns({"_dates": F.when(wants(r.PACKED) | wants(r.BEST), dates), "_prices": F.when(wants(r.MRP), F.filter(prices, lambda a: a["amount"] >= 1))})
    earliest = F.array_min("_dates")["key"]
    first = F.array_max(F.filter("_dates", lambda t: t["key"] == earliest))["hit"]
    s = s.withColumns({"_a": first, "_z": F.array_max("_dates")["hit"], "_months": F.size(F.array_distinct(F.transform("_dates", lambda t: t["key"])))})
    later = (F.col("_z.value") != F.coalesce(f"{r.PACKED}.value", F.when(wants(r.PACKED), F.col("_a.value")), F.lit(""))) & ((F.col("_months") >= 2) | ~wants(r.PACKED))
    coded = lambda c: c.rlike(r"^[A-Z0-9][A-Z0-9\-/.: ]{2,14}$") & c.rlike(r"\d") & c.rlike("[A-Z]") & ~c.rlike(r"\b[A-Z]{4,}\b") & ~c.rlike(f"(?i){r.DATE}") & ~c.rlike(d.PRICE) & ~c.rlike(d.PLAIN_QUANTITY)
    code = _head(F.filter("_near", lambda x: coded(F.trim(x["text"]))))
    amount = lambda x: F.regexp_extract(x["text"], f"({COLUMNS[d.NET][1]})", 1)
    sized = _head(F.filter("_near", lambda x: amount(x) != ""))
    s = s.withColumns({"_code": F.when(wants(d.BATCH), code), "_sized": F.when(wants(d.NET), sized)})
    found = {
        r.PACKED: F.when(wants(r.PACKED), F.col("_a")), r.BEST: F.when(wants(r.BEST) & later, F.col("_z")), r.MRP: F.array_max("_prices")["hit"],
        d.BATCH: F.when(F.col("_code").isNotNull(), _hit(F.trim("_code.text"), F.col("_code"), BLOCK_CAP)), d.NET: F.when(F.col("_sized").isNotNull(), _hit(amount(F.col("_sized")), F.col("_sized"), BLOCK_CAP)),
    }
    s = s.withColumns({k: F.coalesce(F.col(k), v) for k, v in found.items()})
    return s.drop("_missing", "_lone", "_pairs", "_highs", "_box", "_near", "_dates", "_prices", "_a", "_z", "_months", "_code", "_sized")


def country_stage(s: DataFrame) -> DataFrame:
    """Without a stated origin: the last country of the maker's address, else India for an Indian place or postal code."""
    told = F.concat_ws(" ", f"{d.MAKER}.text", f"{d.ADDRESS}.text", f"{d.ADDRESS}.value")
    named, address = _country(told), F.col(d.ADDRESS)
    local = told.rlike(d.PLACE) | F.regexp_replace(told, r"\s", "").rlike(d.PIN)
    implied = lambda value, most: address.withField("value", value).withField("confidence", F.least(F.lit(most), address["confidence"]))
    found = F.when(address.isNotNull() & named.isNotNull(), implied(named, COUNTRY_CAP)).when(address.isNotNull() & local, implied(F.lit("India"), INDIA_CAP))
    return s.withColumn(r.COUNTRY, F.coalesce(r.COUNTRY, found))


def staged(fields: DataFrame, lines: DataFrame, by: Sequence[str] = ("image_id",)) -> DataFrame:
    """Declarations (by, key, value, ord, confidence) after all stages; `fields` are those that the readers found."""
    by = list(by)
    s = repaired(legend_stage(state_of(gathered(fields, lines, by), by)))
    s = country_stage(repaired(columns_stage(s), care=False))
    return rows_of(written(s.select(*by, *KEYS), "state"), by)
