"""Line classification: hashed features, softmax over a weight table, training with Spark ML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelforge.functions.text import EDGE_R, fnv1a, letters, normalise, word

BUCKETS = 4096
_ANY = r"[^\n\r\x{2028}\x{2029}]"
_MONTH, _DAY, _YEAR = "(?:0?[1-9]|1[0-2])", "(?:0?[1-9]|[12][0-9]|3[01])", "(?:20)?[0-9]{2}"
# Shapes of a line that count as features.
SHAPES = {
    "#currency": "₹|" + word("rs|inr|mrp"), "#price": rf"[0-9][0-9,]*\.[0-9]{{2}}{EDGE_R}",
    "#date": word(rf"{_MONTH}[/\-.]{_YEAR}|{_DAY}[/\-.]{_MONTH}[/\-.]{_YEAR}|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s*,?\s*{_YEAR}"),
    "#months": word(r"[0-9]{1,2}\s*months?"), "#pin": word(r"[0-9]{3}\s?[0-9]{3}"), "#phone": word(r"1800[\s-]?[0-9]{3}[\s-]?[0-9]{3,4}|[0-9]{10}") + r"|\+91",
    "#email": r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.]+", "#web": rf"(?i)www\.|\.(?:com|in|co\.in){EDGE_R}",
    "#unit": word(r"[0-9]+(?:\.[0-9]+)?\s*(?:mg|g|gm|gms|kg|ml|l|ltr|litres?|n|pcs|pieces)"), "#count": word(r"[0-9]+\s*n\s*x"), "#long14": word("[0-9]{14}"),
    "#code": word(r"[A-Z]{1,3}[\s-]?[0-9]{3,6}(?:[\s-]?[A-Z0-9]{1,5})?", ignore_case=False),
    "#corp": word("ltd|limited|pvt|private|llp|inc|industries|foods|mills|co"),
    "#addr": word(r"road|street|marg|nagar|house|plot|estate|park|sector|p\.?o\.?|distt|dist|vill|village|tehsil|floor"),
    "#state": word("gujarat|maharashtra|telangana|karnataka|tamil nadu|kerala|delhi|uttar pradesh|uttarakhand|punjab|haryana|rajasthan|madhya pradesh|west bengal|assam|bihar|odisha|andhra|himachal|goa"),
    "#country": word("india|china|sri lanka|nepal|usa|uk|uae|thailand|malaysia|indonesia|vietnam"),
    "#allcaps": r"^[^a-z]*[A-Z][^a-z]*\z", "#short": rf"^{_ANY}{{1,14}}\z", "#long": rf"^{_ANY}{{60,}}\z", "#colon": ":", "#paren": r"\(", "#pct": "%", "#digits-heavy": r"^(?:[^0-9]*[0-9]){6,}",
}
_SPACES = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def _fifth(part: Column, whole: Column) -> Column:
    return F.least(F.lit(4), F.floor(part / whole * 5)).cast("string")


def feature_names(text: Column) -> Column:
    """array<struct<name, weight>>: words, pairs, first and last word, trigrams, shapes, ratios, number of words, bias. A null
    text is empty."""
    text = F.coalesce(text, F.lit(""))
    norm = normalise(text)
    words = F.filter(F.split(norm, " "), lambda w: w != "")
    one = lambda prefix, value, weight: F.struct(F.concat(F.lit(prefix), value).alias("name"), F.lit(float(weight)).alias("weight"))
    n = F.size(words)
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: one("b:", F.concat_ws("_", F.element_at(words, i), F.element_at(words, i + 1)), 1)))
    padded = F.concat(F.lit(" "), norm, F.lit(" "))
    trigrams = F.when(F.length(padded) >= 3, F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: one("c:", F.substring(padded, i, F.lit(3)), 0.5)))
    ends = F.when(n > 0, F.array(one("first:", F.get(words, F.lit(0)), 1.5), one("last:", F.get(words, n - 1), 1)))
    shapes = F.filter(F.array(*[F.when(text.rlike(p), one("", F.lit(name), 2)) for name, p in SHAPES.items()]), lambda s: s.isNotNull())
    # Characters beyond the first plane count twice, as in the reference.
    total = F.greatest(F.lit(1), F.length(F.regexp_replace(F.regexp_replace(text, _SPACES, ""), r"[\x{10000}-\x{10FFFF}]", "xx")))
    digits = F.length(F.regexp_replace(text, "[^0-9]", ""))
    sizes = F.array(one("#digit-ratio:", _fifth(digits, total), 1.5), one("#letter-ratio:", _fifth(letters(text), total), 1.5), one("#words:", F.least(n, F.lit(8)).cast("string"), 1))
    none = F.array().cast("array<struct<name:string,weight:double>>")
    parts = [F.transform(words, lambda w: one("w:", w, 1)), pairs, ends, trigrams, shapes, sizes, F.array(one("", F.lit("#bias"), 1))]
    return F.concat(*[F.coalesce(p, none) for p in parts])


def features(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, index, weight): hashed features, sums at collisions, of length 1."""
    named = df.select(key, F.inline(feature_names(F.col(text))))
    sums = named.groupBy(key, fnv1a(F.col("name"), BUCKETS).alias("index")).agg(F.sum("weight").alias("weight"))
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(key)))
    return sums.withColumn("weight", F.col("weight") / norm)


def softmax_top2(scores: Column) -> Column:
    """struct(best, p, second, second_p) of an array of class scores; p to three decimals."""
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda a, z: a + F.exp(z - top))
    ranked = F.array_sort(F.transform(scores, lambda z, i: F.struct((-z).alias("z"), i.alias("i"))))
    p = lambda k: F.floor(F.exp(-ranked[k]["z"] - top) / total * 1000 + 0.5) / 1000
    return F.struct(ranked[0]["i"].alias("best"), p(0).alias("p"), ranked[1]["i"].alias("second"), p(1).alias("second_p"))


def score(feature_rows: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """Class scores from (key, index, weight) and a weight table (index, class, value) of at most classes x BUCKETS rows."""
    joined = feature_rows.join(weights, "index")
    return joined.groupBy(key, "class").agg(F.sum(F.col("weight") * F.col("value")).alias("score"))


def shown_tag(label: Column, p: Column, least: float = 0.55) -> Column:
    return F.when((label != "OTHER") & (p >= least), label)


def train(df: DataFrame, text: str, label: str, rounds: int = 30):
    """A multinomial logistic regression over the hashed features (Spark ML); returns the fitted pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, StringIndexer

    rows = df.withColumn("names", F.transform(feature_names(F.col(text)), lambda f: f["name"])).withColumn("class", F.col(label))
    steps = [StringIndexer(inputCol="class", outputCol="label"), HashingTF(inputCol="names", outputCol="features", numFeatures=BUCKETS), LogisticRegression(maxIter=rounds, regParam=1e-5)]
    return Pipeline(stages=steps).fit(rows)


def quantise(weights: DataFrame) -> DataFrame:
    """(class, index, value) as whole numbers in -127..127 and a scale per class."""
    scale = F.max(F.abs("value")).over(Window.partitionBy("class")) / 127
    return weights.withColumn("scale", scale).withColumn("q", F.when(F.col("scale") == 0, 0).otherwise(F.floor(F.col("value") / F.col("scale") + 0.5)).cast("int"))
