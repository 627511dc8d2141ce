"""Rule evaluation: one row per label in, rule results, scores, verdicts and findings out.

A label is a row with one struct (value, confidence, mm, contrast, scaled) per declaration key, named in lower case; keys
that the row doesn't have count as missing. All 17 rules are expressions over that row, so evaluation has no join, and
no shuffle but the one that gathers a label's declarations. The catalogue is a small table of settings: its rows become
literals of the plan, so an edited rule acts at the next evaluation.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.functions.num import round_half_up, to_fixed
from labelforge.functions.text import padded, present, word

# Declaration keys in their order, buckets with their maxima, and the catalogue.
KEYS = ("PRODUCT_IDENTITY", "MANUFACTURER_NAME", "MANUFACTURER_ADDRESS", "NET_QUANTITY", "MRP", "CONSUMER_CARE", "DATE_OF_PACKING", "BEST_BEFORE", "COUNTRY_OF_ORIGIN", "IMPORTER_DETAILS", "FSSAI_LICENSE", "BATCH_NUMBER")
BUCKETS = {"MANDATORY": 45, "FORMATTING": 20, "READABILITY": 20, "PACKAGING": 15}
GROUPED_KEYS = ("PRODUCT_IDENTITY", "MANUFACTURER_NAME", "NET_QUANTITY", "MRP", "CONSUMER_CARE", "DATE_OF_PACKING")
MOST_RULES = 1000


@dataclass(frozen=True)
class Rule:
    rule_id: str
    name: str
    bucket: str
    severity: str
    weight: int
    key: str | None = None
    params: dict = field(default_factory=dict)
    active: bool = True


CATALOGUE = (
    Rule("LMPC-R06-01", "Product identity declared", "MANDATORY", "HIGH", 5, "PRODUCT_IDENTITY"),
    Rule("LMPC-R06-02", "Manufacturer / packer name declared", "MANDATORY", "HIGH", 6, "MANUFACTURER_NAME"),
    Rule("LMPC-R06-03", "Complete manufacturer address declared", "MANDATORY", "MEDIUM", 5, "MANUFACTURER_ADDRESS", {"requirePinCode": "1"}),
    Rule("LMPC-R06-04", "Net quantity declared", "MANDATORY", "HIGH", 8, "NET_QUANTITY"),
    Rule("LMPC-R06-05", "Retail sale price declared", "MANDATORY", "HIGH", 8, "MRP"),
    Rule("LMPC-R06-06", "Consumer care details declared", "MANDATORY", "HIGH", 7, "CONSUMER_CARE"),
    Rule("LMPC-R06-07", "Month and year of packing declared", "MANDATORY", "HIGH", 6, "DATE_OF_PACKING"),
    Rule("LMPC-FMT-01", "MRP declaration format", "FORMATTING", "MEDIUM", 8, "MRP", {"requireInclusiveOfTaxes": "1"}),
    Rule("LMPC-FMT-02", "Net quantity unit format", "FORMATTING", "MEDIUM", 7, "NET_QUANTITY"),
    Rule("LMPC-FMT-03", "Principal display panel grouping", "FORMATTING", "LOW", 5),
    Rule("LMPC-RDB-01", "Minimum declaration height", "READABILITY", "MEDIUM", 11, None, {"minHeightMm": "1.5", "minHeightMmPrincipalPanel": "2"}),
    Rule("LMPC-RDB-02", "Declaration legibility and contrast", "READABILITY", "LOW", 9, None, {"minContrastRatio": "4.5", "minOcrConfidence": "0.75"}),
    Rule("LMPC-PKG-01", "Country of origin declared", "PACKAGING", "MEDIUM", 4, "COUNTRY_OF_ORIGIN"),
    Rule("LMPC-IMP-01", "Importer details for imported packages", "PACKAGING", "HIGH", 4, "IMPORTER_DETAILS"),
    Rule("LMPC-PKG-02", "Best before / use by declared", "PACKAGING", "LOW", 3, "BEST_BEFORE"),
    Rule("LMPC-PKG-03", "Batch / lot identification declared", "PACKAGING", "LOW", 2, "BATCH_NUMBER"),
    Rule("LMPC-PKG-04", "Statutory licence number declared", "PACKAGING", "LOW", 2, "FSSAI_LICENSE"),
)


def load_rules(table: DataFrame) -> tuple[Rule, ...]:
    """The catalogue from its table (rule_id, seq, name, bucket, severity, weight, key, params, active)."""
    rows = table.orderBy("seq").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"a catalogue has at most {MOST_RULES} rules")
    return tuple(Rule(r.rule_id, r.name, r.bucket, r.severity, r.weight, r.key, dict(r.params or {}), bool(r.active)) for r in rows)


def only(*ids: str, rules: Sequence[Rule] = CATALOGUE) -> tuple[Rule, ...]:
    return tuple(replace(r, active=r.rule_id in ids) for r in rules)


class Label:
    """Access to the declarations of a row."""

    def __init__(self, columns: Sequence[str]):
        self.columns = set(columns)

    def part(self, key: str, name: str, kind: str) -> Column:
        return F.col(key.lower())[name] if key.lower() in self.columns else F.lit(None).cast(kind)

    def value(self, key: str) -> Column:
        return present(self.part(key, "value", "string"))

    def confidence(self, key: str) -> Column:
        return F.coalesce(self.part(key, "confidence", "double"), F.lit(0.9))

    def count(self, test: Callable[[str], Column]) -> Column:
        return sum((F.when(test(k), 1).otherwise(0) for k in KEYS if k.lower() in self.columns), F.lit(0))

    def measured(self, key: str) -> Column:
        return self.value(key).isNotNull() & self.part(key, "contrast", "double").isNotNull()


def outcome(status: Column, detected: Column, confidence: Column) -> Column:
    return F.struct(status.alias("status"), detected.cast("string").alias("detected"), confidence.cast("double").alias("confidence"))


Validator = Callable[[Label, Rule], Column]
VALIDATORS: dict[str, Validator] = {}


def register_rule(*rule_ids: str) -> Callable[[Validator], Validator]:
    """Makes a function (label, rule) -> outcome() the validator of these rules; rules without one are for review."""

    def put(f: Validator) -> Validator:
        VALIDATORS.update(dict.fromkeys(rule_ids, f))
        return f

    return put


@register_rule("LMPC-R06-01", "LMPC-R06-02", "LMPC-R06-04", "LMPC-R06-05", "LMPC-PKG-01", "LMPC-PKG-02", "LMPC-PKG-03", "LMPC-PKG-04")
def presence(label: Label, rule: Rule) -> Column:
    v, c = label.value(rule.key), label.confidence(rule.key)
    return outcome(F.when(v.isNull(), "FAIL").when(c < 0.75, "REVIEW").otherwise("PASS"), v, c)


@register_rule("LMPC-R06-03")
def address(label: Label, rule: Rule) -> Column:
    v = label.value(rule.key)
    pin = F.regexp_replace(v, r"\s", "").rlike(word("[0-9]{6}"))
    domestic = v.rlike("(?i)india")
    lacking = ~pin & domestic if float(rule.params.get("requirePinCode", 0)) == 1 else F.lit(False)
    return outcome(F.when(v.isNull(), "FAIL").when(lacking, "REVIEW").otherwise("PASS"), v, label.confidence(rule.key))


@register_rule("LMPC-R06-06")
def consumer_care(label: Label, rule: Rule) -> Column:
    v = label.value(rule.key)
    both = v.rlike(r"\+?[0-9][0-9\s-]{7,}") & v.rlike(r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.]+")
    return outcome(F.when(v.isNull(), "FAIL").when(both, "PASS").otherwise("REVIEW"), v, label.confidence(rule.key))


@register_rule("LMPC-R06-07")
def packing_date(label: Label, rule: Rule) -> Column:
    v = label.value(rule.key)
    good = v.rlike(r"(0[1-9]|1[0-2])[/\-.\s]20[0-9]{2}") | v.rlike(r"[A-Za-z]{3,}\s*,?\s*20[0-9]{2}")
    return outcome(F.when(v.isNull(), "FAIL").when(good, "PASS").otherwise("REVIEW"), v, label.confidence(rule.key))


@register_rule("LMPC-FMT-01")
def price_format(label: Label, rule: Rule) -> Column:
    v = label.value(rule.key)
    currency = v.rlike("₹|" + r"(?i)(?<![A-Za-z0-9_])rs(?:\.(?=[A-Za-z0-9_])|(?![A-Za-z0-9_]))")
    prefix = v.rlike(word("mrp") + "|maximum retail price")
    tax = v.rlike(r"(?i)incl(usive)?\.?\s*(of)?\s*all\s*tax")
    status = F.when(v.isNull(), "NOT_APPLICABLE").when(~currency, "FAIL")
    if float(rule.params.get("requireInclusiveOfTaxes", 1)) == 1:
        status = status.when(~tax & ~prefix, "FAIL").when(~tax, "REVIEW")
    return outcome(status.otherwise("PASS"), v, F.when(v.isNull(), 0.9).otherwise(label.confidence(rule.key)))


@register_rule("LMPC-FMT-02")
def quantity_format(label: Label, rule: Rule) -> Column:
    v = label.value(rule.key)
    units = r"^[0-9]+(\.[0-9]+)?\s?(mg|g|kg|ml|l|cm|m|{})$"
    status = F.when(v.isNull(), "NOT_APPLICABLE").when(F.trim(v).rlike(units.replace("{}", "N")), "PASS").when(F.trim(v).rlike("(?i)" + units.replace("{}", "n")), "REVIEW")
    return outcome(status.otherwise("FAIL"), v, F.when(v.isNull(), 0.9).otherwise(label.confidence(rule.key)))


def missing_keys(label: Label, keys: Sequence[str] = GROUPED_KEYS) -> Column:
    return F.array_compact(F.array(*[F.when(label.value(k).isNull(), k) for k in keys]))


@register_rule("LMPC-FMT-03")
def grouping(label: Label, rule: Rule) -> Column:
    lacking = F.size(missing_keys(label))
    said = F.when(lacking == 0, "All mandatory declarations located on a single panel").otherwise(F.concat((F.lit(6) - lacking).cast("string"), F.lit(" of 6 declarations located")))
    return outcome(F.when(lacking == 0, "PASS").otherwise("REVIEW"), said, F.when(lacking == 0, 0.9).otherwise(0.86))


@register_rule("LMPC-RDB-01")
def print_height(label: Label, rule: Rule) -> Column:
    least = float(rule.params.get("minHeightMm", 1.5))
    mm = lambda k: label.part(k, "mm", "double")
    measured = label.count(label.measured)
    scaled = label.count(lambda k: label.measured(k) & F.coalesce(label.part(k, "scaled", "boolean"), F.lit(False)))
    under = label.count(lambda k: label.measured(k) & (mm(k) < least))
    near = label.count(lambda k: label.measured(k) & (mm(k) >= least) & (mm(k) < least * 1.12))
    unscaled = (measured > 0) & (scaled == 0)
    status = F.when(unscaled, "REVIEW").when(under >= 2, "FAIL").when((under > 0) | (near > 0), "REVIEW").otherwise("PASS")
    confidence = F.when(unscaled, 0.6).when(under >= 2, 0.82).when((under > 0) | (near > 0), 0.79).otherwise(0.85)
    return outcome(status, F.concat(under.cast("string"), F.lit(" below the minimum height")), confidence)


@register_rule("LMPC-RDB-02")
def legibility(label: Label, rule: Rule) -> Column:
    contrast, sure = float(rule.params.get("minContrastRatio", 4.5)), float(rule.params.get("minOcrConfidence", 0.75))
    flagged = label.count(lambda k: label.measured(k) & ((label.part(k, "contrast", "double") < contrast) | (label.confidence(k) < sure)))
    status = F.when(flagged >= 4, "FAIL").when(flagged >= 1, "REVIEW").otherwise("PASS")
    return outcome(status, F.concat(flagged.cast("string"), F.lit(" below the legibility threshold")), F.when(flagged >= 4, 0.8).when(flagged >= 1, 0.83).otherwise(0.88))


@register_rule("LMPC-IMP-01")
def importer(label: Label, rule: Rule) -> Column:
    origin, v, c = label.value("COUNTRY_OF_ORIGIN"), label.value(rule.key), label.confidence(rule.key)
    imported = F.coalesce((F.trim(origin) != "") & ~origin.rlike("(?i)india"), F.lit(False))
    addressed = v.rlike("[0-9]{6}") | v.rlike(word("road|street|nagar|marg|plot|sector|industrial|park|floor"))
    status = F.when(~imported, "NOT_APPLICABLE").when(v.isNull(), "FAIL").when(~addressed | (c < 0.8), "REVIEW").otherwise("PASS")
    return outcome(status, F.when(imported, v).otherwise(origin), F.when(imported, c).otherwise(0.95))


def review(label: Label, rule: Rule) -> Column:
    return outcome(F.lit("REVIEW"), F.lit(None), F.lit(0.5))


def gather_labels(declarations: DataFrame, carry: Sequence[str] = ("inspection_id",)) -> DataFrame:
    """One row per label from (inspection_id, seq, key, value, confidence, mm, contrast, scaled); of a repeated key the
    last counts. This is the only shuffle of an evaluation."""
    one = F.struct("value", "confidence", "mm", "contrast", "scaled")
    return declarations.groupBy(*carry).agg(*[F.max_by(F.when(F.col("key") == k, one), F.when(F.col("key") == k, F.col("seq"))).alias(k.lower()) for k in KEYS])


def evaluate(labels: DataFrame, rules: Sequence[Rule] = CATALOGUE) -> DataFrame:
    """Adds `results`: an array, in catalogue order, of each active rule's outcome."""
    label = Label(labels.columns)
    shown = []
    for seq, r in enumerate(x for x in rules if x.active):
        o = VALIDATORS.get(r.rule_id, review)(label, r)
        fixed = [F.lit(v).alias(k) for k, v in (("seq", seq), ("rule_id", r.rule_id), ("name", r.name), ("bucket", r.bucket), ("severity", r.severity), ("weight", r.weight))]
        shown.append(F.struct(*fixed, o["status"].alias("status"), o["detected"].alias("detected"), to_fixed(o["confidence"], 2).alias("confidence")))
    return labels.withColumn("results", F.array(*shown))


def scored(evaluated: DataFrame) -> DataFrame:
    """Adds a score per bucket, their sum and the verdict. A bucket in which nothing applies earns its maximum."""
    results = F.col("results")

    def total(of: Callable[[Column], Column]) -> Column:
        return F.aggregate(results, F.lit(0.0), lambda a, r: a + of(r))

    parts = {}
    for bucket, most in BUCKETS.items():
        own = lambda r, b=bucket: (r["bucket"] == b) & (r["status"] != "NOT_APPLICABLE")
        earned = F.col(f"_{bucket}")["earned"]
        applicable = F.col(f"_{bucket}")["applicable"]
        share = lambda r: F.when(r["status"] == "PASS", 1.0).when(r["status"] == "REVIEW", 0.5).otherwise(0.0)
        evaluated = evaluated.withColumn(
            f"_{bucket}",
            F.struct(total(lambda r, own=own: F.when(own(r), r["weight"]).otherwise(0)).alias("applicable"), total(lambda r, own=own: F.when(own(r), r["weight"] * share(r)).otherwise(0.0)).alias("earned")),
        )
        parts[bucket.lower()] = F.when(applicable == 0, F.lit(most)).otherwise(round_half_up(earned / applicable * most)).cast("int")
    out = evaluated.withColumns(parts).drop(*[f"_{b}" for b in BUCKETS])
    out = out.withColumn("score", sum((F.col(b.lower()) for b in BUCKETS), F.lit(0)))
    some = lambda test: F.exists(results, test)
    status = (
        F.when(~some(lambda r: r["status"].isin("PASS", "REVIEW")), "NOT_DETECTED")
        .when(some(lambda r: (r["status"] == "FAIL") & (r["severity"] == "HIGH")) | (F.col("score") < 70), "NON_COMPLIANT")
        .when(some(lambda r: (r["status"] == "FAIL") | ((r["status"] == "REVIEW") & (r["severity"] != "LOW"))) | (F.col("score") < 90), "NEEDS_REVIEW")
        .otherwise("COMPLIANT")
    )
    return out.withColumn("verdict", status)


def rule_results(evaluated: DataFrame, *carry: str) -> DataFrame:
    return evaluated.select(*carry, F.inline("results"))


def findings(evaluated: DataFrame, key: str) -> DataFrame:
    """One row per finding: numbered in catalogue order, placed by severity; review findings are at most MEDIUM."""
    found = F.filter("results", lambda r: r["status"].isin("FAIL", "REVIEW"))

    def one(r: Column, i: Column) -> Column:
        severity = F.when((r["status"] == "REVIEW") & (r["severity"] == "HIGH"), "MEDIUM").otherwise(r["severity"])
        rank = F.when(severity == "HIGH", 0).when(severity == "MEDIUM", 1).otherwise(2)
        title = F.when(r["status"] == "FAIL", r["name"]).otherwise(F.concat(r["name"], F.lit(" — verification required")))
        return F.struct(rank.alias("rank"), (i + 1).alias("number"), r["rule_id"].alias("rule_id"), title.alias("title"), r["bucket"].alias("bucket"), severity.alias("severity"), F.coalesce(r["detected"], F.lit("Not detected")).alias("detected"), r["confidence"].alias("confidence"))

    rows = evaluated.select(key, F.posexplode(F.array_sort(F.transform(found, one))).alias("position", "f"))
    finding_id = F.concat_ws("-V", F.col(key).cast("string"), padded(F.col("f.number")))
    return rows.select(key, finding_id.alias("finding_id"), (F.col("position") + 1).alias("position"), "f.rule_id", "f.title", "f.bucket", "f.severity", "f.detected", "f.confidence")
