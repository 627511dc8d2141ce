"""Rules on whole labels: worked goldens, truth tables, invariants."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelforge.operators import rules
from labelforge.operators.rules import KEYS

DECLARATION = "inspection_id string, seq int, key string, value string, confidence double, mm double, contrast double, scaled boolean"
COUNTRY, CARE = "COUNTRY_OF_ORIGIN", "CONSUMER_CARE"
CASES = {
    "rice": {
        "PRODUCT_IDENTITY": ("Basmati rice", 0.99, 42, 12.1), "MANUFACTURER_NAME": ("Field Foods Pvt. Ltd.", 0.97, 22, 11.4), "MANUFACTURER_ADDRESS": ("Plot 4, Hyderabad - 501401, India", 0.94, 17, 10.2),
        "NET_QUANTITY": ("5 kg", 0.98, 34, 12.6), "MRP": ("MRP Rs. 650.00 (incl. of all taxes)", 0.98, 34, 12.6), CARE: ("1800-200-4455, care@field.example", 0.93, 19, 4.2), "DATE_OF_PACKING": ("08/2026", 0.96, 24, 11.8),
        "BEST_BEFORE": ("18 months", 0.92, 24, 11.8), COUNTRY: ("India", 0.97, 22, 11.9), "FSSAI_LICENSE": ("10018043002915", 0.95, 18, 10.9), "BATCH_NUMBER": ("BR-2608", 0.95, 18, 10.9),
    },
    "spices": {
        "PRODUCT_IDENTITY": ("Masala", 0.98, 42, 11.6), "MANUFACTURER_NAME": ("Spice Works", 0.95, 22, 10.8), "MANUFACTURER_ADDRESS": ("Area 1, Hyderabad - 500055", 0.81, 17, 2.9), "NET_QUANTITY": ("500gms.", 0.72, 13, 9.4),
        "MRP": ("Rs 185/-", 0.94, 34, 12.2), CARE: (None, 0.94, None, None), "DATE_OF_PACKING": ("07/2026", 0.70, 13, 9.1), "BEST_BEFORE": ("12 months", 0.68, 24, 2.7), COUNTRY: ("India", 0.96, 22, 11.5),
        "FSSAI_LICENSE": ("13319004000278", 0.93, 18, 10.4), "BATCH_NUMBER": (None, 0.91, None, None),
    },
    "biscuits": {
        "PRODUCT_IDENTITY": ("Cookies", 0.99, 42, 11.9), "MANUFACTURER_NAME": ("Bakers Pvt. Ltd.", 0.96, 22, 11.1), "MANUFACTURER_ADDRESS": ("Unit 7, Pune - 411026, India", 0.93, 17, 10.4), "NET_QUANTITY": ("200 g", 0.97, 34, 12.4),
        "MRP": ("MRP Rs. 60", 0.96, 34, 12.4), CARE: ("Bakers, 022-4000-1188", 0.79, 13, 3.4), "DATE_OF_PACKING": ("09/2026", 0.74, 15, 9.6), "BEST_BEFORE": ("06 months", 0.90, 24, 11.2), COUNTRY: ("India", 0.96, 22, 11.4),
        "FSSAI_LICENSE": ("11517008000342", 0.94, 18, 10.6), "BATCH_NUMBER": (None, 0.88, None, None),
    },
    "chocolate": {
        "PRODUCT_IDENTITY": ("Dark chocolate", 0.98, 42, 11.7), "MANUFACTURER_NAME": ("Schokolade AG", 0.95, 22, 10.9), "MANUFACTURER_ADDRESS": ("Strasse 14, 6300 Zug, Switzerland", 0.92, 17, 10.1), "NET_QUANTITY": ("100 G", 0.95, 34, 12.3),
        "MRP": ("MRP Rs. 425.00 (incl. of all taxes)", 0.97, 34, 12.3), CARE: ("1800-419-7788, help@imports.example", 0.91, 19, 10.5), "DATE_OF_PACKING": ("06/2026", 0.94, 24, 11.6), "BEST_BEFORE": ("12/2027", 0.94, 24, 11.6),
        COUNTRY: ("Switzerland", 0.96, 22, 11.5), "IMPORTER_DETAILS": ("Gourmet Imports", 0.68, 13, 3.1), "FSSAI_LICENSE": ("10021032001884", 0.93, 18, 10.3), "BATCH_NUMBER": ("AN-70", 0.93, 18, 10.3),
    },
}
GOLDEN = {"rice": (45, 20, 16, 15, 96, "COMPLIANT"), "spices": (34, 3, 0, 10, 47, "NON_COMPLIANT"), "biscuits": (42, 16, 10, 12, 80, "NEEDS_REVIEW"), "chocolate": (45, 17, 10, 13, 85, "NEEDS_REVIEW")}


def labels(spark, cases):
    rows = [(c, 1, k, v, conf, None if px is None else px / 10, contrast, None if px is None else True) for c, own in cases.items() for k, (v, conf, px, contrast) in own.items()]
    # An earlier reading of the same key is replaced by the later one.
    rows += [(c, 0, "MRP", "", 0.1, None, None, None) for c in cases]
    return rules.gather_labels(spark.createDataFrame(rows, DECLARATION))


def test_goldens(spark):
    got = {r.inspection_id: tuple(r)[1:] for r in rules.scored(rules.evaluate(labels(spark, CASES))).select("inspection_id", "mandatory", "formatting", "readability", "packaging", "score", "verdict").collect()}
    assert got == GOLDEN


def test_findings(spark):
    rows = rules.findings(rules.evaluate(labels(spark, {"x": CASES["spices"]})), "inspection_id").orderBy("position").collect()
    order = {"HIGH": 0, "MEDIUM": 1, "LOW": 2}
    ranks = [order[r.severity] for r in rows]
    assert ranks == sorted(ranks) and sorted(r.finding_id for r in rows) == [f"x-V{i:02d}" for i in range(1, len(rows) + 1)]
    assert [r.detected for r in rows if r.rule_id == "LMPC-R06-06"] == ["Not detected"]
    assert all(r.severity != "HIGH" for r in rows if r.title.endswith("verification required"))


TRUTH = [
    ("LMPC-R06-03", {"MANUFACTURER_ADDRESS": "Pune, India"}, "REVIEW"), ("LMPC-R06-03", {"MANUFACTURER_ADDRESS": "Pune"}, "PASS"), ("LMPC-R06-03", {"MANUFACTURER_ADDRESS": "Pune 411 026, India"}, "REVIEW"),
    ("LMPC-R06-03", {"MANUFACTURER_ADDRESS": "Pune - 411 026, India"}, "PASS"), ("LMPC-R06-03", {}, "FAIL"),
    ("LMPC-R06-07", {"DATE_OF_PACKING": "02/22"}, "REVIEW"), ("LMPC-R06-07", {"DATE_OF_PACKING": "Aug 2026"}, "PASS"), ("LMPC-R06-07", {"DATE_OF_PACKING": "Aug-2026"}, "REVIEW"),
    ("LMPC-FMT-01", {"MRP": "INR 60"}, "FAIL"), ("LMPC-FMT-01", {"MRP": "₹60 incl of all taxes"}, "PASS"), ("LMPC-FMT-01", {"MRP": "éRs 60 MRP"}, "REVIEW"), ("LMPC-FMT-01", {}, "NOT_APPLICABLE"), ("LMPC-FMT-01", {"MRP": "Hrs 60"}, "FAIL"),
    ("LMPC-FMT-02", {"NET_QUANTITY": " 10 N "}, "PASS"), ("LMPC-FMT-02", {"NET_QUANTITY": "10 KG"}, "REVIEW"), ("LMPC-FMT-02", {"NET_QUANTITY": "2 N x 150 g (300 g)"}, "FAIL"),
    ("LMPC-IMP-01", {COUNTRY: "India"}, "NOT_APPLICABLE"), ("LMPC-IMP-01", {COUNTRY: "China"}, "FAIL"), ("LMPC-IMP-01", {COUNTRY: "China", "IMPORTER_DETAILS": "Co, 4 Mill Road"}, "PASS"), ("LMPC-IMP-01", {COUNTRY: "China", "IMPORTER_DETAILS": "Co, Roadster"}, "REVIEW"),
    ("LMPC-FMT-03", {}, "REVIEW"), ("LMPC-RDB-01", {}, "PASS"), ("LMPC-RDB-02", {}, "PASS"), ("OWN-01", {}, "REVIEW"),
]


def test_truth_table(spark):
    catalogue = (*rules.CATALOGUE, rules.Rule("OWN-01", "Own", "PACKAGING", "LOW", 1))
    rows = [(str(i), 0, k, v, 0.95, None, None, None) for i, (_, own, _) in enumerate(TRUTH) for k, v in {"BATCH_NUMBER": "b", **own}.items()]
    results = rules.rule_results(rules.evaluate(rules.gather_labels(spark.createDataFrame(rows, DECLARATION)), catalogue), "inspection_id").collect()
    got = {(r.inspection_id, r.rule_id): r.status for r in results}
    assert [got[(str(i), rule)] for i, (rule, _, _) in enumerate(TRUTH)] == [want for _, _, want in TRUTH]


def test_empty_bucket_earns_its_maximum(spark):
    out = rules.scored(rules.evaluate(labels(spark, {"x": {}}), rules.only("LMPC-FMT-01"))).first()
    assert (out.mandatory, out.formatting, out.readability, out.packaging, out.verdict) == (45, 20, 20, 15, "NOT_DETECTED")


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.fixed_dictionaries({}, optional={k: st.tuples(st.sampled_from(["", "x", "5 kg", "India", "MRP Rs 5", "08/2026"]), st.floats(0, 1), st.integers(5, 60), st.floats(1, 15)) for k in KEYS}), min_size=1, max_size=12))
def test_invariants(spark, made):
    cases = {str(i): c for i, c in enumerate(made)}
    out = rules.scored(rules.evaluate(labels(spark, cases))).select("mandatory", "formatting", "readability", "packaging", "score", "verdict", "results").collect()
    assert len(out) == len(cases)
    for r in out:
        assert 0 <= r.mandatory <= 45 and 0 <= r.formatting <= 20 and 0 <= r.readability <= 20 and 0 <= r.packaging <= 15 and r.score == r.mandatory + r.formatting + r.readability + r.packaging
        assert all(x.status in ("PASS", "FAIL", "REVIEW", "NOT_APPLICABLE") and 0 <= x.confidence <= 1 for x in r.results) and [x.seq for x in r.results] == list(range(17))


def test_loaded_rules_act(spark):
    table = spark.createDataFrame([("LMPC-FMT-01", 1, "n", "FORMATTING", "LOW", 3, "MRP", {"requireInclusiveOfTaxes": "0"}, True)], "rule_id string, seq int, name string, bucket string, severity string, weight int, key string, params map<string,string>, active boolean")
    loaded = rules.load_rules(table)
    assert rules.evaluate(labels(spark, {"x": {"MRP": ("Rs 9", 0.9, None, None)}}), loaded).select(F.col("results")[0]["status"]).first()[0] == "PASS"


@pytest.mark.parametrize("parts", [1, 8])
def test_partitions_do_not_matter(spark, parts):
    got = rules.scored(rules.evaluate(labels(spark, CASES).repartition(parts))).select("inspection_id", "score").collect()
    assert {r.inspection_id: r.score for r in got} == {k: v[4] for k, v in GOLDEN.items()}
