"""The engine's queries over the analogue tables, each with SQL that gives the same rows.

orders stand for inspections (status F, O, P: compliant, for review, non-compliant), lineitem for findings (R, A, N: high,
medium, low), part for products and label texts, customers in nations and regions for officers, events for the audit
feed, documents and conversations for recognised texts and readings.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelforge.functions import geom, num, tables, text
from labelforge.operators import agreement, analytics, classify, declarations, layout, mutate, panels, products, readers, reconcile, registers, rules, stages, temporal
from labelforge.sources.scratch import written
from labelforge.sources.tables import table
from labelforge.streaming import events as feed
from labelforge.streaming import figures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


# --- rules over labels made from part

FOUR = rules.only("LMPC-R06-04", "LMPC-R06-05", "LMPC-FMT-01", "LMPC-FMT-02")


def part_labels(spark: SparkSession, d: str) -> DataFrame:
    """One label per part, with price and quantity in five spellings."""
    k, r = F.col("p_partkey") % 5, F.floor("p_retailprice").cast("string")
    price = F.when(k == 0, F.concat(F.lit("MRP Rs. "), r, F.lit(".00 (incl. of all taxes)"))).when(k == 1, F.concat(F.lit("MRP Rs. "), r)).when(k == 2, F.concat(F.lit("Rs "), r, F.lit("/-"))).when(k == 3, r)
    size = F.col("p_size").cast("string")
    quantity = F.concat(size, F.when(k == 0, " g").when(k == 1, " G").when(k == 2, "gms.").when(k == 3, " kg"))
    confidence = (F.lit(70) + F.col("p_partkey") % 30) / F.lit(100.0)
    one = lambda v: F.struct(v.alias("value"), confidence.alias("confidence"))
    return table(spark, d, "part").select("p_partkey", "p_brand", "p_name", one(price).alias("mrp"), one(quantity).alias("net_quantity"))


_LABELS = """lab AS (SELECT p_partkey, p_brand, (70 + p_partkey % 30) / 100.0::DOUBLE AS conf,
  CASE p_partkey % 5 WHEN 0 THEN 'MRP Rs. ' || floor(p_retailprice)::BIGINT || '.00 (incl. of all taxes)' WHEN 1 THEN 'MRP Rs. ' || floor(p_retailprice)::BIGINT
    WHEN 2 THEN 'Rs ' || floor(p_retailprice)::BIGINT || '/-' WHEN 3 THEN '' || floor(p_retailprice)::BIGINT END AS mrp,
  CASE p_partkey % 5 WHEN 0 THEN p_size || ' g' WHEN 1 THEN p_size || ' G' WHEN 2 THEN p_size || 'gms.' WHEN 3 THEN p_size || ' kg' END AS qty FROM part),
res AS (
  SELECT *, 0 AS seq, 'LMPC-R06-04' AS rule_id, 'HIGH' AS severity, 8 AS weight, CASE WHEN qty IS NULL THEN 'FAIL' WHEN conf < 0.75 THEN 'REVIEW' ELSE 'PASS' END AS status, conf AS c FROM lab
  UNION ALL SELECT *, 1, 'LMPC-R06-05', 'HIGH', 8, CASE WHEN mrp IS NULL THEN 'FAIL' WHEN conf < 0.75 THEN 'REVIEW' ELSE 'PASS' END, conf FROM lab
  UNION ALL SELECT *, 2, 'LMPC-FMT-01', 'MEDIUM', 8, CASE WHEN mrp IS NULL THEN 'NOT_APPLICABLE' WHEN NOT regexp_matches(mrp, '(?i)₹|\\brs\\.?\\b') THEN 'FAIL'
      WHEN NOT regexp_matches(mrp, '(?i)incl(usive)?\\.?\\s*(of)?\\s*all\\s*tax') THEN CASE WHEN regexp_matches(mrp, '(?i)\\bmrp\\b|maximum retail price') THEN 'REVIEW' ELSE 'FAIL' END ELSE 'PASS' END,
      CASE WHEN mrp IS NULL THEN 0.9 ELSE conf END FROM lab
  UNION ALL SELECT *, 3, 'LMPC-FMT-02', 'MEDIUM', 7, CASE WHEN qty IS NULL THEN 'NOT_APPLICABLE' WHEN regexp_matches(qty, '^\\d+(\\.\\d+)?\\s?(mg|g|kg|ml|l|cm|m|N)$') THEN 'PASS'
      WHEN regexp_matches(qty, '(?i)^\\d+(\\.\\d+)?\\s?(mg|g|kg|ml|l|cm|m|n)$') THEN 'REVIEW' ELSE 'FAIL' END, CASE WHEN qty IS NULL THEN 0.9 ELSE conf END FROM lab),
buckets AS (SELECT p_partkey, p_brand,
  sum(CASE WHEN seq < 2 THEN weight * CASE status WHEN 'PASS' THEN 1.0 WHEN 'REVIEW' THEN 0.5 ELSE 0.0 END ELSE 0 END)::DOUBLE AS e1, sum(CASE WHEN seq < 2 THEN weight ELSE 0 END)::DOUBLE AS a1,
  sum(CASE WHEN seq > 1 AND status <> 'NOT_APPLICABLE' THEN weight * CASE status WHEN 'PASS' THEN 1.0 WHEN 'REVIEW' THEN 0.5 ELSE 0.0 END ELSE 0 END)::DOUBLE AS e2,
  sum(CASE WHEN seq > 1 AND status <> 'NOT_APPLICABLE' THEN weight ELSE 0 END)::DOUBLE AS a2,
  bool_or(status IN ('PASS', 'REVIEW')) AS seen, bool_or(status = 'FAIL' AND severity = 'HIGH') AS high, bool_or(status = 'FAIL') AS failed, bool_or(status = 'REVIEW' AND severity <> 'LOW') AS rev
  FROM res GROUP BY p_partkey, p_brand),
scores AS (SELECT *, floor(e1 / a1 * 45 + 0.5)::INTEGER AS mandatory, CASE WHEN a2 = 0 THEN 20 ELSE floor(e2 / a2 * 20 + 0.5)::INTEGER END AS formatting FROM buckets),
verdicts AS (SELECT *, mandatory + formatting + 35 AS score, CASE WHEN NOT seen THEN 'NOT_DETECTED' WHEN high OR mandatory + formatting + 35 < 70 THEN 'NON_COMPLIANT'
  WHEN failed OR rev OR mandatory + formatting + 35 < 90 THEN 'NEEDS_REVIEW' ELSE 'COMPLIANT' END AS verdict FROM scores)
"""


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return rules.scored(rules.evaluate(part_labels(spark, d), FOUR))


@query(f"""WITH {_LABELS} SELECT p_brand, count(*) AS n, count_if(verdict = 'COMPLIANT')::BIGINT AS compliant, count_if(verdict = 'NEEDS_REVIEW')::BIGINT AS needs_review,
  count_if(verdict = 'NON_COMPLIANT')::BIGINT AS non_compliant, count_if(verdict = 'NOT_DETECTED')::BIGINT AS not_detected, sum(score)::BIGINT AS score_sum FROM verdicts GROUP BY p_brand""")
def verdict_flagship(spark, d):
    v = F.col("verdict")
    return _judged(spark, d).groupBy("p_brand").agg(
        F.count("*").alias("n"), *[F.count_if(v == x.upper()).alias(x) for x in ("compliant", "needs_review", "non_compliant", "not_detected")], F.sum("score").alias("score_sum")
    )


@query(f"WITH {_LABELS} SELECT p_partkey, seq, rule_id, status, floor(c * 100 + 0.5)::BIGINT AS confidence_pct FROM res")
def rule_results(spark, d):
    return rules.rule_results(rules.evaluate(part_labels(spark, d), FOUR), "p_partkey").select("p_partkey", "seq", "rule_id", "status", F.floor(F.col("confidence") * 100 + 0.5).alias("confidence_pct"))


@query(f"WITH {_LABELS} SELECT rule_id, status, count(*) AS n FROM res GROUP BY ALL")
def rule_status_matrix(spark, d):
    return rules.rule_results(rules.evaluate(part_labels(spark, d), FOUR)).groupBy("rule_id", "status").agg(F.count("*").alias("n"))


@query(f"""WITH {_LABELS}, f AS (SELECT p_partkey, rule_id, CASE WHEN status = 'REVIEW' AND severity = 'HIGH' THEN 'MEDIUM' ELSE severity END AS severity,
    row_number() OVER (PARTITION BY p_partkey ORDER BY seq) AS number FROM res WHERE status IN ('FAIL', 'REVIEW'))
  SELECT p_partkey, p_partkey || '-V' || lpad(number::VARCHAR, 2, '0') AS finding_id, row_number() OVER (PARTITION BY p_partkey ORDER BY CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, number)::INTEGER AS position,
    rule_id, severity FROM f""")
def findings_numbered(spark, d):
    return rules.findings(rules.evaluate(part_labels(spark, d), FOUR), "p_partkey").select("p_partkey", "finding_id", "position", "rule_id", "severity")


@query(f"WITH {_LABELS} SELECT p_partkey, mandatory, formatting, 20 AS readability, 15 AS packaging, score, verdict FROM verdicts")
def score_buckets(spark, d):
    return _judged(spark, d).select("p_partkey", "mandatory", "formatting", "readability", "packaging", "score", "verdict")


@query(f"WITH {_LABELS} SELECT p_partkey, concat_ws(',', 'PRODUCT_IDENTITY', 'MANUFACTURER_NAME', CASE WHEN qty IS NULL THEN 'NET_QUANTITY' END, CASE WHEN mrp IS NULL THEN 'MRP' END, 'CONSUMER_CARE', 'DATE_OF_PACKING') AS missing FROM lab")
def missing_keys(spark, d):
    labels = part_labels(spark, d)
    return labels.select("p_partkey", F.array_join(rules.missing_keys(rules.Label(labels.columns)), ",").alias("missing"))


# --- registers


def inspections(spark, d) -> DataFrame:
    return table(spark, d, "orders").withColumn("verdict", analytics.recode(F.col("o_orderstatus"), analytics.VERDICTS))


_VERDICT = "CASE o_orderstatus WHEN 'F' THEN 'COMPLIANT' WHEN 'O' THEN 'NEEDS_REVIEW' WHEN 'P' THEN 'NON_COMPLIANT' END"


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderstatus = 'P' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1998-12-31 23:59:59'")
def inspection_filter(spark, d):
    rows = registers.matching(table(spark, d, "orders"), o_orderstatus="P", o_orderpriority=registers.ALL)
    return registers.between_days(rows, "o_orderdate", "1996-01-01", "1998-12-31").select("o_orderkey", "o_custkey", "o_orderdate")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE contains(lower(concat_ws(' ', c_name, c_mktsegment, o_orderpriority)), 'ma')")
def inspection_search(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return registers.searching(rows, " MA ", "c_name", "c_mktsegment", "o_orderpriority").select("o_orderkey", "c_name")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def has_high_finding(spark, d):
    return registers.having_child(table(spark, d, "orders"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey", F.col("l_returnflag") == "R").select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def no_finding(spark, d):
    return registers.without_child(table(spark, d, "orders"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey").select("o_orderkey", "o_orderstatus")


_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate"


@query(f"""WITH c AS (SELECT l_orderkey, count(*) AS n, arg_min(l_partkey, ({_ORDER})) AS f, arg_max(l_partkey, ({_ORDER})) AS l FROM lineitem GROUP BY 1)
  SELECT o_orderkey, coalesce(n, 0)::BIGINT AS n_findings, f AS first_part, l AS last_part FROM orders LEFT JOIN c ON l_orderkey = o_orderkey""")
def nest_findings(spark, d):
    rows = registers.ends(table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey", _ORDER.split(", "), "l_partkey")
    return rows.select("o_orderkey", F.col("n").alias("n_findings"), F.col("first").alias("first_part"), F.col("last").alias("last_part"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, o_custkey, c_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey
  WHERE l_returnflag = 'R' AND l_linestatus = 'O' AND contains(lower(concat_ws(' ', c_name, o_orderpriority)), '1')""")
def finding_register(spark, d):
    rows = registers.matching(table(spark, d, "lineitem"), l_returnflag="R", l_linestatus="O").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return registers.searching(rows, "1", "c_name", "o_orderpriority").select("l_orderkey", "l_linenumber", "l_partkey", "o_custkey", "c_name")


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10 OFFSET 10")
def page_2(spark, d):
    return registers.page(table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), [F.desc("o_orderdate"), F.asc("o_orderkey")], 1)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 8")
def top_k(spark, d):
    return registers.newest(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 8, [F.desc("o_totalprice"), F.asc("o_orderkey")])


@query("SELECT o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) <= 30")
def newest_30(spark, d):
    return registers.newest(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), 30, [F.desc("o_orderdate"), F.desc("o_orderkey")])


@query("""WITH h AS (SELECT 0 AS source_seq, 'part' AS kind, p_partkey AS id, p_name AS title FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand)), '42')
  UNION ALL SELECT 1, 'officer', c_custkey, c_name FROM customer WHERE contains(lower(c_name), '42') UNION ALL SELECT 2, 'supplier', s_suppkey, s_name FROM supplier WHERE contains(lower(s_name), '42'))
  SELECT * FROM h ORDER BY source_seq, id LIMIT 40""")
def global_search(spark, d):
    part, customer, supplier = (table(spark, d, t) for t in ("part", "customer", "supplier"))
    return registers.global_search(
        {"part": (part, F.col("p_partkey"), F.col("p_name"), ["p_name", "p_brand"]), "officer": (customer, F.col("c_custkey"), F.col("c_name"), ["c_name"]), "supplier": (supplier, F.col("s_suppkey"), F.col("s_name"), ["s_name"])}, "42", 40
    )


@query("SELECT DISTINCT p_brand FROM part")
def distinct_brands(spark, d):
    return table(spark, d, "part").select("p_brand").distinct()


@query("SELECT p_type, min(p_partkey) AS first_seen FROM part GROUP BY p_type")
def distinct_first_seen(spark, d):
    return registers.first_seen(table(spark, d, "part"), "p_type", "p_partkey")


@query("""SELECT role, conv_id, turn, role IN ('system', 'assistant') AS may_review FROM conversations""")
def capabilities(spark, d):
    role = analytics.recode(F.col("role"), {"system": "ADMIN", "assistant": "SUPERVISOR", "user": "INSPECTOR"})
    return table(spark, d, "conversations").select("role", "conv_id", "turn", registers.may(role, "inspection:verify").alias("may_review"))


@query("""SELECT c_custkey, concat_ws(',', CASE WHEN c_acctbal < 0 THEN 'balance' END, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'segment' END, CASE WHEN length(c_name) < 5 THEN 'name' END) AS failed FROM customer""")
def input_validation(spark, d):
    checks = {"balance": F.col("c_acctbal") >= 0, "segment": F.col("c_mktsegment") == "BUILDING", "name": F.length("c_name") >= 5}
    return table(spark, d, "customer").select("c_custkey", F.array_join(registers.failed_fields(checks), ",").alias("failed"))


# --- analytics


@query("""WITH f AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT count(*) AS total, count_if(o_orderstatus = 'F')::BIGINT AS compliant, count_if(o_orderstatus = 'O')::BIGINT AS needs_review,
  count_if(o_orderstatus = 'P')::BIGINT AS non_compliant, coalesce(sum(n), 0)::BIGINT AS findings, floor(count_if(o_orderstatus = 'F') * 100.0::DOUBLE / count(*) * 10 + 0.5) / 10 AS rate FROM orders LEFT JOIN f ON l_orderkey = o_orderkey""")
def dashboard_kpis(spark, d):
    found = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("f"))
    s = F.col("o_orderstatus")
    out = table(spark, d, "orders").join(found, "o_orderkey", "left").agg(F.count("*").alias("total"), F.count_if(s == "F").alias("compliant"), F.count_if(s == "O").alias("needs_review"), F.count_if(s == "P").alias("non_compliant"), F.coalesce(F.sum("f"), F.lit(0)).alias("findings"))
    return out.withColumn("rate", num.percent(F.col("compliant"), F.col("total")))


@query("SELECT o_orderpriority, count(*) AS n, count_if(o_orderstatus = 'F')::BIGINT AS passed, floor(count_if(o_orderstatus = 'F') * 100.0::DOUBLE / count(*) * 10 + 0.5) / 10 AS rate FROM orders GROUP BY 1")
def category_compliance(spark, d):
    return analytics.rate_by(table(spark, d, "orders"), ["o_orderpriority"], F.col("o_orderstatus") == "F")


@query("""SELECT r_name, count(*) AS n, count_if(o_orderstatus = 'P')::BIGINT AS bad, sum(floor(o_totalprice * 100 + 0.5)::BIGINT)::BIGINT AS cents FROM orders JOIN customer ON c_custkey = o_custkey
  JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1""")
def region_stats(spark, d):
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    # Orders are summed per customer first: what is shuffled and joined is a row per customer.
    own = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("bad"), F.sum(num.cents(F.col("o_totalprice"))).alias("cents"))
    rows = table(spark, d, "customer").join(own, "c_custkey").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("r_name").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "cents")])


@query("""WITH dom(seq, severity, flag) AS (VALUES (0, 'HIGH', 'R'), (1, 'MEDIUM', 'A'), (2, 'LOW', 'N'), (3, 'NONE', '?')) SELECT seq, severity, count(l_orderkey) AS n FROM dom LEFT JOIN lineitem ON l_returnflag = flag GROUP BY 1, 2""")
def severity_distribution(spark, d):
    rows = table(spark, d, "lineitem").select(analytics.recode(F.col("l_returnflag"), analytics.SEVERITIES).alias("severity"))
    return analytics.over_domain(rows, "severity", ["HIGH", "MEDIUM", "LOW", "NONE"])


def monthly(spark, d) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month"), "o_orderpriority").agg(F.count("*").alias("n"))


_MONTHLY = "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2"


@query(_MONTHLY)
def monthly_trend(spark, d):
    return monthly(spark, d)


@query(f"""WITH m AS ({_MONTHLY}), b AS (SELECT *, lag(n) OVER (PARTITION BY o_orderpriority ORDER BY month) AS before FROM m)
  SELECT *, CASE WHEN before > 0 THEN floor((n - before) * 1000.0::DOUBLE / before + 0.5) / 10 END AS change_pct FROM b""")
def period_change(spark, d):
    return analytics.period_change(monthly(spark, d), ["o_orderpriority"], "month")


@query("WITH m AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, count(*) AS n FROM orders GROUP BY 1) SELECT * FROM (SELECT * FROM m ORDER BY month DESC LIMIT 6) ORDER BY month")
def trend_tail(spark, d):
    months = table(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")).agg(F.count("*").alias("n"))
    return months.orderBy(F.desc("month")).limit(6).orderBy("month")


_ROLLUP = f"SELECT o_custkey, count(*) AS n, arg_max({_VERDICT}, (o_orderdate, o_orderkey)) AS latest, count_if(o_orderstatus = 'P')::BIGINT AS n_bad, count_if(o_orderstatus = 'P') >= 2 AS repeat_offender FROM orders GROUP BY 1"


@query(_ROLLUP)
def product_rollup(spark, d):
    return analytics.rollup_per_key(inspections(spark, d), "o_custkey", "o_orderdate", "o_orderkey", "verdict", "NON_COMPLIANT")


@query(f"SELECT o_custkey, n_bad FROM ({_ROLLUP}) WHERE repeat_offender")
def repeat_offenders(spark, d):
    return product_rollup(spark, d).where("repeat_offender").select("o_custkey", "n_bad")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_customer(spark, d):
    return registers.latest_per(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")])


@query("SELECT count(DISTINCT l_orderkey) AS inspections_with_findings, count(DISTINCT l_partkey) AS products FROM lineitem")
def count_distinct(spark, d):
    return table(spark, d, "lineitem").agg(F.count_distinct("l_orderkey").alias("inspections_with_findings"), F.count_distinct("l_partkey").alias("products"))


@query("""SELECT l_returnflag, list_sort(list(l_quantity))[len(list(l_quantity)) // 2 + 1] AS upper_median, list_sort(list(l_quantity))[floor(0.3 * (len(list(l_quantity)) - 1))::BIGINT + 1] AS p30, count(*) AS n FROM lineitem GROUP BY 1""")
def median_upper_p30(spark, d):
    return analytics.index_quantiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity")


@query("""WITH m AS (SELECT event_type, median(value) AS mid FROM events GROUP BY 1), o AS (SELECT e.*, abs(value - mid) AS off FROM events e JOIN m USING (event_type)),
  s AS (SELECT event_type, median(off) AS mad FROM o GROUP BY 1) SELECT event_id, event_type FROM o JOIN s USING (event_type) WHERE off <= mad * 2.5""")
def mad_trim(spark, d):
    return analytics.trimmed(table(spark, d, "events").select("event_id", "event_type", "value"), ["event_type"], "value").select("event_id", "event_type")


@query("SELECT user_id, floor(regr_slope(value, event_id) * 1e6 + 0.5)::BIGINT AS slope_micro, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 2")
def slope_per_user(spark, d):
    return analytics.slope(table(spark, d, "events"), ["user_id"], "event_id", "value").where("n > 2").select("user_id", F.floor(F.col("slope") * 1e6 + 0.5).alias("slope_micro"), "n")


@query("""WITH s AS (SELECT user_id, event_type, count(*) AS votes FROM events GROUP BY 1, 2) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, event_type) = 1""")
def vote_argmax(spark, d):
    return analytics.vote(table(spark, d, "events").select("user_id", "event_type"), ["user_id"], "event_type", F.lit(1))


@query("""WITH g AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
  SELECT user_id, event_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM g""")
def gap_islands(spark, d):
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, d, "events").select("user_id", "event_id", "ts").withColumn("before", before)
    return analytics.islands(rows, ["user_id"], ["ts", "event_id"], F.col("ts") - F.col("before") > F.expr("INTERVAL 30 MINUTE")).select("user_id", "event_id", "island")


@query("""WITH g AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) SELECT user_id, event_id, event_type FROM g WHERE event_type IS DISTINCT FROM b""")
def adjacent_distinct(spark, d):
    return analytics.changes_only(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type")


@query("SELECT event_id, count_if(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)::BIGINT AS recent_errors FROM events")
def lookback_2(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 0)
    return table(spark, d, "events").select("event_id", F.count_if(F.col("event_type") == "error").over(w).alias("recent_errors"))


@query("""SELECT event_type, count(*) AS n, count_if(value > 50 AND event_type = 'purchase')::BIGINT AS tp, count_if(value > 50 AND event_type <> 'purchase')::BIGINT AS fp, count_if(NOT value > 50 AND event_type = 'purchase')::BIGINT AS fn,
  count_if(NOT value > 50 AND event_type <> 'purchase')::BIGINT AS tn, CASE WHEN count_if(event_type = 'purchase') = 0 THEN 0.0::DOUBLE ELSE floor(count_if(value > 50 AND event_type = 'purchase') * 100.0::DOUBLE / count_if(event_type = 'purchase') * 10 + 0.5) / 10 END AS recall_pct
  FROM events GROUP BY 1""")
def confusion(spark, d):
    return analytics.confusion(table(spark, d, "events"), F.col("value") > 50, F.col("event_type") == "purchase", ["event_type"])


@query("""WITH x AS (SELECT l.doc_id, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS actual, CASE WHEN n_chars > 1500 THEN 'good' ELSE 'bad' END AS predicted FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
  SELECT actual, predicted, count(*) AS n FROM x WHERE actual <> predicted GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 8""")
def confusion_matrix(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    rows = rows.select(F.when(F.col("quality") == 1, "good").otherwise("bad").alias("actual"), F.when(F.col("n_chars") > 1500, "good").otherwise("bad").alias("predicted"))
    return analytics.off_diagonal(rows, "actual", "predicted")


@query("SELECT r_name, o_orderstatus, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY CUBE (r_name, o_orderstatus)")
def cube_region_status(spark, d):
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.cube("r_name", "o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, count(*) AS n FROM orders GROUP BY ROLLUP (y, m)")
def rollup_month(spark, d):
    return table(spark, d, "orders").select(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).rollup("y", "m").agg(F.count("*").alias("n"))


# --- readings and layout


@query("""WITH c AS (SELECT conv_id, turn, text, (60 + (turn * 7 + length(text)) % 40) / 100.0::DOUBLE AS conf FROM conversations),
  g AS (SELECT conv_id, list({'c': conf, 't': text} ORDER BY turn, conf, text) AS l, count(*) AS n FROM c WHERE text IS NOT NULL GROUP BY 1),
  f AS (SELECT conv_id, n, list_reduce(l, lambda a, b: CASE WHEN abs(a.c - b.c) > 0.08 THEN CASE WHEN b.c > a.c THEN b ELSE a END WHEN length(b.t) > length(a.t) THEN b ELSE a END) AS r FROM g)
  SELECT conv_id, r.t AS value, r.c AS confidence, n AS n_readings FROM f""")
def best_reading_fold(spark, d):
    rows = table(spark, d, "conversations").where("text is not null").withColumn("confidence", (F.lit(60) + (F.col("turn") * 7 + F.length("text")) % 40) / F.lit(100.0))
    return reconcile.best_readings(rows, ["conv_id"], ["turn"], "text")


@query("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY (doc_id % 12) * 100 + n_chars + 10 * 0.5::DOUBLE DESC, doc_id)::INTEGER AS place FROM documents")
def pass_rank(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return reconcile.rank_passes(rows, ["source"], reconcile.pass_score(F.col("doc_id") % 12, F.col("n_chars"), F.lit(0.5)), ["doc_id"]).select("doc_id", "source", "place")


@query("""SELECT doc_id, CASE WHEN doc_id % 12 >= 8 AND quality = 1 THEN 'GOOD' WHEN doc_id % 12 >= 4 THEN 'MARGINAL' ELSE 'POOR' END AS level,
  concat_ws(',', CASE WHEN doc_id % 40 < 18 THEN 'SMALL_PRINT' END, CASE WHEN quality = 0 THEN 'UNREADABLE' END, CASE WHEN doc_id % 12 < 4 THEN 'FEW_FIELDS' WHEN doc_id % 12 < 8 THEN 'SOME_FIELDS' END) AS reasons FROM labels""")
def quality_level(spark, d):
    found = F.col("doc_id") % 12
    _, reasons = reconcile.image_quality(F.col("doc_id") % 40, F.when(F.col("quality") == 0, 0.5).otherwise(0.9), found)
    return table(spark, d, "labels").select("doc_id", reconcile.quality_level(found, F.col("quality") == 1).alias("level"), F.array_join(reasons, ",").alias("reasons"))


def _boxes(spark, d) -> DataFrame:
    """Parts as lines of text: eight to an image, with places from their numbers."""
    k = F.col("p_partkey")
    x0, y0 = ((k * 37) % 400).cast("double"), ((k * 53) % 120).cast("double")
    return table(spark, d, "part").select((k / 8).cast("long").alias("image_id"), k.alias("ord"), x0.alias("x0"), y0.alias("y0"), (x0 + 20 + F.col("p_size") * 3).alias("x1"), (y0 + 20).alias("y1"))


_BOXES = """b AS (SELECT p_partkey // 8 AS image_id, p_partkey AS ord, ((p_partkey * 37) % 400)::DOUBLE AS x0, ((p_partkey * 53) % 120)::DOUBLE AS y0,
  ((p_partkey * 37) % 400)::DOUBLE + 20 + p_size * 3 AS x1, ((p_partkey * 53) % 120)::DOUBLE + 20 AS y1 FROM part)"""


@query(f"""WITH {_BOXES} SELECT c.image_id, c.ord AS caption, v.ord AS value FROM b c JOIN b v ON c.image_id = v.image_id AND c.ord <> v.ord AND c.ord % 2 = 0 AND v.y0 >= c.y1 - 20 * 0.3::DOUBLE AND v.y0 - c.y1 <= 90
  AND greatest(0, least(c.x1, v.x1) - greatest(c.x0, v.x0)) / greatest(1, least(c.x1 - c.x0, v.x1 - v.x0)) >= 0.25 QUALIFY row_number() OVER (PARTITION BY c.image_id, c.ord ORDER BY v.y0, v.ord) = 1""")
def nearest_below(spark, d):
    b = _boxes(spark, d)
    return layout.nearest_below(b.where("ord % 2 = 0"), b, ["image_id"], 90).select("image_id", F.col("c_ord").alias("caption"), F.col("v_ord").alias("value"))


@query(f"""WITH {_BOXES} SELECT c.image_id, c.ord AS caption, v.ord AS value FROM b c JOIN b v ON c.image_id = v.image_id AND c.ord <> v.ord AND c.ord % 2 = 0 AND abs((c.y0 + c.y1) / 2 - (v.y0 + v.y1) / 2) <= 15
  AND v.x0 > (c.x0 + c.x1) / 2 AND v.x0 - c.x1 < 600 QUALIFY row_number() OVER (PARTITION BY c.image_id, c.ord ORDER BY v.x0, v.ord) = 1""")
def same_band(spark, d):
    b = _boxes(spark, d)
    return layout.same_row(b.where("ord % 2 = 0"), b, ["image_id"]).select("image_id", F.col("c_ord").alias("caption"), F.col("v_ord").alias("value"))


@query(f"""WITH {_BOXES} SELECT image_id, count(*) AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM b GROUP BY 1""")
def union_boxes(spark, d):
    return _boxes(spark, d).groupBy("image_id").agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def part_lines(spark: SparkSession, d: str) -> DataFrame:
    """Parts as labels of up to six lines: prices beside, below or without a caption, dates, origins, licences."""
    k, r = F.col("p_partkey"), F.floor("p_retailprice").cast("string")
    by_5 = lambda *x: reduce(lambda c, i: c.when(k % 5 == i, x[i]), range(len(x)), F.when(F.lit(False), ""))
    month = F.lpad((k % 12 + 1).cast("string"), 2, "0")
    texts = F.array(
        by_5(F.concat(F.lit("MRP Rs. "), r, F.lit(".00")), F.concat(F.lit("MRP Rs. "), r), F.concat(F.lit("Rs "), r, F.lit("/-")), F.lit("Maximum Retail Price")),
        by_5(F.lit("(incl. of all taxes)"), F.lit("contents"), F.lit("contents"), F.concat(F.lit("Rs. "), r, F.lit(".00"))),
        F.when(k % 3 == 0, F.concat(F.lit("Mfg. Date: "), month, F.lit("/2024"))).otherwise(F.concat(month, F.lit("/2024"))),
        F.when(k % 2 == 0, "Best before 18 months").otherwise(F.concat(F.lit("15/"), month, F.lit("/2026"))),
        F.when(k % 3 == 0, "Made in Sri Lanka").otherwise("Country of origin: India"),
        F.when(k % 7 == 0, F.concat(F.lit("1001"), F.lpad(k.cast("string"), 10, "0"))),
    )
    x = table(spark, d, "part").select("p_partkey", F.posexplode(texts).alias("ord", "text"))
    y0 = F.col("ord") * 30.0
    return x.select("p_partkey", "ord", "text", F.lit(0.9).alias("confidence"), F.lit(0.0).alias("x0"), y0.alias("y0"), F.lit(200.0).alias("x1"), (y0 + 20).alias("y1"))


@query("""WITH p AS (SELECT p_partkey, p_partkey % 5 AS k, floor(p_retailprice)::BIGINT::VARCHAR AS r, lpad((p_partkey % 12 + 1)::VARCHAR, 2, '0') AS m FROM part)
  SELECT p_partkey, 'MRP' AS key, CASE k WHEN 0 THEN 'Rs. ' || r || '.00 (incl. of all taxes)' WHEN 1 THEN 'MRP Rs. ' || r WHEN 2 THEN 'Rs ' || r ELSE 'Maximum Retail Price Rs. ' || r || '.00' END AS value,
    CASE k WHEN 3 THEN 1 ELSE 0 END AS ord, 90 AS confidence_pct FROM p WHERE k < 4
  UNION ALL SELECT p_partkey, 'DATE_OF_PACKING', m || '/2024', 2, CASE WHEN p_partkey % 3 = 0 THEN 90 ELSE 80 END FROM p
  UNION ALL SELECT p_partkey, 'BEST_BEFORE', CASE WHEN p_partkey % 2 = 0 THEN '18 months' ELSE '15/' || m || '/2026' END, 3, CASE WHEN p_partkey % 2 = 0 THEN 90 ELSE 80 END FROM p
  UNION ALL SELECT p_partkey, 'COUNTRY_OF_ORIGIN', CASE WHEN p_partkey % 3 = 0 THEN 'Sri Lanka' ELSE 'India' END, 4, 90 FROM p
  UNION ALL SELECT p_partkey, 'FSSAI_LICENSE', '1001' || lpad(p_partkey::VARCHAR, 10, '0'), 5, 90 FROM p WHERE p_partkey % 7 = 0""")
def label_fields(spark, d):
    f = readers.fields(part_lines(spark, d), ["p_partkey"])
    return f.select("p_partkey", "key", "value", "ord", F.floor(F.col("confidence") * 100 + 0.5).cast("int").alias("confidence_pct"))


def declared_lines(spark: SparkSession, d: str) -> DataFrame:
    """Parts as labels of eight lines: quantities alone and in packs, batch, maker, address, care."""
    k = F.col("p_partkey")
    n = lambda x: x.cast("string")
    texts = F.array(
        F.when(k % 2 == 0, F.concat(F.lit("Net Qty: "), n(k % 500 + 1), F.lit(" g"))).otherwise(F.concat(F.lit("Net weight: "), n(k % 4 + 2), F.lit(" N x 50 g"))),
        F.when(k % 3 == 0, F.concat(F.lit("Batch No.: AB"), n(k % 90000 + 10000))).otherwise(F.concat(F.lit("XB"), n(k % 90000 + 10000))),
        F.when(k % 5 == 0, "Made for you:").otherwise("Manufactured by: Alpha Mills Ltd., India:"),
        F.concat(F.lit("Plot "), n(k % 90 + 1), F.lit(", Mill Road, Pune 411 045")),
        F.lit("Customer care: write to us"),
        F.concat(F.lit("care"), n(k), F.lit("@shop.example")),
        F.lit("Country of origin: India"),
        F.lit("MRP Rs. 75.00"),
    )
    x = table(spark, d, "part").select("p_partkey", F.posexplode(texts).alias("ord", "text"))
    y0 = F.col("ord") * 30.0
    return x.select("p_partkey", "ord", "text", F.lit(0.9).alias("confidence"), F.lit(0.0).alias("x0"), y0.alias("y0"), F.lit(200.0).alias("x1"), (y0 + 20).alias("y1"))


@query("""WITH p AS (SELECT p_partkey, p_partkey::VARCHAR AS t, p_partkey % 90 + 1 AS plot, p_partkey % 90000 + 10000 AS code, p_partkey % 4 + 2 AS packs, p_partkey % 500 + 1 AS g FROM part)
  SELECT p_partkey, 'NET_QUANTITY' AS key, CASE WHEN p_partkey % 2 = 0 THEN g || ' g' ELSE packs || ' N x 50 g (' || packs * 50 || ' g)' END AS value, 0 AS ord, 90 AS confidence_pct FROM p
  UNION ALL SELECT p_partkey, 'BATCH_NUMBER', CASE WHEN p_partkey % 3 = 0 THEN 'AB' ELSE 'XB' END || code, 1, CASE WHEN p_partkey % 3 = 0 THEN 90 ELSE 70 END FROM p
  UNION ALL SELECT p_partkey, 'MANUFACTURER_NAME', 'Alpha Mills Ltd.', 2, 90 FROM p WHERE p_partkey % 5 <> 0
  UNION ALL SELECT p_partkey, 'MANUFACTURER_ADDRESS', 'Plot ' || plot || ', Mill Road, Pune 411 045', 3, 90 FROM p
  UNION ALL SELECT p_partkey, 'CONSUMER_CARE', 'Customer care: write to us, care' || t || '@shop.example', 4, 90 FROM p
  UNION ALL SELECT p_partkey, 'COUNTRY_OF_ORIGIN', 'India', 6, 90 FROM p
  UNION ALL SELECT p_partkey, 'MRP', 'MRP Rs. 75.00', 7, 90 FROM p""")
def label_declarations(spark, d):
    f = declarations.declarations(declared_lines(spark, d), ["p_partkey"])
    return f.select("p_partkey", "key", "value", "ord", F.floor(F.col("confidence") * 100 + 0.5).cast("int").alias("confidence_pct"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'URGENT' ELSE trim(o_orderpriority) END AS o_orderpriority, o_orderstatus FROM orders")
def partial_update(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.trim("o_orderpriority").alias("o_orderpriority"), "o_orderstatus")
    return mutate.patch(rows, F.col("o_orderstatus") == "O", {"o_orderpriority": F.lit("URGENT")})


@query("SELECT c_custkey, CASE WHEN c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) THEN NULL ELSE c_nationkey END AS c_nationkey FROM customer")
def reference_cleared(spark, d):
    gone = table(spark, d, "nation").where("n_regionkey = 1")
    return mutate.clear_reference(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", gone, "n_nationkey")


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def rows_added(spark, d):
    old = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return mutate.insert_new(old, table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), "id")


# --- texts


@query(r"""SELECT doc_id, regexp_matches(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.]+') AS has_email, regexp_matches(text, '\+?[0-9][0-9 \t\n\r\f\v-]{8,}') AS has_phone FROM documents""")
def extract_contacts(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", t.rlike(r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.]+").alias("has_email"), t.rlike(r"\+?[0-9][0-9 \t\n\r\f\x0B-]{8,}").alias("has_phone"))


@query(r"""SELECT doc_id, floor(coalesce(try_cast(replace(regexp_extract(text, '([0-9][0-9,]*(?:\.[0-9]+)?)', 1), ',', '') AS DOUBLE), 0) * 100 + 0.5)::BIGINT AS number_cents FROM documents WHERE length(regexp_extract(text, '([0-9][0-9,]*(?:\.[0-9]+)?)', 1)) <= 15""")
def extract_numbers(spark, d):
    rows = table(spark, d, "documents").where(F.length(F.regexp_extract("text", r"([0-9][0-9,]*(?:\.[0-9]+)?)", 1)) <= 15)
    return rows.select("doc_id", num.cents(text.first_number(F.col("text"))).alias("number_cents"))


@query(r"""SELECT doc_id, list_aggregate(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda w: CASE WHEN length(regexp_replace(w, '[^A-Za-z]', '', 'g')) >= 3 THEN 1 ELSE 0 END), 'sum')::BIGINT AS wordlike FROM documents WHERE regexp_matches(text, '[A-Za-z0-9]')""")
def looks_like_words(spark, d):
    rows = table(spark, d, "documents").where(F.col("text").rlike("[A-Za-z0-9]"))
    words = F.regexp_extract_all("text", F.lit("([A-Za-z0-9]+)"), F.lit(1))
    return rows.select("doc_id", F.size(F.filter(words, lambda w: text.letters(w) >= 3)).cast("long").alias("wordlike"))


@query()
def extract_numbers_all(spark, d):
    """extract_numbers without its limit of 15 characters, which its SQL needs: a row for every document."""
    return table(spark, d, "documents").select("doc_id", text.first_cents(F.col("text")).alias("number_cents"))


@query()
def looks_like_words_all(spark, d):
    """Whether a text reads as words, for every document."""
    return table(spark, d, "documents").select("doc_id", text.looks_like_words(F.col("text")).alias("wordlike"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[\s\x{a0}\x{feff}]+', ' ', 'g')) AS shown FROM pages""")
def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", text.html_text(F.col("html")).alias("shown"))


@query(r"""SELECT p_partkey, substr(regexp_replace(regexp_replace(lower(concat_ws(' ', p_brand, p_name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48) AS slug FROM part""")
def scan_identity(spark, d):
    return table(spark, d, "part").select("p_partkey", text.slug(F.concat_ws(" ", "p_brand", "p_name")).alias("slug"))


@query(r"""SELECT c_custkey, upper(substr(regexp_extract(c_name, '^\s*(\S)', 1), 1, 1)) AS initial, regexp_replace(c_name || '@x.example', '^(.).*(@.*)$', '\1***\2') AS masked FROM customer""")
def masked_names(spark, d):
    name = F.col("c_name")
    return table(spark, d, "customer").select("c_custkey", F.substring(text.initials(F.regexp_extract(name, r"^\s*(\S+)", 1)), 1, 1).alias("initial"), text.mask_email(F.concat(name, F.lit("@x.example"))).alias("masked"))


@query(r"""WITH t AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')) AS a FROM benchmark), u AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')) AS b FROM documents)
  SELECT item_id, doc_id, floor(len(list_filter(list_intersect(a, b), lambda w: length(w) > 2)) / greatest(1, least(len(a), len(b)))::DOUBLE * 1000 + 0.5)::BIGINT AS overlap FROM t JOIN u ON u.doc_id = t.item_id""")
def token_overlap(spark, d):
    pairs = table(spark, d, "benchmark").select("item_id", F.col("text").alias("a")).join(table(spark, d, "documents").select(F.col("doc_id"), F.col("text").alias("b")), F.col("item_id") == F.col("doc_id"))
    return pairs.select("item_id", "doc_id", F.floor(text.token_overlap(F.col("a"), F.col("b")) * 1000 + 0.5).alias("overlap"))


@query()
def fnv_features(spark, d):
    lines = table(spark, d, "benchmark").select("item_id", "text")
    return classify.features(lines, "item_id", "text").groupBy("item_id").agg(F.count("*").alias("n"), F.max_by("index", F.struct("weight", "index")).alias("strongest"))


@query("""WITH z AS (SELECT vec_id, list_transform(embedding[1:10], lambda x: x::DOUBLE * 4) AS z FROM embeddings), s AS (SELECT vec_id, z, list_max(z) AS top, list_sum(list_transform(z, lambda x: exp(x - list_max(z)))) AS total FROM z)
  SELECT vec_id, (list_position(z, top) - 1)::INTEGER AS best, floor(1 / total * 1000 + 0.5)::BIGINT AS p_milli FROM s""")
def softmax_top2(spark, d):
    scores = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double") * 4)
    top = table(spark, d, "embeddings").select("vec_id", classify.softmax_top2(scores).alias("t"))
    return top.select("vec_id", F.col("t.best").alias("best"), F.floor(F.col("t.p") * 1000 + 0.5).alias("p_milli"))


@query("""SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS row_json FROM events""")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.to_json(F.struct("event_id", "event_type")).alias("row_json"))


# --- changes


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders UNION ALL SELECT -o_orderkey - 1, 'X', 'new' FROM orders WHERE o_orderkey % 70 = 0""")
def upsert_whitelist(spark, d):
    old = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    fresh = lambda key: F.struct(key.alias("o_orderkey"), F.lit("X").alias("o_orderstatus"), F.lit("new").alias("o_orderpriority"))
    # Every seventh inspection changes its status (its priority is not for updates), every seventieth also adds a new one.
    changed = old.where("o_orderkey % 7 = 0").select(F.explode(F.when(F.col("o_orderkey") % 70 == 0, F.array(fresh(F.col("o_orderkey")), fresh(-F.col("o_orderkey") - 1))).otherwise(F.array(fresh(F.col("o_orderkey"))))).alias("r"))
    return mutate.upsert(old, changed.select("r.*"), "o_orderkey", ["o_orderstatus"])


@query("SELECT c_custkey, c_name FROM customer UNION ALL SELECT s_suppkey + 1000000, s_name FROM supplier")
def insert_ignore(spark, d):
    old = table(spark, d, "customer").select("c_custkey", "c_name")
    s = table(spark, d, "supplier")
    more = s.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name")).join(old.select("c_custkey"), "c_custkey", "left_semi")
    return mutate.insert_new(old, more.unionByName(s.select((F.col("s_suppkey") + 1000000).alias("c_custkey"), F.col("s_name").alias("c_name"))), "c_custkey")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def cascade_delete(spark, d):
    gone = table(spark, d, "orders").where("o_orderstatus = 'P'")
    return mutate.delete(table(spark, d, "lineitem"), "l_orderkey", gone, "o_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE WHEN c_acctbal >= 0 THEN o_custkey END AS o_custkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def set_null_on_delete(spark, d):
    return mutate.clear_reference(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", table(spark, d, "customer").where("c_acctbal < 0"), "c_custkey")


@query("SELECT o_orderkey, 'LM-' || lpad((500 + row_number() OVER (ORDER BY o_orderdate, o_orderkey))::VARCHAR, 8, '0') AS number FROM orders")
def numbered(spark, d):
    rows = mutate.number_on(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), 500, [F.col("o_orderdate"), F.col("o_orderkey")], "n")
    return rows.select("o_orderkey", F.concat(F.lit("LM-"), text.padded(F.col("n"), 8)).alias("number"))


# --- feeds


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, sum(floor(value * 100 + 0.5)::BIGINT)::BIGINT AS total FROM events GROUP BY 1, 2")
def window_tumbling(spark, d):
    return feed.per_window(table(spark, d, "events").withColumn("value", num.cents(F.col("value"))), "ts", "1 hour", ["event_type"])


@query("""SELECT (time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * k) AS window_start, count(*) AS n, sum(floor(value * 100 + 0.5)::BIGINT)::BIGINT AS total FROM events, (VALUES (0), (1)) v(k) GROUP BY 1""")
def window_sliding(spark, d):
    return feed.per_window(table(spark, d, "events").withColumn("value", num.cents(F.col("value"))), "ts", "1 hour", [], "30 minutes")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events),
  s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def session(spark, d):
    return feed.sessions(table(spark, d, "events").select("ts", "user_id"), "ts", "user_id", "30 minutes")


@query("""SELECT user_id, CASE WHEN count_if(event_type = 'purchase') > 0 THEN 'CLOSED' ELSE 'UNDER_REVIEW' END AS stage FROM events GROUP BY 1""")
def review_stage(spark, d):
    decision = F.when(F.col("event_type") == "purchase", "CLOSE").otherwise("NOTE")
    return feed.stages(table(spark, d, "events"), "user_id", decision)


# --- panels of a label, products and their counters


@query(r"""WITH p AS (SELECT l_orderkey, l_returnflag, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 3 = 0 THEN 'value ' || l_suppkey END AS value, (32 + l_partkey % 32) / 64.0::DOUBLE AS conf,
    CASE WHEN l_suppkey % 4 = 0 THEN 'Domestic ' || l_suppkey % 5 END AS why FROM lineitem),
  g AS (SELECT l_orderkey, l_returnflag, avg(conf) FILTER (value IS NULL) AS miss, arg_min(why, (l_linenumber, l_partkey, l_suppkey)) FILTER (value IS NULL AND why IS NOT NULL) AS why,
    list({'c': conf, 'v': value} ORDER BY l_linenumber, l_partkey, l_suppkey, conf, value) FILTER (value IS NOT NULL) AS l FROM p GROUP BY 1, 2),
  f AS (SELECT *, CASE WHEN l IS NOT NULL THEN list_reduce(l, lambda a, b: CASE WHEN abs(a.c - b.c) > 0.08 THEN CASE WHEN b.c > a.c THEN b ELSE a END WHEN length(b.v) > length(a.v) THEN b ELSE a END) END AS r FROM g)
  SELECT l_orderkey, l_returnflag, r.v AS value, CASE WHEN r IS NOT NULL THEN r.c WHEN miss * 8 = floor(miss * 8) AND floor(miss * 8) % 2 = 1 THEN floor(miss * 100 + 0.5) / 100 ELSE printf('%.2f', miss)::DOUBLE END AS confidence,
    CASE WHEN r IS NULL THEN why END AS not_applicable FROM f""")
def merged_declarations(spark, d):
    x = table(spark, d, "lineitem").select(
        "l_orderkey", "l_returnflag", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("value "), F.col("l_suppkey").cast("string"))).alias("value"),
        ((32 + F.col("l_partkey") % 32) / F.lit(64.0)).alias("confidence"), F.when(F.col("l_suppkey") % 4 == 0, F.concat(F.lit("Domestic "), (F.col("l_suppkey") % 5).cast("string"))).alias("not_applicable"),
    )
    return panels.merge_panels(x, ["l_orderkey", "l_returnflag"], ["l_linenumber", "l_partkey", "l_suppkey"])


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 13 AS found, l_returnflag AS name, l_quantity::BIGINT AS words, l_suppkey * 10 AS ms, l_partkey % 40 AS cap_px, l_linestatus = 'O' AS refocused FROM lineitem),
  k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, found, name) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM p)
  SELECT l_orderkey, count(*) AS n_panels, sum(words)::BIGINT AS words, sum(ms)::BIGINT AS ms, min(cap_px) AS cap_px, bool_or(refocused) AS refocused, string_agg(found::VARCHAR, '/' ORDER BY i) AS best_of,
    string_agg('--- Image ' || i || ' of ' || n || ': ' || name || ' ---', chr(10) ORDER BY i) AS headings FROM k GROUP BY 1""")
def panel_summary(spark, d):
    x = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_partkey") % 13).alias("found"), F.col("l_returnflag").alias("name"), F.col("l_quantity").cast("long").alias("words"),
        (F.col("l_suppkey") * 10).alias("ms"), (F.col("l_partkey") % 40).alias("cap_px"), (F.col("l_linestatus") == "O").alias("refocused"),
    )
    return panels.panel_summary(x, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"])


@query("SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag))[1] AS first_key, len(list(DISTINCT l_returnflag))::INTEGER AS n_keys FROM lineitem GROUP BY 1")
def keys_of_all_images(spark, d):
    return panels.keys_seen(table(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag").select("l_orderkey", F.get("keys", F.lit(0)).alias("first_key"), F.size("keys").alias("n_keys"))


@query("""WITH w AS (SELECT p_partkey // 40 AS image, p_partkey // 8 AS line, (p_partkey % 8) * 50 + p_size / 2 AS x, ((p_partkey * 53) % 20)::DOUBLE AS y FROM part WHERE 40 + p_size >= 50),
  s AS (SELECT image, line, count(*) AS n, count(*) * sum(x * y) - sum(x) * sum(y) AS num, count(*) * sum(x * x) - sum(x) * sum(x) AS den, max(x) - min(x) AS across FROM w GROUP BY 1, 2),
  a AS (SELECT image, CASE WHEN n >= 3 AND den > 0 AND across > 400 * 0.05 THEN degrees(atan2(num, den)) END AS angle FROM s)
  SELECT image, count(angle) AS n_lines, CASE WHEN count(angle) >= 3 THEN floor(median(angle) * 10 + 0.5) / 10 END AS tilt FROM a GROUP BY 1""")
def image_tilt(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    x = table(spark, d, "part").select(F.floor(k / 40).alias("image"), F.floor(k / 8).alias("line"), ((k % 8) * 50 + size / 2.0).alias("x"), ((k * 53) % 20).cast("double").alias("y"), (40 + size).cast("double").alias("confidence"))
    return panels.tilt(x, ["image"], "line", F.lit(400.0))


@query("""WITH p AS (SELECT o_custkey, o_orderkey, o_orderstatus = 'F' AS hosted, o_orderkey % 12 AS found, o_orderkey % 7 AS score FROM orders),
  b AS (SELECT o_custkey, coalesce(max(found) FILTER (hosted) >= 8, false) AS stands_alone, max(score) FILTER (hosted) AS h, max(score) FILTER (NOT hosted) AS l, arg_max(o_orderkey, (score, -o_orderkey)) FILTER (hosted) AS hk,
    arg_max(o_orderkey, (score, -o_orderkey)) FILTER (NOT hosted) AS lk FROM p GROUP BY 1), c AS (SELECT *, h IS NOT NULL AND (stands_alone OR l IS NULL OR h >= l) AS from_hosted FROM b)
  SELECT o_custkey, stands_alone, from_hosted AS hosted, CASE WHEN from_hosted THEN hk ELSE lk END AS o_orderkey, CASE WHEN from_hosted THEN h ELSE l END AS score FROM c""")
def leading_pass(spark, d):
    k = F.col("o_orderkey")
    return panels.leading_pass(table(spark, d, "orders"), ["o_custkey"], F.col("o_orderstatus") == "F", k % 12, k % 7, "o_orderkey")


@query("""SELECT l_partkey, CASE min(CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) WHEN 0 THEN 'violation' WHEN 1 THEN 'review' ELSE 'valid' END AS tone,
  arg_min(l_suppkey, (CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_orderkey, l_linenumber, l_suppkey)) AS l_suppkey FROM lineitem GROUP BY 1""")
def region_verdicts(spark, d):
    status = F.when(F.col("l_returnflag") == "R", "FAIL").when(F.col("l_returnflag") == "A", "REVIEW").otherwise("PASS")
    return panels.region_verdicts(table(spark, d, "lineitem").withColumn("status", status), ["l_partkey"], "status", ["l_orderkey", "l_linenumber"], "l_suppkey")


_PRODUCTS = f"""f AS (SELECT l_orderkey, count_if(l_linestatus = 'O')::BIGINT AS n FROM lineitem GROUP BY 1),
  c AS (SELECT o_custkey, count(*) AS inspection_count, min(o_orderdate) AS created_at, max(o_orderdate) AS last_inspected_at, arg_max({_VERDICT}, (o_orderdate, o_orderkey)) AS latest_status, sum(coalesce(n, 0))::BIGINT AS open_findings,
    count_if(o_orderstatus = 'P') >= 2 AS repeat_offender FROM orders LEFT JOIN f ON l_orderkey = o_orderkey GROUP BY 1),
  p AS (SELECT c_custkey, c_mktsegment, coalesce(inspection_count, 0) AS inspection_count, created_at, last_inspected_at, latest_status, coalesce(open_findings, 0) AS open_findings, coalesce(repeat_offender, false) AS repeat_offender
    FROM customer LEFT JOIN c ON o_custkey = c_custkey)"""


@query(f"WITH {_PRODUCTS} SELECT * FROM p")
def products_with_counters(spark, d):
    findings = products.open_findings(table(spark, d, "lineitem"), "l_orderkey", F.col("l_linestatus") == "O").withColumnRenamed("l_orderkey", "o_orderkey")
    seen = inspections(spark, d).join(findings, "o_orderkey", "left").withColumn("open_findings", F.coalesce("open_findings", F.lit(0).cast("long")))
    counters = products.product_counters(seen, "o_custkey", "o_orderdate", "o_orderkey", "verdict", "NON_COMPLIANT", "open_findings").withColumnRenamed("o_custkey", "c_custkey")
    return products.with_counters(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), counters, "c_custkey")


@query(f"WITH {_PRODUCTS} SELECT c_custkey, last_inspected_at, latest_status FROM p WHERE repeat_offender AND c_mktsegment = 'MACHINERY' ORDER BY last_inspected_at DESC NULLS LAST")
def offending_products(spark, d):
    return products.listed_products(products_with_counters(spark, d), True, c_mktsegment="MACHINERY", latest_status=registers.ALL).select("c_custkey", "last_inspected_at", "latest_status")


@query("""SELECT o_custkey, o_orderkey, row_number() OVER w::INTEGER AS place, sum(o_orderkey % 101) OVER w::DOUBLE / row_number() OVER w AS mean_so_far FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def compliance_history(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", (F.col("o_orderkey") % 101).alias("score"))
    return products.history(rows, "o_custkey", "o_orderdate", "o_orderkey", "score").select("o_custkey", "o_orderkey", "place", "mean_so_far")


@query("SELECT o_orderkey, coalesce(s_name, (SELECT s_name FROM supplier ORDER BY s_suppkey LIMIT 1)) AS s_name FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey")
def officer_or_first(spark, d):
    return products.with_default(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("s_suppkey")), table(spark, d, "supplier"), "s_suppkey", "s_suppkey", "s_name").select("o_orderkey", "s_name")


@query("""SELECT s_suppkey, CASE WHEN (s_suppkey % 7) || 'x' || s_suppkey IN (SELECT (c_custkey % 5) || 'x' || c_custkey FROM customer) THEN 'official'
  WHEN s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900) THEN 'email' END AS conflict FROM supplier""")
def key_conflicts(spark, d):
    name = lambda k, m, x: F.concat((F.col(k) % m).cast("string"), F.lit(x), F.col(k).cast("string"))
    new = table(spark, d, "supplier").select("s_suppkey", name("s_suppkey", 7, "x").alias("official"), F.concat(F.col("s_nationkey").cast("string"), F.lit("@m ")).alias("email"))
    mail = F.when(F.col("c_acctbal") > 9900, F.concat(F.col("c_nationkey").cast("string"), F.lit("@M")))
    old = table(spark, d, "customer").select(name("c_custkey", 5, "X").alias("official"), mail.alias("email"))
    return products.conflicts(new, old, "official", "email").select("s_suppkey", "conflict")


@query("""WITH e AS (SELECT event_id, user_id, ts, event_type, count_if(event_type = 'signup') OVER w AS code, max(CASE WHEN event_type = 'signup' THEN ts END) OVER w AS since FROM events
    WHERE event_type IN ('signup', 'purchase', 'error') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  t AS (SELECT *, count_if(event_type = 'purchase') OVER k AS used, count_if(event_type <> 'signup') OVER k AS tries FROM e WINDOW k AS (PARTITION BY user_id, code ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT event_id, user_id, CASE WHEN code = 0 OR used > 0 OR tries >= 3 OR ts > since + INTERVAL 2 DAY THEN 'EXPIRED' WHEN event_type = 'purchase' THEN 'ACCEPTED' ELSE 'WRONG' END AS status FROM t WHERE event_type <> 'signup'""")
def code_attempts(spark, d):
    kind = F.col("event_type")
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type").where(kind.isin("signup", "purchase", "error"))
    return products.code_attempts(rows, "user_id", ["ts", "event_id"], "ts", kind == "signup", kind == "purchase", "2 days", 3).select("event_id", "user_id", "status")


@query("""SELECT count(*) AS n, count_if(l_linestatus = 'O')::BIGINT AS open, count_if(l_linestatus = 'F')::BIGINT AS verified, count_if(l_returnflag = 'R')::BIGINT AS high, count_if(l_linestatus = 'O' AND l_returnflag = 'R')::BIGINT AS open_high FROM lineitem""")
def scalar_counters(spark, d):
    is_open, high = F.col("l_linestatus") == "O", F.col("l_returnflag") == "R"
    return analytics.counts_of(table(spark, d, "lineitem"), [], {"open": is_open, "verified": F.col("l_linestatus") == "F", "high": high, "open_high": is_open & high})


@query("SELECT l_orderkey, coalesce(floor(avg(l_quantity::BIGINT) FILTER (l_returnflag = 'R') * 8 + 0.5) / 8, 0)::DOUBLE AS mean FROM lineitem GROUP BY 1")
def mean_or_zero(spark, d):
    eighths = lambda x: F.floor(x * 8 + 0.5) / 8.0
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(panels.mean_or_zero(F.col("l_quantity").cast("long"), F.col("l_returnflag") == "R", 9).alias("mean")).withColumn("mean", eighths(F.col("mean")))


@query("""WITH p AS (SELECT s_suppkey, lpad((98000 + s_suppkey)::VARCHAR, 5, '0') || lpad((s_suppkey * 37 % 100000)::VARCHAR, 5, '0') AS d FROM supplier)
  SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '+91' || d WHEN 1 THEN '+91' || d WHEN 2 THEN '+44' || d ELSE '+' || d END AS phone FROM p""")
def phone_numbers(spark, d):
    k = F.col("s_suppkey")
    a, b = F.lpad((98000 + k).cast("string"), 5, "0"), F.lpad((k * 37 % 100000).cast("string"), 5, "0")
    shown = F.when(k % 4 == 0, F.concat(a, F.lit("-"), b)).when(k % 4 == 1, F.concat(F.lit("91 "), a, b)).when(k % 4 == 2, F.concat(F.lit(" +44 ("), a, F.lit(") "), b)).otherwise(F.concat(F.lit("+"), a, b))
    return table(spark, d, "supplier").select("s_suppkey", text.e164(shown).alias("phone"))


@query("""WITH m AS (SELECT event_id, ts, floor(date_diff('microsecond', ts, TIMESTAMP '2024-02-15 00:00:00') / 6e7 + 0.5) AS m FROM events),
  h AS (SELECT *, floor(m / 60 + 0.5) AS h FROM m), d AS (SELECT *, floor(h / 24 + 0.5) AS d FROM h)
  SELECT event_id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m::BIGINT || 'm ago' WHEN h < 24 THEN h::BIGINT || 'h ago' WHEN d < 30 THEN d::BIGINT || 'd ago' ELSE strftime(ts, '%d %b %Y') END AS shown FROM d""")
def relative_times(spark, d):
    return table(spark, d, "events").select("event_id", text.ago(F.to_timestamp_ntz(F.lit("2024-02-15 00:00:00")), F.col("ts")).alias("shown"))


@query(f"WITH {_BOXES} SELECT ord, greatest(0, x0 / 256)::DOUBLE AS x, greatest(0, y0 / 64)::DOUBLE AS y, least(1, (x1 - x0) / 256)::DOUBLE AS w, least(1, (y1 - y0) / 64)::DOUBLE AS h FROM b")
def unit_boxes(spark, d):
    box = F.struct("x0", "y0", "x1", "y1")
    return _boxes(spark, d).select("ord", geom.unit_box(box, F.lit(256.0), F.lit(64.0)).alias("b")).select("ord", "b.*")


@query(f"WITH {_BOXES} SELECT ord // 4 AS image, ord % 4 // 2 AS line, ord % 4 AS word, 'w' || ord AS text, (50 + ord % 50)::DOUBLE AS confidence, x0, y0, x1, y1 FROM b")
def provider_words(spark, d):
    """Parts as a provider's answer of one paragraph with two lines of two words, as JSON, read back."""
    k = F.col("ord")
    at = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    kind = F.when(k % 2 == 1, "LINE_BREAK").otherwise("SPACE")
    letters = F.array(F.struct(F.lit("w").alias("text"), F.lit(None).cast("struct<detectedBreak:struct<type:string>>").alias("property")), F.struct(k.cast("string").alias("text"), F.struct(F.struct(kind.alias("type")).alias("detectedBreak")).alias("property")))
    word = F.struct(F.struct(F.array(at("x0", "y0"), at("x1", "y0"), at("x1", "y1"), at("x0", "y1")).alias("vertices")).alias("boundingBox"), ((50 + k % 50) / 100.0).alias("confidence"), letters.alias("symbols"))
    one = F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), word.alias("w")))), lambda x: x["w"])  # four words an image
    images = _boxes(spark, d).groupBy(F.floor(k / 4).alias("image")).agg(one.alias("words"))
    nested = F.struct(F.array(F.struct(F.struct(F.array(F.struct(F.array(F.struct(F.array(F.struct("words")).alias("paragraphs"))).alias("blocks"))).alias("pages")).alias("fullTextAnnotation"))).alias("responses"))
    return layout.words_of_vision(images.select("image", F.to_json(nested).alias("json")), "json", ["image"]).drop("block")


@query("""WITH p AS (SELECT p_partkey, CASE p_partkey % 2 WHEN 0 THEN 'MRP' ELSE 'PRODUCT_NAME' END AS key, CASE p_partkey % 2 WHEN 0 THEN 'Rs. ' || p_size || '.00' ELSE p_name END AS expected,
    CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN 'MRP ' || (p_size + p_partkey % 4 // 2) || '.00 incl' ELSE upper(p_name) || ' by ' || p_brand END AS got FROM part)
  SELECT p_partkey, key, CASE WHEN got IS NULL THEN false WHEN key = 'MRP' THEN contains(regexp_replace(got, '[^0-9]', '', 'g'), regexp_replace(expected, '[^0-9]', '', 'g'))
    OR contains(regexp_replace(expected, '[^0-9]', '', 'g'), regexp_replace(got, '[^0-9]', '', 'g')) ELSE contains(lower(got), expected) END AS ok FROM p""")
def field_agreement(spark, d):
    """Labels and predictions of parts: prices right or off by one, names in capitals with the brand after them."""
    k, size = F.col("p_partkey"), F.col("p_size")
    p = table(spark, d, "part").withColumn("key", F.when(k % 2 == 0, "MRP").otherwise("PRODUCT_NAME"))
    expected = F.when(k % 2 == 0, F.concat(F.lit("Rs. "), size.cast("string"), F.lit(".00"))).otherwise(F.col("p_name"))
    read = F.when(k % 2 == 0, F.concat(F.lit("MRP "), (size + F.floor(k % 4 / 2)).cast("string"), F.lit(".00 incl"))).otherwise(F.concat(F.upper("p_name"), F.lit(" by "), F.col("p_brand")))
    file = lambda folder: F.concat(F.lit(folder), k.cast("string"), F.lit(".jpg")).alias("file")
    labels = p.select("p_partkey", file(""), "key", expected.alias("expected"))
    predictions = p.where(k % 11 != 0).select(file("photographs/"), "key", read.alias("got"))
    return agreement.judged(labels, predictions).select("p_partkey", "key", "ok")


# --- stages over a label's declarations


def staged_labels(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Parts as labels of six lines, and what readers have found on them: prices whose sign was read as a 7, dates swapped, as a
    range, or behind the marks of a legend, a batch number in a second column, and no country."""
    k = F.col("p_partkey")
    n = lambda x: x.cast("string")
    price = F.concat(n((k % 50 + 10) * 5), F.lit(".00"))
    place = F.when(k % 5 == 0, "Jalan Besar 7, Surabaya 60293, Indonesia").otherwise("Mill Road, Pune 411 045")
    texts = F.array(
        F.concat(F.lit("Made by Alpha Mills Ltd., "), place), F.lit("Rs 0.50 per g"), F.when(k % 4 >= 2, "*MFD. #EXP.").otherwise("Crisp and light"),
        F.when(k % 4 >= 2, F.concat(F.lit("*03/2024 #0"), n(k % 9 + 1), F.lit("/2025"))).otherwise("Keep dry"), F.lit("Batch No.:"), F.concat(F.lit("AB"), n(k % 90000 + 10000)),
    )
    lines = table(spark, d, "part").select("p_partkey", F.posexplode(texts).alias("ord", "text"))
    row, right = F.least("ord", F.lit(4)) * 34.0 + 40, F.when(F.col("ord") == 5, 220.0).otherwise(0.0)
    lines = lines.select("p_partkey", "ord", "text", F.lit(0.9).alias("confidence"), (right + 20).alias("x0"), row.alias("y0"), (right + 200).alias("x1"), (row + 26).alias("y1"))
    hit = lambda key, value, ord_: F.struct(F.lit(key).alias("key"), value.alias("value"), F.lit(ord_).alias("ord"), F.lit(0.9).alias("confidence"))
    found = F.array(
        hit(declarations.MAKER, F.lit("Alpha Mills Ltd."), 0), hit(declarations.ADDRESS, place, 0), hit(declarations.NET, F.concat(F.lit("Net "), n((k % 50 + 10) * 10), F.lit(" g")), 1),
        hit(readers.MRP, F.concat(F.when(k % 3 == 0, "MRP 7").otherwise("MRP ₹"), price), 1), hit(readers.PACKED, F.when(k % 4 == 0, "06/2026"), 2),
        hit(readers.BEST, F.when(k % 4 == 0, "05/2024").when(k % 4 == 1, "01/2024 - 06/2025"), 3),
    )
    fields = table(spark, d, "part").select("p_partkey", F.explode(found).alias("x")).select("p_partkey", "x.*").where("value is not null")
    return fields, lines


@query("""WITH p AS (SELECT p_partkey, p_partkey % 4 AS q, CASE WHEN p_partkey % 5 = 0 THEN 'Jalan Besar 7, Surabaya 60293, Indonesia' ELSE 'Mill Road, Pune 411 045' END AS place,
    (p_partkey % 50 + 10) * 5 AS rupees, p_partkey % 90000 + 10000 AS code FROM part)
  SELECT p_partkey, 'MANUFACTURER_NAME' AS key, 'Alpha Mills Ltd.' AS value, 0 AS ord, 90 AS confidence_pct FROM p
  UNION ALL SELECT p_partkey, 'MANUFACTURER_ADDRESS', place, 0, 90 FROM p
  UNION ALL SELECT p_partkey, 'COUNTRY_OF_ORIGIN', CASE WHEN place LIKE '%Indonesia' THEN 'Indonesia' ELSE 'India' END, 0, CASE WHEN place LIKE '%Indonesia' THEN 70 ELSE 65 END FROM p
  UNION ALL SELECT p_partkey, 'NET_QUANTITY', rupees * 2 || ' g', 1, 90 FROM p
  UNION ALL SELECT p_partkey, 'MRP', 'MRP ₹' || rupees || '.00', 1, 90 FROM p
  UNION ALL SELECT p_partkey, 'DATE_OF_PACKING', CASE q WHEN 0 THEN '05/2024' WHEN 1 THEN '01/2024' ELSE '03/2024' END, 3, CASE WHEN q < 2 THEN 90 ELSE 85 END FROM p
  UNION ALL SELECT p_partkey, 'BEST_BEFORE', CASE q WHEN 0 THEN '06/2026' WHEN 1 THEN '06/2025' ELSE '0' || p_partkey % 9 + 1 || '/2025' END, CASE q WHEN 0 THEN 2 ELSE 3 END, CASE WHEN q < 2 THEN 90 ELSE 85 END FROM p
  UNION ALL SELECT p_partkey, 'BATCH_NUMBER', 'AB' || code, 5, 85 FROM p""")
def label_stages(spark, d):
    fields, lines = staged_labels(spark, d)
    f = stages.staged(fields, lines, ["p_partkey"])
    return f.select("p_partkey", "key", "value", "ord", F.floor(F.col("confidence") * 100 + 0.5).cast("int").alias("confidence_pct"))


# --- joins in time, sketches, folds


def _skewed_events(spark: SparkSession, d: str) -> DataFrame:
    """Events of which one user has a third."""
    return table(spark, d, "events").select("event_id", F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("user_id")).cast("long").alias("user_id"), "ts", "event_type", "value")


_SKEWED = "e AS (SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END::BIGINT AS user_id, ts, event_type, value FROM events)"


@query(f"""WITH {_SKEWED} SELECT l.event_id, l.user_id, r.event_id AS last_event_id, r.value AS last_value FROM (SELECT * FROM e WHERE event_type = 'purchase') l
  LEFT JOIN LATERAL (SELECT event_id, value FROM e v WHERE v.event_type = 'view' AND v.user_id = l.user_id AND v.ts <= l.ts ORDER BY v.ts DESC, v.event_id DESC LIMIT 1) r ON true""")
def view_before_purchase(spark, d):
    e = _skewed_events(spark, d)
    views = e.where("event_type = 'view'").withColumn("viewed", F.col("event_id"))
    found = temporal.as_of(e.where("event_type = 'purchase'"), views, "user_id", "ts", "event_id", ["viewed", "value"])
    return found.select("event_id", "user_id", F.col("last_viewed").alias("last_event_id"), "last_value")


@query(f"""WITH {_SKEWED} SELECT l.event_id, count(*) AS clicks, min(r.ts) AS first_click FROM e l JOIN e r ON l.user_id = r.user_id AND r.ts BETWEEN l.ts - INTERVAL 2 HOUR AND l.ts
  WHERE l.event_type = 'error' AND r.event_type = 'click' GROUP BY 1""")
def clicks_before_error(spark, d):
    e = _skewed_events(spark, d).drop("value")
    pairs = temporal.within(e.where("event_type = 'error'"), e.where("event_type = 'click'"), "user_id", "ts", 7200)
    return pairs.groupBy(F.col("l_event_id").alias("event_id")).agg(F.count("*").alias("clicks"), F.min("r_ts").alias("first_click"))


@query("SELECT date_trunc('month', ts)::DATE AS month, count(DISTINCT user_id) AS users, true AS close FROM events GROUP BY 1")
def distinct_users(spark, d):
    """Sketches of each day, united by month, beside the exact counts."""
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    estimate = temporal.united(temporal.distinct_sketches(e, ["day"], "user_id").withColumn("month", F.trunc("day", "month")), ["month"])
    exact = e.groupBy(F.trunc("day", "month").alias("month")).agg(F.count_distinct("user_id").alias("users"))
    return exact.join(estimate, "month").select("month", "users", (F.abs(F.col("estimate") / F.col("users") - 1) <= 0.065).alias("close"))


@query("""SELECT o_orderkey, 'MRP ' || o_custkey || '.' || lpad((o_orderkey % 100)::VARCHAR, 2, '0') || ' desk@shop' || o_custkey || '.com, Ltd. 7th' AS line FROM orders""")
def glued_words(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    words = F.array(F.lit("MRP"), F.concat(c, F.lit(":")), F.lpad((k % 100).cast("string"), 2, "0"), F.lit("desk@"), F.concat(F.lit("shop"), c, F.lit(".")), F.lit("com"), F.lit(","), F.lit("Ltd."), F.lit("7th"))
    gaps = F.array(*[F.lit(x) for x in (20, 20, 5, 20, 5, 5, 8, 20, 12)])
    boxes = F.transform(words, lambda w, i: F.struct(w.alias("text"), F.lit(0.9).alias("confidence"), (i * 200 + F.element_at(gaps, i + 1)).cast("double").alias("x0"), F.lit(0.0).alias("y0"), (i * 200 + 200).cast("double").alias("x1"), F.lit(20.0).alias("y1")))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(F.transform(layout.glued(boxes), lambda w: w["text"]), " ").alias("line"))


_PRODUCT = "((({a}) * ({b})::HUGEINT) % 4294967296)::BIGINT"
_MIX = "xor({p}, {q})".format(p=_PRODUCT.format(a="xor({x}, {x} >> 16)", b=2246822507), q=_PRODUCT.format(a="xor({y}, {y} >> 13)", b=3266489909))


@query(f"""WITH t AS (SELECT p_partkey, list_transform(string_split(p_name, ''), lambda c: ord(c)::BIGINT) AS u FROM part),
  s AS (SELECT p_partkey, list_reduce(u, lambda h, c: {_PRODUCT.format(a="xor(h, c)", b=2654435761)}, xor(3735928559::BIGINT, len(u)::BIGINT)) AS a,
    list_reduce(u, lambda h, c: {_PRODUCT.format(a="xor(h, c)", b=1597334677)}, xor(1103547991::BIGINT, len(u)::BIGINT)) AS b FROM t),
  m AS (SELECT p_partkey, {_MIX.format(x="a", y="b")} AS a, b FROM s)
  SELECT p_partkey, repeat(printf('%08x', {_MIX.format(x="b", y="a")}) || printf('%08x', a), 4) AS checksum FROM m""")
def checksums(spark, d):
    return table(spark, d, "part").select("p_partkey", text.checksum64(F.col("p_name")).alias("checksum"))


@query("""WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events)
  SELECT user_id AS owner, count(*) AS events, count_if(before IS NULL OR ts - before > INTERVAL 1 DAY)::BIGINT AS bursts FROM e GROUP BY 1""")
def user_bursts(spark, d):
    tables.register(spark)
    rows = table(spark, d, "events").select(F.col("user_id").alias("owner"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.lit(86_400_000_000).alias("apart"))
    return spark.sql("SELECT * FROM bursts(TABLE({rows}) PARTITION BY owner ORDER BY at)", rows=rows)


# --- figures kept by changes


@query("""SELECT event_type, count(*) AS n, sum(coalesce(floor(value * 100 + 0.5)::BIGINT, 0))::BIGINT AS cents
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC NULLS LAST) AS k FROM events) WHERE k = 1 GROUP BY 1""")
def figures_by_changes(spark, d):
    """Users by their latest event, kept over five spans of time by what each changes; the SQL recomputes them."""
    image = F.struct("event_type", F.floor(F.col("value") * 100 + 0.5).cast("long").alias("cents"))
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    at = F.unix_micros("ts")
    start, end = events.agg(F.min(at), F.max(at)).first()
    step = F.coalesce(F.floor((at - F.lit(start)) * 5 / (F.lit(end) - F.lit(start) + 1)), F.lit(0))
    changes = figures.images(events, "user_id", ["ts", "event_id"], image)
    changes = written(changes.select("before", "after", step.cast("int").alias("step")), "changes")
    kept = changes.limit(0).select("after.event_type", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("cents"))
    for k in range(5):
        kept = written(figures.apply(kept, changes.where(F.col("step") == k), ["event_type"]), "figures")
    return kept
