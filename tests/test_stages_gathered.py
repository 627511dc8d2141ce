"""Stages over one gathered row a label: what the driver plans for them, and ties on one line."""

import re

from labelforge.operators import declarations as d
from labelforge.operators import readers as r
from labelforge.operators import stages
from labelforge.plans.queries import QUERIES
from tests.test_stages import FIELDS, LINES

#: Characters of a string that the driver's heap (750 MB, regions of 1 MB) doesn't hold in a region of its own.
HUGE = 512 * 1024


def test_driver_plans_two_queries(spark):
    """One that writes the state and one that reads it, with one shuffle (before: ten, one of them with a plan of 1 MB)."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(60_000)
    before = store.executionsCount()
    assert len(QUERIES["label_stages"](spark, "/root/testdata/sf0.001").collect()) == 1600
    bus.waitUntilEmpty(60_000)
    new = store.executionsList(before, 100)
    plans = [new.apply(i).physicalPlanDescription() for i in range(new.size())]
    assert len(plans) == 2 and max(map(len, plans)) < HUGE
    final = "".join(p.split("== Initial Plan ==")[0] for p in plans)  # trees of operators, without their arguments
    assert len(re.findall(r"[+:*] +Exchange|- Exchange", final)) == 1 and "Join" not in final and "Window" not in final


def rows(spark, lines, fields=()):
    at = lambda i, n, t: (i, n, t, 0.9, 0.0, n * 30.0, 100.0, n * 30.0 + 20)
    out = stages.staged(spark.createDataFrame(list(fields), FIELDS), spark.createDataFrame([at(*x) for x in lines], LINES)).collect()
    return {(x.image_id, x.key): x.value for x in out}


def test_first_of_two_values_after_a_mark(spark):
    got = rows(spark, [(0, 0, "*MFD. #EXP."), (0, 1, "*03/2024 *04/2024 #05/2025")])
    assert got == {(0, r.PACKED): "03/2024", (0, r.BEST): "05/2025"}


def test_lines_in_any_order_and_images_without_an_id_or_lines(spark):
    lines = [(0, 1, "@ AB12"), (None, 1, "@ ZZ99"), (0, 0, "@Batch"), (None, 0, "@Batch")]
    got = rows(spark, lines, [(None, d.NET, "200 g", 0, 0.9), (7, d.NET, "300 g", 0, 0.9), (0, d.NET, "Net 400 g", 5, 0.9)])
    assert got == {(0, d.BATCH): "AB12", (0, d.NET): "400 g"}
