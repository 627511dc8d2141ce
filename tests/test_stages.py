"""Stages over declarations, worked by hand."""

import pytest

from labelforge.operators import declarations as d
from labelforge.operators import readers as r
from labelforge.operators import stages

LINES = "image_id long, ord int, text string, confidence double, x0 double, y0 double, x1 double, y1 double"
FIELDS = "image_id long, key string, value string, ord int, confidence double"

#: What readers found of a label (value and line), its lines (text, or text, x0 and row), and what the stages make of it.
CASES = {
    "country of the address": ({d.MAKER: ("Blue Hill Works", 0), d.ADDRESS: ("Surabaya 60293, Indonesia.", 1)}, ["Blue Hill Works", "Surabaya 60293, Indonesia."], {r.COUNTRY: ("Indonesia", 0.7)}),
    "the last country counts": ({d.ADDRESS: ("India Street 7, Seoul 12345, South Korea", 0)}, ["India Street 7, Seoul 12345, South Korea"], {r.COUNTRY: ("Korea", 0.7)}),
    "short names in capitals": ({d.ADDRESS: ("Long Street 12345, Dubai, UAE", 0)}, ["Long Street 12345, Dubai, UAE"], {r.COUNTRY: ("UAE", 0.7)}),
    "postal code": ({d.ADDRESS: ("Plot 4, Hill Road, 411 045", 0)}, ["Plot 4, Hill Road, 411 045"], {r.COUNTRY: ("India", 0.65)}),
    "a stated country stays": ({d.ADDRESS: ("Plot 4, Pune 411 045", 0), r.COUNTRY: ("Nepal", 1)}, ["Plot 4, Pune 411 045", "Nepal"], {r.COUNTRY: ("Nepal", 0.9)}),
    "no address, no country": ({d.MAKER: ("Alpha Mills of Pune", 0)}, ["Alpha Mills of Pune"], {r.COUNTRY: None}),
    "torn maker": ({d.MAKER: ("xq rt zzk 9", 0)}, ["x"], {d.MAKER: None}),
    "a maker that points elsewhere": ({d.MAKER: ("For name, address scan the code", 0)}, ["x"], {d.MAKER: None}),
    "an address that names no place": ({d.ADDRESS: ("Some words that name nothing", 0)}, ["x"], {d.ADDRESS: None}),
    "open bracket in a name": ({d.NAME: ("Herbal Soap (with", 0)}, ["x"], {d.NAME: None}),
    "licence with blanks": ({r.LICENCE: ("1001 8043 0029 15", 0)}, ["x"], {r.LICENCE: ("10018043002915", 0.9)}),
    "range in one date": ({r.BEST: ("01/2024 - 06/2025", 0)}, ["x"], {r.PACKED: ("01/2024", 0.9), r.BEST: ("06/2025", 0.9)}),
    "swapped dates": ({r.PACKED: ("06/2026", 0), r.BEST: ("05/2024", 1)}, ["x", "y"], {r.PACKED: ("05/2024", 0.9), r.BEST: ("06/2026", 0.9)}),
    "equal dates": ({r.PACKED: ("06/2026", 0), r.BEST: ("06-2026", 1)}, ["x", "y"], {r.PACKED: ("06/2026", 0.9), r.BEST: None}),
    "no year of a pack": ({r.PACKED: ("06/2050", 0), r.BEST: ("18 months", 1)}, ["x", "y"], {r.PACKED: None, r.BEST: ("18 months", 0.9)}),
    "a lost price": ({r.MRP: ("MRP ₹9", 0)}, ["x"], {r.MRP: None}),
    "a sign read as 7": ({r.MRP: ("MRP 7220.00", 0), d.NET: ("200 g", 1)}, ["a", "b", "Rs. 1.10 per g"], {r.MRP: ("MRP ₹220.00", 0.9)}),
    "a price that begins with 7": ({r.MRP: ("MRP 7220.00", 0), d.NET: ("6.5 kg", 1)}, ["a", "b", "Rs. 1.11 / g"], {r.MRP: ("MRP 7220.00", 0.9)}),
    "no unit price": ({r.MRP: ("MRP 7220.00", 0), d.NET: ("200 g", 1)}, ["a", "b"], {r.MRP: ("MRP 7220.00", 0.9)}),
    "quantity within words": ({d.NET: ("Net 200 g when packed", 0)}, ["x"], {d.NET: ("200 g", 0.9)}),
    "a pack with its total": ({d.NET: ("2 N x 150 g (300 g)", 0)}, ["x"], {d.NET: ("2 N x 150 g (300 g)", 0.9)}),
    "grams of a nutrient": ({d.NET: ("3 g", 0)}, ["Fat 3 g"], {d.NET: None}),
    "a small pack says so": ({d.NET: ("3 g", 0)}, ["Net wt. 3 g"], {d.NET: ("3 g", 0.9)}),
    "care goes on to its number": ({d.CARE: ("Customer care:", 0)}, ["Customer care:", "write to the desk", "1800-22-3344-55"], {d.CARE: ("Customer care:, write to the desk, 1800-22-3344-55", 0.9)}),
    "care without any contact": ({d.CARE: ("Customer care:", 0)}, ["Customer care:", "a", "b", "c", "1800-22-3344-55"], {d.CARE: None}),
    "legend": ({}, ["*MFD. #EXP. @Batch", "*03/2024 #09/2025", "@ AB12"], {r.PACKED: ("03/2024", 0.85), r.BEST: ("09/2025", 0.85), d.BATCH: ("AB12", 0.85)}),
    "legend of a price": ({}, ["*MRP", "* Rs 55.00"], {r.MRP: ("MRP ₹55.00", 0.85)}),
    "twin columns": (
        {}, [("MRP:", 0, 0), ("₹ 60.00", 200, 0), ("Mfg. Date:", 0, 1), ("12/2024", 200, 1), ("Use by:", 0, 2), ("11/2027", 200, 2), ("Lot No.:", 0, 3), ("B1224", 200, 3)],
        {r.MRP: ("MRP ₹ 60.00", 0.85), r.PACKED: ("12/2024", 0.85), r.BEST: ("11/2027", 0.85), d.BATCH: ("B1224", 0.85)},
    ),
    "one value, two captions": ({}, [("Mfg. Date:", 0, 0), ("Use by:", 110, 0), ("12/2024", 300, 0)], {r.PACKED: None, r.BEST: ("12/2024", 0.85)}),
    "header row": (
        {}, [("LOT NO.", 0, 0), ("USE BY", 150, 0), ("MFG. DATE", 300, 0), ("ZX 4411", 0, 1), ("11/2026", 150, 1), ("12/2024", 300, 1)],
        {d.BATCH: ("ZX 4411", 0.75), r.PACKED: ("12/2024", 0.75), r.BEST: ("11/2026", 0.75)},
    ),
    "null and empty lines": ({}, [None, ""], {}),
}


@pytest.fixture(scope="module")
def got(spark):
    lines, fields = [], []
    for i, (found, own, _) in enumerate(CASES.values()):
        for n, x in enumerate(own):
            text, x0, row = x if isinstance(x, tuple) else (x, 0, n)
            lines.append((i, n, text, 0.9, float(x0), row * 30.0, x0 + 100.0, row * 30.0 + 20))
        fields += [(i, key, value, ord_, 0.9) for key, (value, ord_) in found.items()]
    out = stages.staged(spark.createDataFrame(fields, FIELDS), spark.createDataFrame(lines, LINES)).collect()
    assert len({(x.image_id, x.key) for x in out}) == len(out)
    return {(x.image_id, x.key): (x.value, round(x.confidence, 3)) for x in out}


@pytest.mark.parametrize("name", list(CASES))
def test_case(got, name):
    i = list(CASES).index(name)
    want = CASES[name][2]
    assert {k: got.get((i, k)) for k in want} == want


def test_empty_tables(spark):
    assert stages.staged(spark.createDataFrame([], FIELDS), spark.createDataFrame([], LINES)).count() == 0
