"""Numbers and word checks of every document, against plain versions."""

import math
import re
from decimal import ROUND_FLOOR, Decimal

from labelforge.plans.queries import QUERIES

SHORT = re.compile(r"^(?:ltd|pvt|llp|inc|co|mfg|mfd|mktd|regd|no|st|rd|dist|distt|po|hp|mh|tn|ka|up|wb|ap|ts|gj|rj|mp|dl|hr|pb|uk|jk|blr|hyd|ph|tel|fssai)\.?,?\Z", re.I | re.A)
TEXTS = [
    None, "", "no digits", "4111111111111111 card", "1,234.565 x", "12.345678901234567", "90071992547409.93", "92233720368547757.99", "92233720368547759", "9" * 60, "Привет мир", "漢字",
    "Acme Foods Pvt. Ltd., Pune", "bcd fgh jkl", "the quick brown", "12 34", "Tel. No. 123", "good w@rd", "ab cd ef the", "\x0bgood\tword\n", "tel\u0085 x",
]


def cents(text):
    m = re.search(r"[0-9][0-9,]*(?:\.[0-9]+)?", text or "")
    number = m[0].replace(",", "") if m else "0"
    if float(number) < 2**53 / 100:
        return math.floor(float(number) * 100 + 0.5)
    value = (Decimal(number) * 100 + Decimal("0.5")).to_integral_value(ROUND_FLOOR)
    return int(value) if Decimal(number) <= 92233720368547758 else None


def wordlike(text):
    tokens = [t for t in re.split(r"[ \t\n\x0b\f\r\xa0﻿]+", text or "") if re.search("[A-Za-z]", t)]
    good = [t for t in tokens if SHORT.match(t) or (re.search("[aeiouy]", t, re.I | re.A) and len(re.findall("[A-Za-z]", t)) >= 3 and not re.search(r"[^A-Za-z0-9&()'.,\-/%+]", t))]
    return bool(tokens) and len(good) >= math.ceil(len(tokens) * 0.6)


def test_every_document_has_a_row(spark, tmp_path):
    real = [(r.doc_id + 1000, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = [*enumerate(TEXTS), *real]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in QUERIES["extract_numbers_all"](spark, str(tmp_path)).collect()} == {(k, cents(t)) for k, t in rows}
    assert {tuple(r) for r in QUERIES["looks_like_words_all"](spark, str(tmp_path)).collect()} == {(k, wordlike(t)) for k, t in rows}
