"""More languages than one block holds."""

from __future__ import annotations

import numpy as np

from labelforge.llm import language


def test_many_languages(spark):
    pick = np.random.default_rng(5)
    vocabulary = {f"t{k:03}": ["".join(pick.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(12)] for k in range(150)}
    text = lambda lang: " ".join(pick.choice(vocabulary[lang], 40))
    rows = [(i * 1000 + k, text(lang), lang) for i, lang in enumerate(vocabulary) for k in range(4)]
    mixed = [(-1, text("t003") + " " + text("t148"), None), (-2, None, None), (-3, "12 34", None)]
    docs = spark.createDataFrame([*rows, *mixed], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify_documents(docs).collect()}
    assert len(got) == len(rows) + 3
    assert sum(got[d].lang_pred == lang for d, _, lang in rows) >= 0.98 * len(rows)
    assert {x.split(":")[0] for x in got[-1].languages.split(",")} == {"t003", "t148"}
    assert got[-2].lang_pred == got[-3].lang_pred == "und"


def test_blocks_give_what_one_table_gives(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    where = language.fit(docs)
    (names, table), = language.blocks(where)
    texts = [r.text for r in docs.limit(60).collect()] + ["", None]
    pi = language.proportions(texts, table)
    want = [{names[k]: row[k] for k in np.flatnonzero(row)} for row in pi]
    assert [dict(x) for x in language.mixtures(texts, [(names, table)])] == want
    singly = [dict(x) for x in language.mixtures(texts, [([x], table[:, [k]]) for k, x in enumerate(names)])]
    assert all(s.keys() == w.keys() and all(abs(s[k] - w[k]) < 1e-6 for k in s) for s, w in zip(singly, want, strict=True))


def test_words_are_runs_of_letters():
    import re

    numerals = "".join(c for c in map(chr, range(0x80, 0x20000)) if c.isalnum() and not c.isalpha())
    plain = re.compile(rf"[^\W\d_{re.escape(numerals)}]+")
    for text in ("Ab½cd ²x ⅣV _a_ 12three ⑦", "Ünï\u0301x İstanbul 漢字三 ٣د 𝟙a", "", "½", "plain words"):
        assert language.words_of(text) == plain.findall(text.lower())
