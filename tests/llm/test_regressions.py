"""Faults that were found and mended."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from labelforge.llm import common, jaccard_join, language, pieces, pii, warc


def test_every_case_twin_of_a_digit_word_is_read():
    twins = {c: [x for x in map(chr, range(0x20000)) if not 0xD800 <= ord(x) < 0xE000 and re.fullmatch(re.escape(c), x, re.IGNORECASE)] for w in pii.DIGIT_WORDS for c in w}
    for word in pii.DIGIT_WORDS:
        for i, c in enumerate(word):
            for twin in twins[c]:
                pii.disguised_spans(f"call {word[:i]}{twin}{word[i + 1 :]} four one two", [])
    text = "card ſix 011 1111 1111 1117 x"
    assert [text[a:b] for a, _, b in pii.disguised_spans(text, pii.plain_spans(text))] == ["ſix 011 1111 1111 1117"]


@pytest.mark.parametrize("four", ["𝟒", "④", "⁴", "４", "٤", "४"])
def test_styled_digits(four):
    text = f"so {four}111 1111 1111 1111 here"
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in pii.disguised_spans(text, pii.plain_spans(text))] == [("card", f"{four}111 1111 1111 1111")]


def test_archives_are_read_by_several_tasks(spark):
    pages = spark.range(600).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 40).alias("html")).repartition(6)
    manifest = warc.archive_pages(pages)
    assert manifest.count() == 6
    tasks = warc.read_archives(manifest).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(tasks) > 2 and sum(r["count"] for r in tasks) == 600


def test_numerals_are_no_letters(spark):
    rows = [(1, "plain words of this language here", "en"), (2, "½ ² ① Ⅳ", None), (None, "zzz qqq zzz qqq", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify_documents(docs).collect()}
    assert got[2] == ("und", 0.0) and {x[0] for x in got.values()} == {"en", "und"}


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        conf = {}
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        common.shared_dir(Session())


def test_toxicity_score_is_that_of_the_most_toxic_window():
    """The model against a plain version, windows of several words included; misspellings share n-grams with their words."""
    import random
    import zlib

    import numpy as np

    from labelforge.llm import toxicity

    rng = random.Random(4)
    plain = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    bad = ["zwertlich", "quxxorous", "vyrrulent"]
    texts, marks = [], []
    for i in range(400):
        words = rng.choices(plain, k=40)
        if i % 4 == 0:
            words[rng.randrange(40)] = rng.choice(bad)
        texts.append(" ".join(words))
        marks.append(int(i % 4 == 0))
    for window in (1, 2):
        model = toxicity.fit(texts, marks, toxicity.Training(window=window))
        top = model.scorer()

        def value(word):
            b = f"<{word}>".encode()
            rows = [b, *(b[i : i + k] for k in (3, 4, 5) for i in range(len(b) - k + 1))]
            return sum(float(model.table[zlib.crc32(r) % toxicity.BUCKETS]) for r in rows) / len(rows)

        for text in [*texts[:6], "one", "One two", ""]:
            words = re.findall(r"[^\W_]+", text.lower())
            w = min(window, len(words))
            want = max((sum(map(value, words[i : i + w])) / w for i in range(len(words) - w + 1)), default=None) if words else None
            assert top(text) == pytest.approx(toxicity.NOTHING if want is None else model.bias + want, abs=1e-4)
        caught = [float(model.score(np.array([top(t)]))[0]) >= 0.7 for t in texts]
        assert np.mean(np.array(caught) == np.array(marks, bool)) > 0.97
        if window == 1:
            doubled = [" ".join([*plain[:20], w + w[-1], *plain[20:40]]) for w in bad]
            assert all(float(model.score(np.array([top(t)]))[0]) >= 0.7 for t in doubled)
            assert float(model.score(np.array([top(" ".join(plain[:40]))]))[0]) < 0.7


def test_words_of_a_shingle_set_are_hashed_in_one_call(monkeypatch):
    """A call for each rare word took most of the first pass over the texts."""
    made, keep = [], common.hashlib.blake2b
    monkeypatch.setattr(common.hashlib, "blake2b", lambda *a, **k: made.append(a) or keep(*a, **k))
    rng = random.Random(9)
    for words in (5, 6, 300):
        text = " ".join(rng.choice(["Never\x00met", "never\x00", "never", "É", "é", "\x85", "　", f"rare{rng.random()}"]) for _ in range(words))
        own = text.encode().lower().split()
        found = jaccard_join.shingle_set(text)
        assert len(found) == len({tuple(own[i : i + 5]) for i in range(words - 4)}) and (found[1:] > found[:-1]).all()
        assert (jaccard_join.shingle_set(f" {text}\n") == found).all()
    assert not made


def test_line_ends_need_no_byte_strings():
    """A newline, a tab or a NUL is a piece of its own byte; only characters of several bytes are put together from bytes."""
    model = pieces.load(pieces.MODEL, 1.0)
    lattices = pieces.Lattices(model)
    texts = ["a\nb\n\n\tc\x00", "\n", "x\x00\x0a0A \x01", "snow ☃\n\U0001f9ff\n▁"]
    ids = pieces.encode_batch(texts, [1, 2, 3, 4], lattices, 42)
    assert [pieces.decode(x.tolist(), model) for x in ids] == texts
    assert "\0" not in "".join(model.text[i] for i in ids[1]) and model.byte[10] in ids[0].tolist()
    first, last, _, piece, *_ = model.edges([" a", "\n", "\x00"])
    assert (piece >= 0).all()
