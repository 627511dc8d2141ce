"""Collocations against counts of every phrase."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from labelforge.llm import phrases
from tests.llm.data import DOCS, awkward, empty


def brute(items, least, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) from Counters."""
    f, n = Counter(), Counter()
    for lang, text in items:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    own = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    gone = {(lang, w[i : i + m]) for (lang, w), a in own.items() for m in range(2, len(w)) for i in range(len(w) - m + 1) if 100 * a >= 80 * f[lang, w[i : i + m]]}
    out = {}
    for (lang, w), a in own.items():
        if (lang, w) not in gone:
            cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)}


def rows(df):
    return {tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


def invented(seed, number):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["Zum", "zum", "é", "'", "…", "aa", "a"]
    fixed = ["new york city hall", "w1 w2 w3", "a a a a a", "vis à vis"]
    out = []
    for i in range(number):
        text = "".join(rng.choice([*words, *fixed]) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\r\n", "\x0b", "\x85", "\x1f"]) for _ in range(rng.randint(0, 60)))
        out.append((i, text, rng.choice(["en", "en", "de", None, "und"]), "s", 0, None, None, None, None))
    return [*out, (None, None, "en", None, None, None, None, None, None), (1, "", None, None, None, None, None, None, None)]


@pytest.mark.parametrize(("least", "block"), [(3, 500), (30, 1 << 20)])
def test_counts_of_every_phrase(spark, least, block):
    items = invented(3, 400)
    got = phrases.collocations(spark.createDataFrame(items, DOCS).repartition(5), least, top=40, block_bytes=block)
    assert rows(got) == brute([(r[2], r[1]) for r in items], least, 40)


def test_awkward_rows_and_empty_tables(spark):
    docs = awkward(spark)
    assert rows(phrases.collocations(docs, 2)) == brute([(r.lang, r.text) for r in docs.collect()], 2)
    assert phrases.collocations(empty(spark)).count() == 0


def test_a_language_with_most_rows_and_one_piece_longer_than_a_block(spark):
    items = [(i, f"so it goes on and on {i % 5}. So it goes", "en") for i in range(300)] + [(900, "la la land " * 3000, "fr")]
    docs = spark.createDataFrame(items, "doc_id long, text string, lang string")
    assert rows(phrases.collocations(docs, 30, block_bytes=1000)) == brute([(r[2], r[1]) for r in items], 30)


def test_blocks_are_cut_between_pieces():
    data = phrases.tokens("One two. three four; five\nsix seven eight!" * 50)
    parts = list(phrases.cut(data, 64))
    assert len(parts) > 20 and all(p.startswith(b" ") and p.endswith(b" . ") for p in parts)
    assert [t for p in parts for t in p.split() if t != b"."] == [t for t in data.split() if t != b"."]
    assert list(phrases.cut(phrases.tokens(""), 64))


def test_cells_bound_counts_from_above():
    """Few cells: many phrases share one; no frequent phrase is lost."""
    data = phrases.tokens(" ".join(f"a{i % 7} b{i % 11}" for i in range(400)))
    own, hashes, whole = phrases.phrase_hashes(data, "en")
    true = Counter(b" ".join(own[i : i + k + 1]) for k, ok in enumerate(whole) for i in np.flatnonzero(ok))
    cell, count = np.unique(np.concatenate([h[ok] >> np.uint64(64 - 8) for h, ok in zip(hashes, whole)]), return_counts=True)
    found = phrases.candidates(own, hashes, whole, cell[count >= 30], 8)
    assert {p for p, a in true.items() if a >= 30} <= found


def test_a_word_is_looked_up_once_however_often_it_occurs(monkeypatch):
    asked = []

    class Table:
        def __getitem__(self, word):
            asked.append(word)
            return phrases.hash64(word)

    monkeypatch.setattr(phrases, "_words", Table())
    own, _, _ = phrases.phrase_hashes(phrases.tokens("so it goes. " * 500), "en")
    assert own[:4] == [b"so", b"it", b"goes", b"."] and len(own) == 2001
    assert sorted(asked) == [b".", b"goes", b"it", b"so"]


def test_matches_of_hundreds_of_words_that_share_letters():
    """Ranks above 256 take other first letters; overlaps count, and what lies between candidates stops a match."""
    rng = random.Random(5)
    data = phrases.tokens("".join(f"w{rng.choice((i, i, i + 1, 7))}{rng.choice('   .')}" + "a a a a " * (i % 3) for i in range(700) for _ in range(4)))
    words, numbers = phrases.numbered(data)
    hashes, whole = phrases.hashes_at(words, numbers, "en")
    true = Counter(tuple(numbers[i : i + k].tolist()) for k, ok in enumerate(whole, 1) for i in np.flatnonzero(ok))
    cell, count = np.unique(np.concatenate([h[ok] >> np.uint64(64 - 40) for h, ok in zip(hashes, whole)]), return_counts=True)
    where = phrases.places(hashes, whole, cell[count >= 2], 40)
    one = phrases.distinct(where, numbers)
    found = {tuple(numbers[i : i + k].tolist()): n for k, (at, own) in enumerate(zip(one[1:], phrases.matches(numbers, where, one)), 2) for i, n in zip(at.tolist(), own.tolist())}
    assert len({x for p in found for x in p}) > 300
    assert found == {p: a for p, a in true.items() if a >= 2 and len(p) > 1}
