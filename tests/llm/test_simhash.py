"""The radius of the fingerprints against true near copies, and the search's long and cut lists against brute force."""

import random
from collections import Counter
from itertools import combinations

import pytest

from labelforge.llm import simhash

RARE, COMMON = [f"term{i}" for i in range(20_000)], [f"c{i}" for i in range(60)]


def text_of(rng, n):
    return [rng.choice(COMMON) if rng.random() < 0.4 else rng.choice(RARE) for _ in range(n)]


def similarity(a, b):
    x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def near_copies(rng):
    """Pairs at 0.8 or more: words exchanged, a passage cut out, put in or replaced."""
    while True:
        a = text_of(rng, rng.randint(60, 600))
        b, kind, at = list(a), rng.randrange(4), rng.randrange(len(a))
        if kind == 0:
            for _ in range(rng.randint(1, max(1, len(a) // 40))):
                b[rng.randrange(len(b))] = rng.choice(RARE)
        else:
            k = rng.randint(1, len(a) // 8)
            b[at : at + (k if kind in (1, 3) else 0)] = text_of(rng, k) if kind in (2, 3) else []
        if a != b and similarity(a, b) >= 0.8:
            yield " ".join(a), " ".join(b)


def bits(a, b):
    return (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()


def test_near_copies_lie_within_the_radius():
    rng = random.Random(1)
    pairs = near_copies(rng)
    found = [bits(*map(simhash.fingerprint, next(pairs))) <= simhash.RADIUS for _ in range(600)]
    assert sum(found) / len(found) >= 0.9
    prints = [simhash.fingerprint(" ".join(text_of(rng, 300))) for _ in range(200)]
    assert all(bits(a, b) > 2 * simhash.RADIUS for a, b in combinations(prints, 2))


def test_near_copies_of_the_given_table_lie_within_the_radius(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text is not null").select("text").distinct().collect()]
    words = [t.lower().split() for t in texts]
    sets = [{hash(tuple(w[i : i + 5])) for i in range(len(w) - 4)} for w in words]
    holders = {}
    for k, s in enumerate(sets):
        for x in s:
            if x % 4 == 0:
                holders.setdefault(x, []).append(k)
    pairs = {p for h in holders.values() if 1 < len(h) <= 100 for p in combinations(h, 2)}
    pairs = [(a, b) for a, b in pairs if words[a] != words[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    found = [bits(simhash.fingerprint(texts[a]), simhash.fingerprint(texts[b])) <= simhash.RADIUS for a, b in pairs]
    assert len(found) > 20 and sum(found) / len(found) >= 0.9


@pytest.mark.parametrize("tile, short", [(1 << 16, 2048), (1 << 16, 4), (16, 2048), (16, 4)])
def test_counts_and_pairs_in_long_and_cut_lists(spark, monkeypatch, tile, short):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng, prints = random.Random(2), set()
    for _ in range(6):
        p = rng.getrandbits(128)
        for _ in range(40):
            q = p
            for _ in range(rng.randint(0, 9)):
                q ^= 1 << rng.randrange(128)
            prints.add(q)
    blocks = simhash.Blocks(simhash.RADIUS)
    want = [(a, b) for a, b in combinations(sorted(prints), 2) if (a ^ b).bit_count() <= simhash.RADIUS]
    counts = Counter(f"{x:032x}" for pair in want for x in pair)
    df = spark.createDataFrame([(f"{p:032x}",) for p in [*prints, *list(prints)[:7]]] + [(None,)], "fingerprint string")
    got = simhash.close_pairs(df).collect()
    assert sorted((int(r.a, 16), int(r.b, 16)) for r in got) == want
    assert {r.fingerprint: r.n_close for r in simhash.close_counts(df).collect()} == counts
    # Python's workers have their own SHORT: the search itself, without Spark.
    monkeypatch.setattr(simhash, "SHORT", short)
    import numpy as np

    rows = np.array([[p >> 64, p & (2**64 - 1)] for p in sorted(prints)], np.uint64)
    found = [(i, j) for k in range(blocks.count - 1) for v in np.unique(blocks.values(rows, k)) for at in [np.flatnonzero(blocks.values(rows, k) == v)] for i, j, _ in blocks.search(rows[at], rows[at], True, k) for i, j in zip(at[i], at[j])]
    number = {p: i for i, p in enumerate(sorted(prints))}
    assert sorted(tuple(sorted(map(int, x))) for x in found) == sorted((number[a], number[b]) for a, b in want)
