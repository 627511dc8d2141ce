"""b-bit MinHash: components against brute force, estimates against true similarities, groups of near copies."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from labelforge.llm import jaccard_join, minhash
from labelforge.llm.jaccard_join import Forests, fine_bits, fine_links, fine_points, linked
from tests.llm.data import awkward, empty
from tests.llm.test_contracts import WORD, near_copies, rows


def brute(items, percent=85):
    sets = []
    for d, text in items:
        w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append((d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    at = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            at[x].append(i)
    shared = Counter((a, b) for own in at.values() for k, a in enumerate(own) for b in own[k + 1 :])
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for (a, b), o in shared.items():
        if 100 * o >= percent * (len(sets[a][1]) + len(sets[b][1]) - o):
            up[root(a)] = root(b)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[root(i)] = min(least.get(root(i), d), d)
    return Counter((d, len(s), least[root(i)], d == least[root(i)]) for i, (d, s) in enumerate(sets))


def test_components_around_the_threshold(spark):
    items = near_copies()
    docs = spark.createDataFrame(items, "doc_id long, text string")
    for tile in (minhash.TILE, 3):
        assert rows(minhash.near_duplicates(docs, tile=tile), "doc_id", "n_shingles", "component_id", "kept") == brute(items)


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = rows(minhash.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept")
    want = brute([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None])
    assert {k: v for k, v in got.items() if k[0] is not None} == want
    assert got[(None, 56, 7, False)] == 1 and got[(None, 0, None, True)] == 1
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_a_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    """500 texts of which many pairs lie on either side of the threshold."""
    rng, written, keep = random.Random(5), [], jaccard_join.materialise
    words, items = [f"w{i}" for i in range(160)], []
    for i in range(500):
        own = list(words)
        for _ in range(rng.randint(1, 4)):
            own[rng.randrange(160)] = f"e{rng.randrange(10**6)}"
        items.append((i, " ".join(own)))

    def watched(df, name):
        out = keep(df, name)
        if name in ("forests", "found"):
            written.append((name, out.where("a is not null").count()))
        return out

    monkeypatch.setattr(jaccard_join, "materialise", watched)
    assert rows(minhash.near_duplicates(spark.createDataFrame(items, "doc_id long, text string")), "doc_id", "n_shingles", "component_id", "kept") == brute(items)
    assert written[0][0] == "found" and all(n <= 8 * 500 for name, n in written if name == "forests"), written


def test_estimates_are_corrected_for_chance():
    rng = np.random.default_rng(2)
    for share in (0.0, 0.5, 0.85, 1.0):
        errors = []
        for _ in range(60):
            n = 400
            both = round(2 * n * share / (1 + share))
            pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            x, y = pool[:n], np.concatenate([pool[:both], pool[n : 2 * n - both]])
            a, b = (np.frombuffer(minhash.pack_bits(minhash.minima(s)), np.uint64)[None] for s in (x, y))
            errors.append(minhash.estimates(a, b)[0, 0] - both / (2 * n - both))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_bands_and_cut_at_the_threshold():
    """The chance that a pair just at 0.85 shares no band is negligible, and the cut is far below what estimates scatter."""
    assert (1 - 0.85**minhash.ROWS) ** minhash.BANDS < 1e-10
    assert 0.6 < minhash.cut(85) < 0.75


def test_places_of_many_partners_agree_with_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    sets = []
    for size in (6, 40, 127, 128, 130, 150, 600, 640, 2900):
        for share in (1.0, 0.9, 0.8, 0.5):
            own = base[:size].copy()
            gone = rng.random(size) >= share
            own[gone] = rng.integers(0, 1 << 63, int(gone.sum()), dtype=np.uint64)
            sets.append(np.unique(own))
    n = np.array([len(s) for s in sets])
    places, bits = [fine_points(s) for s in sets], np.array([fine_bits(k) for k in n.tolist()])
    i, j = np.nonzero(np.ones((len(sets), len(sets)), bool))
    exact = np.array([linked(len(np.intersect1d(sets[a], sets[b])), n[a], n[b], 85) for a, b in zip(i, j, strict=True)])
    for most_bits, read in ((24, 1 << 20), (24, 500), (0, 1 << 20)):  # masks, masks in many parts, pairs one by one
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(jaccard_join, "MASK_BITS", most_bits)
            patch.setattr(jaccard_join, "MASK_READ", read)
            got = fine_links(places.__getitem__, bits, n, 85)(i, j)
        assert got[exact].all()  # never loses a link
        assert (got & ~exact).sum() <= 4  # and lets hardly anything else through
    assert fine_links(places.__getitem__, bits, n, 85)(i[:0], j[:0]).tolist() == []


def test_forests_grow_as_pair_by_pair():
    rng = np.random.default_rng(5)
    for number in (1, 4):
        sid = rng.permutation(200) - 100
        x, y = np.triu_indices(200, 1)
        likeness = rng.random(len(x))
        fits = rng.random(len(x)) < 0.2
        verdict = {(a, b): f for a, b, f in zip(x.tolist(), y.tolist(), fits.tolist(), strict=True)}
        plain, want, rest = Forests(number), [], False
        for k in np.argsort(-likeness, kind="stable").tolist():
            pair = min(int(sid[x[k]]), int(sid[y[k]])), max(int(sid[x[k]]), int(sid[y[k]]))
            if not plain.apart(*pair):
                rest = True
            elif fits[k]:
                plain.join(*pair)
                want.append((*pair, likeness[k]))
        forests = Forests(number)
        may_link = lambda i, j: np.array([verdict[p] for p in zip(i.tolist(), j.tolist(), strict=True)], bool)
        got = list(forests.grow(sid, x, y, likeness, may_link))
        assert rest and got == [*want, None]
        assert list(forests.grow(sid, x[:1], y[:1], likeness[:1], may_link)) in ([], [None])
