"""SimHash fingerprints of 128 bits, and search within a Hamming radius by permuted block tables.

Terms are words with A-Z in lower case, weighted 1 + ln(count). Each term's hash votes with its weight for or against
every bit.

Search: the bits are cut into radius + 2 blocks, so fingerprints within the radius agree in at least two. Each block is a
table whose key is the block's content; inside a key, long lists are matched by every later block as well. A pair is
reported where the first block (and, in long lists, the second) in which it agrees is the one at hand, hence once. Keys of
more than TILE fingerprints are cut into slices, and each pair of slices is a group of its own. Equal fingerprints are one
row there.

The radius of 14 is measured: of pairs of unequal texts whose sets of five words have a Jaccard similarity of 0.8 or more,
0.94 or more lie within it (README); texts without anything in common are some 60 bits apart. Two blocks of 8 bits each must
agree before a pair of a long list is compared, so comparisons grow with the square of the distinct texts, over 2**16 a
table; a smaller radius makes longer blocks.

Defined cases: a null text is empty; an empty text's fingerprint is 0; rows are in the order of doc_id (nulls first) and
text, repeated ids are neighbours; equal texts have equal fingerprints and don't count as each other's neighbours; an empty
table gives no rows; other columns than doc_id and text aren't looked at; very long texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelforge.llm.common import WordTable, hash64, map_batches, materialise

BITS = 128
RADIUS = 14
TILE = 1 << 16  # fingerprints of a slice: 1 MB
SHORT = 2048  # lists of up to as many are compared directly
AT_ONCE = 1 << 20  # comparisons held in memory
_words = WordTable(hash64)
_A, _B = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def fingerprint(text: str | None) -> bytes:
    """16 bytes."""
    words = Counter((text or "").encode().lower().split())
    if not words:
        return bytes(BITS // 8)
    terms = _mix(np.fromiter(map(_words.__getitem__, words), np.uint64, len(words)))
    order = np.argsort(terms)  # sums of floats depend on their order
    terms, count = terms[order], np.fromiter(words.values(), np.int64, len(words))[order]
    weight = (1 + np.log(count)).astype(np.float32)
    bits = np.unpackbits(np.stack([terms, _mix(terms * _A + _B)], 1).view(np.uint8), axis=1)
    votes = weight @ bits.astype(np.float32)
    return np.packbits(votes * 2 > weight.sum()).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    return 1 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / BITS


def edited(text: str, following: str) -> str:
    """The last quarter of the text's code points replaced by the first as many of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, part int, own string, first string"


def _row(doc_id, text: str, fp: bytes, following: str, next_fp: bytes) -> list:
    e = edited(text, following)
    efp = fingerprint(e) if e != text else fp
    return [doc_id, len(text), hashlib.sha256(e.encode()).hexdigest(), fp.hex(), efp.hex(), likeness(fp, efp), likeness(fp, next_fp)]


def _batch(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the next of its partition. The last row waits for the next partition's first: it keeps its text."""
    part, first, held, rows = TaskContext.get().partitionId(), None, None, []
    for b in batches:
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            text = text or ""
            fp = fingerprint(text)
            if held is None:
                first = text
            else:
                rows.append([*_row(*held, text, fp), None, None, None])
            held = (doc_id, text, fp)
        if len(rows) >= 256:
            yield _batch(rows)
            rows = []
    if held is not None:
        rows.append([held[0], len(held[1]), None, held[2].hex(), None, None, None, part, held[1], first])
    if rows:
        yield _batch(rows)


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [[*_row(r["doc_id"], r["own"], fingerprint(r["own"]), r["following"], fingerprint(r["following"])), None, None, None] for r in b.to_pylist()]
        if rows:
            yield _batch(rows)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with likenesses (1 - distance / bits)."""
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    found = materialise(map_batches(ordered, _chain, SCHEMA), "fingerprints")
    # One row per partition is open; its neighbour is the next partition that has rows, after the last one the first.
    ends = found.where("part is not null")
    order = Window.orderBy("part")
    parts = ends.select("part").withColumn("next", F.lead("part").over(order)).withColumn("next", F.coalesce("next", F.min("part").over(Window.partitionBy())))
    opened = ends.select("doc_id", "part", "own").join(parts, "part").join(ends.select(F.col("part").alias("next"), F.col("first").alias("following")), "next")
    closed = map_batches(opened.select("doc_id", "own", "following"), _close, SCHEMA)
    return found.where("part is null").unionByName(closed).drop("part", "own", "first")


def half(column: str, k: int) -> Column:
    """64 bits of a hexadecimal fingerprint as a number."""
    digits = F.substring(column, 16 * k + 1, 16)
    high, low = (F.conv(F.substring(digits, s, 8), 16, 10).cast("long") for s in (1, 9))
    return F.shiftleft(high, 32).bitwiseOR(low)


class Blocks:
    """Which bits of the two halves belong to each of the radius + 2 blocks."""

    def __init__(self, radius: int):
        self.radius, self.count = radius, radius + 2
        bounds = [BITS * k // self.count for k in range(self.count + 1)]
        cut = [[(max(low, 64 * p) - 64 * p, min(high, 64 * p + 64) - 64 * p) for p in (0, 1)] for low, high in zip(bounds, bounds[1:])]
        self.masks = [[((1 << (high - low)) - 1) << (64 - high) if low < high else 0 for low, high in halves] for halves in cut]

    def key(self, k: int) -> Column:
        signed = [m - (1 << 64) if m >> 63 else m for m in self.masks[k]]
        return F.xxhash64(F.lit(k), *[F.col(f"h{p}").bitwiseAND(F.lit(m).cast("long")) for p, m in enumerate(signed) if m])

    def values(self, rows: np.ndarray, k: int) -> np.ndarray:
        """Equal where block k is (not the other way round); rows: two columns of 64 bits."""
        m0, m1 = (np.uint64(m) for m in self.masks[k])
        return (rows[:, 0] & m0) ^ _mix((rows[:, 1] & m1) * _A)

    def first(self, x: np.ndarray, start: int) -> np.ndarray:
        """First block from start on without a bit of x."""
        out = np.full(len(x), self.count)
        for k in reversed(range(start, self.count)):
            m0, m1 = (np.uint64(m) for m in self.masks[k])
            out[(x[:, 0] & m0 | x[:, 1] & m1) == 0] = k
        return out

    def compare(self, a: np.ndarray, b: np.ndarray, same: bool, first: int, second: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row of a, row of b, distance) of the pairs that belong to this place; same: b is a, and each pair counts once."""
        step = max(1, AT_ONCE // max(1, len(b))) if not same else max(1, min(128, AT_ONCE // max(1, len(b))))
        for start in range(0, len(a), step):
            part, past = a[start : start + step, None], start if same else 0
            distance = np.bitwise_count(part[..., 0] ^ b[None, past:, 0]) + np.bitwise_count(part[..., 1] ^ b[None, past:, 1])
            i, j = np.nonzero(distance <= self.radius)
            d, i, j = distance[i, j], i + start, j + past
            if same:
                once = i < j
                i, j, d = i[once], j[once], d[once]
            x = a[i] ^ b[j]
            here = self.first(x, 0) == first
            if second is not None:
                here &= self.first(x, first + 1) == second
            if here.any():
                yield i[here], j[here], d[here]

    def search(self, a: np.ndarray, b: np.ndarray, same: bool, first: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if len(a) * len(b) <= SHORT**2:
            yield from self.compare(a, b, same, first, None)
            return
        for k in range(first + 1, self.count):
            va = self.values(a, k)
            ia = np.argsort(va, kind="stable")
            vb, ib = (va, ia) if same else (self.values(b, k), None)
            ib = np.argsort(vb, kind="stable") if ib is None else ib
            common = np.intersect1d(va, vb)
            places = [np.searchsorted(v[i], common, side) for v, i in ((va, ia), (vb, ib)) for side in ("left", "right")]
            for a0, a1, b0, b1 in zip(*places, strict=True):
                for i, j, d in self.compare(a[ia[a0:a1]], b[ib[b0:b1]], same, first, k):
                    yield ia[a0:a1][i], ib[b0:b1][j], d


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray]]:
    """(block, within one slice, the slices' rows) of each group; rows come sorted by group."""
    names = ("key", "low", "high")

    def group(parts: list[pa.RecordBatch]) -> tuple[int, bool, np.ndarray, np.ndarray]:
        t = pa.Table.from_batches(parts)
        rows = np.stack([t.column(c).to_numpy().view(np.uint64) for c in ("h0", "h1")], 1)
        low, high, own = t.column("low")[0].as_py(), t.column("high")[0].as_py(), t.column("own").to_numpy()
        return t.column("block")[0].as_py(), low == high, rows[own == low], rows[own == high]

    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        ids = np.stack([b.column(c).to_numpy() for c in names], 1)
        starts = np.concatenate([[0], np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1, [len(ids)]])
        for s, e in zip(starts, starts[1:]):
            if last is not None and tuple(ids[s]) != last:
                yield group(held)
                held = []
            last = tuple(ids[s])
            held.append(b.slice(s, e - s))
    if held:
        yield group(held)


def _pairs_of(blocks: Blocks) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, same, a, b in _groups(batches):
            for i, j, d in blocks.search(a, b, same, block):
                columns = [a[i, 0].view(np.int64), a[i, 1].view(np.int64), b[j, 0].view(np.int64), b[j, 1].view(np.int64), d.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a0", "a1", "b0", "b1", "distance"])

    return run


def _counts_of(blocks: Blocks) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, same, a, b in _groups(batches):
            na, nb = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
            for i, j, _ in blocks.search(a, b, same, block):
                na += np.bincount(i, minlength=len(a))
                nb += np.bincount(j, minlength=len(b))
            for rows, n in ((a, na + nb),) if same else ((a, na), (b, nb)):
                if n.any():
                    columns = [rows[n > 0, 0].view(np.int64), rows[n > 0, 1].view(np.int64), n[n > 0]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h0", "h1", "n"])

    return run


def _tables(prints: DataFrame, blocks: Blocks) -> DataFrame:
    """(key, low, high, own, block, h0, h1): each distinct fingerprint under the content of each block but the last, which no
    pair has as the first of two. Keys of more than TILE fingerprints are cut into slices by hash: low and high name a
    group's two slices, own the row's."""
    distinct = materialise(prints.select("fingerprint").where("fingerprint is not null").distinct().select(half("fingerprint", 0).alias("h0"), half("fingerprint", 1).alias("h1")), "prints")
    keys = F.array(*[F.struct(F.lit(k).alias("block"), blocks.key(k).alias("key")) for k in range(blocks.count - 1)])
    rows = distinct.select("h0", "h1", F.inline(keys))
    hot = materialise(rows.groupBy("key").count().where(F.col("count") > TILE).select("key", F.ceil(F.col("count") / TILE).alias("slices")), "hot-keys")
    rows = rows.join(hot, "key", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("h0", "h1"), "slices")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "block", "h0", "h1")
    return rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")


def _hexadecimal(h0: str, h1: str) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in (h0, h1)]))


def close_pairs(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """prints: column fingerprint. (a, b, distance) of all pairs of distinct fingerprints within the radius, a < b."""
    blocks = Blocks(radius)
    found = map_batches(_tables(prints, blocks), _pairs_of(blocks), "a0 long, a1 long, b0 long, b1 long, distance int")
    found = found.select(_hexadecimal("a0", "a1").alias("a"), _hexadecimal("b0", "b1").alias("b"), "distance")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance")


def close_counts(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """prints: column fingerprint. (fingerprint, n_close) of distinct fingerprints with others within the radius. Pairs are
    counted where they are found: a group of k near copies gives at most k rows a table, not k * k."""
    blocks = Blocks(radius)
    found = map_batches(_tables(prints, blocks), _counts_of(blocks), "h0 long, h1 long, n long")
    return found.groupBy("h0", "h1").agg(F.sum("n").alias("n_close")).select(_hexadecimal("h0", "h1").alias("fingerprint"), "n_close")


def fingerprint_documents(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fingerprints() and n_close: how many other distinct fingerprints lie within the radius."""
    prints = materialise(fingerprints(docs), "all-prints")
    close = materialise(close_counts(prints, radius), "close-counts")
    return prints.join(close, "fingerprint", "left").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", F.coalesce("n_close", F.lit(0)).cast("long").alias("n_close")
    )
