"""Near-duplicate removal with b-bit MinHash: bands of minima propose pairs, packed low bits estimate, full sets decide.

A document's set is that of its five-word shingles (as in `jaccard_join`). A set of n shingles gets HASHES minima, one for
each of so many permutations of its shingles' hashes. BANDS bands of ROWS minima each are hashed to a key; sets with a
common key are a bucket. Of each minimum only the BITS low bits are kept, packed into BITS planes of HASHES bits, so a
signature has 64 bytes. Two signatures agree where no plane differs, which bit counts tell; as unlike minima have equal low
bits by chance once in 2**BITS, the share of agreement E gives the similarity (E - C) / (1 - C), C = 2**-BITS.

At similarity 0.85 two sets share no band once in 2 * 10**10 pairs, and the estimate lies under CUT, six standard errors
below 0.85, once in 10**9. Every set is first held against one other of its buckets, that with which it shares most bands;
buckets that then still hold several components are searched pair by pair through the signatures, in tiles of bounded size.
Pairs whose estimate reaches the cut are looked at again through their shingles as places on a fine line, as estimates scatter
by 0.026; a forest of what stays is confirmed on full sets, in rounds of a few pairs a set (`jaccard_join.settle`): no bucket
is capped, and no bucket's pairs are all sent anywhere. Buckets of the same sets count as one.

Defined cases: null and wordless texts have an empty set, link with nothing and are kept; equal sets count once, so exact
copies cost one signature; sets of under six shingles link to equal ones only; repeated doc_ids stay as rows; a null doc_id
is linked through equal sets only, its component is the least non-null id of that group or null, and it is kept only where
it is null itself; other columns, whatever their names, are not looked at; very long texts are used whole; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelforge.llm.common import map_batches, materialise
from labelforge.llm.jaccard_join import SHARD_BYTES, TILE, Forests, fine_bits, fine_links, forest_batches, mix64, set_id, set_points, settle, shingle_set, texts_of, unpack, verify, with_components

PERCENT = 85
BANDS, ROWS = 32, 4
HASHES, BITS = 256, 2
SIGNATURE = HASHES * BITS // 8  # bytes
#: Smaller sets of different shingles can't reach the similarity.
LEAST = 6
_rng = np.random.default_rng(13)
_FACTOR, _SHIFT = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) for _ in range(2))
_FACTOR |= np.uint32(1)
CHANCE = 2.0**-BITS


def minima(shingles: np.ndarray, block: int = 128) -> np.ndarray:
    """The least value of each of HASHES permutations of 32 bits over the set."""
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, np.uint32(0xFFFFFFFF))
    for i in range(0, len(h), block):
        x = (h[i : i + block, None] ^ _SHIFT) * _FACTOR
        x ^= x >> np.uint32(15)  # low bits get their share of the high ones
        np.minimum(least, x.min(0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64)


def pack_bits(least: np.ndarray) -> bytes:
    """Low bits of the minima, plane by plane."""
    return b"".join(np.packbits((least >> np.uint32(b)).astype(np.uint8) & 1).tobytes() for b in range(BITS))


def estimates(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarity of each signature of x to each of y, freed of chance agreement. Rows are BITS planes of 64-bit words."""
    unlike = np.zeros((len(x), len(y)), np.int64)
    plane = x.shape[1] // BITS
    for w in range(plane):
        differs = x[:, None, w] ^ y[None, :, w]
        for b in range(1, BITS):
            differs |= x[:, None, b * plane + w] ^ y[None, :, b * plane + w]
        unlike += np.bitwise_count(differs)
    return (1 - unlike / HASHES - CHANCE) / (1 - CHANCE)


def cut(percent: int) -> float:
    """Six standard errors of the estimate below the similarity."""
    agree = CHANCE + (1 - CHANCE) * percent / 100
    return percent / 100 - 6 * sqrt(agree * (1 - agree) / HASHES) / (1 - CHANCE)


def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, set id, signature and band keys of each text; a set that this task has met lately has no keys again."""
    lately: set[int] = set()
    for b in batches:
        out = []
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            s = shingle_set(text)
            sid = set_id(s) if len(s) else None
            if len(s) < LEAST or sid in lately:
                out.append((doc_id, len(s), sid, None, None))
                continue
            if len(lately) >= 200_000:
                lately.clear()
            lately.add(sid)
            least = minima(s)
            out.append((doc_id, len(s), sid, pack_bits(least), band_keys(least).tolist()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["doc_id", "n_shingles", "sid", "signature", "bands"])


def estimated_edges(percent: int):
    """For `settle`: of a tile's signatures, forests of pairs of different components whose estimate reaches the cut."""
    least = cut(percent)

    def make(number: int):
        def edges(tile: list[list], forests: Forests) -> Iterator[tuple[int, int, float] | None]:
            sid, n, label, side = (np.array(x, np.int64) for x in list(zip(*tile, strict=True))[:4])
            if (label == label[0]).all():
                return
            signature = np.frombuffer(b"".join(x[4][:SIGNATURE] for x in tile), np.uint64).reshape(len(tile), -1)
            opener, places = zstandard.ZstdDecompressor(), {}

            def place(k: int) -> np.ndarray:
                if k not in places:
                    places[k] = unpack(tile[k][4][SIGNATURE:], opener)
                return places[k]

            found = []
            for i in range(0, len(tile), 256):
                at = slice(i, i + 256)
                e = estimates(signature[at], signature)
                fits = (e >= least) & (label[at, None] != label[None]) & (100 * np.minimum(n[at, None], n[None]) >= percent * np.maximum(n[at, None], n[None]))
                fits &= (side[at, None] < side[None]) if side.any() else sid[at, None] < sid[None]
                x, y = np.nonzero(fits)
                found.append((x + i, y, e[x, y]))
            x, y, likeness = (np.concatenate(c) for c in zip(*found, strict=True))
            bits = np.array([fine_bits(x[1]) for x in tile])
            yield from forests.grow(sid, x, y, likeness, fine_links(place, bits, n, percent))

        return forest_batches(edges, number)

    return make


def near_duplicates(docs: DataFrame, percent: int = PERCENT, tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles, sid, component_id and kept of every document: links are pairs of 100 * intersection >=
    percent * union, for a percentage of 80 or more."""
    docs = docs.select("doc_id", "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = int(min(max(32, total // SHARD_BYTES), 1_000_000))
    drawn = materialise(map_batches(docs, sketches, "doc_id long, n_shingles long, sid long, signature binary, bands array<long>"), "sketches")
    known = drawn.select("doc_id", "n_shingles", "sid")
    homes = known.where("sid is not null and doc_id is not null").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"))
    homes = materialise(homes, "homes")
    homes, sizes = homes.drop("n"), homes.drop("doc_id")

    keys = drawn.where("bands is not null").select("sid", F.explode("bands").alias("list_id")).distinct()
    content = [F.min("sid").alias("least"), F.count("*").alias("sets"), F.bit_xor(F.xxhash64("sid")).alias("content")]
    buckets = materialise(keys.groupBy("list_id").agg(*content).where("sets > 1"), "buckets")
    buckets = buckets.groupBy("least", "sets", "content").agg(F.min("list_id").alias("list_id"), F.count("*").alias("bands"))
    lists = materialise(keys.join(buckets.select("list_id", "least", "bands"), "list_id"), "lists")
    votes = lists.where("sid != least").groupBy("sid", "least").agg(F.sum("bands").alias("bands"))
    pairs = materialise(votes.groupBy("sid").agg(F.max_by("least", F.struct("bands", "least")).alias("a")).select("a", F.col("sid").alias("b")), "star-pairs")


    def fetch(wanted: DataFrame) -> DataFrame:
        """Signature and places of the sets asked for."""
        signature = drawn.where("signature is not null").join(wanted, "sid").groupBy("sid").agg(F.first("signature").alias("signature"))
        places = map_batches(texts_of(docs, wanted.join(homes, "sid")).select("sid", "text"), set_points, "sid long, n long, places binary").dropDuplicates(["sid"])
        return places.join(signature, "sid").select("sid", "n", F.concat("signature", "places").alias("places"))

    labels = settle(docs, homes, sizes, lists.select("list_id", "sid"), verify(pairs, docs, homes, percent), pairs, fetch, estimated_edges(percent), shards, tile, percent)
    return with_components(known, labels).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
