"""Exact Jaccard join on word shingles: count vectors bound the overlap, an R-tree prunes, exact sets decide.

A set's shingle hashes are dealt to groups by hash range. Two sets A, B with |A| <= |B| and Jaccard of 0.8 or more differ
in at most |A| / 4 shingles, so of any |A| / 4 + 1 groups that A fills, one has the same content in B. Sets meet where
the content of such a group is equal ("shared group"); a group's content says far more than one shingle, so unrelated
texts with a common passage rarely meet. Number of groups: one of a row of levels that grows by half; a set enters the
level of its own size and those of the smallest set that it may link to.

Each set that meets others is first held against one of them, exactly: of the least sets of its shared groups, the one of
most groups. Shared groups that then still hold more than one component go through an R-tree over the sets' count
vectors (64 coordinates or more, one for some one or two shingles, so that chance adds little to what sets of any size
share): subtrees and pairs are dropped where the sum of coordinate minima is below the overlap needed, or the component
is the same already; pairs that stay are looked at again in places 256 times as fine. Of what is left, a task passes on a
spanning forest, the likeliest links first. Over all tasks each set keeps its BEST likeliest of these pairs, which are
verified exactly on their texts: at most BEST pairs a set, whatever the size of a group of near copies and in however many
tasks its lists meet. Of the others, those whose ends are still apart come next. Once all pairs of the forests lie within
components, so does whatever was left out; else the lists that had more pairs come again, with their sets of those components that a
pair which doesn't link had put together, and four times as many disjoint forests, until all is settled; so no link between different sets is lost. A list of more than TILE sets is cut by size and hash, and its tiles meet two by two in tasks of their own.

Defined cases: null and wordless texts have an empty set and link with nothing; equal sets count once; repeated doc_ids
stay as rows; a null doc_id is linked through equal sets only, and its component is the least non-null id of that group
or null; an empty table gives no rows; very long texts are used whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelforge.llm.common import hash64, map_batches, materialise

SHINGLE = 5
GROUPS, MOST_GROUPS = 64, 1 << 24
#: Places for each coordinate of a vector, so that a pair is known nearly exactly before texts are sent.
FINE = 1 << 8
FLUSH = 400_000
BITS = 1 << 20
#: Members of a star that meet its centre in one task.
CHUNK = 128
#: Sets of one list that are compared in one task; longer lists are cut into tiles of about so many.
TILE = 2048
#: Rounds of disjoint forests are so many times as wide as the one before.
WIDER = 4
#: Pairs that a set keeps for its first exact check; later checks of the same pairs take WIDER times as many.
BEST = 3
#: A task forgets its forests beyond so many pairs: then it passes on more pairs, never fewer.
HELD_PAIRS = 400_000
#: Places of at most so many bits are looked up in a mask, so many places of other sets at a time.
MASK_BITS, MASK_READ = 24, 1 << 20
#: Bytes of text for each shard of the groups' keys.
SHARD_BYTES = 24 << 20
_P = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's five-word shingles, A-Z in lower case."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([hash64(b"\0".join([b"%d" % len(words), *words]))], np.uint64)
    h = pd.util.hash_array(np.array(words, object), categorize=False)  # SipHash of all words in one call
    m = len(h) - SHINGLE + 1
    s = h[:m].copy()
    for k in range(1, SHINGLE):
        s = s * _P + h[k : k + m]
    s = mix64(s)
    s.sort()
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


def set_id(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def coordinates(n: int) -> int:
    """How many groups the vector of a set of this size counts: a power of two."""
    return min(max(GROUPS, 1 << (n // 2).bit_length()), MOST_GROUPS)


def vectors(shingles: np.ndarray) -> np.ndarray:
    """Counts of one byte; more coordinates in the case that one doesn't fit."""
    m = coordinates(len(shingles))
    while True:
        v = np.bincount((shingles >> np.uint64(65 - m.bit_length())).astype(np.int64), minlength=m)
        if v.max(initial=0) < 256:
            return v.astype(np.uint8)
        m *= 2


def fold(vector: np.ndarray, m: int) -> np.ndarray:
    """The same counts over m coordinates: groups are ranges of hashes, so neighbours are added."""
    return vector.reshape(m, -1).sum(1, dtype=np.uint32)


def bound(a: np.ndarray, b: np.ndarray) -> int:
    """The most shingles that sets of these vectors can share: the sum of coordinate minima."""
    m = min(len(a), len(b))
    return int(np.minimum(fold(a, m), fold(b, m)).sum(dtype=np.int64))


def linked(overlap, a, b, percent: int = 80):
    """100 * intersection >= percent * union."""
    return (100 + percent) * overlap >= percent * (a + b)


@cache
def levels() -> list[int]:
    """Numbers of groups, each half as many again."""
    out = [1]
    while out[-1] < 1 << 30:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return out


def level_of(n: int) -> int:
    """The first level at which n // 4 + 1 filled groups are likely: one in ten may be empty."""
    need, k = n // 4 + 1, 0
    while need > 1 and levels()[k] * 9 < need * 10:
        k += 1
    return k


def group_keys(shingles: np.ndarray) -> np.ndarray:
    """Keys of the filled groups by which this set meets every set that it links to."""
    n = len(shingles)
    out = []
    for k in range(level_of(-(-4 * n // 5)), level_of(n) + 1):
        m = levels()[k]
        if m == 1:
            continue  # equal sets only, and those have one id
        most = min(n // 4, m * 9 // 10 - 1 if m > 1 else 0)  # shingles that may differ at this level
        group = ((shingles >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        content = np.add.reduceat(mix64(shingles + _P), first)
        salt = np.uint64(k) << np.uint64(40)
        keys = mix64(content + mix64(salt + group[first]))
        out.append(keys[: most + 1])
        if len(keys) < most + 1:  # too few filled groups: empty ones count too
            empty = np.setdiff1d(np.arange(m, dtype=np.uint64), group[first])
            out.append(mix64(mix64(salt + empty) + np.uint64(1)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def fine_points(shingles: np.ndarray) -> np.ndarray:
    """The set's shingles as places among FINE times as many groups as its vector counts, sorted."""
    return (shingles >> np.uint64(64 - fine_bits(len(shingles)))).astype(np.uint32)


def fine_bits(n: int) -> int:
    return coordinates(n).bit_length() - 1 + FINE.bit_length() - 1


def pack(points: np.ndarray) -> bytes:
    """Differences, their low bytes first: most of the high bytes are zero."""
    steps = np.diff(points, prepend=np.uint32(0)).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(data: bytes, opener: zstandard.ZstdDecompressor) -> np.ndarray:
    steps = np.frombuffer(opener.decompress(data), np.uint8).reshape(4, -1).T
    return np.cumsum(np.ascontiguousarray(steps).view("<u4")[:, 0], dtype=np.uint32)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """At least as many as the sets share: places of each that the other has, the lesser number."""
    at, of = np.searchsorted(b, a), np.searchsorted(a, b)
    return min(int((b[np.minimum(at, len(b) - 1)] == a).sum()), int((a[np.minimum(of, len(a) - 1)] == b).sum()))


def set_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and packed places of the sets that are asked for; a text under a repeated id may be another set."""
    for b in batches:
        rows = [(i, len(s), pack(fine_points(s))) for i, x in zip(b.column("sid").to_pylist(), b.column("text").to_pylist(), strict=True) if set_id(s := shingle_set(x)) == i]
        sid, n, places = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(sid, pa.int64()), pa.array(n, pa.int64()), pa.array(places, pa.binary())], ["sid", "n", "places"])


_RECORD = np.dtype([("doc_id", "<i8"), ("no_id", "?"), ("n", "<i8"), ("sid", "<i8")])


def set_blocks(shards: int):
    """One pass over the texts. Blocks of (key, sid) by shard, distinct within a block; a set that this task has met lately
    isn't sent again. Blocks of records, one for each row, dealt to the shards in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sids, records, held, lately, turn = [], [], [], 0, set(), TaskContext.get().partitionId() * 7919

        def flush():
            k, s = (np.concatenate([np.empty(0, t), *x]) for x, t in ((keys, np.uint64), (sids, np.int64)))
            shard = (k % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            parts = [p for p in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(p)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([*(int(shard[p[0]]) for p in parts), turn % shards], pa.int64()), pa.array([*(k[p].tobytes() for p in parts), None], pa.binary()),
                    pa.array([*(s[p].tobytes() for p in parts), None], pa.binary()), pa.array([None] * len(parts) + [np.array(records, _RECORD).tobytes()], pa.binary()),
                ],
                ["shard", "keys", "sids", "records"],
            )

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                s = shingle_set(text)
                sid = set_id(s) if len(s) else 0
                records.append((doc_id or 0, doc_id is None, len(s), sid))
                if len(s) >= 4 and sid not in lately:  # smaller ones link to equal sets only
                    if len(lately) >= 200_000:
                        lately.clear()
                    lately.add(sid)
                    keys.append(group_keys(s))
                    sids.append(np.full(len(keys[-1]), sid, np.int64))
                    held += len(keys[-1])
                if held >= FLUSH or len(records) >= 20_000:
                    yield flush()
                    keys, sids, records, held, turn = [], [], [], 0, turn + 1
        if records:
            yield flush()

    return run


EDGE, LIST, ROW = range(3)


def shared_groups(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one shard: how many groups each set shares with the least of them (EDGE: least, set, groups), each distinct list
    of sets that share a group (LIST: name, -, size, members), and the rows' records (ROW: doc_id, set, size)."""
    rows = np.frombuffer(b"".join(pdf["records"].dropna()), _RECORD)
    out = [pd.DataFrame({"kind": ROW, "a": pd.array(rows["doc_id"], "Int64"), "b": pd.array(rows["sid"], "Int64"), "n": rows["n"], "members": None})]
    out[0].loc[rows["no_id"], "a"] = pd.NA
    out[0].loc[rows["n"] == 0, "b"] = pd.NA
    k = np.frombuffer(b"".join(pdf["keys"].dropna()), np.uint64)
    s = np.frombuffer(b"".join(pdf["sids"].dropna()), np.int64)
    order = np.lexsort((s, k))
    k, s = k[order], s[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
    k, s = k[new], s[new]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(k)))
    first, size = first[size > 1], size[size > 1]
    if len(first):
        begin = np.cumsum(size) - size
        at = np.repeat(first - begin, size) + np.arange(size.sum())
        member, low = s[at], np.repeat(s[first], size)
        name = np.add.reduceat(mix64(member.view(np.uint64)), begin)
        order = np.lexsort((low, member))
        member, low = member[order], low[order]
        new = np.flatnonzero(np.concatenate(([True], (member[1:] != member[:-1]) | (low[1:] != low[:-1]))))
        edges = pd.DataFrame({"kind": EDGE, "a": low[new], "b": member[new], "n": np.diff(np.append(new, len(member))), "members": None})
        kept = np.unique(name, return_index=True)[1]
        members = [s[i : i + n].tobytes() for i, n in zip(first[kept], size[kept], strict=True)]
        out += [edges[edges["a"] != edges["b"]], pd.DataFrame({"kind": LIST, "a": name[kept].view(np.int64), "b": 0, "n": size[kept], "members": members})]
    return pd.concat([x.astype({"a": "Int64", "b": "Int64"}) for x in out])


def verified(percent: int):
    """Of rows sorted by home and chunk, the home's own text first: the members that link to it, by the sum of coordinate
    minima first, then exactly. Holds one home's set at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centre, low = None, None, None
        for b in batches:
            keep: list[tuple[int, int]] = []
            for home, chunk, sid, text in zip(*(b.column(x).to_pylist() for x in ("home", "chunk", "sid", "text")), strict=True):
                s = shingle_set(text)
                if set_id(s) != sid:
                    continue  # another text under a repeated id
                if home == sid:
                    at, centre, low = (home, chunk), s, vectors(s)
                elif at == (home, chunk) and linked(bound(low, vectors(s)), len(centre), len(s), percent):
                    both = np.concatenate([centre, s])
                    both.sort(kind="stable")  # two sorted runs: merged in one pass
                    if linked(int((both[1:] == both[:-1]).sum()), len(centre), len(s), percent):
                        keep.append((home, sid))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in keep], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The columns of `wanted` (sid, doc_id and others) and the texts under these ids. A one-hash Bloom filter of at most
    2**20 numbers keeps most other texts out of the shuffle."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(BITS))
    bits = F.broadcast(wanted.select(bit.alias("bit")).distinct())
    return docs.withColumn("bit", bit).join(bits, "bit", "left_semi").drop("bit").join(wanted.hint("merge"), "doc_id")


def verify(pairs: DataFrame, docs: DataFrame, homes: DataFrame, percent: int = 80) -> DataFrame:
    """The pairs that link. Texts are sent, not sets, which are larger: those of all b to their a, of which a large group
    is cut into chunks that each get the text of a."""
    chunks = pairs.groupBy("a").agg((F.floor(F.count("*") / CHUNK) + 1).alias("chunks"))
    members = pairs.join(chunks, "a").select(F.col("a").alias("home"), F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk"), F.col("b").alias("sid"))
    centres = chunks.select(F.col("a").alias("home"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("a").alias("sid"))
    wanted = materialise(members.unionByName(centres).join(homes, "sid"), "wanted")
    rows = texts_of(docs, wanted).select("home", "chunk", "sid", "text")
    rows = rows.repartition("home", "chunk").sortWithinPartitions("home", "chunk", F.col("home") != F.col("sid"))
    return materialise(map_batches(rows, verified(percent), "a long, b long"), "links")


class Node:
    """A node of the R-tree: the rows below it, their bounding box and range of sizes."""

    def __init__(self, rows: np.ndarray, points: np.ndarray, n: np.ndarray, label: np.ndarray, leaf: int = 24):
        own = points[rows]
        self.rows, self.high = rows, own.max(0)
        self.least, self.most = n[rows].min(), n[rows].max()
        same = label[rows[0]]
        self.label = same if (label[rows] == same).all() else None
        self.children = []
        if len(rows) > leaf:
            spread = own.max(0).astype(np.int64) - own.min(0)
            by = n[rows] if self.most - self.least > spread.max() else own[:, spread.argmax()]
            order = rows[np.argsort(by, kind="stable")]
            self.children = [Node(x, points, n, label, leaf) for x in np.array_split(order, 2)]


def tree_join(points: np.ndarray, n: np.ndarray, label: np.ndarray, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows, of different labels, whose coordinate minima sum to the overlap needed, and these sums. With `side`,
    only pairs of a row of side 0 and one of side 1."""
    if side is None:
        root = Node(np.arange(len(n)), points, n, label)
        stack = [(root, root)]
    else:
        own = [np.flatnonzero(side == k) for k in (0, 1)]
        if not len(own[0]) or not len(own[1]):
            return
        stack = [(Node(own[0], points, n, label), Node(own[1], points, n, label))]
    while stack:
        x, y = stack.pop()
        if x.label is not None and x.label == y.label or 4 * max(x.least, y.least) > 5 * min(x.most, y.most):
            continue
        if x is not y and not linked(int(np.minimum(x.high, y.high).sum(dtype=np.int64)), x.least, y.least):
            continue
        if not x.children and not y.children:
            overlap = np.minimum(points[x.rows][:, None], points[y.rows][None]).sum(2, dtype=np.int64)
            good = linked(overlap, n[x.rows][:, None], n[y.rows][None]) & (label[x.rows][:, None] != label[y.rows][None])
            i, j = np.nonzero(np.triu(good, 1) if x is y else good)
            if len(i):
                yield x.rows[i], y.rows[j], overlap[i, j]
        elif x is y:
            a, b = x.children
            stack += [(a, a), (a, b), (b, b)]
        elif x.children and (not y.children or len(x.rows) >= len(y.rows)):
            stack += [(c, y) for c in x.children]
        else:
            stack += [(x, c) for c in y.children]


class Forests:
    """Edge-disjoint forests over sets: an edge joins the first in which its ends are apart."""

    def __init__(self, number: int):
        self.up: list[dict[int, int]] = [{} for _ in range(number)]
        self.edges: set[tuple[int, int]] = set()

    def _roots(self, up: dict[int, int], a: int, b: int) -> tuple[int, int]:
        while (z := up.get(a, a)) != a:
            up[a] = a = up.get(z, z)
        while (z := up.get(b, b)) != b:
            up[b] = b = up.get(z, z)
        return a, b

    def apart(self, a: int, b: int) -> bool:
        """Whether there is a forest in which they are."""
        return any(x != y for x, y in (self._roots(up, a, b) for up in self.up))

    def join(self, a: int, b: int) -> None:
        for up in self.up:
            x, y = self._roots(up, a, b)
            if x != y:
                up[x] = y
                self.edges.add((a, b))
                return

    def roots(self, sets: list[int]) -> np.ndarray:
        """A row for each forest: the roots of the sets."""
        return np.array([[self._roots(up, a, a)[0] for a in sets] for up in self.up], np.int64)

    def grow(self, sid: np.ndarray, x: np.ndarray, y: np.ndarray, likeness: np.ndarray, may_link) -> Iterator[tuple[int, int, float] | None]:
        """Takes pairs of rows, the likeliest first: yields those that join the forests, and None where others had their
        ends joined already. Pairs come in blocks that double; of a block only those that are still apart at its start go
        through `may_link`, all at once, so a dense group costs little more than its sets."""
        order = np.argsort(-likeness, kind="stable")
        x, y, likeness, names = x[order], y[order], likeness[order], sid.tolist()
        at, step, rest = 0, 4 * len(names), False
        name = lambda i, j: (min(names[i], names[j]), max(names[i], names[j]))
        while at < len(x):
            i, j, w = x[at : at + step], y[at : at + step], likeness[at : at + step]
            roots = self.roots(names)
            apart = (roots[:, i] != roots[:, j]).any(0)
            rest = rest or any(name(i[k], j[k]) not in self.edges for k in np.flatnonzero(~apart))
            i, j, w = i[apart], j[apart], w[apart]
            fits = may_link(i, j)
            for pair, v in zip(map(name, i[fits].tolist(), j[fits].tolist()), w[fits].tolist(), strict=True):
                if pair in self.edges:
                    continue
                if self.apart(*pair):
                    self.join(*pair)
                    yield *pair, v
                else:
                    rest = True
            at, step = at + step, 2 * step
        if rest:
            yield None


def fine_links(place, bits: np.ndarray, n: np.ndarray, percent: int = 80):
    """Whether the places of rows i[k] and j[k] let them link: of j's at least as many as the two share are places of i.
    `place` gives a row's places; all partners of a row are looked up at once in a mask of its places."""

    def of(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        overlap, low = np.zeros(len(i), np.int64), np.minimum(bits[i], bits[j])
        order = np.lexsort((low, i))
        cuts = np.flatnonzero((np.diff(i[order]) != 0) | (np.diff(low[order]) != 0)) + 1
        for rows in np.split(order, cuts) if len(order) else []:
            a, level = int(i[rows[0]]), int(low[rows[0]])
            own = place(a) >> np.uint32(bits[a] - level)
            if level > MASK_BITS:
                overlap[rows] = [common(own, place(k) >> np.uint32(bits[k] - level)) for k in j[rows].tolist()]
                continue
            mask = np.zeros(1 << level, np.uint8)
            mask[own] = 1
            for part in np.split(rows, np.flatnonzero(np.diff(np.cumsum(n[j[rows]]) // MASK_READ)) + 1):
                theirs = [place(k) >> np.uint32(bits[k] - level) if bits[k] > level else place(k) for k in j[part].tolist()]
                length = np.array([len(t) for t in theirs])
                overlap[part] = np.add.reduceat(mask[np.concatenate(theirs)], np.cumsum(length) - length, dtype=np.int64)
        return linked(overlap, n[i], n[j], percent)

    return of


def forest_edges(number: int):
    """Rows sorted by tile: of the pairs that both bounds let through (a < b), the vectors' and that of the finer places,
    those of `number` disjoint forests. A row with a list's id tells that the list had pairs whose ends were joined already.
    Holds one tile at a time."""

    def edges(tile: list[list], forests: Forests) -> Iterator[tuple[int, int, float] | None]:
        """New edges with their bound on the likeness, and None for a pair whose ends are joined already."""
        sid, n, label, side = (np.array(x, np.int64) for x in list(zip(*tile, strict=True))[:4])
        if (label == label[0]).all():
            return
        opener = zstandard.ZstdDecompressor()
        own, bits = [unpack(x[4], opener) for x in tile], np.array([fine_bits(x[1]) for x in tile])
        low = int(bits.min())
        m = low - FINE.bit_length() + 1
        points = np.stack([np.bincount(v >> np.uint32(b - m), minlength=1 << m).astype(np.uint32) for v, b in zip(own, bits.tolist(), strict=True)])
        found = list(tree_join(points, n, label, side if side.any() else None))
        if not found:
            return
        x, y, overlap = (np.concatenate(c) for c in zip(*found, strict=True))
        yield from forests.grow(sid, x, y, overlap / (n[x] + n[y] - overlap), fine_links(own.__getitem__, bits, n))

    return forest_batches(edges, number)


def forest_batches(edges, number: int):
    """The loop of forest_edges over tiles; `edges` finds those of one tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forests, at, rows, out = Forests(number), None, [], []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal forests
            rest = False
            for pair in edges(rows, forests):
                if pair is None:
                    rest = True
                else:
                    out.append((*pair, None))
            if rest:
                out.append((None, None, None, at[0]))
            if len(forests.edges) > HELD_PAIRS:
                forests = Forests(number)
            if len(out) >= 50_000:
                yield batch()

        def batch() -> pa.RecordBatch:
            nonlocal out
            a, b, w, c = zip(*out, strict=True)
            out = []
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(w, pa.float64()), pa.array(c, pa.int64())], ["a", "b", "w", "list_id"])

        for b in batches:
            for list_id, tile, *row in zip(*(b.column(x).to_pylist() for x in ("list_id", "tile", "sid", "n", "label", "side", "places")), strict=True):
                if at != (list_id, tile):
                    if rows:
                        yield from close()
                    at, rows = (list_id, tile), []
                rows.append(row)
        if rows:
            yield from close()
        if out:
            yield batch()

    return run


def components(links: DataFrame) -> DataFrame:
    """(sid, label): label is the least set id that can be reached. Large-star and small-star steps until all are stars.

    A step has four shuffles: the least neighbour of every set that is the greater end of a link, links by their lesser end
    (its greater neighbours go to the least one), by their greater end (its lesser neighbours go to the least one), and
    distinct links."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v")
    while True:
        least = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        large = edges.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        near = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = materialise(near.select(F.explode(ends).alias("edge")).select("edge.u", "edge.v").where("u != v").distinct(), "stars")
        if are_stars(edges):
            return edges.select(F.col("u").alias("sid"), F.col("v").alias("label"))


def are_stars(edges: DataFrame) -> bool:
    """Of edges (u, v) with u > v: whether each u has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("end"), "v").unionByName(edges.select(F.col("v").alias("end"), F.lit(None).cast("long").alias("v")))
    seen = ends.groupBy("end").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.max(F.col("v").isNull()).alias("centre"))
    return seen.where("least is not null and (centre or least != most)").agg(F.count("*")).first()[0] == 0


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after `links` (a, b) between labels are added: only these labels go through the steps, not all links."""
    moved = components(links)  # a set that is a label has no row in `labels`
    to = moved.select(F.col("sid").alias("label"), F.col("label").alias("root"))
    kept = labels.join(to, "label", "left").select("sid", F.coalesce("root", "label").alias("label"))
    return materialise(kept.unionByName(moved), "joined-labels")


def open_tiles(lists: DataFrame, labels: DataFrame, tile: int = TILE) -> DataFrame:
    """Rows (list_id, tile, sid, n, label, side) of lists with more than one component.

    A list of at most `tile` sets is one tile, without the sets that are too small or large to link to any other of the
    list: in order of size it is enough to look at both neighbours. A longer list is cut into bands, so that sets that link
    are of one band or of two neighbours, and a band by hash into parts of about `tile` sets; each two parts that may hold a
    link are a tile, with sides 0 and 1, and each part is one for itself."""
    labelled = lists.join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    several = labelled.groupBy("list_id").agg((F.min("label") != F.max("label")).alias("open"), F.count("*").alias("sets")).where("open").select("list_id", "sets")
    rows = materialise(labelled.join(several, "list_id").select("list_id", "sid", "n", "label", "sets"), "open-lists")
    along = Window.partitionBy("list_id").orderBy("n", "sid")
    near = [F.lag("n").over(along) * 5 >= F.col("n") * 4, F.col("n") * 5 >= F.lead("n").over(along) * 4]
    near = F.coalesce(near[0], F.lit(False)) | F.coalesce(near[1], F.lit(False))
    columns = ["list_id", "tile", "sid", "n", "label", "side"]
    small = rows.where(F.col("sets") <= tile).withColumn("near", near).where("near").withColumns({"tile": F.lit(0).cast("long"), "side": F.lit(0)}).select(*columns)

    large = rows.where(F.col("sets") > tile)
    if large.isEmpty():
        return small
    large = large.withColumn("band", F.floor(F.log("n") / F.log(F.lit(1.25)) + 1e-9))
    parts = large.groupBy("list_id", "band").agg((F.floor(F.count("*") / tile) + 1).alias("parts"))
    above, below = (parts.select("list_id", (F.col("band") + k).alias("band"), F.col("parts").alias(name)) for k, name in ((-1, "above"), (1, "below")))
    parts = parts.join(above, ["list_id", "band"], "left").join(below, ["list_id", "band"], "left").fillna(0, ["above", "below"])
    large = large.join(parts, ["list_id", "band"]).withColumn("part", F.pmod(F.xxhash64("sid"), F.col("parts")))
    to = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    name = lambda band, p, q, kind: F.xxhash64(F.lit(kind), band, p, q)
    meets = F.concat(
        F.transform(to(F.col("parts")), lambda q: F.struct(name(F.col("band"), F.least("part", q), F.greatest("part", q), 1).alias("tile"), (q < F.col("part")).cast("int").alias("side"))),
        F.transform(to(F.col("above")), lambda q: F.struct(name(F.col("band"), F.col("part"), q, 2).alias("tile"), F.lit(0).alias("side"))),
        F.transform(to(F.col("below")), lambda q: F.struct(name(F.col("band") - 1, q, F.col("part"), 2).alias("tile"), F.lit(1).alias("side"))),
    )
    return small.unionByName(large.withColumn("m", F.explode(meets)).select("list_id", "m.tile", "sid", "n", "label", "m.side"))


def link_components(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles, sid and component_id of every document."""
    docs = docs.select("doc_id", "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = int(min(max(32, total // SHARD_BYTES), 1_000_000))
    blocks = map_batches(docs, set_blocks(shards), "shard long, keys binary, sids binary, records binary")
    met = materialise(blocks.groupBy("shard").applyInPandas(shared_groups, "kind int, a long, b long, n long, members binary"), "shared-groups")
    known = met.where(F.col("kind") == ROW).select(F.col("a").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("b").alias("sid"))
    votes = met.where(F.col("kind") == EDGE).groupBy("a", "b").agg(F.sum("n").alias("n"))
    pairs = materialise(votes.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", "b"), "star-pairs")
    homes = known.where("sid is not null and doc_id is not null").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"))
    homes = materialise(homes, "homes")
    homes, sizes = homes.drop("n"), homes.drop("doc_id")
    links = verify(pairs, docs, homes)
    lists = met.where(F.col("kind") == LIST).select(F.col("a").alias("list_id"), "members").dropDuplicates(["list_id"])
    lists = materialise(map_batches(lists, list_rows, "list_id long, sid long"), "lists")
    fetch = lambda wanted: map_batches(texts_of(docs, wanted.join(homes, "sid")).select("sid", "text"), set_points, "sid long, n long, places binary").dropDuplicates(["sid"])
    labels = settle(docs, homes, sizes, lists, links, pairs, fetch, forest_edges, shards, tile)
    return with_components(known, labels)


def likeliest(pairs: DataFrame, most: int) -> DataFrame:
    """Of pairs (a, b, w), those that are among the `most` of greatest w of either end."""
    ends = pairs.select("a", "b", "w", F.explode(F.array("a", "b")).alias("end"))
    rank = F.row_number().over(Window.partitionBy("end").orderBy(F.desc("w"), "a", "b"))
    return ends.withColumn("rank", rank).where(F.col("rank") <= most).select("a", "b").distinct()


def settle(docs, homes, sizes, lists, links, done, fetch, edges, shards: int, tile: int = TILE, percent: int = 80) -> DataFrame:
    """(sid, label) after all lists (list_id, sid) are settled: no pair of a list that links has its ends apart.

    `fetch` gives what `edges` needs of the sets (sid) asked for, as (sid, n, places); `edges` makes the function over tiles
    that gives forests of pairs that may link. `links` are the pairs known to link, `done` those that were checked."""
    labels, points, number = components(links), None, 1
    while True:
        still = materialise(open_tiles(lists.join(sizes, "sid"), labels, tile), "open-tiles")
        if still.isEmpty():
            return labels
        if points is None:  # labels only grow together: no later round has sets that this one hasn't
            points = materialise(fetch(still.select("sid").distinct()), "points")
        rows = still.drop("n").join(points, "sid").repartition(shards, "list_id", "tile").sortWithinPartitions("list_id", "tile")
        found = materialise(map_batches(rows, edges(number), "a long, b long, w double, list_id long"), "found")
        forest, most = found.where("a is not null").groupBy("a", "b").agg(F.max("w").alias("w")), BEST
        while True:
            ends = [labels.select(F.col("sid").alias(x), F.col("label").alias(f"label_{x}")) for x in ("a", "b")]
            apart = forest.join(ends[0], "a", "left").join(ends[1], "b", "left").where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b"))
            apart = materialise(apart.select("a", "b", "w", "label_a", "label_b"), "apart")  # pairs within a component are settled
            forest = apart.select("a", "b", "w")
            more = materialise(likeliest(forest.join(done, ["a", "b"], "left_anti"), most), "forests")
            if more.isEmpty():
                break
            fresh, done, most = verify(more, docs, homes, percent), done.unionByName(more), most * WIDER
            if not fresh.isEmpty():
                labels = joined(labels, fresh.join(apart, ["a", "b"]).select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")))
        if forest.isEmpty():
            return labels  # what a task left out is joined by what it passed on
        # A path in a task's forest that joins what isn't linked leaves its first and its last component by a pair that
        # doesn't link, so only sets of components at such pairs may have lost a link.
        torn = apart.select(F.explode(F.array(F.coalesce("label_a", "a"), F.coalesce("label_b", "b"))).alias("label")).distinct()
        crowded = found.where("list_id is not null").select("list_id").distinct()
        lists = lists.join(crowded, "list_id", "left_semi").join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
        lists, number = materialise(lists.join(torn, "label", "left_semi").select("list_id", "sid"), "crowded-lists"), number * WIDER


def with_components(known: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows (doc_id, n_shingles, sid) with the least doc_id of each row's component."""
    labels = materialise(known.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("first")).join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid")), "labels")
    least = labels.groupBy("label").agg(F.min("first").alias("component_id"))
    by_set = materialise(labels.join(least, "label").select("sid", "component_id"), "components")
    out = known.join(by_set, "sid", "left")
    return out.select("doc_id", "n_shingles", "sid", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def list_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for name, members in zip(b.column("list_id").to_pylist(), b.column("members").to_pylist(), strict=True):
            sid = np.frombuffer(members, np.int64)
            for i in range(0, len(sid), 50_000):
                part = sid[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), name, np.int64)), pa.array(part)], ["list_id", "sid"])


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without those that link to one with a smaller id. Texts without words stay. Where ids repeat, equal
    rows become one."""
    found = materialise(link_components(docs), "found")
    gone = materialise(found.where("component_id < doc_id").select("doc_id").distinct(), "gone")
    repeats = not found.groupBy("doc_id").count().where("count > 1").isEmpty()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    return kept.distinct() if repeats else kept
