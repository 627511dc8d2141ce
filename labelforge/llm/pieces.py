"""Sampled SentencePiece segmentations: forward filtering, backward sampling over the piece lattice; lossless decoding.

A text gets one dummy space in front; the model's U+2581 stands for a space, and what no piece covers becomes byte pieces
(so does a U+2581 that the text holds itself). No piece goes on past a space or holds a newline, so the lattice has a single node at
each such place and the samples of the units between are independent: a unit's forward pass is done once and kept, and
all units of a batch are then sampled backwards together. The random numbers come from the row's key, the unit's place
and the step alone, so a row's segmentation doesn't depend on partitions, batches or attempts.

The public model is a BPE model whose scores are negative merge ranks; a piece of rank r has log-probability
-temperature * ln(r + 2), which is Zipf's law. Nothing is trained.

Defined cases: null and empty texts have no pieces and decode to ''; a null key is seeded as the text 'null'; rows that
repeat a key and text repeat their segmentation; very long texts are used whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from labelforge.llm.common import map_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: A unit: spaces and what follows them, or a newline.
_UNITS = re.compile("\n| *[^ \n]+| +")
#: Lattices are forgotten beyond so many edges: 16 bytes each, and their units about as much again.
MOST_EDGES = 2_500_000


class Pieces:
    def __init__(self, model: str, temperature: float = 1.0):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=model)
        self.id: dict[str, int] = {}
        self.logp: dict[str, float] = {}
        self.byte = [-1] * 256
        self.text: list[str] = []
        for i in range(p.vocab_size()):
            s = p.id_to_piece(i)
            if p.is_byte(i):
                b = int(s[3:5], 16)
                self.byte[b] = i
                self.text.append(chr(b) if 0 < b < 128 else f"\0{s[3:5]}")  # such a byte is a character in any run
            elif p.is_control(i) or p.is_unknown(i):
                self.text.append("")
            else:
                s = s.replace(SPACE, " ")
                self.text.append(s)
                if " " in s.lstrip(" ") or "\n" in s:
                    raise ValueError("a piece goes past a space; units would not be independent")
                # Runs of spaces have no rank of their own: they share the lowest.
                rank = min(-p.get_score(i), p.vocab_size())
                self.id[s], self.logp[s] = i, -temperature * math.log(rank + 2)
        self.byte_logp = -temperature * math.log(2 * p.vocab_size())
        self.longest = max(map(len, self.id))
        self.levels = [self._level(k) for k in range(1, self.longest + 1)]

    def _level(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the pieces' beginnings of length k: hashes in order, the piece that ends there or -1, its log-probability."""
        starts = sorted({s[:k] for s in self.id if len(s) >= k}, key=_hash)
        return np.array([_hash(s) for s in starts], np.uint64), np.array([self.id.get(s, -1) for s in starts], np.int32), np.array([self.logp.get(s, 0.0) for s in starts])

    def edges(self, units: list[str]):
        """Of all units, one after the other: edges (start, end, log-probability, piece) between character positions, the
        position that each unit starts at, and the byte strings; a byte string's piece is -2 - its number, a single byte's its own."""
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        length = np.array([len(u) for u in units], np.int64)
        start = np.cumsum(length) - length
        end = np.repeat(start + length, length)
        at, h, found = np.arange(len(codes)), np.zeros(len(codes), np.uint64), []
        for k, (hashes, piece, logp) in enumerate(self.levels):
            h = h * _BASE + codes[at + k] + np.uint64(1)
            place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            known = hashes[place] == h
            place, at, h = place[known], at[known], h[known]
            is_piece = piece[place] >= 0
            found.append((at[is_piece], np.full(is_piece.sum(), k + 1), logp[place[is_piece]], piece[place[is_piece]]))
            if k == 0:
                bare = np.ones(len(codes), bool)
                bare[found[0][0]] = False
            more = at + k + 1 < end[at]
            at, h = at[more], h[more]
        bare = np.flatnonzero(bare)
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in codes[bare].tolist()]
        own = np.array([self.byte[r[0]] if len(r) == 1 else -1 for r in raw], np.int64)
        found.append((bare, np.ones(len(bare), np.int64), self.byte_logp * np.array([len(r) for r in raw], float), np.where(own >= 0, own, -2 - np.arange(len(bare)))))
        first, size, logp, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        return first, first + size, logp, piece.astype(np.int32), start, length, raw


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _hash(s: str) -> int:
    h = 0
    for c in s:
        h = (h * int(_BASE) + ord(c) + 1) & (2**64 - 1)
    return h


@cache
def load(model: str, temperature: float) -> Pieces:
    return Pieces(model, temperature)


class Lattices:
    """Forward-filtered lattices of units as arrays. A unit of n characters has n + 1 nodes; a node's edges lead back, with
    running conditional probabilities; longer pieces come first."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}  # last node of a unit
        self.raw: list[bytes] = []
        self.nodes = self.held = 0
        self.first = np.zeros(1 << 16, np.int32)  # of a node: its first edge; one more at the end
        self.run, self.back, self.piece = np.empty(1 << 18), np.empty(1 << 18, np.int32), np.empty(1 << 18, np.int32)

    @staticmethod
    def _room(array: np.ndarray, n: int) -> np.ndarray:
        return array if n <= len(array) else np.concatenate([array, np.empty(max(n - len(array), len(array) // 2), array.dtype)])

    def add(self, units: list[str]) -> None:
        first, last, logp, piece, start, length, raw = self.pieces.edges(units)
        unit = np.repeat(np.arange(len(units)), length)
        shift = unit[first]  # a unit has one node more than characters
        step = last - start[shift]
        alpha = np.zeros(length.sum() + len(units))
        first, last = first + shift, last + shift
        # Forwards by position in the unit, over all units at once.
        longest = self.pieces.longest + 1
        by_end = last * longest + (longest - (last - first))  # longer pieces first; no two edges have one key
        order = np.argsort(step * (longest * len(alpha) + longest) + by_end)
        first, last, logp, piece, step = first[order], last[order], logp[order], piece[order], step[order]
        new = np.flatnonzero(np.concatenate(([True], last[1:] != last[:-1])))
        bounds = np.searchsorted(step[new], np.arange(1, length.max() + 2))
        for k in range(len(bounds) - 1):
            own = new[bounds[k] : bounds[k + 1]]
            stop = new[bounds[k + 1]] if bounds[k + 1] < len(new) else len(last)
            z = alpha[first[own[0] : stop]] + logp[own[0] : stop]
            at = own - own[0]
            most = np.maximum.reduceat(z, at)
            total = np.add.reduceat(np.exp(z - np.repeat(most, np.diff(np.append(at, len(z))))), at)
            alpha[last[own]] = most + np.log(total)
        p = np.exp(alpha[first] + logp - alpha[last])
        order = np.argsort(last * longest + (longest - (last - first)), kind="stable")  # nearly in order
        first, last, piece, p = first[order], last[order], piece[order], p[order]
        new = np.flatnonzero(np.concatenate(([True], last[1:] != last[:-1])))
        size = np.diff(np.append(new, len(last)))
        total = np.cumsum(p)
        run = total - np.repeat(total[new] - p[new], size)
        run[new + size - 1] = 2.0  # the last edge takes what rounding leaves
        counts = np.zeros(len(alpha), np.int64)
        counts[last[new]] = size
        n, e = self.nodes + len(alpha), self.held + len(last)
        self.first = self._room(self.first, n + 1)
        self.run, self.back, self.piece = (self._room(x, e) for x in (self.run, self.back, self.piece))
        self.first[self.nodes : n + 1] = self.held + np.concatenate(([0], np.cumsum(counts)))
        self.run[self.held : e], self.back[self.held : e] = run, last - first
        self.piece[self.held : e] = np.where(piece < 0, piece - len(self.raw), piece)
        self.raw += raw
        self.at.update(zip(units, (self.nodes + np.cumsum(length + 1) - 1).tolist(), strict=True))
        self.nodes, self.held = n, e


def _uniform(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def seed_of(key, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}:{'null' if key is None else key}".encode(), digest_size=8).digest(), "little")


def encode_batch(texts: list[str | None], keys: list, lattices: Lattices, seed: int) -> list[np.ndarray]:
    """Piece ids of each text."""
    if lattices.held > MOST_EDGES:
        lattices.clear()
    every, counts = [], []
    for text in texts:
        units = _UNITS.findall(" " + text) if text else []
        counts.append(len(units))
        every += units
    counts = np.array(counts)
    if not every:
        return [np.empty(0, np.int32) for _ in texts]
    if new := [u for u in dict.fromkeys(every) if u not in lattices.at]:
        lattices.add(new)
    first, run, back, piece = lattices.first, lattices.run, lattices.back, lattices.piece
    node = np.fromiter(map(lattices.at.__getitem__, every), np.int64, len(every))
    place = np.arange(len(node)) - np.repeat(np.cumsum(counts) - counts, counts)
    base = np.repeat(np.array([seed_of(k, seed) for k in keys], np.uint64), counts) + place.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
    live, step, taken = np.arange(len(node)), 0, []
    while len(live):
        u = _uniform(base[live] + np.uint64((step * 0x9E3779B97F4A7C15) & (2**64 - 1)))
        edge = first[node[live]].astype(np.int64)
        more = np.flatnonzero(run[edge] <= u)
        while len(more):
            edge[more] += 1
            more = more[run[edge[more]] <= u[more]]
        taken.append((live, piece[edge]))
        node[live] -= back[edge]
        live = live[first[node[live] + 1] > first[node[live]]]
        step += 1
    steps = np.zeros(len(node), np.int64)
    for live, _ in taken:
        steps[live] += 1
    end = np.cumsum(steps)
    flat = np.empty(end[-1], np.int32)
    for k, (live, p) in enumerate(taken):
        flat[end[live] - 1 - k] = p
    bounds = np.concatenate(([0], np.cumsum(np.add.reduceat(np.append(steps, 0), np.minimum(np.cumsum(counts) - counts, len(steps))) * (counts > 0))))
    out = []
    for i in range(len(texts)):
        ids = flat[bounds[i] : bounds[i + 1]]
        if len(ids) and ids.min() < 0:
            ids = np.array([x for p in ids.tolist() for x in ([p] if p >= 0 else [lattices.pieces.byte[b] for b in lattices.raw[-2 - p]])], np.int32)
        out.append(ids)
    return out


_BYTES = re.compile("(?:\0[0-9A-F]{2})+")


def decode(ids, pieces: Pieces) -> str:
    """The text again: spaces from U+2581, runs of byte pieces as UTF-8, without the dummy space."""
    text = "".join(map(pieces.text.__getitem__, ids))
    if "\0" in text:
        text = _BYTES.sub(lambda m: bytes.fromhex(m[0].replace("\0", "")).decode("utf-8", "surrogatepass"), text)
    return text[1:]


def encode_documents(docs: DataFrame, model: str = MODEL, temperature: float = 1.0, seed: int = 42) -> DataFrame:
    """doc_id, n_chars, piece_ids, n_pieces, ids_sha256 (of the ids as 32-bit little-endian numbers) and lossless."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model, temperature)
        lattices = Lattices(pieces)
        for b in batches:
            texts, keys = b.column("text").to_pylist(), b.column("doc_id").to_pylist()
            ids = encode_batch(texts, keys, lattices, seed)
            same = [decode(x.tolist(), pieces) == (t or "") for x, t in zip(ids, texts, strict=True)]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), pa.array([len(t or "") for t in texts], pa.int64()), pa.array(offsets[1:] - offsets[:-1], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids], pa.string()), pa.array(same, pa.bool_()),
                    pa.ListArray.from_arrays(offsets, np.concatenate(ids) if ids else np.empty(0, np.int32)),
                ],
                ["doc_id", "n_chars", "n_pieces", "ids_sha256", "lossless", "piece_ids"],
            )

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_chars long, n_pieces long, ids_sha256 string, lossless boolean, piece_ids array<int>")
