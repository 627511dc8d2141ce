"""Phrase collocation mining: phrases of two to four words that occur far more often than their parts suggest.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and packed into blocks of one language, kept as
distinct words and the numbers of the words at each place, so words are split and hashed once. Each block gives its
share of a count sketch: every phrase of one to four words, with its language, falls into one of many cells (one hash row;
a cell for each four to eight bytes of text, so that a cell's count exceeds its phrases' by two to five), and a block sends
its cells and counts, packed, to the shards of the cells. A shard sums and answers each block with those of its cells
that reach the least count. A cell's sum is an upper bound for each of its phrases, and so are the sums of the cells of the
phrases within it; a phrase whose every bound reaches the least count is a candidate of the block. Candidates
compile into one Aho-Corasick automaton for a block, over two letters a word: one of the letters that begin a word, one of those
that end it, so a match begins and ends with a word. What no candidate covers is a single delimiter; a scan counts all matches,
overlaps included (single words are counted as they are), and the blocks' counts, as sorted lists of phrases that compress well, are
summed exactly. Nothing that is frequent enough is missed, as bounds are never too
low, and what the sketch let through wrongly falls to the threshold. What moves is a packed cell for each distinct phrase of a
block; what a task holds is bounded by the block.

Scores compare a phrase with its parts at its worst cut. Phrases inside a longer candidate of nearly the same count go.

Defined cases: a null lang is `und`; null, empty and wordless texts have no words; repeated rows count each; texts of any
length are cut into blocks between pieces (a single piece is never cut); ties go by count, then by phrase in UTF-8 order; other
columns, whatever their names, are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache
from operator import itemgetter
from zlib import crc32

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelforge.llm.common import WordTable, hash64, map_batches, materialise
from labelforge.llm.jaccard_join import mix64

LONGEST = 4
LEAST_COUNT = 30
#: A longer candidate with so many percent of a phrase's count stands for it.
COVERED = 80
TOP = 2000
#: Bytes of text in a block, and for each shard of the sketch.
BLOCK_BYTES, SHARD_BYTES = 8 << 20, 4 << 20
#: Parts of a language that are ranked on their own first.
RANK_PARTS = 64
BREAK = b"."
_TO_BREAK = bytes(ord(BREAK) if chr(i) in ".,;:!?\n\x0b\x0c\r" else i for i in range(256))
_P = np.uint64(0x9E3779B97F4A7C15)
_words = WordTable(hash64)


def tokens(text: str) -> bytes:
    """Words and breaks (which no word contains), each after a space, with a break at the end."""
    data = text.encode("utf-8", "surrogatepass").lower().translate(_TO_BREAK)
    return b" " + b" ".join(data.replace(BREAK, b" . ").split()) + b" . "


def cut(data: bytes, most: int) -> Iterator[bytes]:
    """Parts of about `most` bytes, cut at breaks."""
    at = 0
    while len(data) - at > most:
        end = data.rfind(b" . ", at, at + most)
        if end <= at:
            end = data.find(b" . ", at + most)
        if end < 0 or end + 3 >= len(data):
            break
        yield data[at : end + 3]
        at = end + 2
    yield data[at:]


def numbered(data: bytes) -> tuple[list[bytes], np.ndarray]:
    """The distinct words (and the break), the most frequent first, and the number of the one at each token."""
    own = data.split()
    words = [x for x, _ in Counter(own).most_common()]
    number = {x: i for i, x in enumerate(words)}
    return words, np.fromiter(map(number.__getitem__, own), np.int64, len(own))


def hashes_at(words: list[bytes], numbers: np.ndarray, lang: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each length from one word, the hash of the phrase at each token, and whether it holds no break."""
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))[numbers]
    breaks = np.cumsum(np.concatenate(([False], np.array([x == BREAK for x in words], bool)[numbers])))
    salt = np.uint64(hash64(lang.encode("utf-8", "surrogatepass")))
    hashes, whole, s = [], [], np.zeros(len(h), np.uint64)
    for k in range(1, min(LONGEST, len(h)) + 1):
        s = s[: len(h) - k + 1] * _P + h[k - 1 :]
        hashes.append(mix64(s + salt + np.uint64(k)))
        whole.append(breaks[k:] == breaks[:-k])
    return hashes, whole


def phrase_hashes(data: bytes, lang: str) -> tuple[list[bytes], list[np.ndarray], list[np.ndarray]]:
    """The tokens of a text with the hashes of their phrases."""
    words, numbers = numbered(data)
    return [words[i] for i in numbers.tolist()], *hashes_at(words, numbers, lang)


def pack(x: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1).T).view("<u8")[:, 0]


def opened(words: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(words).split(b" ")


SKETCH, TEXT = 0, 1


def blocks(block_bytes: int):
    """One pass over the texts: the words of each block, of one language, and their numbers at each place, compressed, and how
    many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, {}, 0

        def flush() -> pa.RecordBatch:
            rows = []
            for i, (lang, parts) in enumerate(held.items(), number):
                words, numbers = numbered(b"".join(parts))
                breaks = np.count_nonzero(numbers == words.index(BREAK))
                rows.append((i, lang, len(numbers) - breaks, zstandard.ZstdCompressor(level=3).compress(b" ".join(words)), pack(numbers)))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()))], ["block", "lang", "n", "words", "numbers"])

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                for part in cut(tokens(text), block_bytes):
                    if size and size + len(part) > block_bytes:
                        yield flush()
                        number, held, size = number + len(held), {}, 0
                    held.setdefault(lang, []).append(part)
                    size += len(part)
        if size:
            yield flush()

    return run


def sketches(bits: int, shards: int):
    """The distinct cells of each block, with counts, by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, lang, words, numbers in zip(*(b.column(x).to_pylist() for x in ("block", "lang", "words", "numbers")), strict=True):
                hashes, whole = hashes_at(opened(words), unpack(numbers).view(np.int64), lang)
                cell, count = np.unique(np.concatenate([h[ok] >> np.uint64(64 - bits) for h, ok in zip(hashes, whole, strict=True)]), return_counts=True)
                if not len(cell):
                    continue
                shard = ((cell >> np.uint64(max(0, bits - 32))) * np.uint64(shards)) >> np.uint64(min(bits, 32))
                border = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(cell)])).tolist()
                rows = [(int(shard[i]), block, pack(np.diff(cell[i:j], prepend=np.uint64(0))), pack(count[i:j])) for i, j in zip(border[:-1], border[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["shard", "block", "cells", "counts"])

    return run


def frequent_cells(least: int):
    """Of one shard: its cells whose sum over all blocks reaches the least count, for each block that has any."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [np.cumsum(unpack(x), dtype=np.uint64) for x in pdf["cells"]]
        cell = np.concatenate(own)
        order = np.argsort(cell, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(cell[order]) != 0)))
        total = np.add.reduceat(np.concatenate([unpack(x) for x in pdf["counts"]])[order], first)
        frequent = cell[order][first][total >= least]
        out = []
        for block, x in zip(pdf["block"], own, strict=True):
            found = x[np.searchsorted(frequent, x, side="right") > np.searchsorted(frequent, x, side="left")]
            if len(found):
                out.append((block, pack(np.diff(found, prepend=np.uint64(0)))))
        return pd.DataFrame(out, columns=["block", "cells"])

    return run


def places(hashes: list[np.ndarray], whole: list[np.ndarray], frequent: np.ndarray, bits: int) -> list[np.ndarray]:
    """For each length, the tokens at which a phrase begins of which every bound, its own and those of the phrases within it, is
    high enough."""
    if not len(frequent):
        return []
    low = np.uint64((1 << 22) - 1)
    maybe = np.zeros(int(low) + 1, bool)  # most cells are told apart by their low bits
    maybe[frequent & low] = True
    out, before = [], None
    for h, ok in zip(hashes, whole, strict=True):
        where = np.flatnonzero(ok if before is None else ok & before[:-1] & before[1:])
        cell = h[where] >> np.uint64(64 - bits)
        some = maybe[cell & low]
        where, cell = where[some], cell[some]
        where = where[frequent[np.minimum(np.searchsorted(frequent, cell), len(frequent) - 1)] == cell]
        before = np.zeros(len(h), bool)
        before[where] = True
        out.append(where)
    return out


def candidates(own: list[bytes], hashes: list[np.ndarray], whole: list[np.ndarray], frequent: np.ndarray, bits: int) -> set[bytes]:
    """The phrases at these places."""
    return {b" ".join(own[i : i + k]) for k, where in enumerate(places(hashes, whole, frequent, bits), 1) for i in where.tolist()}


def distinct(where: list[np.ndarray], numbers: np.ndarray) -> list[np.ndarray]:
    """For each length, one place of each phrase. Phrases are told apart by their words' numbers, not by hashes: the number of
    the phrase without its last word, and that word's."""
    out, of = [], np.zeros(len(numbers), np.int64)
    for k, at in enumerate(where):
        _, one, name = np.unique(of[at] * (numbers.max() + 1) + numbers[at + k], return_index=True, return_inverse=True)
        of[at] = name  # every longer phrase begins at a place of a shorter one
        out.append(at[one])
    return out


#: Letters of a word in the automaton's text: one of those from FIRST begins it, one of those from LAST to FIRST ends it.
DELIMITER, LAST, FIRST = 0, 1, 257


def letters(ranks: np.ndarray) -> str:
    """Two letters a word."""
    return np.stack([FIRST + (ranks >> 8), LAST + (ranks & 255)], -1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def matches(numbers: np.ndarray, where: list[np.ndarray], one: list[np.ndarray]) -> list[np.ndarray]:
    """How often each phrase occurs, by length from two words: all matches of an automaton of the phrases. Words are ranked
    among those that some candidate covers; what lies between covered words is one delimiter."""
    covered = np.zeros(len(numbers), bool)
    covered[where[1]] = covered[where[1] + 1] = True  # longer candidates begin and end with one of two words
    at = np.flatnonzero(covered)
    rank = np.cumsum(np.bincount(numbers[at], minlength=numbers.max() + 1) > 0) - 1
    begin = 2 * np.arange(len(at)) + np.cumsum(np.diff(at, prepend=-1) > 1)
    text = np.full(begin[-1] + 2, DELIMITER, "<u4")
    text[begin], text[begin + 1] = FIRST + (rank[numbers[at]] >> 8), LAST + (rank[numbers[at]] & 255)
    automaton, size = ahocorasick.Automaton(), 0
    for k, places_of in enumerate(one[1:], 2):
        phrases = letters(rank[numbers[places_of[:, None] + np.arange(k)]])
        for i in range(len(places_of)):
            automaton.add_word(phrases[2 * k * i : 2 * k * (i + 1)], size + i)
        size += len(places_of)
    automaton.make_automaton()
    found = np.fromiter(map(itemgetter(1), automaton.iter(text.tobytes().decode("utf-32-le", "surrogatepass"))), np.int64)
    return np.split(np.bincount(found, minlength=size), np.cumsum([len(x) for x in one[1:]])[:-1])


def scan(bits: int, shards: int):
    """Rows sorted by (block, kind), a block's frequent cells (SKETCH) before its words: how often each candidate occurs, as
    sorted lists of phrases and their counts by language and shard."""

    def count(words: list[bytes], numbers: np.ndarray, where: list[np.ndarray]) -> Iterator[tuple[int, bytes, int]]:
        """(shard, phrase, count) in the order of shards and words."""
        one = distinct(where, numbers)
        counts = [np.bincount(numbers, minlength=len(words))[numbers[one[0]]]]
        if len(where) > 1 and len(where[1]):
            counts += matches(numbers, where, one)
        order = np.empty(len(words), np.int64)
        order[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        rows = np.full((sum(map(len, one)), LONGEST), -1)
        end = 0
        for k, at in enumerate(one, 1):
            rows[end : end + len(at), :k] = numbers[at[:, None] + np.arange(k)]
            end += len(at)
        first = np.lexsort(np.where(rows < 0, -1, order[rows]).T[::-1])
        rows, words = rows[first].tolist(), [*words, b""]  # -1 is no word
        for row, n in zip(rows, np.concatenate(counts)[first].tolist(), strict=True):
            phrase = b" ".join([words[i] for i in row]).rstrip(b" ")
            yield crc32(phrase) % shards, phrase, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cells = None, []
        for b in batches:
            for block, kind, lang, packed, words, numbers in zip(*(b.column(x).to_pylist() for x in ("block", "kind", "lang", "cells", "words", "numbers")), strict=True):
                if block != at:
                    at, cells = block, []
                if kind == SKETCH:
                    cells.append(np.cumsum(unpack(packed), dtype=np.uint64))
                    continue
                if not cells:
                    continue
                frequent = np.concatenate(sorted(cells, key=itemgetter(0)))  # shards are ranges of cells
                words, numbers = opened(words), unpack(numbers).view(np.int64)
                by: dict[int, tuple[list[bytes], list[int]]] = {}
                for shard, phrase, n in count(words, numbers, places(*hashes_at(words, numbers, lang), frequent, bits)):
                    own = by.setdefault(shard, ([], []))
                    own[0].append(phrase)
                    own[1].append(n)
                rows = [(shard, zstandard.ZstdCompressor(level=6).compress(b"\n".join(own)), pack(np.array(counts, np.uint64))) for shard, (own, counts) in by.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows)), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary())))], ["lang", "shard", "phrases", "counts"])

    return run


def summed(least: int):
    """Of one language and shard: the phrases whose counts sum to the least or more."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        total: dict[bytes, int] = {}
        for phrases, counts in zip(pdf["phrases"], pdf["counts"], strict=True):
            for x, n in zip(zstandard.ZstdDecompressor().decompress(phrases).split(b"\n"), unpack(counts).tolist(), strict=True):
                total[x] = total.get(x, 0) + n
        rows = [(x.decode("utf-8", "surrogatepass"), x.count(b" ") + 1, n) for x, n in total.items() if n >= least]
        return pd.DataFrame(rows, columns=["phrase", "words", "a"]).assign(lang=pdf["lang"].iloc[0])

    return run


@cache
def _sequence_of_parts() -> list[tuple[int, int, int]]:
    """(words, from, length) of all parts of two words or more of phrases of three words or more."""
    return [(k, i, m) for k in range(3, LONGEST + 1) for m in range(2, k) for i in range(k - m + 1)]


def phrase_counts(docs: DataFrame, least: int = LEAST_COUNT, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, a) of all phrases of one to four words that occur `least` times or more, exactly, and (lang, n)."""
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits, shards = min(max(20, int(total).bit_length() - 2), 60), int(max(8, total // SHARD_BYTES))
    texts = materialise(map_batches(docs, blocks(block_bytes), "block long, lang string, n long, words binary, numbers binary"), "blocks")
    sketch = map_batches(texts.select("block", "lang", "words", "numbers"), sketches(bits, shards), "shard long, block long, cells binary, counts binary")
    frequent = sketch.groupBy("shard").applyInPandas(frequent_cells(least), "block long, cells binary")
    rows = texts.select("block", F.lit(TEXT).alias("kind"), "lang", F.lit(None).cast("binary").alias("cells"), "words", "numbers")
    rows = rows.unionByName(frequent.withColumn("kind", F.lit(SKETCH)), allowMissingColumns=True)
    rows = rows.repartition("block").sortWithinPartitions("block", "kind")
    found = map_batches(rows, scan(bits, max(8, shards // 4)), "lang string, shard long, phrases binary, counts binary")
    counts = found.groupBy("lang", "shard").applyInPandas(summed(least), "lang string, phrase string, words int, a long")
    return materialise(counts, "phrase-counts"), texts.groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, least: int = LEAST_COUNT, covered: int = COVERED, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's `top` candidates that no longer one stands for."""
    counts, words = phrase_counts(docs, least, block_bytes)
    own = counts.where("words >= 2")
    count = counts.select("lang", F.col("phrase").alias("part"), "a")
    cuts = own.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring_index(phrase, ' ', k - words)"))
    cuts = cuts.join(count.select("lang", F.col("part").alias("left"), F.col("a").alias("l")), ["lang", "left"])
    cuts = cuts.join(count.select("lang", F.col("part").alias("right"), F.col("a").alias("r")), ["lang", "right"])
    cuts = cuts.withColumn("score", F.expr("(CAST(a AS DECIMAL(20, 0)) * 2000000) DIV (CAST(l AS DECIMAL(20, 0)) + r)"))
    worst = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k"))
    scored = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), worst.alias("at")).select("lang", "phrase", "a", "at.*")

    part = lambda i, m: F.array_join(F.slice("w", i + 1, m), " ")
    parts = F.filter(F.array(*[F.when(F.col("words") == k, part(i, m)) for k, i, m in _sequence_of_parts()]), lambda x: x.isNotNull())
    longer = counts.where("words >= 3").withColumn("w", F.split("phrase", " ")).select("lang", F.explode(parts).alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a"))).drop("longer")

    order = [F.desc("score"), F.desc("a"), "phrase"]
    kept = kept.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return kept.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
