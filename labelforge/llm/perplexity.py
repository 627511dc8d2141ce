"""Quality by perplexity under an interpolated modified Kneser-Ney model over five-grams of characters.

A code point is a symbol of 12 bits: those below 0x800 stand for themselves (letters in lower case, all digits as 0, all
white space as a space), others are hashed to the upper half; so a five-gram of any script is a number of 60 bits, and its
context and its suffix are a quotient and a remainder of it.

Training: each task sums the five-grams of its trusted texts (label quality 1), Spark sums and shards them. Continuation
counts, discounts and context totals of every order are group-bys and joins of these sharded counts. The model is a table
of grams of all orders, as large as the trusted text makes it: a gram's discounted share, and the weight that it leaves to
shorter grams as a context.

Scoring: the texts are packed into blocks. The distinct grams of a block, of all orders, are joined with the model's
shards, and what is found comes back as one small file for each block. A task then reads the block, its grams' parts, and
interpolates from the shortest order up. So a gram is sent once for each block that has it, not for each place where it
stands, and no worker holds the model.

A text's perplexity is kept within its language's limit: the `quantile` of its held-out trusted texts' perplexities. One
trusted text in HELD_OUT (by crc32 of doc_id) is left out of the counts for that, as the model knows the grams of the texts
it has counted and would set limits that no new text keeps. A quantile that n texts are too few for (n below 1 / (1 -
quantile)) is at least that of a normal law of the logarithms, with (1 + 2 / sqrt(n)) times their deviation. A language of
fewer than LEAST_HELD held-out texts has the limit of all held-out texts; if these are as few, that of all trusted texts.

Defined cases: null and empty texts have no perplexity and aren't kept; without trusted text every other text is kept and
perplexity is that of 4096 equally likely symbols; a document labelled twice is trusted if any label says so; repeated
rows stay, rows that repeat a trusted doc_id are all trusted; very long texts are used whole; columns other than doc_id,
text and lang aren't read, so they may have any name; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.llm.common import fold, map_batches, materialise, scratch

SYMBOLS, ORDER = 4096, 5
HELD_OUT, LEAST_HELD = 5, 3
#: A row of a block ends at so many characters, a block at so many.
ROW_CHARS, BLOCK_CHARS = 2 << 20, 64 << 20
#: A gram's key has its order above its code.
_TAG = 60


def _table() -> np.ndarray:
    out = np.arange(0x800, dtype=np.uint16)
    for c in range(0x800):
        s = chr(c)
        low = s.lower()
        if s.isspace():
            out[c] = 32
        elif s.isdecimal():
            out[c] = 48
        elif len(low) == 1 and ord(low) < 0x800:
            out[c] = ord(low)
    return out


_SYMBOL = _table()


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = _SYMBOL[np.minimum(codes, 0x7FF)]
    if len(codes) and codes.max() >= 0x800:
        mixed = 0x800 + ((codes * np.uint32(0x9E3779B1)) >> np.uint32(21))
        return np.where(codes < 0x800, low, mixed).astype(np.uint16)
    return low


def grams(texts: list[np.ndarray]) -> np.ndarray:
    """The five-gram that ends at each symbol, text after text; each text begins after four spaces."""
    gap = np.full(ORDER - 1, 32, np.uint16)
    s = np.concatenate([x for t in texts for x in (gap, t)] or [gap]).astype(np.int64)
    g = s[: len(s) - ORDER + 1].copy()
    for k in range(1, ORDER):
        g = g * SYMBOLS + s[k : len(s) - ORDER + 1 + k]
    # The grams that end in a gap go.
    keep = np.ones(len(g), bool)
    ends = np.cumsum(np.array([len(t) + ORDER - 1 for t in texts], np.int64))[:-1] - (ORDER - 1)
    keep[(ends[:, None] + np.arange(ORDER - 1)).ravel()] = False
    return g[keep]


def keys_of(codes: np.ndarray) -> np.ndarray:
    """Distinct keys of the given five-grams, their contexts and all that are shorter."""
    out, g = [], codes
    for order in range(ORDER, 0, -1):
        out.append(g + (order << _TAG))
        context = pd.unique(g // SYMBOLS)
        out.append(context + ((order - 1) << _TAG))
        g = pd.unique(g % SYMBOLS ** (order - 1))
    return pd.unique(np.concatenate(out))


BLOCKS = "block long, doc_id array<long>, lang array<string>, length array<long>, symbols binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer, part, block, in_block, rows, held = zstandard.ZstdCompressor(level=6), TaskContext.get().partitionId() << 24, 0, 0, [], 0

    def row() -> pa.RecordBatch:
        ids, langs, texts = zip(*rows, strict=True)
        data = packer.compress(np.concatenate(texts).astype("<u2").tobytes().decode("utf-16-le").encode())
        columns = [pa.array([part | block], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([langs], pa.list_(pa.string())), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([data], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["block", "doc_id", "lang", "length", "symbols"])

    for b in batches:
        for doc_id, text, lang in zip(*(b.column(x).to_pylist() for x in ("doc_id", "text", "lang")), strict=True):
            rows.append((doc_id, lang, symbols(text or "")))
            held += len(rows[-1][2])
            if held >= ROW_CHARS or len(rows) >= 20_000:
                yield row()
                in_block, rows, held = in_block + held, [], 0
                if in_block >= BLOCK_CHARS:
                    block, in_block = block + 1, 0
    if rows:
        yield row()


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list, np.ndarray, list[np.ndarray]]]:
    """Block, ids, languages, lengths and texts of each row."""
    opener = zstandard.ZstdDecompressor()
    for b in batches:
        for k in range(b.num_rows):
            block, ids, langs, length, data = (b.column(x)[k].as_py() for x in ("block", "doc_id", "lang", "length", "symbols"))
            ends = np.cumsum(length)
            yield block, ids, langs, np.array(length, np.int64), np.split(np.frombuffer(opener.decompress(data).decode().encode("utf-16-le"), "<u2"), ends[:-1])


def _side_file(where: str, block: int) -> pd.DataFrame | None:
    """What was written under block=N."""
    store, path = fs.FileSystem.from_uri(f"{where}/block={block}")
    if store.get_file_info(path).type == fs.FileType.NotFound:
        return None
    tables = []
    for info in store.get_file_info(fs.FileSelector(path)):
        if info.path.endswith(".parquet"):
            with pq.ParquetFile(store.open_input_file(info.path)) as f:
                tables.append(f.read())
    return pa.concat_tables(tables).to_pandas()


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of trusted texts, and held_out: whether they are for the limits, not for the counts."""
    return labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().withColumn("held_out", fold(F.col("doc_id")) % HELD_OUT == 0)


def count_trusted(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """(code, n) of all five-grams of trusted text. Only ids are joined; a task learns its block's from a file."""
    where = scratch(blocks.sparkSession, "trusted")
    ids = blocks.select("block", F.explode("doc_id").alias("doc_id")).join(trusted_ids(labels).where("not held_out").hint("merge"), "doc_id")
    ids.select("block", "doc_id").distinct().repartition("block").write.partitionBy("block").parquet(where)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, trusted, total, waiting, held = None, set(), pd.Series(dtype=np.int64), [], 0

        def merged() -> pd.Series:
            codes, n = np.unique(np.concatenate(waiting), return_counts=True)
            return total.add(pd.Series(n, codes), fill_value=0).astype(np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(total), 100_000):
                part = total.iloc[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part.index.to_numpy(np.int64)), pa.array(part.to_numpy(np.int64))], ["code", "n"])

        for block, ids, _, _, texts in _unpack(batches):
            if at != block:
                found = _side_file(where, block)
                at, trusted = block, set() if found is None else set(found["doc_id"].tolist())
            own = [t for d, t in zip(ids, texts, strict=True) if d in trusted and len(t)]
            if own:
                waiting.append(grams(own))
                held += len(waiting[-1])
            if held >= 4_000_000:
                total, waiting, held = merged(), [], 0
                if len(total) >= 3_000_000:
                    yield from out()
                    total = total.iloc[:0]
        if waiting:
            total = merged()
        yield from out()

    return materialise(map_batches(blocks, run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "gram-counts")


def train(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """The model: key, part (a gram's discounted share of its context) and gamma (what a context leaves to shorter grams)."""
    counts, tables = count_trusted(blocks, labels), []
    for order in range(ORDER, 0, -1):
        n1, n2, n3, n4 = counts.agg(*[F.count_if(F.col("n") == k) for k in (1, 2, 3, 4)]).first()
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
        d = [min(max(k - (k + 1) * y * b / a, 0.0), float(k)) if a else 0.5 * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        discount = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        counts = counts.withColumns({"context": F.expr(f"code div {SYMBOLS}"), "discount": discount})
        contexts = counts.groupBy("context").agg(F.sum("n").alias("total"), F.sum("discount").alias("given"))
        contexts = materialise(contexts, "contexts")
        key = lambda code, k: (F.col(code) + F.lit(k << _TAG)).alias("key")
        parts = counts.join(contexts, "context").select(key("code", order), ((F.col("n") - F.col("discount")) / F.col("total")).cast("float").alias("part"), F.lit(None).cast("float").alias("gamma"))
        gammas = contexts.select(key("context", order - 1), F.lit(None).cast("float").alias("part"), (F.col("given") / F.col("total")).cast("float").alias("gamma"))
        tables += [parts, gammas]
        if order > 1:  # how many different symbols stand before the shorter gram
            counts = materialise(counts.groupBy((F.col("code") % SYMBOLS ** (order - 1)).alias("code")).agg(F.count("*").alias("n")), "continuations")
    model = tables[0]
    for t in tables[1:]:
        model = model.unionByName(t)
    return materialise(model.groupBy("key").agg(F.max("part").alias("part"), F.max("gamma").alias("gamma")), "kneser-ney")


def _block_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (block, key) of a task's rows, as far as its memory goes: a block is sent in parts if it has many."""
    at, held = None, np.empty(0, np.int64)

    def out() -> Iterator[pa.RecordBatch]:
        keys = np.sort(keys_of(held))
        for i in range(0, len(keys), 100_000):
            part = keys[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), at, np.int64)), pa.array(part)], ["block", "key"])

    for block, _, _, _, texts in _unpack(batches):
        if at is not None and (at != block or len(held) >= 4_000_000):
            yield from out()
            held = np.empty(0, np.int64)
        at = block
        held = pd.unique(np.concatenate([held, grams([t for t in texts if len(t)])]))
    if at is not None:
        yield from out()


def probabilities(codes: np.ndarray, key: np.ndarray, part: np.ndarray, gamma: np.ndarray) -> np.ndarray:
    """Of five-grams, from the sorted keys that the model has: interpolated from the shortest order up."""

    def look(wanted: np.ndarray, values: np.ndarray, otherwise: float) -> np.ndarray:
        at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        found = values[at]
        return np.where((key[at] == wanted) & ~np.isnan(found), found, otherwise)

    p = np.full(len(codes), 1 / SYMBOLS)
    if len(key):
        for order in range(1, ORDER + 1):
            g = codes % SYMBOLS**order
            # An unseen context leaves all to the shorter grams.
            p = look(g + (order << _TAG), part, 0.0) + look(g // SYMBOLS + ((order - 1) << _TAG), gamma, 1.0) * p
    return p


def score(blocks: DataFrame, model: DataFrame) -> DataFrame:
    """doc_id, lang, n_chars and perplexity per character."""
    where = scratch(blocks.sparkSession, "block-grams")
    asked = map_batches(blocks, _block_keys, "block long, key long")  # a key that a block's parts repeat does no harm
    asked.join(model.hint("merge"), "key").repartition("block").sortWithinPartitions("block", "key").write.option("compression", "zstd").partitionBy("block").parquet(where)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, key, part, gamma = None, *(np.empty(0, t) for t in (np.int64, np.float32, np.float32))
        for block, ids, langs, length, texts in _unpack(batches):
            if at != block:
                found = _side_file(where, block)
                at = block
                if found is not None:
                    found = found.sort_values("key")
                    key, part, gamma = (found[x].to_numpy() for x in ("key", "part", "gamma"))
                else:
                    key = np.empty(0, np.int64)
            place, codes = pd.factorize(grams([t for t in texts if len(t)]))
            total = np.concatenate(([0.0], np.cumsum(np.log(np.maximum(probabilities(codes, key, part, gamma), 1e-12))[place])))
            end = np.cumsum(length)
            mean = (total[end] - total[end - length]) / np.maximum(length, 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(length), pa.array(np.exp(-mean), pa.float64(), mask=length == 0)],
                ["doc_id", "lang", "n_chars", "perplexity"],
            )

    return map_batches(blocks, run, "doc_id long, lang string, n_chars long, perplexity double")


def perplexities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    blocks = materialise(map_batches(docs.select("doc_id", "text", "lang"), _pack, BLOCKS), "blocks")
    return materialise(score(blocks, train(blocks, labels)), "perplexities")


def _limit(quantile: float) -> tuple[Column, Column]:
    """texts and most: how many perplexities there are, and their limit."""
    texts, seen = F.count("perplexity"), F.percentile_approx("perplexity", quantile, 10_000)
    spread = F.coalesce(F.stddev_samp(F.log("perplexity")), F.lit(0.0)) * (1 + 2 / F.sqrt(texts))
    normal = F.exp(F.avg(F.log("perplexity")) + NormalDist().inv_cdf(quantile) * spread)
    return texts.alias("texts"), F.when(texts * (1 - quantile) < 1, F.greatest(seen, normal)).otherwise(seen).alias("most")


def keep_fluent(docs: DataFrame, labels: DataFrame, quantile: float = 0.995) -> DataFrame:
    """doc_id, lang, n_chars, perplexity, most (the language's limit) and kept."""
    scores = perplexities(docs, labels).withColumn("_lang", F.coalesce("lang", F.lit("")))
    trusted = materialise(scores.where("perplexity is not null").join(trusted_ids(labels).hint("merge"), "doc_id").select("_lang", "perplexity", "held_out"), "trusted-perplexities")
    held = trusted.where("held_out")
    limits = materialise(held.groupBy("_lang").agg(*_limit(quantile)).where(F.col("texts") >= LEAST_HELD).select("_lang", "most"), "limits")
    both = held.agg(*_limit(quantile)).first(), trusted.agg(*_limit(quantile)).first()
    overall = next((x["most"] for x in both if x["texts"] >= LEAST_HELD), both[1]["most"])
    out = scores.join(limits, "_lang", "left").withColumn("most", F.coalesce("most", F.lit(overall if overall is not None else float("inf"))))
    return out.select("doc_id", "lang", "n_chars", "perplexity", "most", F.coalesce(F.col("perplexity") <= F.col("most"), F.lit(False)).alias("kept"))
