"""Language identification as a mixture: what share of a text's words each language has.

A word's likelihood in a language is that of its character trigrams (ends marked, lower case), hashed to 2**15 buckets with
additive smoothing. Expectation-maximisation gives each text's proportions. The set of languages grows greedily: the
language that the full mixture favours most joins if the log-likelihood rises by more than the penalty, PENALTY + ln(words).
The prediction is the language with the largest proportion in the final set, the score that proportion.

Counts are taken from all documents of the training folds; the model is a table in the shared folder, one row of 2**15
numbers a language. Workers read it in blocks of BLOCK languages, so there may be any number of them: the languages that a
block's mixtures choose, and the SPARE best of the others, meet the next block's. Up to BLOCK languages are one block.

Defined cases: null texts and texts without letters are `und` with score 0; documents without language or doc_id aren't
learned from; with nothing to learn from all is `und`; repeated rows count each.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelforge.llm.common import fold, map_batches, materialise, scratch

BUCKETS = 1 << 15
BLOCK, SPARE = 64, 8
HELD_BLOCKS = 4  # more are read again for each batch of texts
PENALTY = 6.0
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case. To `re`, fractions and raised, circled and Roman numerals are as good as letters, so
    what holds one is cut there; a class without these 1,800 characters would be walked for every character."""
    found = _WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split(" ")) if x]


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams of the words, and where each word's begin; every word has at least one."""
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = (codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2:]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    middle = np.flatnonzero(codes[1:-1] == 32)  # trigrams around a space belong to no word
    size = np.array([len(w) for w in words], np.int64)
    h = np.delete(h, middle) >> np.uint64(49)
    return h.astype(np.int64), np.cumsum(size) - size


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for b in batches:
        by: dict[str, list[str]] = {}
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            by.setdefault(lang, []).extend(words_of(text))
        for lang, words in by.items():
            if words:
                new = np.bincount(trigrams(words)[0], minlength=BUCKETS)
                counts[lang] = counts[lang] + new if lang in counts else new
    for lang, c in counts.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(c[at], pa.int64())], ["lang", "bucket", "n"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in b.to_pylist():
            c = np.full(BUCKETS, 0.5)
            for x in row["counts"]:
                c[x["bucket"]] += x["n"]
            yield pa.RecordBatch.from_arrays([pa.array([row["lang"]], pa.string()), pa.array([np.log(c / c.sum()).astype(np.float32).tobytes()], pa.binary())], ["lang", "vector"])


def fit(docs: DataFrame, folds: int = 5, held_out: int = 0) -> str:
    """Writes the model to the shared folder: (lang, vector), in the order of lang."""
    rows = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null").where(fold(F.col("doc_id")) % folds != held_out)
    sums = map_batches(rows.select("text", "lang"), _count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # At most BUCKETS entries a language, however many its documents are.
    counts = sums.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("counts"))
    where = scratch(docs.sparkSession, "languages")
    materialise(map_batches(counts, _vectors, "lang string, vector binary"), "language-vectors").orderBy("lang").write.parquet(where)
    return where


def blocks(where: str) -> Iterator[tuple[list[str], np.ndarray]]:
    """Languages and their log-probabilities (buckets x languages), BLOCK at a time."""
    store, path = fs.FileSystem.from_uri(where)
    names, vectors = [], []

    def table() -> np.ndarray:
        return np.ascontiguousarray(np.stack([np.frombuffer(v, np.float32) for v in vectors]).T)

    for info in sorted(store.get_file_info(fs.FileSelector(path)), key=lambda i: i.path):
        if info.path.endswith(".parquet"):
            with pq.ParquetFile(store.open_input_file(info.path)) as f:
                for b in f.iter_batches(BLOCK):
                    for lang, vector in zip(*[c.to_pylist() for c in b.columns], strict=True):
                        names.append(lang)
                        vectors.append(vector)
                        if len(names) == BLOCK:
                            yield names, table()
                            names, vectors = [], []
    if names:
        yield names, table()


def learn(docs: DataFrame, folds: int = 5, held_out: int = 0) -> tuple[list[str], np.ndarray]:
    """All languages and their log-probabilities by bucket, on the driver."""
    found = list(blocks(fit(docs, folds, held_out)))
    return [x for names, _ in found for x in names], np.concatenate([np.zeros((0, BUCKETS)), *[t.T for _, t in found]])


def _mix(p: np.ndarray, of: np.ndarray, first: np.ndarray, n: np.ndarray, pi: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """EM from pi; languages at 0 stay there. Proportions and log-likelihoods (of p, which is scaled by word)."""
    for _ in range(steps):
        r = p * pi[of]
        r /= r.sum(1, keepdims=True) + 1e-300
        pi = np.add.reduceat(r, first) / n[:, None]
    return pi, np.add.reduceat(np.log((p * pi[of]).sum(1) + 1e-300), first)


def _choose(ll: np.ndarray, n: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """ll: words x languages; n: words of each text. Proportions in the chosen set and in the full mixture."""
    first = np.cumsum(n) - n
    single = np.add.reduceat(ll, first)
    top = ll.max(1, keepdims=True)
    p, shift = np.exp(np.maximum(ll - top, -50)), np.add.reduceat(top[:, 0], first)
    of = np.repeat(np.arange(len(n)), n)
    full, _ = _mix(p, of, first, n, np.full((len(n), ll.shape[1]), 1 / ll.shape[1]), 6)
    best = single.argmax(1)
    chosen = np.zeros_like(full)
    chosen[np.arange(len(n)), best] = 1.0
    value = single[np.arange(len(n)), best] - shift
    open_ = np.ones(len(n), bool)
    while True:  # each round offers every open text the next language of its full mixture
        rest = np.where(chosen > 0, 0, full)
        new = rest.argmax(1)
        open_ &= rest.max(1) * n >= 1.5
        at = np.flatnonzero(open_)
        if not len(at):
            break
        pick = np.repeat(open_, n)
        trial = (chosen[at] > 0).astype(float)
        trial[np.arange(len(at)), new[at]] = 1
        size = n[at]
        pi, like = _mix(p[pick], np.repeat(np.arange(len(at)), size), np.cumsum(size) - size, size, trial / trial.sum(1, keepdims=True), 8)
        better = like - value[at] > penalty + np.log(size)
        chosen[at[better]], value[at[better]] = pi[better], like[better]
        open_[at[~better]] = False
    return chosen, full


def _read(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    found = [words_of(t or "") for t in texts]
    return [w for words in found for w in words], np.array([len(words) for words in found], np.int64)


def proportions(texts: list[str | None], table: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """(texts x languages); a row of zeros where a text has no letters. table: buckets x languages."""
    out = np.zeros((len(texts), table.shape[1]))
    words, counts = _read(texts)
    if words:
        buckets, begin = trigrams(words)
        out[counts > 0] = _choose(np.add.reduceat(table[buckets], begin).astype(np.float64), counts[counts > 0], penalty)[0]
    return out


def mixtures(texts: list[str | None], model: Iterable[tuple[list[str], np.ndarray]], penalty: float = PENALTY) -> list[list[tuple[str, float]]]:
    """Each text's languages with their proportions, the largest first."""
    out: list[list[tuple[str, float]]] = [[] for _ in texts]
    words, counts = _read(texts)
    if not words:
        return out
    rows = np.flatnonzero(counts)
    n = counts[rows]
    of = np.repeat(np.arange(len(rows)), n)
    buckets, begin = trigrams(words)
    ll = own = chosen = full = None
    for names, table in model:
        new = np.add.reduceat(table[buckets], begin).astype(np.float64)
        here = np.broadcast_to(np.array(names, object), (len(rows), len(names)))
        if ll is not None:
            width = min(full.shape[1], int((chosen > 0).sum(1).max()) + SPARE)
            held = np.argsort(-((chosen > 0) * 2 + full), axis=1, kind="stable")[:, :width]
            new = np.concatenate([np.take_along_axis(ll, held[of], 1), new], 1)
            here = np.concatenate([np.take_along_axis(own, held, 1), here], 1)
        ll, own = new, here
        chosen, full = _choose(ll, n, penalty)
    for k, row in enumerate(rows if ll is not None else []):
        out[row] = [(own[k, j], float(chosen[k, j])) for j in np.argsort(-chosen[k], kind="stable") if chosen[k, j] > 0]
    return out


def identify(docs: DataFrame, where: str, folds: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred, score, and `languages`: the chosen set with proportions in hundredths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if held is None:
                held = list(islice(blocks(where), HELD_BLOCKS + 1))
            found = mixtures(b.column("text").to_pylist(), held if len(held) <= HELD_BLOCKS else blocks(where))
            names = [x[0][0] if x else "und" for x in found]
            score = [min(x[0][1], 1.0) if x else 0.0 for x in found]
            sets = [",".join(f"{lang}:{round(100 * p)}" for lang, p in x) for x in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.string())], ["doc_id", "lang_pred", "score", "languages"])

    found = map_batches(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double, languages string")
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id")) % folds == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "languages")


def identify_documents(docs: DataFrame) -> DataFrame:
    return identify(docs, fit(docs))
