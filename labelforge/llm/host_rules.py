"""Quality rules per text and per host, in DataFrame functions only.

Each rule's failures are counted by host, a rate is shrunk by a beta prior fitted to all hosts, and the verdict on the host
comes back to its documents: where a host's rate lies far above that of all hosts, its documents that fail the rule go,
and all of its documents where it fails in more than half.

Defined cases: a null text has no words; ties of rates are no excess; very long texts are counted whole; a null host counts as the host ''; an empty table gives no rows; repeated rows
stay and count each; only the columns named here are read, so others may have any name.
Eight-word windows are compared by 64-bit hashes within one text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.llm.common import WORD_BREAK, materialise

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once per row, also where lambdas in the body use it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WORD_BREAK), lambda w: w != "")


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def repeated_words(words: Column, size: int = 8) -> Column:
    """Words in windows of `size` words that occur at least twice in the text, first occurrences included."""

    def covered(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            marked = F.transform(s, lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"]))
            return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

        def width(p: Column) -> Column:
            steps = F.transform(p, lambda at, j: F.least(F.lit(size), F.coalesce(F.get(p, j + 1) - at, F.lit(size))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return let(let(pairs, starts), width)

    windows = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (size - 1)), lambda i: F.xxhash64(F.slice(h, i, size)))
    counted = lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w))
    of = lambda h: F.when(F.size(h) < size, 0).otherwise(let(windows(h), counted))
    return let(F.transform(words, lambda w: F.xxhash64(w)), of).cast("long")


def repeated_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(without(x, SPACES)) > 0)
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def text_rules(docs: DataFrame, host: str = "source", least_words: int = 20, most_repeated: int = 30) -> DataFrame:
    """doc_id, host, counts and base_failed of each text."""
    text = F.coalesce("text", F.lit(""))
    # The counts over words share one array: struct fields of one let(), so the text is split once.
    counts = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    found = docs.select(
        "doc_id", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), counts.alias("c"),
        F.length(without(text, SPACES)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        repeated_lines(text).alias("n_dup_lines"),
    ).select("doc_id", "host", "c.n_words", "word_chars", "n_symbols", "n_dup_lines", "c.n_repeat_words")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return found.withColumn("base_failed", failed)


def rule_failures(max_symbols: int = 10, max_dup_lines: int = 30, shortest_word: int = 2, longest_word: int = 40) -> dict[str, Column]:
    """The rules by name, over the counts of text_rules: few words, repeated words, symbols (of 100 words at most so many),
    repeated lines (of 100 words), and words that are too short or long on average."""
    n, words = F.col("n_words"), F.col("word_chars")
    return {
        "few_words": n < 20,
        "repeats": 100 * F.col("n_repeat_words") > 30 * n,
        "symbols": 100 * F.col("n_symbols") > max_symbols * n,
        "lines": 100 * F.col("n_dup_lines") > max_dup_lines * n,
        "word_length": (n > 0) & ((words < shortest_word * n) | (words > longest_word * n)),
    }


def host_rates(rules: DataFrame, failures: dict[str, Column]) -> DataFrame:
    """One row for each host: host_docs, for each rule failed_* and rate_*, the failure rate shrunk to that of all hosts by a
    beta prior, and limit_*, what a host's rate may be.

    The prior of a rule is fitted to all hosts by moments: the mean is the rate of all documents, the strength follows from
    the spread of hosts' rates beyond what chance gives. The limit is LIMIT standard deviations of that spread above the mean,
    but no more than MOST_RATE."""
    counts = [F.count_if(f).alias(f"failed_{name}") for name, f in failures.items()]
    hosts = materialise(rules.groupBy("host").agg(F.count("*").alias("host_docs"), *counts), "hosts")
    n = F.col("host_docs")
    sums = [F.sum("host_docs").alias("docs"), F.count("*").alias("hosts"), F.sum(n * n).alias("squares")]
    for name in failures:
        sums += [F.sum(f"failed_{name}").alias(name), F.sum(F.col(f"failed_{name}") * F.col(f"failed_{name}") / n).alias(f"{name}_square")]
    found = hosts.agg(*sums).first()
    docs, columns = found["docs"] or 0, {}
    for name in failures:
        mean, strength, spread = prior(docs, found["hosts"], found["squares"] or 0, found[name] or 0, found[f"{name}_square"] or 0.0)
        columns[f"rate_{name}"] = (F.col(f"failed_{name}") + mean * strength) / (n + strength)
        columns[f"limit_{name}"] = F.lit(min(mean + LIMIT * spread, MOST_RATE))
    return hosts.withColumns(columns)


#: Standard deviations of hosts' true rates by which a host's shrunk rate may lie above the mean, the least room there is, and
#: the rate beyond which a host loses all its documents.
LIMIT, LEAST_ROOM, MOST_RATE = 2.0, 0.05, 0.5


def prior(docs: int, hosts: int, squares: int, failed: int, square: float) -> tuple[float, float, float]:
    """Mean, strength and spread (at least LEAST_ROOM / LIMIT) of a beta prior by the moments of hosts' counts (square: sum
    of failed**2 / docs), after the within-host part is taken off the variance between hosts."""
    if not docs:
        return 0.0, 1.0, LEAST_ROOM / LIMIT
    mean = failed / docs
    room = docs - squares / docs
    between = (square - docs * mean * mean - (hosts - 1) * mean * (1 - mean)) / room if room > 0 else 0.0
    between = min(max(between, 1e-9), max(mean * (1 - mean), 1e-9))
    strength = min(max(mean * (1 - mean) / between - 1, 1.0), 1000.0)
    return mean, strength, max(between**0.5, LEAST_ROOM / LIMIT)


def host_verdicts(docs: DataFrame, host: str = "source") -> DataFrame:
    """Every document with its counts, its own verdict, its host's rates, and `kept`: it passes the base rules, and it isn't a
    document that fails a rule which its host fails too often. A host that fails a rule in most of its documents loses all."""
    rules = materialise(text_rules(docs, host), "text-rules")
    failures = rule_failures()
    hosts = materialise(host_rates(rules, failures), "host-rates")
    joined = rules.join(hosts, "host")
    off = F.lit(False)
    for name, failed in failures.items():
        high = F.col(f"rate_{name}") > F.col(f"limit_{name}")
        off = off | (high & (failed | (F.col(f"rate_{name}") > MOST_RATE)))
    return joined.withColumns({"host_off": off, "host_failed": F.greatest(*[F.col(f"failed_{x}") for x in failures])}).withColumn("kept", ~F.col("base_failed") & ~F.col("host_off"))
