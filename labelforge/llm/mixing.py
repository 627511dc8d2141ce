"""Mixing sources to target weights, in DataFrame functions only.

The tree is domain -> language -> source. A budget goes down the tree by weight; a child that holds too little gives
what it lacks to its siblings, and only what no sibling can take is missing at the parent and so goes to the parent's
siblings. A leaf's tokens come in epochs, each in its own seeded order of documents; it is read up to its budget.

Within an epoch the selected documents are those below one cut in the seeded order, so a leaf needs one cut, found from
sums over `buckets` ranges of the order and then within the one range that the budget ends in. No task needs all
rows of a leaf, and texts are never shuffled.

Defined cases: null language or source count as ''; a text without words is never selected; a leaf without weight gets
nothing; repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelforge.llm.common import WORD, materialise

LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Mix:
    """Weights by level and name (whole numbers; others have `weight`), the share of all tokens to take, and the epochs."""

    weights: dict = field(default_factory=lambda: {"domain": {"domain0": 4, "domain1": 3, "domain2": 2}, "lang": {"en": 4, "de": 3, "fr": 2}, "source": {"src0": 2}})
    weight: int = 1
    share: tuple[int, int] = (4, 5)
    epochs: int = 3
    seed: int = 42
    buckets: int = 4096  # a power of 16


def domain_of(source: Column) -> Column:
    """The domain of a source: by the number that ends its name, modulo 4; 'other' without one."""
    number = F.try_to_number(F.regexp_extract(source, r"([0-9]{1,9})$", 1), F.lit("999999999"))
    return F.coalesce(F.concat(F.lit("domain"), (number.cast("long") % 4).cast("string")), F.lit("other"))


def with_leaf(docs: DataFrame) -> DataFrame:
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return docs.withColumns({"_domain": domain_of(source), "_lang": F.coalesce(F.col("lang").cast("string"), F.lit("")), "_source": source})


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(mix: Mix, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(mix.seed), epoch, F.coalesce(doc_id.cast("string"), F.lit(""))))


def weight_of(mix: Mix, level: str) -> Column:
    known = mix.weights.get(level, {})
    if not known:
        return F.lit(mix.weight).cast("long")
    table = F.create_map(*[F.lit(x) for k, v in known.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(table, F.col(level)), F.lit(mix.weight)).cast("long")


def share_out(nodes: DataFrame, parent: list[str], level: str) -> DataFrame:
    """nodes: the columns of parent, level, weight, cap and the parent's budget (at most the sum of caps of its children
    with weight). Adds `take`: in proportion to weight, at most cap, what one lacks spread over the others by weight.

    Children are taken by rising cap / weight. Those that would get their cap or more of what is left are full; the
    rest share what remains by their weights, rounded along running sums so that nothing is lost."""
    by = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), level)
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.partitionBy(*parent)
    nodes = nodes.where("weight > 0 and cap > 0").withColumns({
        "left": F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "heavy": F.sum("weight").over(after),
    })
    nodes = nodes.withColumn("full", F.min(F.col("cap") * F.col("heavy") <= F.col("left") * F.col("weight")).over(by))
    nodes = nodes.withColumns({
        "rest": F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(all_rows), F.lit(0)),
        "rest_weight": F.sum(F.when(~F.col("full"), F.col("weight"))).over(all_rows),
        "upto": F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0)).over(by),
    })
    part = lambda w: F.expr(f"rest * ({w}) div rest_weight")
    take = F.when(F.col("full"), F.col("cap")).otherwise(part("upto") - part("upto - weight"))
    return nodes.withColumn("take", take.cast("long")).drop("left", "heavy", "full", "rest", "rest_weight", "upto")


def leaf_budgets(tokens: DataFrame, mix: Mix) -> DataFrame:
    """tokens: domain, lang, source, n_tokens. One row per leaf: its tokens, its budget, whole epochs and what remains."""
    leaves = tokens.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    leaves = materialise(leaves.withColumn("cap", F.col("tokens") * mix.epochs), "leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    wanted = total * mix.share[0] // mix.share[1]
    parents = None
    for depth, level in enumerate(LEVELS):
        path = list(LEVELS[: depth + 1])
        # Capacity counts only leaves that can be reached, i.e. that have weight all the way down.
        usable = leaves
        for x in LEVELS[depth:]:
            usable = usable.where(weight_of(mix, x) > 0)
        nodes = usable.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("weight", weight_of(mix, level))
        if parents is None:
            cap = nodes.agg(F.sum("cap")).first()[0] or 0
            nodes = nodes.withColumns({"_root": F.lit(0), "budget": F.lit(min(wanted, cap)).cast("long")})
            parents = share_out(nodes, ["_root"], level).drop("_root")
        else:
            up = parents.select(*path[:-1], F.col("take").alias("budget"))
            parents = share_out(nodes.join(up, path[:-1]), path[:-1], level)
    budgets = parents.select(*LEVELS, F.col("take").alias("budget")).where("budget > 0").join(leaves, list(LEVELS))
    return materialise(budgets.withColumns({"whole": F.expr("budget div tokens"), "part": F.expr("budget % tokens")}).drop("cap"), "budgets")


def cuts(tokens: DataFrame, budgets: DataFrame, mix: Mix) -> DataFrame:
    """budgets with the cut of the leaf's last epoch: documents before `cut_key` are in it, of the one at it `cut_tokens`."""
    digits = len(f"{mix.buckets - 1:x}")
    keyed = (
        tokens.join(budgets.where("part > 0").select(*LEVELS, "whole", "part"), list(LEVELS))
        .withColumn("key", order_key(mix, F.col("whole") + 1, F.col("doc_id"))).withColumn("bucket", F.substring("key", 1, digits))
    )
    sums = keyed.groupBy(*LEVELS, "part", "bucket").agg(F.sum("n_tokens").alias("n"))
    along = Window.partitionBy(*LEVELS).orderBy("bucket")
    ends = sums.withColumn("upto", F.sum("n").over(along)).where("upto >= part and upto - n < part")
    last = materialise(ends.select(*LEVELS, "bucket", (F.col("part") - F.col("upto") + F.col("n")).alias("need")), "cut-ranges")
    inside = keyed.join(last, [*LEVELS, "bucket"]).groupBy(*LEVELS, "need", "key").agg(F.sum("n_tokens").alias("n"))
    along = Window.partitionBy(*LEVELS).orderBy("key")
    at = inside.withColumn("upto", F.sum("n").over(along)).where("upto >= need and upto - n < need")
    at = at.select(*LEVELS, F.col("key").alias("cut_key"), (F.col("need") - F.col("upto") + F.col("n")).alias("cut_tokens"))
    return materialise(budgets.join(at, list(LEVELS), "left"), "cuts")


def plan(docs: DataFrame, mix: Mix) -> tuple[DataFrame, DataFrame]:
    """(doc_id, domain, lang, source, n_tokens) of every document with tokens, and the leaves' cuts."""
    tokens = with_leaf(docs.select("doc_id", "text", "lang", "source")).select(
        "doc_id", F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source"), tokens_of(F.col("text")).alias("n_tokens")
    )
    tokens = materialise(tokens.where("n_tokens > 0"), "tokens")
    return tokens, cuts(tokens, leaf_budgets(tokens, mix), mix)


def select_epochs(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:  # noqa: B008
    """One row per document and epoch it is read in: doc_id, domain, lang, source, n_tokens, epoch, taken_tokens.

    Rows that share one doc_id stand at one place in the order; at a cut they share what is left, in order of size."""
    tokens, leaves = plan(docs, mix)
    leaves = leaves.select(*LEVELS, "whole", "cut_key", "cut_tokens")
    rows = tokens.join(leaves, list(LEVELS)).withColumn("key", order_key(mix, F.col("whole") + 1, F.col("doc_id")))
    taken = F.when(F.col("key") < F.col("cut_key"), F.col("n_tokens")).otherwise(F.lit(0))
    apart = rows.where("cut_key is null or key != cut_key").withColumn("in_last", taken.cast("long"))
    along = Window.partitionBy(*LEVELS).orderBy("n_tokens", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("cut_tokens") - F.coalesce(F.sum("n_tokens").over(along), F.lit(0))
    at = rows.where("key = cut_key").withColumn("in_last", F.greatest(F.lit(0), F.least(F.col("n_tokens"), left)).cast("long"))
    last = F.col("whole") + F.when(F.col("in_last") > 0, 1).otherwise(0)
    rows = apart.unionByName(at).where(last > 0).select("doc_id", *LEVELS, "n_tokens", "whole", "in_last", F.explode(F.sequence(F.lit(1).cast("long"), last)).alias("epoch"))
    return rows.select("doc_id", *LEVELS, "n_tokens", "epoch", F.when(F.col("epoch") <= F.col("whole"), F.col("n_tokens")).otherwise(F.col("in_last")).alias("taken_tokens"))


def mixed_documents(docs: DataFrame, mix: Mix) -> DataFrame:
    """Documents of one epoch of the mix, whole: those that start before their leaf's cut. A leaf's token-prefix can
    exceed its budget by less than one document."""
    _, leaves = plan(docs, mix)
    cut = leaves.select(*[F.col(x).alias(f"_{x}") for x in LEVELS], "whole", "cut_key")
    # The rows travel as one struct, so that no column's name can clash.
    held = with_leaf(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "lang", "source")).join(cut, [f"_{x}" for x in LEVELS])
    key = order_key(mix, F.col("whole") + 1, F.col("row.doc_id"))
    return held.where((tokens_of(F.col("row.text")) > 0) & ((F.col("whole") > 0) | (key <= F.col("cut_key")))).select("row.*")
