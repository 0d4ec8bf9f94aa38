"""Mixing sources to target weights by hierarchical budgeting.

Sources are leaves of a tree: domain, then language, then source. A token budget
goes down the tree level by level. Each node splits what it gets among its children
by weight; a child cannot take more than ``max_epochs`` passes over its texts, and
what it cannot take goes to its siblings, by their weights, before anything is left
to the node's own siblings (a node never receives more than its subtree can take).

A leaf with tokens T and budget A takes every text ``A // T`` times and, of one more
epoch, the texts in seeded order until ``A % T`` tokens are reached; the text that
reaches it is the last. Each epoch has an order of its own, by md5 of seed, epoch
and doc_id. Only the key of that last text is needed to pick the texts, so they are
picked where they are read, and no text is exchanged.

The last key is found in three steps, none of which brings a leaf together, however
large: tokens by leaf and slice of the key space, a running sum over the slices,
and the texts of the one slice where the budget ends.

Defined cases: a null text has no tokens and is never taken; a null language or
source is the group ``?``; rows with one doc_id share a key and are taken together;
children without a weight have weight 1, and weight 0 takes nothing; an empty table
or budget gives an empty result; further columns are not read, and ``take`` keeps
them.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martlet.llm.common import pick, place, saved

LEAF = ("domain", "lang", "source")
#: The key has 60 bits; a slice is what its first 16 say.
SLICE_SHIFT = 44
WORD = "[^ \\t\\n\\x0B\\f\\r]+"


@dataclass(frozen=True)
class Plan:
    """Weights are whole numbers up to 1,000; ``budget_share`` is in thousandths of all tokens."""

    domain_of: Mapping[str, str] = field(default_factory=dict)
    domains: Mapping[str, int] = field(default_factory=dict)
    languages: Mapping[str, int] = field(default_factory=dict)
    sources: Mapping[str, int] = field(default_factory=dict)
    other_domain: str = "other"
    budget_share: int = 600
    max_epochs: int = 3
    seed: int = 7

    def weights(self, level: int) -> Mapping[str, int]:
        return (self.domains, self.languages, self.sources)[level]


def _named(column: str, names: Mapping, otherwise: Column) -> Column:
    if not names:
        return otherwise
    pairs = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(F.try_element_at(pairs, F.col(column)), otherwise)


def key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """A text's place in an epoch: the first 60 bits of an md5."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def sized(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, leaf and number of tokens (words) of each row."""
    rows = pick(docs, doc_id=("doc_id", "bigint"), text=("text", "string"), lang=("lang", "string"), source=("source", "string"))
    rows = rows.select(
        "doc_id",
        F.coalesce("lang", F.lit("?")).alias("lang"),
        F.coalesce("source", F.lit("?")).alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("n_tokens"),
    )
    return rows.withColumn("domain", _named("source", plan.domain_of, F.lit(plan.other_domain)))


def _split(nodes: DataFrame, parent: list[str], child: str, weights: Mapping[str, int]) -> DataFrame:
    """Columns ``parent``, ``child``, cap (what the child can take) and budget (the parent's), to the child's budget."""
    w = nodes.withColumn("w", _named(child, weights, F.lit(1)).cast("bigint")).where("w > 0 and cap > 0")
    group = Window.partitionBy(*parent)
    fill = group.orderBy(F.col("cap") / F.col("w"), child)
    wide = "decimal(24,0)"
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    w = w.withColumns({"before": before, "rest": F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing))})
    full = (F.col("budget") - F.col("before")).cast(wide) * F.col("w").cast("decimal(6,0)") >= F.col("cap").cast(
        wide
    ) * F.col("rest").cast("decimal(12,0)")
    w = w.withColumn("full", full)
    left = F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(group)
    open_w = F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(group)
    w = w.withColumns({"left": left, "open_w": open_w})
    part = F.when(F.col("full"), F.col("cap")).otherwise(
        F.floor(F.col("left").cast(wide) * F.col("w").cast("decimal(6,0)") / F.greatest(F.col("open_w"), F.lit(1))).cast("bigint")
    )
    w = w.withColumn("part", part)
    # Rounding leaves fewer tokens than there are open children: one each, in order of name.
    over = F.col("budget") - F.sum("part").over(group)
    w = w.withColumns({"over": over, "nth": F.row_number().over(group.orderBy("full", child))})
    return w.select(
        *parent, child, (F.col("part") + F.when(~F.col("full") & (F.col("nth") <= F.col("over")), 1).otherwise(0)).alias("budget")
    )


def budgets(leaves: DataFrame, plan: Plan) -> DataFrame:
    """Leaves with ``tokens`` to leaves with ``tokens`` and ``budget``."""
    caps = leaves.withColumn("cap", F.col("tokens") * plan.max_epochs).where("cap > 0")
    for level, names in enumerate(LEAF):  # what weight 0 shuts out is nobody's to give
        caps = caps.where(_named(names, plan.weights(level), F.lit(1)) > 0)
    total = caps.select(F.sum("cap").alias("cap"))
    wanted = leaves.select(F.floor(F.sum("tokens") * plan.budget_share / 1000).cast("bigint").alias("wanted"))
    given = total.join(wanted).select(F.least("cap", "wanted").alias("budget"))
    above: list[str] = []
    for level, child in enumerate(LEAF):
        at = [*above, child]
        nodes = caps.groupBy(*at).agg(F.sum("cap").alias("cap"))
        nodes = nodes.join(given, above) if above else nodes.join(given)
        given = _split(nodes, above, child, plan.weights(level))
        above = at
    return leaves.join(given, list(LEAF)).where("budget > 0")


def cutoffs(rows: DataFrame, plan: Plan) -> DataFrame:
    """For each leaf: tokens, budget, whole epochs, and the last key of one more epoch (-1: none)."""
    leaves = rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"))
    plans = budgets(leaves, plan).selectExpr(
        *LEAF, "tokens", "budget", "budget div tokens as epochs", "budget % tokens as rest"
    )
    plans = saved(plans, "budgets")
    partly = rows.where("n_tokens > 0").join(plans.where("rest > 0"), list(LEAF))
    partly = partly.withColumn("key", key(plan.seed, F.col("epochs") + 1, F.col("doc_id")))
    partly = partly.withColumn("slice", F.shiftright("key", SLICE_SHIFT))
    by_slice = partly.groupBy(*LEAF, "slice").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    upto = F.sum("n").over(Window.partitionBy(*LEAF).orderBy("slice"))
    ends = by_slice.withColumn("upto", upto).where("upto >= rest and upto - n < rest")
    ends = ends.selectExpr(*LEAF, "slice", "rest - (upto - n) as within")
    keys = partly.join(ends, [*LEAF, "slice"]).groupBy(*LEAF, "key").agg(
        F.sum("n_tokens").alias("n"), F.first("within").alias("within")
    )
    reached = F.sum("n").over(Window.partitionBy(*LEAF).orderBy("key"))
    last = keys.withColumn("upto", reached).where("upto - n < within").groupBy(*LEAF).agg(F.max("key").alias("last_key"))
    return saved(
        plans.join(last, list(LEAF), "left").select(
            *LEAF, "tokens", "budget", "epochs", F.coalesce("last_key", F.lit(-1)).alias("last_key")
        ),
        "cutoffs",
    )


def _copies(plan: Plan) -> Column:
    own = key(plan.seed, F.col("epochs") + 1, F.col("doc_id"))
    return (F.col("epochs") + F.when(own <= F.col("last_key"), 1).otherwise(0)).cast("int")


def mix_sources(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, domain, lang, source, epoch (from 1), n_tokens: a row for each time a text is taken."""
    rows = saved(sized(docs, plan), "sized")
    taken = rows.where("n_tokens > 0").join(cutoffs(rows, plan), list(LEAF)).withColumn("copies", _copies(plan))
    epochs = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("epoch")
    return taken.where("copies > 0").select("doc_id", *LEAF, epochs, "n_tokens")


def take(docs: DataFrame, plan: Plan) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as it is taken."""
    names = docs.columns
    ends = cutoffs(saved(sized(docs, plan), "sized"), plan)
    plain = docs.toDF(*(f"_{i}" for i in range(len(names))))
    at = {c: F.col(f"_{place(docs, c)}") for c in ("doc_id", "text", "lang", "source")}
    rows = plain.where(at["text"].rlike(WORD)).withColumns(
        {"doc_id": at["doc_id"].cast("bigint"), "lang": F.coalesce(at["lang"].cast("string"), F.lit("?")), "source": F.coalesce(at["source"].cast("string"), F.lit("?"))}
    )
    rows = rows.withColumn("domain", _named("source", plan.domain_of, F.lit(plan.other_domain)))
    taken = rows.join(ends, list(LEAF)).withColumn("copies", _copies(plan)).where("copies > 0")
    taken = taken.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select(*(F.col(f"_{i}").alias(n) for i, n in enumerate(names)))
