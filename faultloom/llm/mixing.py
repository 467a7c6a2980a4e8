"""Mixing sources to target weights: hierarchical token budgets, then a token prefix of every leaf.

The corpus is a tree of domain, language and source. A node's budget is dealt to its children by
weight; a child whose whole subtree, read max_epochs times, has fewer tokens than its share gets
what it has, and its siblings share the rest by weight. As capacities are those of whole subtrees, a
source that falls short is made up by its sibling sources first, then by the other languages of its
domain, and only then by other domains. All amounts are whole tokens; shares are rounded down.

A leaf reads whole epochs while its budget lasts and then a prefix of one more, in an order drawn
from seed, epoch and id. The prefix is found in two steps, so that no leaf is ever sorted as a
whole: sums per slice of the order say in which slice the budget ends, and only that slice is put
in order. The last document of the prefix may be used in part: take_tokens says how much of it.

Defined cases: a null or empty domain, language or source is the child UNKNOWN. A null or empty
text has no tokens; it is in an epoch that is read whole and in a prefix that reaches beyond it.
Weights that are not given are 1; a weight of 0 leaves the subtree out. Rows with equal or null ids
are separate rows. Columns the operator adds replace columns of the same names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .steps import settle

LEVELS = ("domain", "lang", "source")
UNKNOWN = "unknown"
SLICE_DIGITS = 3  # hexadecimal: 4096 slices of a leaf


@dataclass(frozen=True)
class Targets:
    """Weights by name and level, budget as percent of all tokens, epochs at most, seed."""

    domain: dict[str, int] = field(default_factory=lambda: {"web": 5, "reference": 3, "forum": 2})
    lang: dict[str, int] = field(default_factory=lambda: {"en": 4, "de": 2, "fr": 2, "es": 1})
    source: dict[str, int] = field(default_factory=dict)
    budget_percent: int = 100
    max_epochs: int = 2
    seed: int = 42


def domain_of(source: Column) -> Column:
    """The domain of a source: by the last digit of its name."""
    digit = F.right(source, F.lit(1))
    return (
        F.when(digit.between("0", "3"), "web").when(digit.between("4", "6"), "reference").when(digit.between("7", "9"), "forum")
    )


def token_count(text: Column) -> Column:
    """Words between blanks, tabs and line ends."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\r\n]+")), F.lit(0)).cast("long")


def _weight(name: Column, given: dict[str, int]) -> Column:
    out = F.lit(1)
    for key, w in given.items():
        out = F.when(name == key, w).otherwise(out)
    return out.cast("long")


def _deal(children: DataFrame, parent: list[str]) -> DataFrame:
    """Budget of every child from columns parent_budget, capacity and weight; whole tokens.

    In order of capacity per weight, a child is filled when its parent's budget suffices to give
    every child as much per weight, or its capacity.
    """
    at = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), F.col("capacity"))
    all_ = Window.partitionBy(*parent)
    wanted = children.where("weight > 0")
    sums = wanted.withColumns({
        "c_upto": F.sum("capacity").over(at.rowsBetween(Window.unboundedPreceding, 0)),
        "w_upto": F.sum("weight").over(at.rowsBetween(Window.unboundedPreceding, 0)),
        "w_all": F.sum("weight").over(all_),
    })
    filled = F.expr("c_upto * weight + capacity * (w_all - w_upto) <= parent_budget * weight")
    split = sums.withColumn("filled", filled).withColumns({
        "c_filled": F.sum(F.when(F.col("filled"), F.col("capacity")).otherwise(0)).over(all_),
        "w_open": F.sum(F.when(F.col("filled"), 0).otherwise(F.col("weight"))).over(all_),
    })
    budget = F.expr("if(filled, capacity, weight * (parent_budget - c_filled) div w_open)")
    return split.withColumn("budget", budget).drop("c_upto", "w_upto", "w_all", "filled", "c_filled", "w_open", "parent_budget")


def leaf_budgets(leaves: DataFrame, targets: Targets) -> DataFrame:
    """domain, lang, source, tokens, budget from the tokens of every leaf that no weight of 0 leaves out.
    One row per leaf throughout."""
    capacity = (F.col("tokens") * targets.max_epochs).alias("capacity")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    given = (targets.domain, targets.lang, targets.source)
    # a node's capacity is what may be read below it
    readable = F.least(*(_weight(F.col(name), w) for name, w in zip(LEVELS, given, strict=True))) > 0
    dealt = leaves.where(readable).select(*LEVELS, "tokens", capacity, F.lit(total * targets.budget_percent // 100).cast("long").alias("budget"))
    for depth, name in enumerate(LEVELS):
        path, parent = list(LEVELS[: depth + 1]), list(LEVELS[:depth])
        nodes = dealt.groupBy(*path).agg(F.sum("capacity").alias("capacity"), F.first("budget").alias("parent_budget"))
        nodes = _deal(nodes.withColumn("weight", _weight(F.col(name), given[depth])), parent or [F.lit(1)])
        dealt = dealt.drop("budget").join(nodes.select(*path, "budget"), path)
    return dealt.select(*LEVELS, "tokens", "budget")


def mix(
    docs: DataFrame,
    targets: Targets = Targets(),
    id_col: str = "doc_id",
    text_col: str = "text",
    domain: Column | None = None,
) -> DataFrame:
    """A row per document and epoch it is read in: all columns, domain, epoch, tokens, take_tokens."""
    named = lambda c: F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(UNKNOWN))
    domain = domain_of(F.col("source")) if domain is None else domain
    order = F.md5(F.concat_ws(":", F.lit(targets.seed), F.col("_full"), F.col("_key")))
    own = ["domain", "epoch", "tokens", "take_tokens"]
    rest = [c for c in docs.columns if c.lower() not in own]
    rows = docs.select(
        F.struct(*rest).alias("_row"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_key"), named(domain).alias("_domain"), named(F.col("lang")).alias("_lang"), named(F.col("source")).alias("_source"),
        token_count(F.col(text_col)).alias("_tokens"),
    )
    path = ["_domain", "_lang", "_source"]
    sums = rows.groupBy(*path).agg(F.sum("_tokens").alias("tokens")).withColumnsRenamed(dict(zip(path, LEVELS)))
    budgets = leaf_budgets(settle(sums, "leaves"), targets)
    plan = settle(
        budgets.select(
            F.col("domain").alias("_domain"), F.col("lang").alias("_lang"), F.col("source").alias("_source"),
            F.expr("if(tokens > 0, budget div tokens, 0)").cast("int").alias("_full"),
            F.expr("if(tokens > 0, budget % tokens, 0)").alias("_rest"),
        ),
        "budgets",
    )
    placed = rows.join(plan, path).withColumn("_order", order).withColumn("_slice", F.left("_order", F.lit(SLICE_DIGITS)))
    upto = Window.partitionBy(*path).orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    slices = placed.groupBy(*path, "_slice").agg(F.sum("_tokens").alias("_in"), F.first("_rest").alias("_rest"))
    slices = slices.withColumn("_before", F.sum("_in").over(upto) - F.col("_in")).where("_before < _rest")
    # the slice in which the budget ends, and what is left of the budget there
    last = slices.groupBy(*path).agg(F.max(F.struct("_slice", (F.col("_rest") - F.col("_before")).alias("left"))).alias("m"))
    last = settle(last.select(*path, F.col("m._slice").alias("_last"), F.col("m.left").alias("_left")), "slices")
    begun = placed.join(last, path)
    running = Window.partitionBy(*path).orderBy("_order", "_tokens").rowsBetween(Window.unboundedPreceding, 0)
    ended = (
        begun.where("_slice = _last")
        .withColumn("_room", F.col("_left") - (F.sum("_tokens").over(running) - F.col("_tokens")))
        .where("_room > 0")
        .withColumn("_take", F.least("_tokens", "_room"))
    )
    whole = rows.join(plan.where("_full > 0"), path).withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("_full") - 1)))

    def out(df: DataFrame, epoch: str, take: str) -> DataFrame:
        return df.select("_row.*", F.col("_domain").alias("domain"), F.col(epoch).alias("epoch"),
                         F.col("_tokens").alias("tokens"), F.col(take).alias("take_tokens"))

    return (
        out(whole, "_epoch", "_tokens")
        .unionByName(out(begun.where("_slice < _last"), "_full", "_tokens"))
        .unionByName(out(ended, "_full", "_take"))
    )


def report(docs: DataFrame) -> DataFrame:
    """op10: which documents the mix reads, in which epochs, and how much of them."""
    picked = mix(docs.select("doc_id", "text", "lang", "source"))
    return picked.select("doc_id", "domain", "lang", "source", "epoch", "tokens", "take_tokens")
