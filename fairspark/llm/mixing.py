"""Mixing sources to target weights by hierarchical budgets.

A token budget is shared out in a tree of domains, their languages and the sources within these.  At each node children
get shares by weight; a child whose documents (times the epochs allowed) hold less than its share takes what it has, and
what it leaves goes to its siblings by weight; only what a whole subtree can't take goes to the ancestors' other children.
Each leaf then reads its documents in seeded epochs, each in an order of its own, up to its budget: the documents of the
prefix whose tokens, with those before, fit.

Everything is built-in functions.  A node's children are filled up by one sort by capacity for weight and running sums, on
tables of one row a leaf.  The prefix of a leaf, which may hold a third of all documents, is found in two steps: tokens are
summed by slices of the seeded order (combined before the shuffle), and only the one slice in which the budget ends is
ordered row by row; what is joined back to the documents is where each leaf ends.

Defined cases: null domains, languages and sources are values of their own; null texts have no tokens; a document without
tokens is taken if it is reached within its leaf's budget, and a leaf without any tokens has none and gives nothing; repeated rows count each; weights that aren't given are 1, weights of
0 get nothing; an empty table gives an empty result; further columns are kept by ``mix``, but for
those whose names begin with ``_mix_`` beside its own figures, which are named so.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairspark.llm._spark import fresh, materialise, words

LEVELS = ("_mix_domain", "_mix_lang", "_mix_source")


def _weight(level: str, weights: Mapping[str, int]) -> Column:
    out = F.lit(1)
    for name, weight in weights.items():
        out = F.when(F.col(level) == name, F.lit(int(weight))).otherwise(out)
    return out.cast("double")


def shared_out(nodes: DataFrame, parents: list[str], level: str, budget: str = "_mix_budget") -> DataFrame:
    """Adds ``_mix_given`` to nodes(parents..., level, _mix_weight, _mix_capacity, budget of the parent).

    In order of capacity for weight, the first children that can't take their share keep what they have; the others
    share the rest by weight.
    """
    across = Window.partitionBy(*parents).orderBy(F.col("_mix_ratio").asc(), F.col(level).asc_nulls_first())
    total = Window.partitionBy(*parents)
    nodes = nodes.withColumn("_mix_ratio", F.when(F.col("_mix_weight") > 0, F.col("_mix_capacity") / F.col("_mix_weight")).otherwise(F.lit(float("inf"))))
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.withColumns({"_mix_before": F.coalesce(F.sum("_mix_capacity").over(before), F.lit(0.0)), "_mix_lighter": F.coalesce(F.sum("_mix_weight").over(before), F.lit(0.0)), "_mix_all": F.sum("_mix_weight").over(total)})
    # Full if its capacity is at most its share of what the smaller ones leave; ratios ascend, so those are the first.
    full = F.col("_mix_ratio") * (F.col("_mix_all") - F.col("_mix_lighter")) <= F.col(budget) - F.col("_mix_before")
    nodes = nodes.withColumn("_mix_full", full & (F.col("_mix_weight") > 0))
    taken = F.coalesce(F.sum(F.when(F.col("_mix_full"), F.col("_mix_capacity"))).over(total), F.lit(0.0))
    heavy = F.coalesce(F.sum(F.when(~F.col("_mix_full"), F.col("_mix_weight"))).over(total), F.lit(0.0))
    given = F.when(F.col("_mix_full"), F.col("_mix_capacity")).when(F.col("_mix_weight") > 0, (F.col(budget) - taken) * F.col("_mix_weight") / heavy).otherwise(F.lit(0.0))
    return nodes.withColumn("_mix_given", given).drop("_mix_ratio", "_mix_before", "_mix_lighter", "_mix_all", "_mix_full")


def leaf_budgets(leaves: DataFrame, budget: float, epochs: int, weights: tuple[Mapping[str, int], Mapping[str, int], Mapping[str, int]]) -> DataFrame:
    """_mix_leaf_budget of leaves(levels..., _mix_tokens), whole tokens; budget: of the root."""
    leaves = leaves.withColumn("_mix_capacity", F.col("_mix_tokens").cast("double") * epochs)
    for level, given in zip(LEVELS, weights, strict=True):
        leaves = leaves.withColumn(f"{level}_weight", _weight(level, given))
    usable = F.when((F.col("_mix_domain_weight") > 0) & (F.col("_mix_lang_weight") > 0) & (F.col("_mix_source_weight") > 0), F.col("_mix_capacity")).otherwise(F.lit(0.0))
    leaves = leaves.withColumn("_mix_capacity", usable)
    for depth, level in enumerate(LEVELS):
        keys = list(LEVELS[: depth + 1])
        parents = list(LEVELS[:depth]) or [F.lit(0)]
        nodes = leaves.groupBy(*keys).agg(F.sum("_mix_capacity").alias("_mix_capacity"), F.first(f"{level}_weight").alias("_mix_weight"))
        if depth:
            above = [F.col(f"n.{k}").eqNullSafe(F.col(f"u.{k}")) for k in LEVELS[:depth]]
            nodes = nodes.alias("n").join(upper.alias("u"), above).select("n.*", F.col("u._mix_given").alias("_mix_budget"))  # noqa: F821
        else:
            nodes = nodes.withColumn("_mix_budget", F.lit(float(budget)))
        upper = shared_out(nodes, parents, level).select(*keys, "_mix_given")
    return upper.withColumn("_mix_leaf_budget", F.floor(F.col("_mix_given") + 1e-6).cast("long")).drop("_mix_given")


def mix(
    docs: DataFrame, domain: Column, budget_share: float = 0.7, epochs: int = 2, seed: str = "0", slices: int = 4096, tokens: Column | None = None,
    weights: tuple[Mapping[str, int], Mapping[str, int], Mapping[str, int]] = ({}, {}, {}), lang: str = "lang", source: str = "source", key: str = "doc_id", figures: bool = True,
) -> DataFrame:
    """The rows of docs, all columns, that each leaf's prefix takes, with ``_mix_domain``, ``_mix_tokens`` and ``_mix_epoch`` (from 0).

    budget_share: the budget over all tokens of docs; tokens: a column of whole numbers, by default words of text; without
    figures the result has just the columns of docs.
    """
    count = F.size(words(F.col("text"))) if tokens is None else tokens
    names = docs.columns
    own = [c for c in names if c.startswith("_mix_")]
    docs = docs.withColumnsRenamed(dict(zip(own, fresh(docs, *(f"in{c}" for c in own)), strict=True)))
    rows = docs.withColumns({"_mix_domain": domain, "_mix_lang": F.col(lang), "_mix_source": F.col(source), "_mix_tokens": count.cast("long"), "_mix_key": F.coalesce(F.col(key).cast("string"), F.lit(""))})
    rows = rows.withColumn("_mix_epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    rows = rows.withColumn("_mix_place", F.md5(F.concat_ws(":", F.lit(seed), F.col("_mix_epoch").cast("string"), F.col("_mix_key"))))
    small = materialise(rows.select(*LEVELS, "_mix_tokens", "_mix_epoch", "_mix_place"), "mix-rows")
    digits = max(1, (slices - 1).bit_length() + 3 >> 2)
    small = small.withColumn("_mix_slice", F.substring("_mix_place", 1, digits))
    total = small.where("_mix_epoch = 0").agg(F.sum("_mix_tokens")).first()[0] or 0
    leaves = small.where("_mix_epoch = 0").groupBy(*LEVELS).agg(F.sum("_mix_tokens").alias("_mix_tokens"))
    budgets = materialise(leaf_budgets(leaves, float(int(total * budget_share)), epochs, weights), "mix-budgets")
    # Tokens before each slice of each leaf; a leaf's last slice is the one in which its budget ends.
    sums = small.groupBy(*LEVELS, "_mix_epoch", "_mix_slice").agg(F.sum("_mix_tokens").alias("_mix_sum"), F.max("_mix_place").alias("_mix_last"))
    ordered = Window.partitionBy(*LEVELS).orderBy("_mix_epoch", "_mix_slice").rowsBetween(Window.unboundedPreceding, -1)
    same = lambda a, b, keys: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    sums = sums.withColumn("_mix_before", F.coalesce(F.sum("_mix_sum").over(ordered), F.lit(0)))
    cuts = sums.alias("s").join(budgets.alias("b"), same("s", "b", LEVELS)).where("_mix_before <= _mix_leaf_budget AND _mix_leaf_budget > 0")
    cuts = materialise(cuts.select("s.*", "_mix_leaf_budget"), "mix-slices")
    keys = [*LEVELS, "_mix_epoch", "_mix_slice"]
    whole = cuts.where("_mix_before + _mix_sum <= _mix_leaf_budget").select(*LEVELS, "_mix_epoch", F.col("_mix_last").alias("_mix_place"))
    last = cuts.where("_mix_before + _mix_sum > _mix_leaf_budget")
    # Rows with one place (repeated ids) go together.
    inner = Window.partitionBy(*keys).orderBy("_mix_place")
    edge = small.alias("s").join(last.alias("c"), same("s", "c", keys)).select("s.*", "_mix_before", "_mix_leaf_budget")
    edge = edge.withColumn("_mix_upto", F.col("_mix_before") + F.sum("_mix_tokens").over(inner)).where("_mix_upto <= _mix_leaf_budget").select(*LEVELS, "_mix_epoch", "_mix_place")
    ends = whole.union(edge).groupBy(*LEVELS).agg(F.max(F.struct("_mix_epoch", "_mix_place")).alias("_mix_end"))
    ends = materialise(ends, "mix-ends")
    # Only the leaves' ends are joined to the documents; texts move only where leaves are too many to broadcast.
    joined = rows.alias("d").join(ends.alias("e"), same("d", "e", LEVELS)).where(F.struct("_mix_epoch", "_mix_place") <= F.col("_mix_end"))
    kept = [F.col(f"d.`{c}`").alias(name) for c, name in zip(docs.columns, names, strict=True) if not figures or name not in own]
    return joined.select(*kept, *(F.col(f"d.{c}") for c in ("_mix_domain", "_mix_tokens", "_mix_epoch") if figures))


def domain_of_source(size: int = 5) -> Column:
    """A domain of each ``size`` sources, by the number at a source's end; sources without one have the domain ``other``."""
    number = F.regexp_extract("source", "([0-9]+)$", 1)
    return F.when(number != "", F.concat(F.lit("domain"), F.floor(number.cast("long") / size).cast("string"))).otherwise(F.lit("other"))


