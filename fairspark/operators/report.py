"""Reports on results: effect of iterations, colours, selections, reshaping."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairspark.functions.scalar import baseline_colour, fairness_colour, padded_text, performance_colour


def iteration_effect(df: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("classifier_type", "algorithm", "value"), iteration: str = "iteration", ordinal: str = "ordinal", first: int = 1, second: int = 2) -> DataFrame:
    """For each key with both iterations, how many metrics rise, fall and stay (its first row of either counts)."""
    row = F.struct(*metrics)
    pairs = df.groupBy(*keys).agg(F.min_by(F.when(F.col(iteration) == first, row), F.when(F.col(iteration) == first, F.col(ordinal))).alias("a"), F.min_by(F.when(F.col(iteration) == second, row), F.when(F.col(iteration) == second, F.col(ordinal))).alias("b"))
    pairs = pairs.where("a IS NOT NULL AND b IS NOT NULL")
    count = lambda test: reduce(lambda x, y: x + y, (F.when(test(F.col(f"b.`{m}`"), F.col(f"a.`{m}`")), 1).otherwise(0) for m in metrics))
    return pairs.select(*keys, count(lambda b, a: b > a).alias("num_increases"), count(lambda b, a: b < a).alias("num_decreases"), count(lambda b, a: b == a).alias("num_no_change"))


def effect_by(effect: DataFrame, keys: Sequence[str] = ("classifier_type", "algorithm"), group: str = "value") -> DataFrame:
    """Effects summed by keys, with the names of the groups joined in order."""
    names = F.concat_ws("", F.sort_array(F.collect_set(group)))
    return effect.groupBy(*keys).agg(names.alias(group), *(F.sum(c).alias(c) for c in ("num_increases", "num_decreases", "num_no_change")))


def with_total(effect: DataFrame, label: str, name: str = "Total") -> DataFrame:
    """The rows and a row of totals, its label column holding the name."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast(dict(effect.dtypes)[c]).alias(c) for c in ("num_increases", "num_decreases", "num_no_change")]
    return effect.unionByName(effect.agg(F.lit(name).alias(label), *sums), allowMissingColumns=True)


def colours(df: DataFrame, fairness: Sequence[str], performance: Sequence[str], group: str = "value", iteration: str = "iteration", ordinal: str = "ordinal") -> DataFrame:
    """Each metric's colour against the group's first row of iteration 0 (``<metric>_colour``), and its text to three places."""
    metrics = [*fairness, *performance]
    base = df.where(F.col(iteration) == 0).groupBy(group).agg(*(F.min_by(m, ordinal).alias(f"_base_{m}") for m in metrics))
    joined = df.join(base, group)
    out = {}
    for m in metrics:
        value, start = F.col(m), F.col(f"_base_{m}")
        if m in fairness:
            own = F.when(F.col(iteration) == 0, baseline_colour(value, "disparate_impact" in m)).otherwise(fairness_colour(value, start, "disparate_impact" in m))
        else:
            own = F.when(F.col(iteration) == 0, F.lit("")).otherwise(performance_colour(value, start))
        out |= {f"{m}_colour": own, f"{m}_text": padded_text(m, 3)}
    return joined.withColumns(out).drop(*(f"_base_{m}" for m in metrics))


def selected(df: DataFrame, binary: Sequence[str], multiclass: Sequence[str], iteration: str = "iteration") -> DataFrame:
    """Baseline rows (their group set to the value), binary corrections of the group itself, multiclass corrections; ``part`` orders them."""
    baseline = F.col(iteration) == 0
    own = F.col("algorithm").isin(list(binary)) & (F.col("group") == F.col("value"))
    part = F.when(baseline, 0).when(own, 1).when(F.col("algorithm").isin(list(multiclass)), 2)
    return df.withColumn("part", part).where("part IS NOT NULL").withColumn("group", F.when(F.col("part") == 0, F.col("value")).otherwise(F.col("group")))


def without_set(df: DataFrame, name: str = "Validation") -> DataFrame:
    """Rows of other sets; a missing set stays."""
    return df.where(~F.col("set").eqNullSafe(F.lit(name)))


def coloured_cells(coloured: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """The rows of ``colours`` with a column ``<metric>_cell``: the text, after the command of its colour if it has one."""
    cell = lambda m: F.concat(F.when(F.col(f"{m}_colour") != "", F.concat(F.lit("\\"), F.col(f"{m}_colour"), F.lit(" "))).otherwise(""), F.col(f"{m}_text"))
    return coloured.withColumns({f"{m}_cell": cell(m) for m in metrics})


def latex(rows: Sequence[Sequence[str]], header: Sequence[str], align: str | None = None) -> str:
    """A small table as LaTeX text; align: its columns, by default all to the left."""
    body = [" & ".join(map(str, r)) + r" \\" for r in rows]
    return "\n".join([r"\begin{tabular}{" + (align or "l" * len(header)) + "}", r"\toprule", " & ".join(header) + r" \\", r"\midrule", *body, r"\bottomrule", r"\end{tabular}"])


def latex_of(df: DataFrame, columns: Sequence[str], order: Sequence[str], header: Sequence[str] | None = None, align: str | None = None, most: int = 10_000) -> str:
    """A small result as LaTeX text, rows in order; a larger one raises."""
    rows = df.orderBy(*order).select(*columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return latex([tuple(r) for r in rows], header or columns, align)


def best_and_population(df: DataFrame, classifiers: Sequence[str], metric: str) -> DataFrame:
    """``Best_<classifier>`` from {classifier}_{metric} and ``Population_<classifier>`` from its mean, with the generation."""
    pairs = [c for k in classifiers for c in (F.col(f"{k}_{metric}").alias(f"Best_{k}"), F.col(f"{k}_{metric}mean").alias(f"Population_{k}"))]
    return df.select("Generation", *pairs)


def melted(df: DataFrame, keys: Sequence[str], names: str = "Metric", value: str = "Average Error", legend: str | None = "Legend") -> DataFrame:
    """Wide to long; with a legend, Best or Population by the column's name, which loses that prefix."""
    long = df.unpivot(list(keys), [c for c in df.columns if c not in keys], names, value)
    if legend:
        long = long.withColumn(legend, F.when(F.col(names).contains("Best"), "Best").otherwise("Population")).withColumn(names, F.regexp_replace(names, "^(Best|Population)_", ""))
    return long
