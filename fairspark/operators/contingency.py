"""Contingency counts: the one aggregation behind all group metrics.

Counts by protected group are summed once, in a map-side combined aggregation; the rest of the population is the totals
less the group, so that no group needs another pass.  Groups are few (they are values of a protected attribute).
"""

from __future__ import annotations

from functools import reduce
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairspark.functions.scalar import ratio

COUNTS = ("n", "pp", "pos", "tp", "fp")


def contingency(df: DataFrame, *keys: str, truth: str = "y", prediction: str = "p") -> DataFrame:
    """By keys: n rows, pp predicted positive, pos truly positive, tp and fp; truth and prediction are 0 or 1."""
    y, p = F.col(truth).cast("long"), F.col(prediction).cast("long")
    sums = {"n": F.count(F.lit(1)), "pp": F.sum(p), "pos": F.sum(y), "tp": F.sum(y * p), "fp": F.sum((1 - y) * p)}
    return df.groupBy(*keys).agg(*(F.coalesce(c, F.lit(0)).cast("long").alias(k) for k, c in sums.items()))


def with_rest(counts: DataFrame, *within: str) -> DataFrame:
    """Adds ``rest_*``: the totals (within further keys) less the group's own counts.  One row a group."""
    total = Window.partitionBy(*(within or [F.lit(0)]))
    return counts.withColumns({f"rest_{c}": F.sum(c).over(total) - F.col(c) for c in COUNTS})


def matching(conditions: Mapping[str, object]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c) == F.lit(v) for c, v in conditions.items()), F.lit(True))


def joint_probability(df: DataFrame, conditions: Mapping[str, object], name: str = "probability") -> DataFrame:
    """The share of rows that meet all conditions."""
    hit = F.sum(F.when(matching(conditions), 1).otherwise(0))
    return df.agg(ratio(hit, F.count(F.lit(1))).alias(name))


def conditional_probability(df: DataFrame, event: Mapping[str, object], given: Mapping[str, object], name: str = "probability") -> DataFrame:
    """P(event and given) / P(given), 0 where nothing meets the condition."""
    both = F.sum(F.when(matching({**event, **given}), 1).otherwise(0))
    return df.agg(ratio(both, F.sum(F.when(matching(given), 1).otherwise(0))).alias(name))
