"""Shares of (group, target) pairs, long and pivoted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairspark.functions.scalar import ratio


def distribution(df: DataFrame, group: str, target: str, within: Sequence[str] = ()) -> DataFrame:
    """The share of all rows (within keys) of each pair, long."""
    counts = df.groupBy(*within, F.col(group).cast("string").alias("group"), F.col(target).cast("string").alias("target")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy(*(within or [F.lit(0)])))))


def pivoted(shares: DataFrame, suffix: str = "", within: Sequence[str] = ()) -> DataFrame:
    """One row (by keys) with a column for each pair, by name, 0 where a pair is missing."""
    pairs = sorted(r.pair for r in shares.select(F.concat_ws("_", "group", "target").alias("pair")).distinct().collect())  # groups x targets: few
    wide = shares.groupBy(*within).agg(*(F.coalesce(F.sum(F.when(F.concat_ws("_", "group", "target") == pair, F.col("share"))), F.lit(0.0)).alias(pair + suffix) for pair in pairs))
    return wide


def three_sets(train: DataFrame, validation: DataFrame, group: str, truth: str = "y", prediction: str = "p") -> DataFrame:
    """Training labels, validation labels and predictions, long with ``set``."""
    sets = (("a_train_set", train, truth), ("b_predicted_set", validation, truth), ("c_predictions_set", validation, prediction))
    parts = [distribution(df, group, target).withColumn("set", F.lit(name)) for name, df, target in sets]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
