"""Reductions over the results of many seeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairspark.functions.scalar import squared_error_to_one
from fairspark.operators.ranking import ranked


def _number(x: str) -> Column:
    return F.nanvl(F.col(x).cast("double"), F.lit(None))


def sse_over_seeds(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Squared errors to 1, summed by keys; NaN and null count as missing, nothing at all as 0."""
    return df.groupBy(*keys).agg(*(F.coalesce(F.sum(squared_error_to_one(v)), F.lit(0.0)).alias(v) for v in values))


def mean_over_seeds(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*(F.avg(_number(v)).alias(v) for v in values))


def multi_seed_reduce(df: DataFrame, keys: Sequence[str], decimals: int | None = 3, means_only: bool = False) -> DataFrame:
    """Columns that hold ``fairness`` by squared errors and those that hold ``performance`` by mean, rounded half to even."""
    out = {}
    for c in df.columns:
        if c not in keys and "fairness" in c and not means_only:
            out[c] = F.coalesce(F.sum(squared_error_to_one(c)), F.lit(0.0))
        elif c not in keys and ("fairness" in c or "performance" in c):
            out[c] = F.avg(_number(c))
    return df.groupBy(*keys).agg(*((F.bround(e, decimals) if decimals is not None else e).alias(c) for c, e in out.items()))


def first_or_last(df: DataFrame, seed: str, ordinal: str, head: int | None = None, tail: int | None = None) -> DataFrame:
    """The first and the last rows of each seed, by an ordinal; without either, all rows."""
    if head is None and tail is None:
        return df
    up, down = Window.partitionBy(seed).orderBy(F.col(ordinal).asc()), Window.partitionBy(seed).orderBy(F.col(ordinal).desc())
    keep = F.lit(False)
    if head is not None:
        df, keep = df.withColumn("_up", F.row_number().over(up)), keep | (F.col("_up") <= head)
    if tail is not None:
        df, keep = df.withColumn("_down", F.row_number().over(down)), keep | (F.col("_down") <= tail)
    return df.where(keep).drop("_up", "_down")


def missing_seeds(df: DataFrame, seed: str, first: int, count: int) -> DataFrame:
    """Seeds of first..first+count-1 without a row."""
    expected = df.sparkSession.range(first, first + count).withColumnRenamed("id", "seed")
    return expected.join(df.select(F.col(seed).cast("long").alias("seed")).distinct(), "seed", "left_anti")


def complete_seeds(df: DataFrame, seed: str, part: str, parts: Sequence) -> DataFrame:
    """Rows of the seeds that have rows of every part."""
    full = df.where(F.col(part).isin(list(parts))).groupBy(seed).agg(F.count_distinct(part).alias("_n")).where(F.col("_n") == len(set(parts))).select(seed)
    return df.join(full, seed, "left_semi")


def same_shape(df: DataFrame, seed: str) -> DataFrame:
    """Whether all seeds have as many rows (``same``), and the least and most."""
    return df.groupBy(seed).agg(F.count(F.lit(1)).alias("n")).agg((F.count_distinct("n") <= 1).alias("same"), F.min("n").alias("least"), F.max("n").alias("most"))


def genotype_frequency(df: DataFrame, genotype: str, ordinal: str) -> DataFrame:
    """(genotype, n, first, code): counts, and codes by falling count, ties in order of appearance, from 0."""
    counts = df.groupBy(F.col(genotype).alias("genotype")).agg(F.count(F.lit(1)).alias("n"), F.min(ordinal).alias("first"))
    # Slices by count and then by place of first appearance, so that no task sorts all genotypes.
    out = ranked(counts, [], [F.desc("n"), F.col("first")], F.struct(-F.col("n"), F.shiftright(F.col("first").cast("long"), 20)), "code")
    return out.withColumn("code", (F.col("code") - 1).cast("int"))


def evolution_means(df: DataFrame, generation: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The mean over seeds of each numeric column by generation."""
    kinds = dict(df.dtypes)
    columns = [c for c in df.columns if c != generation and kinds[c] in ("double", "float", "int", "bigint")] if columns is None else columns
    return df.groupBy(generation).agg(*(F.avg(_number(c)).alias(c) for c in columns))
