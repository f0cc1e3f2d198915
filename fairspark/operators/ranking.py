"""Exact ranks within groups that may be huge.

A plain row_number sorts each group in one task.  Here rows are first counted by slices of the order (combined before the
shuffle); a slice's first rank is the running sum of those before it, and only rows of one slice are sorted together.
The ranks are those of row_number over the whole group.

Where slices of one column would be uneven (a value of very many rows, texts with a common prefix), rows are dealt by sampled
ranges of the whole order instead: keys, value and what breaks ties.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairspark.plans.storage import stored


def hash32(key: Column | str, seed: int = 42, factor: int = 2654435761, step: int = 40503) -> Column:
    """A whole number below 2^32 from an integer key and a seed, by plain arithmetic that any SQL engine has."""
    key = F.col(key) if isinstance(key, str) else key
    # In 32-bit halves: nothing passes 2^63, and the result is that of unbounded arithmetic.
    low, high, two = F.pmod(key.cast("long"), F.lit(1 << 16)), F.pmod(F.shiftright(key.cast("long"), 16), F.lit(1 << 16)), F.lit(1 << 32)
    return F.pmod(low * F.lit(factor) + F.pmod(high * F.lit(factor), F.lit(1 << 16)) * F.lit(1 << 16) + F.lit(seed * step), two)


def value_edges(df: DataFrame, column: str, slices: int = 256) -> list[float]:
    """Ascending edges that cut a numeric column into about even slices."""
    found = df.agg(F.percentile_approx(F.col(column).cast("double"), [i / slices for i in range(1, slices)], 4 * slices)).first()[0]
    return sorted(set(found or []))


def sliced_by(column: Column, edges: Sequence[float]) -> Column:
    """How many edges are at most the value: a slice that ascends with it; nulls come first."""
    if not edges:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= column)), F.lit(-1))


def running_total(df: DataFrame, keys: Sequence[str], weight: str, order: Sequence[Column], slice_: Column, total: str = "total", whole: str | None = None) -> DataFrame:
    """Adds the sum of ``weight`` up to and with each row by ``order`` within ``keys``, and of all; slice_ ascends with the order."""
    df, by = df.withColumn("_slice", slice_), list(keys)
    sums = df.groupBy(*by, "_slice").agg(F.sum(weight).alias("_in"))
    everything = Window.partitionBy(*(by or [F.lit(0)]))
    before = F.coalesce(F.sum("_in").over(everything.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*by, "_slice", before.alias("_before"), F.sum("_in").over(everything).alias("_all"))
    joined = df.alias("a").join(sums.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*by, "_slice"]]).select("a.*", "b._before", "b._all")
    out = joined.withColumn(total, F.col("_before") + F.sum(weight).over(Window.partitionBy(*by, "_slice").orderBy(*order)))
    return (out.withColumn(whole, F.col("_all")) if whole else out).drop("_slice", "_before", "_all")


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], slice_: Column, rank: str = "rank", count: str | None = None) -> DataFrame:
    """Adds the rank (from 1) of each row by ``order`` within ``keys``, and their count; slice_ must ascend with the order."""
    df = df.withColumn("_slice", slice_)
    by = list(keys)
    sums = df.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_in"))
    running = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*(by or [F.lit(0)]))
    sums = sums.select(*by, "_slice", F.coalesce(F.sum("_in").over(running), F.lit(0)).alias("_before"), F.sum("_in").over(whole).alias("_all"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*by, "_slice"]]
    joined = df.alias("a").join(sums.alias("b"), same).select("a.*", "b._before", "b._all")
    inside = Window.partitionBy(*by, "_slice").orderBy(*order)
    out = joined.withColumn(rank, F.col("_before") + F.row_number().over(inside))
    if count:
        out = out.withColumn(count, F.col("_all"))
    return out.drop("_slice", "_before", "_all")


def dealt(df: DataFrame, order: Sequence[Column], name: str = "_place") -> DataFrame:
    """df, written, with the row's place within its range of the order, after the range's number times 2^33.

    Ranges come from a sample of all columns of the order, so that they are even however few values its first ones have.
    """
    order = list(order)
    return stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()))


def ranked_by_range(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rank: str = "rank", count: str | None = None) -> DataFrame:
    """Adds the rank (from 1) of each row by ``order`` within ``keys``, and their count; the order should tell all rows apart.

    A key's rank goes on from range to range: each range tells how many rows of the key it has, and where they begin.
    """
    by, part = list(keys), F.shiftright("_place", 33)
    rows = dealt(df, [*(F.col(k) for k in by), *order]).withColumn("_part", part)
    parts = rows.groupBy(*by, "_part").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_in"))
    whole = Window.partitionBy(*(by or [F.lit(0)]))  # a row a range and key
    before = F.coalesce(F.sum("_in").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*by, "_part", "_first", before.alias("_before"), F.sum("_in").over(whole).alias("_all"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*by, "_part"]]
    joined = rows.alias("a").join(parts.alias("b"), same).select("a.*", "b._first", "b._before", "b._all")
    out = joined.withColumn(rank, F.col("_place") - F.col("_first") + F.col("_before") + 1)
    if count:
        out = out.withColumn(count, F.col("_all"))
    return out.drop("_place", "_part", "_first", "_before", "_all")
