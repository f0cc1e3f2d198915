"""Cleaning and encoding: rows with nulls, quantile bins, label codes, dummies, exact stratified splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairspark.operators.ranking import hash32, ranked, ranked_by_range, running_total, sliced_by

#: Fixed value: edges closer than this are one.
NEAR = 1e-8


def drop_invalid(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows without a null among the features; targets aren't looked at."""
    return df.dropna("any", subset=list(features))


def quantile_edges(df: DataFrame, columns: Sequence[str], bins: int = 4) -> dict[str, list[float]]:
    """Interior edges of each column: exact, linearly interpolated percentiles; edges that coincide are merged.

    Values are counted (combined before the shuffle) and their counts added up by slices of the order; only the values at
    the percentiles' ranks come back, at most two for each.
    """
    if not columns:
        return {}
    at = [i / bins for i in range(bins + 1)]
    numbers = [F.col(f"`{c}`").cast("double") for c in columns]
    values = df.select(F.inline(F.array(*(F.struct(F.lit(i).alias("c"), x.alias("v")) for i, x in enumerate(numbers))))).where("v IS NOT NULL")
    cuts = df.agg(*(F.percentile_approx(x, [i / 256 for i in range(1, 256)], 1024).alias(f"c{i}") for i, x in enumerate(numbers))).first()
    slices = F.lit(0)
    for i in range(len(columns)):
        slices = F.when(F.col("c") == i, sliced_by(F.col("v"), sorted(set(cuts[f"c{i}"] or [])))).otherwise(slices)
    counted = running_total(values.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")), ["c"], "n", [F.col("v")], slices, "upto", "all")
    # The value of rank k (from 0) is that with upto - n <= k < upto.
    ranks = F.array(*(F.floor(F.lit(q) * (F.col("all") - 1)) + d for q in at for d in (0, 1)))
    wanted = counted.where(F.exists(ranks, lambda k: (k >= F.col("upto") - F.col("n")) & (k < F.col("upto"))))
    found: dict[int, list] = {}
    for r in wanted.select("c", "v", F.col("upto").alias("upto"), "n", "all").collect():  # at most two a percentile and column
        found.setdefault(r.c, []).append(r)
    out = {}
    for i, c in enumerate(columns):
        rows, kept = sorted(found.get(i, []), key=lambda r: r.v), []
        value = lambda k: next(r.v for r in rows if r.upto - r.n <= k < r.upto)  # noqa: E731, B023
        for q in at if rows else ():
            place = q * (rows[0]["all"] - 1)
            low = int(place)
            edge = value(low) if place == low else value(low) + (value(low + 1) - value(low)) * (place - low)
            if not kept or edge - kept[-1] > NEAR:
                kept.append(edge)
        out[c] = kept[1:-1]
    return out


def binned(column: Column, edges: Sequence[float]) -> Column:
    """Right-open bins, numbered from 0: the number of edges at or below the value."""
    out = F.lit(0)
    for edge in edges:
        out = out + F.when(column >= edge, 1).otherwise(0)
    return F.when(column.isNotNull(), out.cast("int"))


def quantile_bins(df: DataFrame, columns: Sequence[str], bins: int = 4) -> DataFrame:
    """Replaces numeric columns by their bins; all percentiles come from one pass."""
    edges = quantile_edges(df, columns, bins)
    return df.withColumns({c: binned(F.col(c), e) for c, e in edges.items()})


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code) of the distinct non-null values, codes by ascending value from 0.

    Values are ranked by sampled ranges, so that no task sorts them all.
    """
    values = df.select(F.col(f"`{column}`").alias("value")).where("value IS NOT NULL").distinct()
    return ranked_by_range(values, [], [F.col("value")], "code").select("value", (F.col("code") - 1).cast("int").alias("code"))


def label_encode(df: DataFrame, columns: Sequence[str] | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Text columns replaced by codes, and the table (value, code) of each; tables are joined by key, whatever their size."""
    columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)] if columns is None else list(columns)
    tables, out = {}, df
    for i, c in enumerate(columns):
        tables[c] = label_codes(df, c)
        codes = tables[c].select(F.col("value").alias(f"_value{i}"), F.col("code").alias(f"_code{i}"))
        out = out.join(codes, F.col(f"`{c}`") == F.col(f"_value{i}"), "left").withColumn(c, F.col(f"_code{i}")).drop(f"_value{i}", f"_code{i}")
    return out, tables


def labels_of(table: DataFrame, most: int = 10_000) -> dict[int, str]:
    """code -> value of a table of codes that must be small, as groups of a protected attribute are; larger ones raise."""
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} labels")
    return {r.code: r.value for r in sorted(rows, key=lambda r: r.code)}


def dummies(df: DataFrame, column: str, labels: Mapping[int, str]) -> DataFrame:
    """One 0/1 column a label beside the others, by the codes of a protected column."""
    if not labels:
        raise ValueError(f"{column} has no labels")
    return df.withColumns({label: (F.col(column) == code).cast("double") for code, label in labels.items()})


def set_feature(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Replaces a column in its place, or appends it."""
    return df.withColumn(name, value)


def masked(df: DataFrame, columns: Sequence[str], mask: Sequence[int]) -> DataFrame:
    """Drops the listed columns whose bit is 0."""
    if len(columns) != len(mask):
        raise ValueError("one bit a column")
    gone = {c for c, bit in zip(columns, mask, strict=True) if not bit}
    return df.select(*(c for c in df.columns if c not in gone))


def common_columns(left: DataFrame, right: DataFrame) -> list[str]:
    """The columns of the right that the left has, in the right's order."""
    have = set(left.columns)
    return [c for c in right.columns if c in have]


def stratified_split(df: DataFrame, key: str, strata: Sequence[str], shares: Sequence[tuple[str, float]] = (("train", 0.8), ("val", 0.1), ("test", 0.1)), seed: int = 42, part: str = "part") -> DataFrame:
    """Adds the part of each row, exact to a row in each stratum; rows are drawn by a hash of an integer key.

    Quotas are floors of cumulative shares; the last part takes what is left.
    """
    rows = ranked(df.withColumn("_h", hash32(key, seed)), strata, [F.col("_h"), F.col(key)], F.shiftright("_h", 20), "_rank", "_n")
    cut, upto = F.when(F.lit(False), F.lit("")), 0.0
    for name, share in shares[:-1]:
        upto = round(upto + share, 10)
        cut = cut.when(F.col("_rank") <= F.floor(F.lit(upto) * F.col("_n")), F.lit(name))
    return rows.withColumn(part, cut.otherwise(F.lit(shares[-1][0]))).drop("_h", "_rank", "_n")
