"""From raw rows to encoded tables: one description a dataset, one order of steps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairspark.functions.scalar import age_in_three, age_in_two, among, recode_by_pattern
from fairspark.operators.encode import drop_invalid, label_encode, labels_of, quantile_bins


@dataclass(frozen=True)
class Dataset:
    """A table with a row_id, features, ``target`` (0/1) and ``protected_<name>`` codes that survive later changes."""

    data: DataFrame
    features: tuple[str, ...]
    protected: tuple[str, ...]
    mappings: dict[str, dict[int, str]] = field(default_factory=dict)
    #: (value, code) of every encoded column.
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def protected_feature(self, name: str) -> str:
        if name not in self.protected:
            raise ValueError(f"{name} is not a protected attribute")
        return f"protected_{name}"

    def labels(self, name: str) -> dict[int, str]:
        self.protected_feature(name)
        if name not in self.mappings:
            raise ValueError(f"{name} has no labels")
        return self.mappings[name]


def credit_columns(df: DataFrame) -> DataFrame:
    """Sex by code and age by two bounds; the age is cut after it was binned, as published."""
    out = df.withColumn("Attribute9", among("Attribute9", ["A91", "A93", "A94"], "Male", "Female")).withColumn("Attribute13", age_in_two("Attribute13"))
    return out.withColumn("class", among("class", [2], 0.0, 1.0)).withColumnRenamed("class", "target")


def income_columns(df: DataFrame) -> DataFrame:
    out = df.withColumn("age", age_in_three("age"))
    return out.withColumn("income", recode_by_pattern("income", [("<=", 0), (">", 1)]).cast("double")).withColumnRenamed("income", "target")


def law_columns(df: DataFrame) -> DataFrame:
    return df.withColumn("target", F.col("pass_bar").cast("double")).drop("pass_bar")


STEPS: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {"German Credit": ("class", credit_columns), "Adult Income": ("income", income_columns), "Law School Admission Bar Passage": ("pass_bar", law_columns)}


def prepare(raw: DataFrame, name: str, protected: tuple[str, ...], bins: int = 4, key: str | None = None) -> Dataset:
    """Drops invalid rows, bins numbers (but protected ones), recodes, and encodes text, in this order.

    key: a column that identifies rows; without one rows are numbered as read, which one file of this size allows.
    """
    target, recode = STEPS[name]
    features = [c for c in raw.columns if c not in (target, key)]
    rows = drop_invalid(raw, features)
    rows = rows.withColumnRenamed(key, "row_id") if key else rows.withColumn("row_id", F.monotonically_increasing_id())
    numeric = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.NumericType) and f.name in features and f.name not in protected]
    rows = recode(quantile_bins(rows, numeric, bins))
    text = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.StringType) and f.name in features]
    coded, tables = label_encode(rows, text)
    mappings = {p: labels_of(tables[p]) for p in protected if p in tables}
    coded = coded.withColumns({f"protected_{p}": F.col(p) for p in protected})
    return Dataset(coded, tuple(features), protected, mappings, tables)
