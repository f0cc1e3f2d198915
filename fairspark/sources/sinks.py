"""Sinks: appended partitioned tables, and single text files for export.

An append with a run's name may be repeated: its files are written aside, and come into the table by one rename of their
folder, which either happened or didn't.  A run that was killed leaves nothing in the table, one that is run again after it
was published adds nothing.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairspark.functions.scalar import rounded_text


def append(df: DataFrame, path: str, by: Sequence[str] = (), run: str | None = None) -> bool:
    """Adds rows to a Parquet table, partitioned by columns; whether they came in by this call.

    With a run, a name that no other append to the table has, the table is partitioned by ``run`` first, and its rows come in
    whole and once.  What a killed attempt left aside goes.  Readers pass over names with an underscore.
    """
    if run is None:
        df.write.mode("append").partitionBy(*by).parquet(path)
        return True
    if not re.fullmatch(r"[\w.-]+", run):
        raise ValueError(f"not a name for a folder: {run!r}")
    spark = df.sparkSession
    published, aside = f"{path}/run={run}", f"{path}/_aside/{run}"
    if _there(spark, published):
        return False
    delete(spark, aside)
    df.write.partitionBy(*by).parquet(aside)
    # A folder that came into being meanwhile, by the same run elsewhere, must not take this one in as its child.
    if _there(spark, published) or not _renamed(spark, aside, published):
        delete(spark, aside)
        return False
    return True


def published(spark: SparkSession, path: str, run: str) -> bool:
    """Whether a run's rows are in the table."""
    return _there(spark, f"{path}/run={run}")


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _there(spark: SparkSession, path: str) -> bool:
    where, files = _path(spark, path)
    return files.exists(where)


def _renamed(spark: SparkSession, source: str, target: str) -> bool:
    (a, files), (b, _) = _path(spark, source), _path(spark, target)
    return files.rename(a, b)


def formatted(df: DataFrame, decimals: int = 4) -> DataFrame:
    """Floating columns as text with fixed decimals, rounded half to even."""
    return df.withColumns({c: rounded_text(c, decimals) for c, t in df.dtypes if t in ("double", "float")})


def export_csv(df: DataFrame, path: str, decimals: int | None = 4) -> None:
    """A small result as one CSV part with a header."""
    (formatted(df, decimals) if decimals is not None else df).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def save_results(metrics: DataFrame, distributions: DataFrame, path: str, by: Sequence[str] = ("dataset", "seed"), run: str | None = None) -> None:
    """Metrics as they are; shares that are missing as 0."""
    append(metrics, f"{path}/metrics", by, run)
    append(distributions.fillna(0.0), f"{path}/distributions", by, run)


def by_classifier(df: DataFrame, path: str, classifier: str = "classification_algorithm", order: Sequence[str] = ("value", "ordinal"), without: str | None = None) -> None:
    """A folder for each classifier, rows in order within each of its files, NaN and null last; without: a set that is left out.

    Rows are dealt by ranges of classifier and order, so that a large classifier has several files, in order by name.
    """
    rows = df if without is None else df.where(~F.col("set").eqNullSafe(F.lit(without)))
    by = [F.col(c).asc_nulls_last() for c in (classifier, *order) if c in df.columns]
    rows.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").partitionBy(classifier).parquet(path)


def save_evolution(history: DataFrame, path: str, attribute: str, seed: int, iteration: int = 0, run: str | None = None) -> None:
    """Adds the history of a search, a row a generation by its number in ``Generation``, with its attribute, iteration and seed."""
    append(history.withColumns({"attribute": F.lit(attribute), "iteration": F.lit(iteration), "seed": F.lit(seed)}), path, ("attribute", "iteration", "seed"), run)


def delete(spark: SparkSession, path: str) -> bool:
    """Removes a folder; whether there was one."""
    where, files = _path(spark, path)
    return files.delete(where, True)


def backup(df: DataFrame, path: str) -> DataFrame:
    """Writes a table and reads it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
