"""Ranks by sampled ranges: right, and even where values aren't."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairspark.operators import encode
from fairspark.operators.ranking import dealt, ranked_by_range


def skewed(spark):
    """40,000 rows of which nine in ten share a value, and texts with one long common prefix."""
    rows = spark.range(40_000, numPartitions=6).withColumn("v", F.when(F.col("id") % 10 > 0, 7.0).otherwise(F.rand(3)))
    return rows.withColumns({"t": F.concat(F.lit("Customer#" + "0" * 40), F.pmod(F.xxhash64("id"), F.lit(30_000)).cast("string")), "g": F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 3)})


@pytest.mark.parametrize("column", ["v", "t"])
def test_no_range_is_twice_the_mean(spark, column):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # ranges of so few rows would be one
    try:
        rows = dealt(skewed(spark), [F.col(column), F.col("id")])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = [r["count"] for r in rows.groupBy(F.shiftright("_place", 33)).count().collect()]
    assert len(sizes) == 4 and max(sizes) <= 2 * sum(sizes) / len(sizes)


@pytest.mark.parametrize("keys", [[], ["g"], ["g", "v"]])
def test_ranks_are_those_of_row_number(spark, keys):
    rows = skewed(spark)
    order = [F.col("t").desc(), F.col("id")]
    window = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    want = rows.select("id", F.row_number().over(window.orderBy(*order)).alias("rank"), F.count(F.lit(1)).over(window).alias("n"))
    got = ranked_by_range(rows, keys, order, "rank", "n").select("id", "rank", "n")
    assert got.count() == 40_000 and got.exceptAll(want).count() == 0


def test_codes_of_texts_with_a_common_prefix(spark):
    codes = encode.label_codes(skewed(spark), "t").collect()
    assert [r["value"] for r in sorted(codes, key=lambda r: r["code"])] == sorted(r["value"] for r in codes)
    assert sorted(r["code"] for r in codes) == list(range(len(codes)))
    assert encode.label_codes(skewed(spark).limit(0), "t").collect() == []
