"""Rows are numbered as they stand in their files, however files are split."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fairspark.sources import readers


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "8"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_ordinals_of_a_file_read_in_splits(spark, tmp_path, small_splits):
    for seed, n in ((1, 6000), (2, 900), (10, 1)):
        (tmp_path / f"run {seed}.csv").write_text("name,n\n" + "".join(f"row{i},{i}\n" for i in range(n)))
    pattern = f"{tmp_path}/run {{seed}}.csv"
    out = readers.seeds_ends(spark, pattern, 0, 12, schema="name string, n long")
    file = spark.read.option("header", True).schema("name string, n long").csv(f"{tmp_path}/run 1.csv")
    assert file.select("_metadata.file_block_start").distinct().count() >= 8
    assert {r["seed"]: r["n"] for r in out.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).collect()} == {1: 6000, 2: 900, 10: 1}
    assert out.where("ordinal <> n").count() == 0
    ends = readers.seeds_ends(spark, pattern, 0, 12, head=2, tail=3, schema="name string, n long")
    assert sorted((r["seed"], r["n"]) for r in ends.collect()) == [(1, 0), (1, 1), (1, 5997), (1, 5998), (1, 5999), (2, 0), (2, 1), (2, 897), (2, 898), (2, 899), (10, 0)]


def test_values_with_line_ends_and_files_of_other_columns(spark, tmp_path):
    (tmp_path / "a1.csv").write_text('x,y\n"one\ntwo",1\nthree,2\n')
    (tmp_path / "a2.csv").write_text("x,z\nfour,5\n")
    pattern = f"{tmp_path}/a{{seed}}.csv"
    whole = readers.seeds_ends(spark, pattern, 1, 1, schema="x string, y int", multiline=True)
    assert sorted((r["ordinal"], r["x"]) for r in whole.collect()) == [(0, "one\ntwo"), (1, "three")]
    both = readers.seeds_ends(spark, pattern, 1, 2)
    assert sorted((r["seed"], r["ordinal"], r["y"], r["z"]) for r in both.collect()) == [(1, 0, "1", None), (1, 1, "2", None), (2, 0, None, "5")]
    with pytest.raises(FileNotFoundError):
        readers.seeds_ends(spark, f"{tmp_path}/none{{seed}}.csv", 1, 2, schema="x string")
