"""Published results, reproduced from the tables that they were made of."""

from __future__ import annotations

import csv
import os

import pytest
from pyspark.sql import functions as F

from fairspark.operators import reduce, report

DATA = os.path.join(os.path.dirname(__file__), "data")


def read(spark, name):
    return spark.read.option("header", True).option("inferSchema", True).option("escape", '"').csv(f"file://{DATA}/{name}.csv")


def lines(name):
    with open(os.path.join(DATA, f"{name}.csv"), newline="") as file:
        return list(csv.DictReader(file))


@pytest.fixture(scope="module")
def metrics(spark):
    return read(spark, "metrics").cache()


def test_coloured_tables(metrics):
    fair, good = ([c for c in metrics.columns if c.startswith(k)] for k in ("fairness", "performance"))
    expected = {}
    for r in lines("coloured"):
        expected.setdefault((r["table"], r["classifier"]), []).append(r["text"])
    assert sum(map(len, expected.values())) == 516
    for (table, classifier), text in expected.items():
        own = metrics.where((F.col("table") == table) & (F.col("classifier") == classifier))
        cells = report.coloured_cells(report.colours(own, fair, good), [*fair, *good])
        # The groups in order of appearance, and in each its rows as they stand.
        first = own.groupBy("value").agg(F.min("ordinal").alias("first"))
        made = report.latex_of(cells.join(first, "value"), [f"{m}_cell" for m in [*fair, *good]], ["first", "ordinal"], [*fair, *good], "|c" * 9 + "|" + "r|" * 9)
        assert made.split("\n")[4:-2] == text


def test_effects_of_a_second_pass(metrics):
    fair = [c for c in metrics.columns if c.startswith("fairness")]
    totals = {}
    for table in ("german", "law"):
        effect = report.effect_by(report.iteration_effect(metrics.where(F.col("table") == table), fair, ("classifier", "algorithm", "value")), ("classifier", "algorithm"))
        found = {(r.classifier, r.algorithm): (r.value, r.num_increases, r.num_decreases, r.num_no_change) for r in effect.collect()}
        expected = {(r["classifier"], r["algorithm"]): (r["group"], *(int(r[f"num_{k}"]) for k in ("increases", "decreases", "no_change"))) for r in lines("effects") if r["table"] == table and r["algorithm"] != "Total"}
        assert found == expected
        total = report.with_total(effect, "classifier").where("classifier = 'Total'").first()
        totals[table] = (total.num_increases, total.num_decreases, total.num_no_change)
    assert totals == {"german": (142, 194, 168), "law": (130, 82, 838)}


def test_means_over_seeds(spark):
    found = reduce.evolution_means(read(spark, "evolution").withColumn("Generation", F.lit(1)).drop("seed"), "Generation").first().asDict()
    (expected,) = lines("evolution_means")
    assert len(expected) == 40 or len(expected) > 20
    for column, value in expected.items():
        assert found[column] == pytest.approx(float(value), abs=1e-12)


def test_order_of_genotypes(spark):
    found = reduce.genotype_frequency(read(spark, "evolution"), "Genotype", "seed").orderBy("code").collect()
    assert [(r.code, r.genotype) for r in found] == [(int(r["code"]), r["Genotype"]) for r in lines("genotypes")]
    assert [r.n for r in found] == [2] * 5 + [1] * 20
