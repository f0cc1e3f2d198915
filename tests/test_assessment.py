"""Runs from end to end on a small table."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from fairspark.operators import feature_search, pipeline_search
from fairspark.plans import assessment
from fairspark.sources import readers, sinks
from fairspark.sources.prepare import Dataset


SMALL = assessment.Plan(
    seed=7, surrogates=("decision_tree",), target="decision_tree", features=feature_search.Settings(size=2, generations=1, folds=2, model="decision_tree"),
    sequences=pipeline_search.Settings(size=2, generations=2, tournament=2, elite=1, threshold=3), pool=("MSG", "REW"),
)


@pytest.fixture(scope="module")
def dataset(spark):
    rows = spark.range(240).select(F.col("id").alias("row_id"), (F.col("id") % 3 == 0).cast("int").alias("sex"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    rows = rows.withColumn("target", ((F.col("a") + F.when(F.col("sex") == 1, 0).otherwise(2)) > 4).cast("double")).withColumn("protected_sex", F.col("sex"))
    return Dataset(rows, ("sex", "a", "b"), ("sex",), {"sex": {0: "Female", 1: "Male"}})


def test_run(spark, dataset, tmp_path):
    metrics, shares = assessment.run(dataset, "small", ["massaging"], shares=(0.6, 0.2, 0.2), plan=SMALL)
    rows = metrics.collect()
    assert {r.algorithm for r in rows} == {None, "massaging"}
    # baseline, and one correction for two groups; two sets, two kinds of classifier, two groups each
    assert len(rows) == (1 + 2) * 2 * 2 * 2
    assert not any(r.error for r in rows)
    assert all(0 <= r.fairness_consistency <= 1 for r in rows)
    sinks.save_results(metrics.withColumn("seed", F.lit(7)), shares.withColumn("seed", F.lit(7)), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/metrics")).count() == len(rows)


def test_errors_are_rows(dataset, monkeypatch):
    def refuses(*_):
        raise ValueError

    monkeypatch.setitem(assessment.CORRECTIONS, "refuses", refuses)
    metrics, _ = assessment.run(dataset, "small", ["refuses"], shares=(0.6, 0.2, 0.2), plan=SMALL)
    wrong = metrics.where("algorithm = 'refuses'").collect()
    assert all(r.error and r.performance_accuracy == 0.0 and r.fairness_disparate_impact == 0.0 for r in wrong)
    with pytest.raises(ValueError):
        assessment.correction("none")


def test_corrections_keep_rows(spark, dataset, tmp_path):
    df = dataset.data.withColumn("_dummy", (F.col("protected_sex") == 1).cast("int"))
    repaired = assessment.repair(df, "_dummy", "sex", dataset.features)
    assert set(repaired.columns) == set(df.columns)
    assert repaired.count() == 240
    plan = replace(SMALL, evolution=str(tmp_path / "evolution"))
    searched = assessment.sequence_search(dataset.data, "_dummy", "sex", dataset.features, plan)
    assert searched.count() >= 240
    assert "_dummy" not in searched.columns
    history = readers.parquet(spark, str(tmp_path / "evolution"))
    assert {"Genotype", "decision_tree_sse_consistency", "decision_tree_performance_aucmean", "Generation", "seed"} <= set(history.columns)
    kept = assessment.feature_search(df, "_dummy", "sex", dataset.features, SMALL)
    assert "sex" in kept.columns


def test_command_line(spark, tmp_path, monkeypatch):
    from fairspark import __main__ as command
    from fairspark.plans.io_queries import _INI
    from fairspark.sources.config import plan

    lines = [" ".join(["A11", str(6 + i % 50), "A34", "A43", str(1000 + i), "A65", "A75", str(i % 4 + 1), ["A93", "A92"][i % 2], "A101", "4", "A121", str(20 + i % 40), "A143", "A152", "2", "A173", "1", "A192", "A201", str(1 + i % 3 % 2)]) for i in range(200)]
    (tmp_path / "credit.data").write_text("\n".join(lines))
    out = tmp_path / "out"
    text = _INI.replace('"d.cfg"', str(tmp_path / "c.cfg")).replace("a.cfg", str(tmp_path / "c.cfg")).replace("= results", f"= {out}").replace("num_runs = 3", "num_runs = 1").replace("= 2\n[surr", "= 1\n[surr").replace("Attribute9, Attribute13", "Attribute9").replace("svm = True", "svm = False")
    (tmp_path / "c.cfg").write_text(text)
    monkeypatch.setattr(command, "plan", lambda *args: replace(plan(*args), target="decision_tree"))
    command.main(["-dataset", "German Credit", "-path", f"file://{tmp_path}/credit.data", "-configs", str(tmp_path / "c.cfg"), "-algorithm", ""])
    rows = readers.parquet(spark, f"{out}/metrics").collect()
    assert {r.classification_algorithm for r in rows} == {"logistic_regression", "decision_tree"}
    assert {(r.algorithm, r.seed) for r in rows} == {(None, 42)}
