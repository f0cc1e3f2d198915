"""Boosting against a plain version, in one task and by jobs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairspark.operators import boosting, models


def sample(n=160, seed=0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n).round(1), rng.integers(0, 6, n)]).astype(float)
    y = ((x[:, 0] + 0.3 * x[:, 1] + rng.normal(size=n) * 0.3) > 0.8).astype(float)
    x[rng.random(n) < 0.15, 0] = np.nan
    return x, y


def plain(x, y, edges, s):
    """Trees as nested tuples by trying each edge of each feature of each node, with the missing ones on either side."""
    margin, out = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), []
    for _ in range(s.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        score = lambda r: g[r].sum() ** 2 / (h[r].sum() + s.penalty)  # noqa: B023, E731

        def build(rows, depth):
            best = None
            if depth < s.depth:
                for j, e in enumerate(edges):
                    for k, cut in enumerate([*e, np.inf]):
                        for side in (False, True):
                            low = np.where(np.isnan(x[rows, j]), side, x[rows, j] <= cut)
                            left, right = rows[low], rows[~low]
                            if min(h[left].sum(), h[right].sum()) < s.least:  # noqa: B023
                                continue
                            gain = (score(left) + score(right) - score(rows)) / 2 - s.split_cost  # noqa: B023
                            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                                best = (gain, j, k, side, left, right)
            if best is None:
                weight = -g[rows].sum() / (h[rows].sum() + s.penalty) * s.rate  # noqa: B023
                margin[rows] += weight
                return round(float(weight), 9)
            _, j, k, side, left, right = best
            return (j, k, side, build(left, depth + 1), build(right, depth + 1))

        out.append(build(np.arange(len(y)), 0))
    return out, margin


def nested(tree, i=0):
    if tree.feature[i] < 0:
        return round(float(tree.weight[i]), 9)
    return (int(tree.feature[i]), int(tree.bin[i]), bool(tree.missing_left[i]), nested(tree, tree.left[i]), nested(tree, tree.right[i]))


SMALL = boosting.Settings(rounds=4, depth=3, bins=8, split_cost=0.01)


def test_trees_equal_a_plain_version():
    x, y = sample()
    edges = [np.quantile(x[~np.isnan(x[:, 0]), 0], np.arange(1, 8) / 8, method="lower"), np.arange(5.0)]
    edges = [np.unique(e) for e in edges]
    model = boosting.boosted_here(boosting.binned(x, edges), y, edges, SMALL)
    trees, margin = plain(x, y, edges, SMALL)
    assert [nested(t) for t in model.trees] == trees
    assert model.margin(model.binned(x)) == pytest.approx(margin)


def frame(spark, x, y):
    return spark.createDataFrame([(i, None if np.isnan(a) else float(a), float(b), float(t)) for i, ((a, b), t) in enumerate(zip(x, y, strict=True))], "row_id long, a double, b double, target double").repartition(3)


def test_jobs_and_one_task_grow_the_same_trees(spark, monkeypatch):
    x, y = sample(300, 1)
    rows = frame(spark, x, y)
    here = boosting.fit(rows, ["a", "b"], SMALL)
    monkeypatch.setattr(boosting, "LOCAL", 10)
    monkeypatch.setattr(boosting, "WRITTEN", 2)
    jobs = boosting.fit(rows, ["a", "b"], SMALL)
    assert [nested(t) for t in here.trees] == [nested(t) for t in jobs.trees]
    assert here.base == pytest.approx(jobs.base)
    trees, _ = plain(x, y, here.edges, SMALL)
    assert [nested(t) for t in here.trees] == trees


def test_rows_of_the_same_bins_are_one_cell(spark, monkeypatch):
    x, y = sample(900, 3)
    rows = frame(spark, x, y)
    edges = boosting.fit(rows, ["a", "b"], SMALL).edges
    b = boosting.binned(x, edges)
    vectors = F.array(*(F.coalesce(c, F.lit(float("nan"))) for c in ("a", "b")))
    held = boosting.cells(rows.select(vectors.alias("x"), F.col("target").alias("y")), edges).collect()
    assert len(held) == len(np.unique(b, axis=0)) < 100
    assert sum(r["n"] for r in held) == 900 and sum(r["ones"] for r in held) == y.sum()
    trees, _ = plain(x, y, edges, SMALL)
    for most in (boosting.LOCAL, len(held), 10):  # all cells fit a task, though their rows don't; then by jobs
        monkeypatch.setattr(boosting, "LOCAL", most)
        assert [nested(t) for t in boosting.fit(rows, ["a", "b"], SMALL).trees] == trees


def test_missing_values_take_the_better_side():
    x, y = np.array([[0.0]] * 20 + [[1.0]] * 20 + [[np.nan]] * 20), np.array([0.0] * 20 + [1.0] * 40)
    model = boosting.boosted_here(boosting.binned(x, [np.array([0.0])]), y, [np.array([0.0])], boosting.Settings(rounds=3, depth=1))
    assert not model.trees[0].missing_left[0]
    assert ((model.margin(model.binned(x)) > 0) == (y == 1)).all()
    turned = boosting.boosted_here(boosting.binned(x, [np.array([0.0])]), 1 - y, [np.array([0.0])], boosting.Settings(rounds=3, depth=1))
    assert ((turned.margin(turned.binned(x)) > 0) == (y == 0)).all()


def test_as_classifier_and_on_odd_data(spark):
    x, y = sample(400, 2)
    rows = frame(spark, x, y)
    out = models.fit_predict(rows, rows, "xgb", ["a", "b"])
    assert out.count() == 400 and out.where(F.col("prediction") == F.col("target")).count() > 350
    one = boosting.fit(rows.withColumn("target", F.lit(1.0)), ["a", "b"], SMALL)
    assert boosting.predict(one, rows, ["a", "b"]).where("prediction = 1").count() == 400
    assert boosting.fit(rows.limit(0), ["a", "b"], SMALL).trees == []
