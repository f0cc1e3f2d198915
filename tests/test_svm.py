"""The cascade against a plain dual solver on all rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairspark.operators import models, svm


def sample(n, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    return x, np.where((x**2).sum(1) + rng.normal(size=n) * 0.3 > 1.2, 1.0, -1.0)


def frame(spark, x, y):
    return spark.createDataFrame([(i, *map(float, v), float(t > 0)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "row_id long, a double, b double, target double").repartition(3)


def plain_dual(x, y, c, gamma, sweeps=4000):
    """Projected gradient on the dual with the shift as a multiplier: slow, and nothing like the solver."""
    q = svm.kernel(x, x, gamma) * y[:, None] * y[None, :]
    a, rate, push, shift = np.zeros(len(y)), 1.0 / np.linalg.eigvalsh(q).max(), 0.5, 0.0
    for _ in range(sweeps):
        for _ in range(3):
            a = np.clip(a - rate * (q @ a - 1 + y * shift), 0, c)
        shift += push * rate * (a @ y)
    return a, shift


def test_solver_meets_the_conditions_of_the_optimum():
    x, y = sample(400)
    a, shift = svm.solve(x, y, 1.0, 0.5, tolerance=1e-6)
    margin = y * (svm.kernel(x, x, 0.5) @ (a * y) + shift)
    assert abs((a * y).sum()) < 1e-9 and a.min() >= 0 and a.max() <= 1
    assert (margin[a == 0] > 1 - 1e-5).all() and (margin[a == 1] < 1 + 1e-5).all()
    assert np.abs(margin[(a > 0) & (a < 1)] - 1).max() < 1e-5


def test_solver_equals_projected_gradient():
    x, y = sample(60, 3)
    a, shift = svm.solve(x, y, 1.0, 0.5, tolerance=1e-7)
    b, other = plain_dual(x, y, 1.0, 0.5, 20_000)
    k = svm.kernel(x, x, 0.5)
    assert np.abs(k @ (a * y) + shift - (k @ (b * y) + other)).max() < 1e-2


@pytest.mark.parametrize("block", [1000, 70])
def test_cascade_has_the_margins_of_all_rows_at_once(spark, monkeypatch, block):
    monkeypatch.setattr(svm, "BLOCK", block)
    x, y = sample(500, 1)
    machine = svm.fit(frame(spark, x, y), ["a", "b"], c=1.0)
    a, shift = svm.solve(x, y, 1.0, machine.gamma)
    assert machine.gamma == pytest.approx(1 / (2 * x.var()))
    assert np.abs(machine.margin(x) - (svm.kernel(x, x, machine.gamma) @ (a * y) + shift)).max() < 5e-3


def test_too_many_support_vectors_are_approximated(spark, monkeypatch):
    x, y = sample(200, 2)
    rows = frame(spark, x, y)
    monkeypatch.setattr(svm, "MOST", 10)
    with pytest.raises(svm.TooMany):
        svm.fit(rows, ["a", "b"])
    out = models.fit_predict(rows, rows, "rbf_svc", ["a", "b"])
    assert out.where(F.col("prediction") == F.col("target")).count() > 150


def test_some_blocks_tell_that_there_are_too_many(spark, monkeypatch):
    x, y = sample(400, 5)
    rows = frame(spark, x, y)
    for name, value in (("BLOCK", 10), ("FIRST", 3), ("MOST", 8)):
        monkeypatch.setattr(svm, name, value)
    blocks, merged = [], svm._merged
    monkeypatch.setattr(svm, "_merged", lambda found, n, *more: blocks.append(n) or merged(found, n, *more))
    with pytest.raises(svm.TooMany):
        svm.fit(rows, ["a", "b"])
    assert blocks and max(blocks) < 40  # not all blocks were solved
    monkeypatch.setattr(svm, "MOST", 3000)
    a, shift = svm.solve(x, y, 1.0, 1 / (2 * x.var()))
    machine = svm.fit(rows, ["a", "b"])  # where they aren't too many, the solution is that of all rows
    assert np.abs(machine.margin(x) - (svm.kernel(x, x, machine.gamma) @ (a * y) + shift)).max() < 5e-3


@pytest.mark.parametrize("begin", [1 << 16, 100])
def test_machine_of_waves_is_the_optimum_of_all_rows(spark, monkeypatch, begin):
    monkeypatch.setattr(svm, "BEGIN", begin)  # from a sample, by passes over all rows, and at once
    x, y = sample(600, 6)
    rows = frame(spark, x, y)
    machine = svm.approximate(rows.unionByName(rows), ["a", "b"], 0.5, 256)  # each row twice, at half the price
    waves = machine.waved(x).astype(float)
    worth = lambda w: (w[:-1] ** 2).sum() / 2 + np.maximum(0, 1 - y * (waves @ w)).sum()
    a, shift = svm.solve(x, y, 1.0, 1 / (2 * x.var()))
    k = waves[:, :-1] @ waves[:, :-1].T
    assert np.abs(k - svm.kernel(x, x, 1 / (2 * x.var()))).mean() < 0.15  # waves stand for the kernel
    best, w = np.inf, np.zeros(257)  # plain subgradient descent
    for i in range(20_000):
        off = y * (waves @ w) < 1
        w = w - 0.05 / (1 + i) ** 0.6 * 0.1 * (np.append(w[:-1], 0.0) - waves.T @ (off * y))
        best = min(best, worth(w))
    assert worth(machine.weights) < best * 1.01
    assert (np.sign(machine.margin(x)) == np.sign(svm.kernel(x, x, 1 / (2 * x.var())) @ (a * y) + shift)).mean() > 0.93


@pytest.mark.parametrize("held", [4096, 50])
def test_exact_machine_has_the_margins_of_the_dual(spark, monkeypatch, held):
    monkeypatch.setattr(svm, "HELD", held)
    x, y = sample(500, 1)
    machine = svm.exact(frame(spark, x + 1e4, y), ["a", "b"], c=1.0, gamma=0.5)  # far from 0
    a, shift = svm.solve(x, y, 1.0, 0.5, tolerance=1e-6)
    assert np.abs(machine.margin(x + 1e4) - (svm.kernel(x, x, 0.5) @ (a * y) + shift)).max() < 1e-3


def test_equal_rows_count_each(spark):
    x, y = sample(300, 7)
    rows = frame(spark, x, y)
    once, twice = svm.exact(rows, ["a", "b"], 2.0), svm.exact(rows.unionByName(rows), ["a", "b"], 1.0)
    assert np.abs(once.margin(x) - twice.margin(x)).max() < 1e-3


def test_predictions_do_not_depend_on_how_many_support_vectors_there_are(spark, monkeypatch):
    x, y = sample(600, 8)
    rows = frame(spark, x, y)
    gamma = 1 / (2 * x.var())
    a, shift = svm.solve(x, y, 1.0, gamma, tolerance=1e-6)
    margin = svm.kernel(x, x, gamma) @ (a * y) + shift
    monkeypatch.setattr(svm, "MOST", 10)  # far fewer than there are
    out = models.fit_predict(rows, rows, "rbf_svc", ["a", "b"]).collect()
    assert all((r["prediction"] == 1) == (margin[r["row_id"]] > 0) for r in out if abs(margin[r["row_id"]]) > 1e-3)


def test_more_pivots_than_allowed_are_solved_in_the_dual_or_told(spark, monkeypatch):
    x, y = sample(150, 9)
    rows = frame(spark, x, y)
    monkeypatch.setattr(svm, "RANK", 5)
    with pytest.raises(svm.TooMany):
        svm.exact(rows, ["a", "b"])
    a, shift = svm.solve(x, y, 1.0, 1 / (2 * x.var()))
    margin = svm.kernel(x, x, 1 / (2 * x.var())) @ (a * y) + shift
    out = models.fit_predict(rows, rows, "rbf_svc", ["a", "b"]).collect()
    assert all((r["prediction"] == 1) == (margin[r["row_id"]] > 0) for r in out if abs(margin[r["row_id"]]) > 1e-2)
    monkeypatch.setattr(svm, "MOST", 10)
    with pytest.raises(svm.TooMany):
        models.fit_predict(rows, rows, "rbf_svc", ["a", "b"])


def test_one_label_and_missing_features(spark):
    x, y = sample(40, 4)
    rows = frame(spark, x, np.ones(40))
    assert svm.predict(svm.fit(rows, ["a", "b"]), rows, ["a", "b"]).where("prediction = 1").count() == 40
    holed = frame(spark, x, y).unionByName(spark.createDataFrame([(99, None, 1.0, 1.0), (98, float("nan"), 1.0, 0.0)], "row_id long, a double, b double, target double"))
    assert svm.fit(holed, ["a", "b"]).margin(x) == pytest.approx(svm.fit(frame(spark, x, y), ["a", "b"]).margin(x), abs=5e-3)
