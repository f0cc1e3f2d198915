"""The neighbour index and exact trees against exhaustive search."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from fairspark.operators import fairness, feature_search, models, neighbours, trees
from fairspark.plans.queries import QUERIES


def brute_consistency(rows, k=3):
    """rows: (group, features, key, p)."""
    out, keys, p = {}, np.array([r[2] for r in rows]), np.array([r[3] for r in rows], float)
    for g in {r[0] for r in rows}:
        x = np.column_stack([np.array([r[1] for r in rows], float), [r[0] == g for r in rows]])
        gaps = []
        for i in range(len(rows)):
            near = np.lexsort((keys, ((x - x[i]) ** 2).sum(1)))[:k]
            near = [j for j in near if j != i][: k - 1]
            gaps.append(abs(p[i] - (p[i] + p[near].sum()) / (1 + len(near))))
        out[g] = 1 - np.mean(gaps)
    return out


def scored(spark, rows, width):
    names = [f"f{i}" for i in range(width)]
    return spark.createDataFrame([(r[0], *r[1], r[2], r[3]) for r in rows], f"g string, {', '.join(f'{n} double' for n in names)}, key long, p double").repartition(4), names


@pytest.mark.parametrize("kind", ["continuous", "binned", "mixed", "small scale", "few rows"])
def test_consistency_equals_brute_force_with_a_null_group(spark, kind, monkeypatch):
    monkeypatch.setattr(neighbours, "ALONE", 100)
    rng = np.random.default_rng(len(kind))
    n = 5 if kind == "few rows" else 260
    x = {"continuous": rng.normal(size=(n, 2)) * 100, "binned": rng.integers(0, 3, (n, 2)), "mixed": np.column_stack([rng.integers(0, 40, n), rng.integers(0, 3, n)]), "small scale": rng.normal(size=(n, 3)) * 0.3}.get(kind, rng.integers(0, 2, (n, 1)))
    rows = [(["a", "b", None, "c"][int(rng.integers(4))], tuple(map(float, x[i])), i * 7 % 263, float(rng.integers(2)) if kind != "continuous" else float(rng.random())) for i in range(n)]
    df, names = scored(spark, rows, x.shape[1])
    got = {r["value"]: r["consistency"] for r in neighbours.consistency(df, "key", "g", names).collect()}
    assert got == pytest.approx(brute_consistency(rows))


def test_consistency_within_keys_is_that_of_each_by_itself(spark):
    rng = np.random.default_rng(11)
    rows = [(["a", "b"][int(rng.integers(2))] if i % 3 else "only", (float(rng.normal()),), i, float(rng.integers(2))) for i in range(120)]
    seeds = [i % 3 for i in range(120)]
    df = spark.createDataFrame([(s, r[0], *r[1], r[2], float(r[3]), int(i % 2)) for i, (s, r) in enumerate(zip(seeds, rows, strict=True))], "seed int, g string, f double, key long, p double, y int").withColumn("p", F.col("p").cast("int"))
    got = {(r["seed"], r["value"]): r["fairness_consistency"] for r in fairness.fairness(df, "g", within=["seed"], key="key", features=["f"]).collect()}
    want = {(s, g): v for s in range(3) for g, v in brute_consistency([r for r, t in zip(rows, seeds, strict=True) if t == s]).items()}
    assert got == pytest.approx(want)
    sums = fairness.group_sse(df, "g", within=["seed"], key="key", features=["f"])
    assert {r["seed"] for r in sums.collect()} == {0, 1, 2} and "sse_consistency" in sums.columns


def test_consistency_leaves_out_rows_without_a_feature(spark):
    rows = [("a", (float(i),), i, float(i % 2)) for i in range(9)]
    df, names = scored(spark, [*rows, ("a", (float("nan"),), 90, 1.0), ("a", (None,), 91, 1.0), ("b", (1.0,), 92, None)], 1)
    assert {r["value"]: r["consistency"] for r in neighbours.consistency(df, "key", "g", names).collect()} == pytest.approx(brute_consistency(rows))
    assert neighbours.consistency(df.limit(0), "key", "g", names).collect() == []


@pytest.mark.parametrize("pivots", [1, 7, 40])
def test_index_finds_the_nearest_whatever_its_pivots(spark, pivots, monkeypatch):
    monkeypatch.setattr(neighbours, "HELD", 500)
    rng = np.random.default_rng(pivots)
    x = np.concatenate([rng.normal(size=(90, 2)), rng.normal(size=(60, 2)) * 0.01 + 4, rng.integers(0, 3, (40, 2))])
    points = spark.createDataFrame([("ab"[i % 2], v.tolist(), i, 0.0) for i, v in enumerate(x)], "grp string, x array<double>, key long, p double").withColumn("scope", F.lit("s"))
    got = {}
    for r in neighbours.Index(points, 2, pivots).nearest(points.select("scope", "x").distinct(), 4, slack=0.5).collect():
        got.setdefault((tuple(r["x"]), r["grp"]), []).append((r["d2"], r["key"]))
    for q in {tuple(v) for v in x}:
        d2 = ((x - np.array(q)) ** 2).sum(1)
        for grp, own in (("a", range(0, len(x), 2)), ("b", range(1, len(x), 2))):
            brute = sorted((float(d2[i]), i) for i in own)[:4]
            found = sorted(got.get((q, grp), []))
            # All within the k-th distance over both groups and the slack come.
            within = [b for b in brute if b[0] <= np.sort(d2)[3] + 0.5]
            assert found[: len(within)] == within


def test_index_compares_few_pairs(spark):
    t = spark.read.parquet(SF.replace("sf0.01", "sf0.1") + "/orders.parquet").where("o_orderkey % 20 = 0")
    points = t.select(F.lit("s").alias("scope"), F.lit("g").alias("grp"), F.array("o_totalprice", F.pmod("o_custkey", F.lit(997)).cast("double") * 100).alias("x"), F.col("o_orderkey").alias("key"), F.lit(0.0).alias("p"))
    index = neighbours.Index(points, 2)
    vectors = points.select("scope", "x").distinct()
    n = vectors.count()
    sizes = index.points.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    compared = index.visits(vectors, 3, 1.0).groupBy("cell").agg(F.count(F.lit(1)).alias("asked")).join(sizes, "cell").agg(F.sum(F.col("asked") * F.col("n"))).first()[0]
    assert n > 5000 and compared < 0.1 * n * n


def exhaustive(x, y, w):
    """A tree as nested tuples, by trying each feature and boundary of each node."""

    def build(rows):
        weight, ones = w[rows].sum(), (w[rows] * y[rows]).sum()
        best = None
        if 0 < ones < weight:
            for j in range(x.shape[1]):
                values = np.unique(x[rows, j])
                for a, b in zip(values, values[1:], strict=False):
                    low = rows[x[rows, j] <= a]
                    lw, lg = w[low].sum(), (w[low] * y[low]).sum()
                    gain = lg * lg / lw + (ones - lg) ** 2 / (weight - lw)
                    if best is None or gain > best[0]:
                        best = (gain, j, float(trees.middle(a, b)))
        if best is None:
            return ones / weight
        _, j, cut = best
        return (j, cut, build(rows[x[rows, j] <= cut]), build(rows[x[rows, j] > cut]))

    return build(np.flatnonzero(w > 0))


def nested(tree, i=0):
    if tree.feature[i] < 0:
        return tree.value[i]
    return (int(tree.feature[i]), float(tree.threshold[i]), nested(tree, tree.left[i]), nested(tree, tree.right[i]))


def sample(seed, n=120):
    rng = np.random.default_rng(seed)
    return np.column_stack([rng.integers(0, 30, n), rng.normal(size=n).round(1)]).astype(float), (rng.random(n) < 0.4).astype(float), rng.integers(0, 3, n).astype(float)


@pytest.mark.parametrize("seed", range(6))
def test_trees_equal_exhaustive_search(seed):
    x, y, w = sample(seed)
    assert nested(trees.grow(x, y, w, np.random.default_rng(0))) == exhaustive(x, y, w)


def test_trees_go_deeper_than_thirty():
    x = np.arange(200.0).reshape(-1, 1)
    tree = trees.grow(x, np.arange(200) % 2, np.ones(200), np.random.default_rng(0))
    assert tree.depth > 30 and (tree.predict(x) == np.arange(200) % 2).all()


def walked(tree, x):
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("local", [1 << 17, 40])
def test_trees_of_many_models_equal_exhaustive_ones_however_nodes_are_split(spark, monkeypatch, local):
    monkeypatch.setattr(trees, "LOCAL", local)
    x, y, _ = sample(3, 90)
    fold = np.arange(90) % 3
    rows = spark.createDataFrame([(i, x[i].tolist(), float(y[i]), int(fold[i])) for i in range(90)], "key long, x array<double>, y double, fold int").repartition(3)
    masks = [(0, 1), (1,), (0,)]
    got = {(r["mask"], r["key"]): r["share"] for r in trees.cross_predicted(rows, masks, [[0, 1, 2], [1], []], trees.TREE).collect()}
    want = {}
    for m, held in ((0, (0, 1, 2)), (1, (1,))):
        for h in held:
            tree = exhaustive(x[:, masks[m]], y, (fold != h).astype(float))
            want |= {(m, int(i)): walked(tree, x[i, masks[m]]) for i in np.flatnonzero(fold == h)}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("local", [1 << 17, 100])
def test_forests_predict_well_either_way(spark, monkeypatch, local):
    monkeypatch.setattr(trees, "LOCAL", local)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 3))
    rows = spark.createDataFrame([(i, v.tolist(), float(v[0] + v[1] > 0), i % 2) for i, v in enumerate(x)], "key long, x array<double>, y double, fold int")
    found = trees.cross_predicted(rows, [(0, 1, 2)], [[0, 1]], trees.Growth(trees=6)).join(rows, "key")
    assert found.count() == 240 and found.where((F.col("share") > 0.5) == (F.col("y") == 1)).count() > 200


def test_a_forest_of_a_mid_sized_table_is_grown_in_tasks(spark, monkeypatch):
    def moved(*_):
        raise AssertionError("rows were written for each tree")

    monkeypatch.setattr(trees, "_by_aggregation", moved)
    x = F.array((F.xxhash64("id") % 1000).cast("double"), (F.xxhash64("id", F.lit(1)) % 1000).cast("double"))
    rows = spark.range(140_000).select(F.col("id").alias("key"), x.alias("x"), (F.col("id") % 4).cast("int").alias("fold"))
    rows = rows.withColumn("y", (F.col("x")[0] > F.col("x")[1]).cast("double"))
    found = trees.cross_predicted(rows, [(0, 1)], [[0]], trees.Growth(trees=5)).join(rows, "key")
    assert found.count() == 35_000 and found.where((F.col("share") > 0.5) == (F.col("y") == 1)).count() > 34_000
    assert trees.local(4) == 1 << 20 and trees.local(32) == 1 << 17  # as many values, however wide


def test_a_forest_of_a_large_table_is_not_written_for_each_tree(spark, monkeypatch):
    monkeypatch.setattr(trees, "LOCAL", 400)
    written, stored = [], trees.stored

    def counted(df):
        out = stored(df)
        rows = F.size("key") if dict(out.dtypes)["key"].startswith("array") else F.lit(1)
        written.append(out.agg(F.sum(rows)).first()[0])
        return out

    monkeypatch.setattr(trees, "stored", counted)
    rng = np.random.default_rng(6)
    x = np.column_stack([rng.normal(size=(2000, 2)), rng.integers(0, 4, 2000)])
    rows = spark.createDataFrame([(i, v.tolist(), float(v[0] + v[1] > 0), i % 4) for i, v in enumerate(x)], "key long, x array<double>, y double, fold int")
    found = trees.cross_predicted(rows, [(0, 1, 2)], [[0]], trees.Growth(trees=12)).join(rows, "key")
    assert found.count() == 500 and found.where((F.col("share") > 0.5) == (F.col("y") == 1)).count() > 450
    assert max(written) <= 2000


@pytest.mark.parametrize("kind", ["clear", "noise", "one value"])
def test_a_tree_of_a_large_table_is_that_of_one_task(spark, monkeypatch, kind):
    monkeypatch.setattr(trees, "LOCAL", 300)
    monkeypatch.setattr(trees, "SHUFFLED", 1500)
    rng = np.random.default_rng(len(kind))
    x = np.column_stack([rng.normal(size=4000), rng.integers(0, 5, 4000), np.where(rng.random(4000) < 0.9, 1.0, rng.normal(size=4000)), np.ones(4000)])
    y = {"clear": x[:, 0] + x[:, 1] > 2, "noise": rng.random(4000) < 0.3, "one value": x[:, 2] != 1}[kind].astype(float)
    fold = np.arange(4000) % 4
    rows = spark.createDataFrame([(i, x[i].tolist(), float(y[i]), int(fold[i])) for i in range(4000)], "key long, x array<double>, y double, fold int")
    masks = [(0, 1, 2, 3), (3,), (1, 2)]
    got = {(r["mask"], r["key"]): r["share"] for r in trees.cross_predicted(rows, masks, [[1], [0], [0]], trees.TREE).collect()}
    want = {}
    for m, held in ((0, 1), (1, 0), (2, 0)):
        own = np.flatnonzero(fold == held)
        tree = trees.grow(x[:, masks[m]], y, (fold != held).astype(float), np.random.default_rng(0))
        want |= {(m, int(i)): v for i, v in zip(own, tree.predict(x[own][:, masks[m]]), strict=True)}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("tries", [None, 1])
def test_equal_vectors_are_one_with_their_weights_summed(tries):
    x, y, w = sample(7, 900)
    x = x.round()
    vectors, number = trees.distinct(x)
    assert len(vectors) == len(np.unique(x, axis=0)) < 300 and (vectors[number] == x).all()
    columns = list(vectors.T.copy())
    sums = [np.bincount(number, v, len(vectors)) for v in (w, w * y)]
    merged = trees.grown(columns, [np.argsort(c) for c in columns], *sums, np.random.default_rng(1), tries)
    assert nested(merged) == nested(trees.grow(x, y, w, np.random.default_rng(1), tries))


def test_empty_and_one_sided_data(spark):
    rows = spark.createDataFrame([(i, [1.0], 1.0, i % 2) for i in range(6)], "key long, x array<double>, y double, fold int")
    assert {r["share"] for r in trees.cross_predicted(rows, [(0,), ()], [[0], [1]], trees.TREE).collect()} == {1.0}
    assert trees.cross_predicted(rows.limit(0), [(0,)], [[0]]).collect() == []


def test_masks_are_judged_in_one_job_and_by_the_five_metrics(spark):
    rng = np.random.default_rng(9)
    rows = [(i, *map(float, rng.normal(size=2).round(2)), int(rng.integers(2))) for i in range(300)]
    df = spark.createDataFrame([(*r, float(r[1] > 0)) for r in rows], "row_id long, a double, b double, s int, target double")
    judge = feature_search.CrossValidated(df, ["a", "b", "s"], "s", "row_id", feature_search.Settings(model="decision_tree"))
    judge.prepare([(1, 0, 0), (0, 1, 1), (0, 0, 0)])
    assert judge.performance((1, 0, 0)) > 0.95 > judge.performance((0, 1, 1)) and judge.performance((0, 0, 0)) == -1
    five = judge.five((1, 0, 0))
    assert set(five) == {f"fairness_{m}" for m in feature_search.FIVE} | {"fairness_consistency"}
    assert judge.unfairness((1, 0, 0)) == pytest.approx(sum((v - 1) ** 2 for v in five.values()))
    assert feature_search.select_features(df, ["a", "b", "s"], "s", "row_id", feature_search.Settings(size=5, generations=3, model="decision_tree"))[0] == "a"


@pytest.mark.parametrize("jobs", [36, 1])
def test_rows_of_few_vectors_are_counted_however_many_they_are(spark, monkeypatch, jobs):
    monkeypatch.setattr(trees, "JOBS", jobs)
    monkeypatch.setattr(trees, "LOCAL", 100)  # fewer than rows, more than vectors
    monkeypatch.setattr(trees, "CELLS", 100)
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, [float(rng.integers(6)), float(rng.integers(9))], int(rng.integers(2)), i % 3) for i in range(700)], "key long, x array<double>, y int, fold int")
    masks, cells = [(0,), (0, 1), (1,)], trees.counted(df, 3)
    counts = {(r["mask"], r["y"], r["p"]): r["n"] for r in trees.cross_counts(cells, masks, 3, trees.TREE).collect() if r["n"]}
    monkeypatch.setattr(trees, "LOCAL", 1000)
    told = trees.cross_predicted(df, masks, [range(3)] * 3, trees.TREE).join(df.select("key", "y"), "key").withColumn("p", (F.col("share") > 0.5).cast("int"))
    assert counts == {(r["mask"], r["y"], r["p"]): r["count"] for r in told.groupBy("mask", "y", "p").count().collect()}
    monkeypatch.setattr(trees, "CELLS", 20)
    assert trees.cross_counts(cells, masks, 3) is None


def test_search_judges_many_rows_of_few_vectors_without_passes(spark, monkeypatch):
    monkeypatch.setattr(trees, "LOCAL", 50)
    monkeypatch.setattr(trees, "_by_aggregation", None)  # would fail
    df = spark.createDataFrame([(i, float(i % 7), float(i % 2), i % 2, float(i % 7 > 3)) for i in range(600)], "row_id long, a double, b double, s int, target double")
    judge = feature_search.CrossValidated(df, ["a", "b"], "s", "row_id", feature_search.Settings())
    judge.prepare([(1, 0), (0, 1)])
    assert judge.performance((1, 0)) == 1 and judge.performance((0, 1)) < 0.7


@pytest.mark.parametrize("tries", [None, 1])
def test_nodes_of_one_feature_are_grown_along_it(tries):
    rng = np.random.default_rng(11)
    for width in (1, 2, 3):
        x, w = rng.integers(0, 12, (150, width)).astype(float), rng.poisson(1.5, 150).astype(float)
        y, told = rng.integers(0, 2, 150).astype(float), np.full(150, np.nan)
        columns = list(np.ascontiguousarray(x.T))
        tree = trees.grown(columns, [np.argsort(c, kind="stable") for c in columns], w, w * y, np.random.default_rng(0), tries, None, told)
        if tries is None:
            learn = w > 0
            assert nested(tree) == exhaustive(x[learn], y[learn], w[learn])
        assert (told[w > 0] == tree.predict(x)[w > 0]).all()


def test_published_search_keeps_what_decides(spark):
    kept = {r["feature"] for r in QUERIES["feature_search"](spark, SF.replace("sf0.01", "sf0.001")).collect()}
    assert {"price", "balance"} <= kept


@pytest.mark.parametrize("name", ["decision_tree", "random_forest"])
def test_unlimited_trees_as_classifiers(spark, name):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 2))
    df = spark.createDataFrame([(i % 350, float(a), float(b), float(a > b)) for i, (a, b) in enumerate(x)], "row_id long, a double, b double, target double")
    out = models.fit_predict(df.limit(300), df, name, ["a", "b"])
    assert out.count() == 400 and set(df.columns) | {"prediction"} == set(out.columns)
    assert out.where(F.col("prediction") == F.col("target")).count() > 360
