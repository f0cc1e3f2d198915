"""Hand-sized cases, edge cases and invariants."""

from __future__ import annotations

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fairspark.functions import scalar
from fairspark.operators import corrections, encode, fairness, performance, pipeline_search, reduce, report
from fairspark.operators.feature_search import Settings, best_of, flipped, ramped, search
from fairspark.sources import prepare, readers, sinks
from fairspark.sources.config import algorithm_config, dataset_config, plan, pool, run_config
from fairspark.streaming.contingency import live_counts, metrics_of

MICRO = [(1, "a", 1, 1), (2, "a", 1, 0), (3, "a", 0, 1), (4, "a", 0, 0), (5, "a", 1, 1), (6, "b", 1, 1), (7, "b", 0, 0), (8, "b", 0, 0), (9, "b", 1, 0), (10, "c", 0, 0), (11, "c", 0, 0), (12, "c", 1, 1)]
EXPECTED = {"a": (2.1, 0.685714, 1.0, 1.5, 0.5, 1.0), "b": (0.5, 0.75, 0.75, 0.75, 0.75, 0.75), "c": (0.75, 0.888889, 1.4, 0.75, 0.75, 0.6)}


@pytest.fixture(scope="module")
def micro(spark):
    return spark.createDataFrame(MICRO, "id long, g string, y int, p int").cache()


def test_fairness_of_small_case(micro):
    for row in fairness.fairness(micro, "g").collect():
        assert tuple(row)[1:] == pytest.approx(EXPECTED[row.value], abs=1e-6)


def test_performance_of_small_case(micro):
    row = performance.performance(micro, metrics=tuple(performance.ALL)).first()
    assert (row.performance_accuracy, row.performance_f1_score, row.performance_precision, row.performance_recall) == pytest.approx((0.75, 0.727273, 0.8, 0.666667), abs=1e-6)
    assert (row.performance_auc, row.performance_matthews_cc, row.performance_gmean) == pytest.approx((0.75, 0.507093, 0.745356), abs=1e-6)


def test_a_group_without_positives_and_a_rest_without_predictions(spark):
    df = spark.createDataFrame([(1, "a", 0, 1), (2, "a", 0, 0), (3, "b", 1, 0)], "id long, g string, y int, p int")
    rows = {r.value: r for r in fairness.fairness(df, "g").collect()}
    assert rows["a"].fairness_disparate_impact == 0.0
    assert rows["a"].fairness_true_positive_rate_diff == 1.0


@pytest.mark.parametrize(("group", "m"), [("a", 0), ("b", 0), ("c", 0)])
def test_massaging_count_truncates(micro, group, m):
    assert corrections.massaging_m(micro.withColumn("u", (F.col("g") == group).cast("int")), "u").first()["m"] == m


def test_massaging_keeps_the_sum_of_labels(spark):
    rows = [(i, 1, 0, float(i)) for i in range(4)] + [(i, 0, int(i < 10), float(i)) for i in range(4, 12)]
    df = spark.createDataFrame(rows, "id long, u int, y int, x double")
    assert corrections.massaging_m(df, "u").first()["m"] == 2
    out = corrections.massage(df, "u", "id", ["x"])
    assert out.agg(F.sum("y")).first()[0] == 6
    assert out.where("u = 1").agg(F.sum("y")).first()[0] == 2
    assert corrections.massage(df, "u", "id", ["x"], intended=True).agg(F.sum("y")).first()[0] == 6


def test_reweighing_makes_groups_even(micro):
    df = micro.withColumn("s", (F.col("g") == "c").cast("int"))
    cells = {(r.s, r.y): r for r in corrections.reweigh(df, "s").collect()}
    assert cells[1, 0].weight == pytest.approx(0.75)
    assert cells[1, 1].weight == pytest.approx(1.5)
    rate = lambda s: cells[s, 1].n * cells[s, 1].weight / sum(cells[s, y].n * cells[s, y].weight for y in (0, 1))
    assert rate(0) == pytest.approx(rate(1))
    assert corrections.reweigh_and_append(df, "s", "id").count() == 12 + 6


def test_split_keeps_quotas(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("g"))
    counts = {(r.g, r.part): r["count"] for r in encode.stratified_split(df, "id", ["g"]).groupBy("g", "part").count().collect()}
    for g, n in ((0, 334), (1, 333), (2, 333)):
        assert sum(counts[g, p] for p in ("train", "val", "test")) == n
        assert abs(counts[g, "train"] - 0.8 * n) <= 1


def test_edges_of_a_constant_column_collapse(spark):
    df = spark.createDataFrame([(1.0,)] * 5, "x double")
    assert encode.quantile_edges(df, ["x"])["x"] == []
    assert {r.x for r in encode.quantile_bins(df, ["x"]).collect()} == {0}


def test_repair_makes_groups_alike(spark):
    df = spark.range(200).select("id", (F.col("id") % 2).alias("g"), (F.col("id") * (1 + F.col("id") % 2)).cast("double").alias("x"))
    out = corrections.repair(df, "g", "id", "x").groupBy("g").agg(F.avg("repaired").alias("m")).collect()
    assert out[0].m == pytest.approx(out[1].m)


def test_seed_reduction_skips_nan_null_and_missing(spark):
    df = spark.createDataFrame([(1, "k", 2.0), (2, "k", math.nan), (3, "k", None), (5, "k", 0.0)], "seed long, key string, x double")
    assert reduce.sse_over_seeds(df, ["key"], ["x"]).first().x == 2.0
    assert reduce.mean_over_seeds(df, ["key"], ["x"]).first().x == 1.0
    assert [r.seed for r in reduce.missing_seeds(df, "seed", 1, 5).collect()] == [4]


def test_rounding_is_half_to_even(spark):
    df = spark.createDataFrame([(2.00005,), (None,), (math.nan,)], "x double")
    assert [r[0] for r in df.select(scalar.padded_text("x", 4)).collect()] == ["2.0000", "nan", "nan"]
    assert df.select(scalar.rounded_text("x", 4)).collect()[1][0] is None


def test_report_parts(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3)], "a_auc double, a_aucmean double, Generation int")
    long = report.melted(report.best_and_population(df, ["a"], "auc"), ["Generation"]).collect()
    assert {(r.Metric, r.Legend, r["Average Error"]) for r in long} == {("a", "Best", 1.0), ("a", "Population", 2.0)}
    assert report.latex([["x", 1]], ["a", "b"]).count("\n") == 6
    sets = spark.createDataFrame([("Validation",), ("Test",), (None,)], "set string")
    assert report.without_set(sets).count() == 2


@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 1), st.integers(0, 1)), min_size=1, max_size=30))
@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_metric_bounds(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, g string, y int, p int")
    for r in fairness.fairness(df, "g").collect():
        assert r.fairness_disparate_impact >= 0
        assert 0 <= r.fairness_discrimination_score <= 1
        assert 0 <= r.fairness_true_positive_rate_diff <= 2


class Judge:
    """Plain fitness of masks, and the populations that it was shown."""

    def __init__(self, performance, unfairness=lambda m: float(sum(m))):
        self.performance, self.unfairness, self.shown = performance, unfairness, []

    def prepare(self, masks):
        self.shown.append(list(masks))


def test_feature_search_finds_the_better_mask():
    judge = Judge(lambda m: sum(m[:2]) - sum(m[2:]))
    assert search(judge, 5, Settings(size=12, generations=12), seed=1)[:2] == (1, 1)
    assert best_of([(1, 1), (1, 0)], Judge(lambda m: 1.0), intended=True) == (1, 0)
    assert best_of([(1, 1), (1, 0)], Judge(lambda m: 1.0)) == (1, 1)
    import numpy as np

    rng = np.random.default_rng(0)
    assert len(ramped(4, 3, 0.1, 0.9, rng)) == 3
    assert flipped((0, 1), 1.0, rng) == (1, 0)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_feature_search_returns_the_best_of_the_last_generation_it_judged(seed):
    judge = Judge(lambda m: sum(b << i for i, b in enumerate(m)))
    best = search(judge, 6, Settings(size=9, generations=3), seed=seed)
    assert len(judge.shown) == 3 and all(len(masks) == 9 for masks in judge.shown)
    assert best == max(judge.shown[-1], key=judge.performance)
    for before, after in zip(judge.shown, judge.shown[1:], strict=False):  # one elite goes on
        assert after[0] == max(before, key=judge.performance)


def test_sequence_search():
    assert [pipeline_search.space_size(g, 4) for g in (2, 3, 5)] == [494, 18563, 30045014]
    assert sum(1 for _ in pipeline_search.everything(2, 4)) == 494
    assert not pipeline_search.is_large(2, 4)
    evaluate = lambda i: ({"m": {"auc": float(len(i))}}, {"m": {"di": float(sum(a for _, a in i))}})
    found = pipeline_search.Search(evaluate, 2, 2, ["m"], ["auc"], ["di"], intended=True)
    best = found.run()
    assert len(best) == 4
    assert sum(a for _, a in best) == 0

    def refuses(individual):
        raise ValueError

    failing = pipeline_search.Search(refuses, 2, 1, ["m"], ["auc"], ["di"])
    failing.genetic(pipeline_search.Settings(size=4, generations=1))
    assert all(v[0]["m"]["auc"] == 0.0 for v in failing.known.values())
    assert pipeline_search.flatten(((0, 3), (1, 0))) == "0310"


def test_sources_and_preparation(spark, tmp_path):
    lines = [" ".join(["A11", str(6 + i), "A34", "A43", str(1000 + i), "A65", "A75", str(i % 4 + 1), ["A93", "A92"][i % 2], "A101", "4", "A121", str(20 + i), "A143", "A152", "2", "A173", "1", "A192", "A201", str(1 + i % 2)]) for i in range(20)]
    (tmp_path / "credit.data").write_text("\n".join(lines))
    raw = readers.load(spark, "German Credit", str(tmp_path / "credit.data"))
    data = prepare.prepare(raw, "German Credit", ("Attribute9",))
    assert data.labels("Attribute9") == {0: "Female", 1: "Male"}
    assert data.data.count() == 20
    assert {r.target for r in data.data.collect()} == {0.0, 1.0}
    with pytest.raises(ValueError):
        data.protected_feature("Attribute1")
    with pytest.raises(NotImplementedError):
        readers.load(spark, "none", "")
    for seed in (42, 44):
        (tmp_path / f"x_seed_{seed}.csv").write_text("a,b\n1,2\n")
    rows = readers.seeds(spark, f"{tmp_path}/x_seed_{{seed}}.csv", 42, 3).collect()
    assert sorted(r.seed for r in rows) == [42, 44]
    sinks.export_csv(spark.createDataFrame([(1.23456,)], "x double"), str(tmp_path / "out"))
    assert readers.csv(spark, str(tmp_path / "out")).first().x == "1.2346"


def transcribed(evaluate, groups, algorithms, s, rng):
    """The rules of the genetic search, one after another; draws in the same order."""
    select = lambda some: pipeline_search.lexicographic(some, known, rng)
    mean = lambda some, kind, m: sum(known[i][kind]["m"][m] for i in some) / len(some)
    population = [pipeline_search.random_individual(groups, algorithms, rng) for _ in range(s.size)]
    known = {i: evaluate(i) for i in population}
    best = select(population)
    history = [(best, mean(population, 0, "auc"), mean(population, 1, "di"))]
    for _ in range(1, s.generations):
        parents = []
        for _ in population:
            parents.append(select([population[i] for i in rng.choice(len(population), s.tournament, replace=False)]))
        offspring = []
        for j in range(0, len(population) - 1, 2):
            offspring += pipeline_search.crossed(parents[j], parents[j + 1], s.crossover, rng)
        offspring = [pipeline_search.mutated(i, s.mutation, groups, algorithms, rng) for i in offspring]
        known |= {i: evaluate(i) for i in offspring}
        following = []
        for source, count in ((parents, s.elite), (offspring, len(population) - s.elite)):
            for _ in range(count):
                found = select(source)
                source.remove(found)
                following.append(found)
        population = following
        best = select(population)
        history.append((best, mean(population, 0, "auc"), mean(population, 1, "di")))
    return history


@pytest.mark.parametrize("seed", range(6))
def test_genetic_search_follows_the_rules(seed):
    import numpy as np

    evaluate = lambda i: ({"m": {"auc": sum((3 * g + 5 * a) % 7 for g, a in i) / len(i)}}, {"m": {"di": float(sum((2 * g + a) % 4 for g, a in i))}})
    settings_ = pipeline_search.Settings(size=10, generations=6, elite=2)
    found = pipeline_search.Search(evaluate, 3, 4, ["m"], ["auc"], ["di"], seed=seed)
    best = found.genetic(settings_)
    expected = transcribed(evaluate, 3, 4, settings_, np.random.default_rng(seed))
    assert best == expected[-1][0]
    assert len(found.history) == 6
    for (own, scores, means), (other, auc, di) in zip(found.history, expected, strict=True):
        assert own == other
        assert scores == evaluate(own)
        assert (means[0]["m"]["auc"], means[1]["m"]["di"]) == pytest.approx((auc, di))


def test_corrected_tables_are_made_once_for_each_prefix():
    """The published search, 30 x 30 with four corrections, over tables that say what was applied to them."""
    alive, worst = set(), 0

    def keep(table):
        nonlocal worst
        alive.add(table)
        worst = max(worst, len(alive))
        return table

    def correction(a):
        def change(table, group):
            if (group, a) == (2, 3) and table:
                raise ValueError("fails after another")
            return (*table, (group, a))

        return change

    tables = pipeline_search.PrefixTables((), [correction(a) for a in range(4)], keep, alive.discard)
    judged = []

    def evaluate(individual):
        assert tables.table(individual) == individual
        judged.append(individual)
        good = sum(7 * g + 3 * a for g, a in individual) % 11 / len(individual)
        return {"m": {"auc": good}}, {"m": {"di": float(len(individual))}}

    found = pipeline_search.Search(evaluate, 3, 4, ["m"], ["auc"], ["di"], levels=tables.levels)
    found.genetic()
    assert len(found.history) == 30 and not alive and tables.level == {(): ()}
    assert len(judged) == len(set(judged)) > 30
    fails = lambda i: (2, 3) in i[1:]
    assert {i for i in found.known if fails(i)} and all(not fails(i) for i in judged)
    assert all(found.known[i] == found.worst for i in found.known if fails(i))
    assert tables.applied < 0.9 * sum(map(len, found.known))


def test_prefix_tables_equal_applied_sequences(spark):
    from fairspark.plans.storage import forgotten, stored

    train = spark.range(20).withColumn("x", F.col("id") * 1.0)
    steps = [lambda df, g: df.withColumn("x", F.col("x") * 2 + g), lambda df, g: df.withColumn("x", F.col("x") - 3 * g), lambda df, g: df.where(F.col("id") % 3 != g)]
    some = [((0, 0),), ((0, 0), (1, 1)), ((0, 0), (1, 2)), ((0, 0), (1, 2), (1, 0)), ((1, 1),)]
    tables = pipeline_search.PrefixTables(train, steps, stored, forgotten)
    for level in tables.levels(some):
        for one in level:
            assert sorted(map(tuple, tables.table(one).collect())) == sorted(map(tuple, pipeline_search.apply_sequence(train, one, steps).collect()))
    assert tables.applied == 5 < sum(map(len, some))


def test_killed_and_repeated_appends_leave_each_row_once(spark, tmp_path):
    rows, path = spark.range(30).withColumn("seed", F.col("id") % 3), str(tmp_path / "table")

    def fails(batches):
        yield from batches
        raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        sinks.append(rows.mapInArrow(fails, rows.schema), path, ["seed"], "a")
    assert not sinks.published(spark, path, "a")
    assert sinks.append(rows, path, ["seed"], "a") and not sinks.append(rows, path, ["seed"], "a")
    assert sinks.append(rows.where("id < 5"), path, ["seed"], "b")
    read = spark.read.parquet(path)
    assert sorted((r["run"], r["id"]) for r in read.collect()) == sorted([("a", i) for i in range(30)] + [("b", i) for i in range(5)])
    with pytest.raises(ValueError):
        sinks.append(rows, path, ["seed"], "../elsewhere")


def test_settings(tmp_path):
    from fairspark.plans.io_queries import _INI

    path = tmp_path / "c.cfg"
    path.write_text(_INI)
    assert run_config(str(path)).surrogates == ("logistic_regression", "rbf_svc")
    assert dataset_config(str(path), "German Credit").protected == ("Attribute9", "Attribute13")
    assert pool(algorithm_config(str(path), "Pool")) == {0: "MSG", 1: "DIR"}
    for section in ("none", "Repair"):
        with pytest.raises(ValueError):
            dataset_config(str(path), section)
    path.write_text(_INI.replace("n_splits = 3\n", ""))
    with pytest.raises(ValueError, match="n_splits"):
        plan(str(path))


def test_guards(spark, micro):
    from fairspark.functions import text
    from fairspark.sources import checks

    data = prepare.Dataset(micro.selectExpr("id AS row_id", "y AS target", "g"), ("g",), ("g",))
    for wrong in (lambda: checks.check_dataset(data), lambda: checks.check_dataset(1), lambda: checks.check_protected(data, "g"), lambda: checks.check_keys({"a": 1}, ["a", "b"]), lambda: checks.check_callable(3), lambda: checks.check_parameters(len, ["none"]), lambda: text.required("x", {})):
        with pytest.raises(ValueError):
            wrong()
    checks.check_parameters(lambda seed: seed, ["seed"])
    assert text.required("x", {"x": 1}) == 1


def test_kernel_classifier_bends(spark):
    """A ring around a blob: no line parts them."""
    from fairspark.operators import models

    rows = spark.range(800).select(F.col("id").alias("row_id"), (F.col("id") * 0.7).alias("t"), (F.col("id") % 2).cast("double").alias("target"))
    rows = rows.select("row_id", "target", (F.cos("t") * (0.3 + F.col("target"))).alias("a"), (F.sin("t") * (0.3 + F.col("target"))).alias("b"))
    right = lambda name: models.fit_predict(rows, rows, name, ["a", "b"]).agg(F.avg((F.col("prediction") == F.col("target")).cast("double"))).first()[0]
    assert right("rbf_svc") > 0.97
    assert right("linear_svc") < 0.8


def test_large_tables_of_codes_have_all_values(spark):
    df = spark.range(30_000).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("x"))
    coded, tables = encode.label_encode(df)
    assert coded.agg(F.count_distinct("x"), F.min("x"), F.max("x")).first()[:] == (30_000, 0, 29_999)
    assert tables["x"].count() == 30_000
    with pytest.raises(ValueError):
        encode.labels_of(tables["x"])
    assert encode.labels_of(encode.label_codes(df.where("x IN ('v10', 'v9')"), "x")) == {0: "v10", 1: "v9"}


@given(st.lists(st.one_of(st.none(), st.integers(-5, 5).map(float), st.floats(-100, 100)), min_size=1, max_size=40))
@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_quantile_edges_are_exact(spark, values):
    import numpy as np

    df = spark.createDataFrame([(v,) for v in values], "x double")
    known = [v for v in values if v is not None]
    edges = []
    for e in np.quantile(known, np.arange(5) / 4) if known else []:
        if not edges or e - edges[-1] > encode.NEAR:
            edges.append(float(e))
    assert encode.quantile_edges(df, ["x"])["x"] == pytest.approx(edges[1:-1], abs=1e-9)


def test_repair_of_a_tiny_group(spark):
    """The smallest group has one row: the others are one quantile each, moved as a whole."""
    df = spark.createDataFrame([(i, "a" if i else "b", float(i * i), float(i)) for i in range(12)], "id long, g string, x double, y double")
    out = {r.id: (r.x, r.y) for r in corrections.repaired(df, "g", "id", ["x", "y"]).collect()}
    middle = sorted(i * i for i in range(1, 12))[5]
    assert set(out.values()) == {(middle / 2, 3.0)}


def test_stream_counts(spark, micro, tmp_path):
    micro.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(micro.schema).parquet(str(tmp_path / "in"))
    query = live_counts(stream, "g").writeStream.format("memory").queryName("counts_test").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = {r.value: r for r in metrics_of(spark.table("counts_test"), "g").collect()}
    assert rows["a"].fairness_disparate_impact == pytest.approx(2.1)
