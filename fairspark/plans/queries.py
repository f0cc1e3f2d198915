"""The registered queries over the provided tables, and SQL that says the same in another way."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairspark.functions import scalar
from fairspark.operators import contingency, corrections, distribution, encode, fairness, models, neighbours, performance, reduce, report
from fairspark.operators.feature_search import select_features
from fairspark.operators import feature_search as feature_searches
from fairspark.operators import pipeline_search as sequence_searches
from fairspark.operators.pipeline_search import Search, decoded, everything, flatten, gene_pool, space_size
from fairspark.plans import assessment
from fairspark.plans.views import VIEW_SQL, VIEWS, documents_view, events_view, lineitem_view, orders_view, table
from fairspark.streaming.contingency import live_counts

Query = Callable[[SparkSession, str], DataFrame]

#: What ``pipeline_search`` runs with; the published figures (the defaults of both settings) take hours of model fits.
SMALL_SEQUENCES = sequence_searches.Settings(size=4, generations=2, tournament=2, elite=1)
SMALL_FEATURES = feature_searches.Settings(size=3, generations=1, folds=2, model="decision_tree")
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _ctes(view: str) -> str:
    """v: the view; t: its rows against each group, s = 1 in the group."""
    return f"WITH v AS ({VIEW_SQL[view]}), t AS (SELECT k.g AS value, CASE WHEN v.g = k.g THEN 1 ELSE 0 END AS s, v.y, v.p FROM v CROSS JOIN (SELECT DISTINCT g FROM v) k)"


def _rate(what: str, given: str, s: int) -> str:
    """P(what | given, s), 0 where nothing is given."""
    return f"coalesce(count(*) FILTER (WHERE {what} AND {given} AND s = {s})::DOUBLE / nullif(count(*) FILTER (WHERE {given} AND s = {s}), 0), 0.0)"


_SQL_METRICS = {
    "disparate_impact": f"coalesce({_rate('p = 1', 'true', 1)} / nullif({_rate('p = 1', 'true', 0)}, 0), 0.0)",
    "discrimination_score": f"1 - abs({_rate('p = 1', 'true', 1)} - {_rate('p = 1', 'true', 0)})",
    "true_positive_rate_diff": f"abs(1 - ({_rate('p = 1', 'y = 1', 0)} - {_rate('p = 1', 'y = 1', 1)}))",
    "false_positive_rate_diff": f"abs(1 - ({_rate('p = 1', 'y = 0', 0)} - {_rate('p = 1', 'y = 0', 1)}))",
    "false_positive_error_rate_balance_score": f"1 - abs({_rate('p = 1', 'y = 0', 1)} - {_rate('p = 1', 'y = 0', 0)})",
    "false_negative_error_rate_balance_score": f"1 - abs({_rate('p = 0', 'y = 1', 1)} - {_rate('p = 0', 'y = 1', 0)})",
}


#: Consistency of view v by group: of each vector (f, in the group or not) the three nearest rows, ties to the smaller key.
_CONSISTENCY = """rr AS (SELECT k.grp, v.key, v.f, (v.g = k.grp)::INT AS own, v.p::DOUBLE AS p FROM (SELECT DISTINCT g AS grp FROM v) k CROSS JOIN v),
cc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp, f, own ORDER BY key) AS k FROM rr) q WHERE k <= 3),
nn AS (SELECT * FROM (SELECT d.grp, d.f, d.own, cc.key AS ck, cc.p AS cp, row_number() OVER (PARTITION BY d.grp, d.f, d.own ORDER BY (d.f - cc.f) * (d.f - cc.f) + (d.own - cc.own) * (d.own - cc.own), cc.key) AS place
  FROM (SELECT DISTINCT grp, f, own FROM rr) d JOIN cc ON d.grp = cc.grp) q WHERE place <= 3),
oo AS (SELECT * FROM (SELECT rr.grp, rr.key, rr.p, nn.cp, row_number() OVER (PARTITION BY rr.grp, rr.key ORDER BY nn.place) AS j FROM rr JOIN nn ON rr.grp = nn.grp AND rr.f = nn.f AND rr.own = nn.own WHERE nn.ck <> rr.key) q WHERE j <= 2),
mm AS (SELECT grp, key, max(p) AS p, (max(p) + sum(cp)) / (1 + count(*)) AS mean FROM oo GROUP BY grp, key),
near AS (SELECT grp, 1 - avg(abs(p - mean)) AS consistency FROM mm GROUP BY grp)"""


def _add_views() -> None:
    for view, read in VIEWS.items():
        for metric, text in _SQL_METRICS.items():
            def one(spark, d, read=read, metric=metric):
                return fairness.fairness(read(spark, d), "g", metrics=[metric])

            _register(f"{metric}_{view}", f"{_ctes(view)} SELECT value, {text} AS fairness_{metric} FROM t GROUP BY value")(one)

        def bundle(spark, d, read=read):
            return fairness.fairness(read(spark, d), "g", key="key", features=["f"])

        bundled = f"SELECT value, {', '.join(f'{x} AS fairness_{m}' for m, x in _SQL_METRICS.items())} FROM t GROUP BY value"
        seven = f"{_ctes(view)}, {_CONSISTENCY}, six AS ({bundled}), bundle AS (SELECT six.*, consistency AS fairness_consistency FROM six JOIN near ON value = near.grp)"
        _register(f"fairness_bundle_{view}", f"{seven} SELECT * FROM bundle")(bundle)

        def sse(spark, d, read=read):
            return fairness.group_sse(read(spark, d), "g", key="key", features=["f"])

        errors = ", ".join(f"sum((fairness_{m} - 1) * (fairness_{m} - 1)) AS sse_{m}" for m in [*_SQL_METRICS, "consistency"])
        _register(f"group_sse_fitness_{view}", f"{seven} SELECT {errors} FROM bundle")(sse)

        def perf(spark, d, read=read):
            return performance.performance(read(spark, d), metrics=tuple(performance.ALL))

        cells = "count(*) FILTER (WHERE y = 0 AND p = 0)::DOUBLE AS tn, count(*) FILTER (WHERE y = 0 AND p = 1)::DOUBLE AS fp, count(*) FILTER (WHERE y = 1 AND p = 0)::DOUBLE AS fn, count(*) FILTER (WHERE y = 1 AND p = 1)::DOUBLE AS tp"
        sens, spec = "coalesce(tp / nullif(tp + fn, 0), 0)", "coalesce(tn / nullif(tn + fp, 0), 0)"
        prec = "coalesce(tp / nullif(tp + fp, 0), 0)"
        columns = {
            "accuracy": "(tp + tn) / (tp + tn + fp + fn)", "f1_score": f"coalesce(2 * {prec} * {sens} / nullif({prec} + {sens}, 0), 0)", "auc": f"({sens} + {spec}) / 2", "precision": prec, "recall": sens, "specificity": spec,
            "matthews_cc": "coalesce((tp * tn - fp * fn) / nullif(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn), 0), 0)", "gmean": f"sqrt({sens} * {spec})",
        }
        _register(f"performance_{view}", f"WITH v AS ({VIEW_SQL[view]}), c AS (SELECT {cells} FROM v) SELECT {', '.join(f'{x} AS performance_{m}' for m, x in columns.items())} FROM c")(perf)

        def spread(spark, d, read=read):
            return distribution.distribution(read(spark, d), "g", "y")

        _register(f"distribution_long_{view}", f'WITH v AS ({VIEW_SQL[view]}) SELECT g AS "group", y::VARCHAR AS target, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM v) AS share FROM v GROUP BY g, y')(spread)

        def weights(spark, d, read=read):
            return corrections.weigh_one_vs_rest(read(spark, d), "g").select("grp", "s", "y", "n", "weight")

        _register(
            f"reweigh_weights_{view}",
            f"{_ctes(view)}, c AS (SELECT value AS grp, s, y, count(*) AS n FROM t GROUP BY value, s, y) SELECT grp, s, y, n, (sum(n) OVER (PARTITION BY grp, s)) * (sum(n) OVER (PARTITION BY grp, y))::DOUBLE / ((sum(n) OVER (PARTITION BY grp))::DOUBLE * n) AS weight FROM c",
        )(weights)


_add_views()


@_register("confusion_lineitem", f"WITH v AS ({VIEW_SQL['lineitem']}) SELECT count(*) FILTER (WHERE y = 0 AND p = 0) AS tn, count(*) FILTER (WHERE y = 0 AND p = 1) AS fp, count(*) FILTER (WHERE y = 1 AND p = 0) AS fn, count(*) FILTER (WHERE y = 1 AND p = 1) AS tp FROM v")
def confusion_lineitem(spark, d):
    return performance.confusion(lineitem_view(spark, d))


@_register(
    "roc_points",
    f"WITH v AS ({VIEW_SQL['lineitem']}), r AS (SELECT count(*) FILTER (WHERE y = 0 AND p = 1)::DOUBLE / count(*) FILTER (WHERE y = 0) AS fpr, count(*) FILTER (WHERE y = 1 AND p = 1)::DOUBLE / count(*) FILTER (WHERE y = 1) AS tpr FROM v) "
    "SELECT 0 AS ordinal, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr UNION ALL SELECT 1, fpr, tpr FROM r UNION ALL SELECT 2, 1.0, 1.0",
)
def roc_points(spark, d):
    return performance.roc_points(lineitem_view(spark, d))


@_register("joint_probability", f"WITH v AS ({VIEW_SQL['documents']}) SELECT avg(CASE WHEN g = 'en' AND p = 1 THEN 1.0 ELSE 0.0 END) AS probability FROM v")
def joint_probability(spark, d):
    return contingency.joint_probability(documents_view(spark, d), {"g": "en", "p": 1})


@_register("conditional_probability", f"WITH v AS ({VIEW_SQL['lineitem']}) SELECT avg(p::DOUBLE) AS probability FROM v WHERE g = 'R' AND y = 1")
def conditional_probability(spark, d):
    return contingency.conditional_probability(lineitem_view(spark, d), {"p": 1}, {"g": "R", "y": 1})


@_register(
    "distribution_pivot",
    f"WITH v AS ({VIEW_SQL['lineitem']}) SELECT " + ", ".join(f"count(*) FILTER (WHERE g = '{g}' AND y = {y})::DOUBLE / count(*) AS {g}_{y}_a_train_set" for g in "ANR" for y in (0, 1)) + " FROM v",
)
def distribution_pivot(spark, d):
    return distribution.pivoted(distribution.distribution(lineitem_view(spark, d), "g", "y"), "_a_train_set")


@_register("contingency_lineitem", f"WITH v AS ({VIEW_SQL['lineitem']}) SELECT g, count(*) AS n, sum(p)::BIGINT AS pp, sum(y)::BIGINT AS pos, sum(y * p)::BIGINT AS tp, sum((1 - y) * p)::BIGINT AS fp FROM v GROUP BY g")
def contingency_lineitem(spark, d):
    return contingency.contingency(lineitem_view(spark, d), "g")


@_register(
    "three_sets_distribution",
    f"""WITH v AS ({VIEW_SQL['orders']}), q AS (SELECT *, (id * 2654435761 + 42 * 40503) % 4294967296 AS h FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY g, y ORDER BY h, id) AS rn, count(*) OVER (PARTITION BY g, y) AS n FROM q),
s AS (SELECT g, y, p, CASE WHEN rn <= floor(0.8e0 * n) THEN 'train' WHEN rn <= floor(0.9e0 * n) THEN 'val' ELSE 'test' END AS part FROM r),
u AS (SELECT 'a_train_set' AS "set", g AS "group", y::VARCHAR AS target FROM s WHERE part = 'train' UNION ALL SELECT 'b_predicted_set', g, y::VARCHAR FROM s WHERE part = 'val' UNION ALL SELECT 'c_predictions_set', g, p::VARCHAR FROM s WHERE part = 'val'),
c AS (SELECT "set", "group", target, count(*) AS n FROM u GROUP BY "set", "group", target)
SELECT "set", "group", target, n, n::DOUBLE / sum(n) OVER (PARTITION BY "set") AS share FROM c""",
)
def three_sets_distribution(spark, d):
    rows = encode.stratified_split(orders_view(spark, d), "id", ["g", "y"])
    return distribution.three_sets(rows.where("part = 'train'"), rows.where("part = 'val'"), "g")


@_register("drop_null_rows", "SELECT count(*) AS kept FROM (SELECT CASE WHEN l_discount > 0.09 THEN NULL ELSE l_quantity END AS a, CASE WHEN l_tax < 0.01 THEN NULL ELSE l_returnflag END AS b FROM lineitem) q WHERE a IS NOT NULL AND b IS NOT NULL")
def drop_null_rows(spark, d):
    t = table(spark, d, "lineitem").select(F.when(F.col("l_discount") <= 0.09, F.col("l_quantity")).alias("a"), F.when(F.col("l_tax") >= 0.01, F.col("l_returnflag")).alias("b"))
    return encode.drop_invalid(t, ["a", "b"]).agg(F.count(F.lit(1)).alias("kept"))


@_register("label_encode", "SELECT c_custkey, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INT AS c_mktsegment FROM customer")
def label_encode(spark, d):
    return encode.label_encode(table(spark, d, "customer").select("c_custkey", "c_mktsegment"))[0]


@_register("label_mapping", "SELECT p_brand AS value, (row_number() OVER (ORDER BY p_brand) - 1)::INT AS code FROM (SELECT DISTINCT p_brand FROM part) q")
def label_mapping(spark, d):
    return encode.label_codes(table(spark, d, "part"), "p_brand")


@_register("one_hot_protected", 'SELECT l_orderkey, l_linenumber, (l_returnflag = \'A\')::DOUBLE AS "A", (l_returnflag = \'N\')::DOUBLE AS "N", (l_returnflag = \'R\')::DOUBLE AS "R" FROM lineitem')
def one_hot_protected(spark, d):
    coded, mapping = encode.label_encode(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"))
    return encode.dummies(coded, "l_returnflag", encode.labels_of(mapping["l_returnflag"])).drop("l_returnflag")


@_register(
    "quantile_bins",
    "WITH e AS (SELECT quantile_cont(p_retailprice, [0.25, 0.5, 0.75]) AS a, quantile_cont(p_size, [0.25, 0.5, 0.75]) AS b FROM part) "
    "SELECT p_partkey, ((p_retailprice >= a[1])::INT + (p_retailprice >= a[2])::INT + (p_retailprice >= a[3])::INT) AS p_retailprice, ((p_size >= b[1])::INT + (p_size >= b[2])::INT + (p_size >= b[3])::INT) AS p_size FROM part, e",
)
def quantile_bins(spark, d):
    return encode.quantile_bins(table(spark, d, "part").select("p_partkey", "p_retailprice", "p_size"), ["p_retailprice", "p_size"])


@_register(
    "derived_labels",
    "SELECT p_partkey, CASE WHEN p_size > 25 AND p_size < 60 THEN 'Adult' WHEN p_size >= 60 THEN 'Aged' ELSE 'Young' END AS three, CASE WHEN p_size < 25 THEN 'Young' ELSE 'Aged' END AS two, "
    "CASE WHEN p_brand IN ('Brand#11', 'Brand#13') THEN 'Male' ELSE 'Female' END AS listed, CASE WHEN p_size = 2 THEN 0.0 ELSE 1.0 END::DOUBLE AS class FROM part",
)
def derived_labels(spark, d):
    t = table(spark, d, "part")
    return t.select("p_partkey", scalar.age_in_three("p_size").alias("three"), scalar.age_in_two("p_size").alias("two"), scalar.among("p_brand", ["Brand#11", "Brand#13"], "Male", "Female").alias("listed"), scalar.among("p_size", [2], 0.0, 1.0).alias("class"))


@_register("regex_recode", "SELECT o_orderkey, CASE WHEN regexp_matches(o_orderpriority, '^[12]-') THEN 1 WHEN regexp_matches(o_orderpriority, '-') THEN 0 END AS urgent FROM orders")
def regex_recode(spark, d):
    return table(spark, d, "orders").select("o_orderkey", scalar.recode_by_pattern("o_orderpriority", [("^[12]-", 1), ("-", 0)]).alias("urgent"))


@_register("code_to_label", "SELECT c_custkey, CASE c_nationkey WHEN 0 THEN 'zero' WHEN 1 THEN 'one' WHEN 2 THEN 'two' END AS label FROM customer")
def code_to_label(spark, d):
    return table(spark, d, "customer").select("c_custkey", scalar.code_to_label("c_nationkey", {0: "zero", 1: "one", 2: "two"}).alias("label"))


@_register("safe_ratio", "SELECT p_partkey, coalesce(p_retailprice / nullif(p_size % 3, 0), 0.0) AS r, abs(p_retailprice - p_size) AS a, p_retailprice - p_size AS b FROM part")
def safe_ratio(spark, d):
    price, size = F.col("p_retailprice"), F.col("p_size")
    return table(spark, d, "part").select("p_partkey", scalar.ratio(price, size % 3).alias("r"), scalar.abs_diff(price, size).alias("a"), scalar.diff(price, size).alias("b"))


_SPLIT = "WITH v AS (SELECT o_orderkey AS id, o_orderpriority AS g, o_orderstatus AS y, (o_orderkey * 2654435761 + 42 * 40503) % 4294967296 AS h FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY g, y ORDER BY h, id) AS rn, count(*) OVER (PARTITION BY g, y) AS n FROM v), s AS (SELECT id, g, y, CASE WHEN rn <= floor(0.8e0 * n) THEN 'train' WHEN rn <= floor(0.9e0 * n) THEN 'val' ELSE 'test' END AS part FROM r) "


def _split(spark, d):
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("g"), F.col("o_orderstatus").alias("y"))
    return encode.stratified_split(t, "id", ["g", "y"])


@_register("stratified_split_rows", _SPLIT + "SELECT id, g, y, part FROM s")
def stratified_split_rows(spark, d):
    return _split(spark, d)


@_register("stratified_split_counts", _SPLIT + "SELECT g, y, part, count(*) AS n FROM s GROUP BY g, y, part")
def stratified_split_counts(spark, d):
    return _split(spark, d).groupBy("g", "y", "part").agg(F.count(F.lit(1)).alias("n"))


def _massaging_sql(group: str) -> str:
    return f"""WITH v AS ({VIEW_SQL['documents']}), st AS (SELECT y, avg(x) AS mu, var_pop(x) AS vr, count(*) AS n FROM v GROUP BY y), al AS (SELECT var_pop(x) AS vt, count(*) AS n FROM v),
ll AS (SELECT v.id, st.y AS k, ln(st.n * 1.0 / al.n) - 0.5 * ln(2 * pi() * (st.vr + 1e-9 * al.vt)) - (v.x - st.mu) * (v.x - st.mu) / (2 * (st.vr + 1e-9 * al.vt)) AS l FROM v CROSS JOIN st CROSS JOIN al),
sc AS (SELECT id, 1.0 / (1.0 + exp(max(CASE WHEN k = 1 THEN l END) - max(CASE WHEN k = 0 THEN l END))) AS p0 FROM ll GROUP BY id),
b AS (SELECT v.id, CASE WHEN v.g = '{group}' THEN 1 ELSE 0 END AS u, v.y, sc.p0 FROM v JOIN sc ON v.id = sc.id),
q AS (SELECT sum(u) AS u, sum(u * y) AS uy, sum(1 - u) AS p, sum((1 - u) * y) AS py FROM b),
m AS (SELECT CAST(trunc((u * py - p * uy) / CAST(u + p AS DOUBLE)) AS INT) AS m, u::BIGINT AS u, uy::BIGINT AS uy, p::BIGINT AS p, py::BIGINT AS py FROM q),
r AS (SELECT b.*, row_number() OVER (PARTITION BY u, y ORDER BY CASE WHEN u = 1 THEN -p0 ELSE p0 END, id) AS rn FROM b)
"""


def _in_group(spark, d, group: str) -> DataFrame:
    return documents_view(spark, d).withColumn("u", (F.col("g") == group).cast("int"))


@_register("massaging_m", _massaging_sql("de") + "SELECT u, uy, p, py, m FROM m")
def massaging_m(spark, d):
    return corrections.massaging_m(_in_group(spark, d, "de"), "u")


@_register("massaging_candidates", _massaging_sql("de") + "SELECT id, u, y, rn AS rank FROM r")
def massaging_candidates(spark, d):
    return corrections.massaging_candidates(_in_group(spark, d, "de"), "u", "id", ["x"]).select("id", "u", "y", F.col("rank").cast("long").alias("rank"))


@_register("massaging_apply", _massaging_sql("de") + "SELECT r.id, r.u, r.y, CASE WHEN r.u = 1 AND r.y = 0 AND rn <= m.m THEN 1 WHEN r.u = 0 AND r.y = 1 AND rn <= m.m THEN 0 ELSE r.y END AS y2 FROM r CROSS JOIN m")
def massaging_apply(spark, d):
    return corrections.massage(_in_group(spark, d, "de"), "u", "id", ["x"], out="y2").select("id", "u", "y", F.col("y2").cast("int").alias("y2"))


@_register(
    "reweigh_weighted_rates",
    f"{_ctes('orders')}, c AS (SELECT value, s, y, count(*)::DOUBLE AS n FROM t GROUP BY value, s, y), w AS (SELECT *, (sum(n) OVER (PARTITION BY value, s)) * (sum(n) OVER (PARTITION BY value, y)) / (sum(n) OVER (PARTITION BY value)) AS mass FROM c) SELECT value AS grp, s, sum(CASE WHEN y = 1 THEN mass ELSE 0 END) / sum(mass) AS rate FROM w GROUP BY value, s",
)
def reweigh_weighted_rates(spark, d):
    mass = F.col("n") * F.col("weight")
    return corrections.weigh_one_vs_rest(orders_view(spark, d), "g").groupBy("grp", "s").agg(scalar.ratio(F.sum(F.when(F.col("y") == 1, mass).otherwise(0.0)), F.sum(mass)).alias("rate"))


@_register(
    "reweigh_resample",
    f"""WITH v AS (SELECT id, CASE WHEN g = 'de' THEN 1 ELSE 0 END AS s, y FROM ({VIEW_SQL['documents']}) q), c AS (SELECT s, y, count(*) AS n FROM v GROUP BY s, y),
w AS (SELECT s, y, n, (sum(n) OVER (PARTITION BY s)) * (sum(n) OVER (PARTITION BY y)) * 1.0e0 / (sum(n) OVER ()) AS mass FROM c),
cum AS (SELECT s, y, n, (sum(mass) OVER (ORDER BY s, y) - mass) / sum(mass) OVER () AS lo, (sum(mass) OVER (ORDER BY s, y)) / sum(mass) OVER () AS hi FROM w),
k AS (SELECT abs(sum(s) - sum(1 - s)) AS k FROM v), i AS (SELECT i.i FROM (SELECT range AS i FROM range(1000000)) i CROSS JOIN k WHERE i.i < k.k),
dr AS (SELECT i, ((i * 2654435761 + 42 * 40503) % 4294967296) / 4294967296.0e0 AS u1, ((i * 2246822519 + 42 * 97) % 4294967296) / 4294967296.0e0 AS u2 FROM i),
dc AS (SELECT dr.i, cum.s, cum.y, CAST(floor(u2 * cum.n) AS BIGINT) + 1 AS rn FROM dr JOIN cum ON u1 >= cum.lo AND u1 < cum.hi),
vr AS (SELECT v.*, row_number() OVER (PARTITION BY s, y ORDER BY id) AS rn FROM v)
SELECT dc.i AS draw, vr.id, vr.s, vr.y FROM dc JOIN vr ON dc.s = vr.s AND dc.y = vr.y AND dc.rn = vr.rn""",
)
def reweigh_resample(spark, d):
    rows = documents_view(spark, d).select("id", (F.col("g") == "de").cast("int").alias("s"), "y")
    return corrections.resample(rows, "s", "id")


def _repair_sql(source: str) -> str:
    return f"""WITH v AS ({source}), r AS (SELECT id, g, x, (row_number() OVER (PARTITION BY g ORDER BY x, id) - 1) AS rn, count(*) OVER (PARTITION BY g) AS n FROM v),
k AS (SELECT min(n) AS nb FROM r), q AS (SELECT r.*, CAST(floor(rn * nb * 1.0e0 / n) AS BIGINT) AS b FROM r CROSS JOIN k),
gq AS (SELECT g, b, median(x) AS x FROM q GROUP BY g, b), m AS (SELECT b, median(x) AS x FROM gq GROUP BY b)
SELECT q.id, q.g, q.x, 0.25 * q.x + 0.75 * m.x AS repaired FROM q JOIN m ON q.b = m.b"""


@_register("impact_repair_customer", _repair_sql("SELECT c_custkey AS id, c_mktsegment AS g, c_acctbal AS x FROM customer").replace("0.25 * q.x + 0.75 * m.x", "m.x"))
def impact_repair_customer(spark, d):
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("g"), F.col("c_acctbal").alias("x"))
    return corrections.repair(t, "g", "id", "x").select("id", "g", "x", "repaired")


@_register("impact_repair_part", _repair_sql("SELECT p_partkey AS id, p_brand AS g, p_retailprice AS x FROM part"))
def impact_repair_part(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("g"), F.col("p_retailprice").alias("x"))
    return corrections.repair(t, "g", "id", "x", level=0.75).select("id", "g", "x", "repaired")


@_register(
    "consistency_knn",
    f"""WITH v AS (SELECT id, g, p::DOUBLE AS p, (CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END) + (CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END) + (CASE WHEN n_chars > 4000 THEN 1 ELSE 0 END) AS b, toxic AS t FROM ({VIEW_SQL['documents']}) q),
gs AS (SELECT DISTINCT g AS grp FROM v),
j AS (SELECT gs.grp, a.id AS ai, c.id AS ci, a.p AS ap, c.p AS cp, (a.b - c.b) * (a.b - c.b) + (a.t - c.t) * (a.t - c.t) + (CASE WHEN (a.g = gs.grp) <> (c.g = gs.grp) THEN 1 ELSE 0 END) AS d2 FROM gs CROSS JOIN v a CROSS JOIN v c),
r AS (SELECT *, row_number() OVER (PARTITION BY grp, ai ORDER BY d2, CASE WHEN ai = ci THEN 0 ELSE 1 END, ci) AS rn FROM j),
m AS (SELECT grp, ai, max(ap) AS ap, avg(cp) AS mp FROM r WHERE rn <= 3 GROUP BY grp, ai)
SELECT grp AS value, 1 - avg(abs(ap - mp)) AS consistency FROM m GROUP BY grp""",
)
def consistency_knn(spark, d):
    rows = documents_view(spark, d).withColumn("b", encode.binned(F.col("n_chars"), [1001, 2001, 4001]))
    return neighbours.consistency(rows, "id", "g", ["b", "toxic"])


@_register("feature_mask_projection", "SELECT p_partkey, p_brand, p_retailprice FROM part")
def feature_mask_projection(spark, d):
    t = table(spark, d, "part")
    return encode.masked(t, ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"], [0, 1, 0, 0, 1])


@_register("column_intersection", "SELECT p_partkey, p_brand FROM part")
def column_intersection(spark, d):
    t = table(spark, d, "part")
    return t.select(*encode.common_columns(t.select("p_brand", "p_partkey", "p_size"), t.select("p_partkey", "p_name", "p_brand")))


@_register("sse_over_seeds", f"WITH e AS ({VIEW_SQL['events']}) SELECT seed, metric, sum((x - 1) * (x - 1)) AS x FROM e GROUP BY seed, metric")
def sse_over_seeds(spark, d):
    return reduce.sse_over_seeds(events_view(spark, d), ["seed", "metric"], ["x"])


@_register("mean_over_seeds", f"WITH e AS ({VIEW_SQL['events']}) SELECT metric, avg(x) AS x FROM e GROUP BY metric")
def mean_over_seeds(spark, d):
    return reduce.mean_over_seeds(events_view(spark, d), ["metric"], ["x"])


@_register("multi_seed_reduce", f"WITH e AS ({VIEW_SQL['events']}) SELECT metric, sum((x / 500 - 1) * (x / 500 - 1)) AS fairness_x, avg(x) AS performance_x FROM e GROUP BY metric")
def multi_seed_reduce(spark, d):
    rows = events_view(spark, d).select("metric", (F.col("x") / 500).alias("fairness_x"), F.col("x").alias("performance_x"))
    return reduce.multi_seed_reduce(rows, ["metric"], decimals=None)


@_register("mean_only_reduce", f"WITH e AS ({VIEW_SQL['events']}) SELECT metric, avg(x / 500) AS fairness_x, avg(x) AS performance_x FROM e GROUP BY metric")
def mean_only_reduce(spark, d):
    rows = events_view(spark, d).select("metric", (F.col("x") / 500).alias("fairness_x"), F.col("x").alias("performance_x"))
    return reduce.multi_seed_reduce(rows, ["metric"], decimals=None, means_only=True)


@_register("first_last_n_per_seed", f"WITH e AS ({VIEW_SQL['events']}), r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY ordinal) AS a, row_number() OVER (PARTITION BY seed ORDER BY ordinal DESC) AS b FROM e) SELECT seed, metric, x, ordinal, user_id FROM r WHERE a <= 2 OR b <= 3")
def first_last_n_per_seed(spark, d):
    return reduce.first_or_last(events_view(spark, d), "seed", "ordinal", head=2, tail=3)


@_register("missing_seeds", f"WITH e AS ({VIEW_SQL['events']}) SELECT seed FROM (SELECT range AS seed FROM range(5, 45)) s WHERE seed NOT IN (SELECT seed FROM e)")
def missing_seeds(spark, d):
    return reduce.missing_seeds(events_view(spark, d), "seed", 5, 40)


@_register("complete_seeds", "WITH e AS (SELECT user_id AS seed, event_type AS metric, event_id AS ordinal FROM events), k AS (SELECT seed FROM e WHERE metric IN ('click', 'error') GROUP BY seed HAVING count(DISTINCT metric) = 2) SELECT seed, metric, ordinal FROM e WHERE seed IN (SELECT seed FROM k)")
def complete_seeds(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("seed"), F.col("event_type").alias("metric"), F.col("event_id").alias("ordinal"))
    return reduce.complete_seeds(rows, "seed", "metric", ["click", "error"]).select("seed", "metric", "ordinal")


@_register("shape_check", f"WITH e AS ({VIEW_SQL['events']}), c AS (SELECT seed, count(*) AS n FROM e GROUP BY seed) SELECT count(DISTINCT n) <= 1 AS same, min(n) AS least, max(n) AS most FROM c")
def shape_check(spark, d):
    return reduce.same_shape(events_view(spark, d), "seed")


@_register(
    "genotype_frequency",
    "WITH u AS (SELECT user_id, min(event_id) AS o, array_to_string((list(event_type ORDER BY event_id))[1:2], '>') AS genotype FROM events GROUP BY user_id), f AS (SELECT genotype, count(*) AS n, min(o) AS first FROM u GROUP BY genotype) SELECT genotype, n, first, (row_number() OVER (ORDER BY n DESC, first) - 1)::INT AS code FROM f",
)
def genotype_frequency(spark, d):
    first = Window.partitionBy("user_id").orderBy("event_id")
    top = table(spark, d, "events").select("user_id", "event_id", "event_type").withColumn("place", F.row_number().over(first)).where("place <= 2")
    users = top.groupBy("user_id").agg(F.min("event_id").alias("o"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]), ">").alias("genotype"))
    return reduce.genotype_frequency(users, "genotype", "o")


def _results(spark, d) -> DataFrame:
    """Events as result rows: a classifier, an algorithm, a group, an iteration and two metrics."""
    t = table(spark, d, "events")
    return t.select((F.col("user_id") % 3).cast("string").alias("classifier_type"), F.col("event_type").alias("algorithm"), (F.col("user_id") % 5).cast("string").alias("value"), (F.col("event_id") % 3).alias("iteration"), (F.col("value") / 100).alias("fairness_disparate_impact"), (F.col("value") % 1).alias("performance_auc"), F.col("event_id").alias("ordinal"))


_RESULTS = "SELECT (user_id % 3)::VARCHAR AS classifier_type, event_type AS algorithm, (user_id % 5)::VARCHAR AS value, event_id % 3 AS iteration, value / 100 AS fairness_disparate_impact, value % 1 AS performance_auc, event_id AS ordinal FROM events"
_EFFECT = f"""WITH r AS ({_RESULTS}), f AS (SELECT *, row_number() OVER (PARTITION BY classifier_type, algorithm, value, iteration ORDER BY ordinal) AS rn FROM r WHERE iteration IN (1, 2)),
e AS (SELECT a.classifier_type, a.algorithm, a.value, (b.fairness_disparate_impact > a.fairness_disparate_impact)::INT + (b.performance_auc > a.performance_auc)::INT AS num_increases,
  (b.fairness_disparate_impact < a.fairness_disparate_impact)::INT + (b.performance_auc < a.performance_auc)::INT AS num_decreases, (b.fairness_disparate_impact = a.fairness_disparate_impact)::INT + (b.performance_auc = a.performance_auc)::INT AS num_no_change
  FROM f a JOIN f b ON a.classifier_type = b.classifier_type AND a.algorithm = b.algorithm AND a.value = b.value AND a.iteration = 1 AND b.iteration = 2 AND a.rn = 1 AND b.rn = 1)
"""
_METRICS = ["fairness_disparate_impact", "performance_auc"]


@_register("iteration_effect", _EFFECT + "SELECT * FROM e")
def iteration_effect(spark, d):
    return report.iteration_effect(_results(spark, d), _METRICS)


@_register(
    "iteration_effect_report",
    _EFFECT + ", s AS (SELECT classifier_type, algorithm, string_agg(value, '' ORDER BY value) AS value, sum(num_increases)::BIGINT AS num_increases, sum(num_decreases)::BIGINT AS num_decreases, sum(num_no_change)::BIGINT AS num_no_change FROM e GROUP BY classifier_type, algorithm) SELECT * FROM s UNION ALL SELECT 'Total', NULL, NULL, sum(num_increases)::BIGINT, sum(num_decreases)::BIGINT, sum(num_no_change)::BIGINT FROM s",
)
def iteration_effect_report(spark, d):
    return report.with_total(report.effect_by(report.iteration_effect(_results(spark, d), _METRICS)), "classifier_type")


@_register(
    "colour_flags",
    f"""WITH r AS ({_RESULTS}), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY value ORDER BY ordinal) AS rn FROM r WHERE iteration = 0) q WHERE rn = 1)
SELECT r.value, r.classifier_type, r.algorithm, r.iteration, r.ordinal,
  CASE WHEN r.iteration = 0 THEN CASE WHEN r.fairness_disparate_impact > 1.2 THEN 'red' ELSE '' END WHEN r.fairness_disparate_impact <= 1.2 THEN 'green' WHEN r.fairness_disparate_impact >= b.fairness_disparate_impact THEN 'orange' ELSE 'yellow' END AS fairness_disparate_impact_colour,
  CASE WHEN r.iteration = 0 THEN '' WHEN r.performance_auc > b.performance_auc THEN 'green' WHEN r.performance_auc < b.performance_auc THEN 'orange' ELSE 'yellow' END AS performance_auc_colour
FROM r JOIN b ON r.value = b.value""",
)
def colour_flags(spark, d):
    out = report.colours(_results(spark, d), _METRICS[:1], _METRICS[1:])
    return out.select("value", "classifier_type", "algorithm", "iteration", "ordinal", "fairness_disparate_impact_colour", "performance_auc_colour")


@_register(
    "select_union_report",
    f"""WITH r AS (SELECT *, CASE WHEN ordinal % 2 = 0 THEN value ELSE 'other' END AS "group" FROM ({_RESULTS}) q),
p AS (SELECT *, CASE WHEN iteration = 0 THEN 0 WHEN algorithm IN ('click', 'view') AND "group" = value THEN 1 WHEN algorithm = 'purchase' THEN 2 END AS part FROM r)
SELECT ordinal, algorithm, value, iteration, part, CASE WHEN part = 0 THEN value ELSE "group" END AS "group" FROM p WHERE part IS NOT NULL""",
)
def select_union_report(spark, d):
    rows = _results(spark, d).withColumn("group", F.when(F.col("ordinal") % 2 == 0, F.col("value")).otherwise("other"))
    return report.selected(rows, ["click", "view"], ["purchase"]).select("ordinal", "algorithm", "value", "iteration", "part", "group")


_WIDE = "SELECT user_id % 30 AS \"Generation\", avg(value) AS a_auc, max(value) AS a_aucmean, min(value) AS b_auc, avg(value * 2) AS b_aucmean FROM events GROUP BY user_id % 30"


def _evolution(spark, d) -> DataFrame:
    x = F.col("value")
    return table(spark, d, "events").groupBy((F.col("user_id") % 30).alias("Generation")).agg(F.avg(x).alias("a_auc"), F.max(x).alias("a_aucmean"), F.min(x).alias("b_auc"), F.avg(x * 2).alias("b_aucmean"))


@_register(
    "melt_best_population",
    f"WITH w AS ({_WIDE}) SELECT \"Generation\", 'a' AS metric, a_auc AS error, 'Best' AS legend FROM w UNION ALL SELECT \"Generation\", 'a', a_aucmean, 'Population' FROM w UNION ALL SELECT \"Generation\", 'b', b_auc, 'Best' FROM w UNION ALL SELECT \"Generation\", 'b', b_aucmean, 'Population' FROM w",
)
def melt_best_population(spark, d):
    wide = report.best_and_population(_evolution(spark, d), ["a", "b"], "auc")
    return report.melted(wide, ["Generation"], "metric", "error", "legend")


@_register("evolution_means", f"WITH w AS ({_WIDE}) SELECT \"Generation\" % 5 AS generation, avg(a_auc) AS a_auc, avg(b_auc) AS b_auc FROM w GROUP BY \"Generation\" % 5")
def evolution_means(spark, d):
    rows = _evolution(spark, d).select((F.col("Generation") % 5).alias("generation"), "a_auc", "b_auc")
    return reduce.evolution_means(rows, "generation", ["a_auc", "b_auc"])


@_register("formatted_values", "SELECT event_id, printf('%.3f', round_even(value / 7, 3)) AS padded, replace(replace(event_type, 'click', 'CLK'), 'view', 'VW') AS coded FROM events")
def formatted_values(spark, d):
    return table(spark, d, "events").select("event_id", scalar.padded_text(F.col("value") / 7, 3).alias("padded"), scalar.replaced_in_order("event_type", [("click", "CLK"), ("view", "VW")]).alias("coded"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fairness of quality judgements by language."""
    return fairness.fairness(documents_view(spark, sf_dir), "g")


_GROUPS = {"lineitem": "l_returnflag", "documents": "lang", "customer": "c_mktsegment"}


@_register(
    "search_space_size",
    "WITH g AS (" + " UNION ALL ".join(f"SELECT '{t}' AS of, count(DISTINCT {c}) AS groups FROM {t}" for t, c in _GROUPS.items()) + ") "
    "SELECT of, groups, 4 AS algorithms, ((factorial((6 * groups)::INT) / factorial((4 * groups)::INT) / factorial((2 * groups)::INT)) - 1)::BIGINT AS size FROM g",
)
def search_space_size(spark, d):
    """How many sequences of four corrections the groups of three tables allow."""
    counts = [(t, table(spark, d, t).agg(F.count_distinct(c)).first()[0]) for t, c in _GROUPS.items()]
    return spark.createDataFrame([(t, n, 4, space_size(n, 4)) for t, n in counts], "of string, groups long, algorithms int, size long")


@_register("gene_product", "WITH g AS (SELECT lang, dense_rank() OVER (ORDER BY lang) - 1 AS code FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) x) SELECT code::INT AS group_code, lang, a.range::INT AS algorithm_code FROM g CROSS JOIN range(4) a")
def gene_product(spark, d):
    """Each group of documents with each of four corrections."""
    labels = encode.labels_of(encode.label_codes(table(spark, d, "documents"), "lang"))
    return spark.createDataFrame([(g, labels[g], a) for g, a in gene_pool(len(labels), 4)], "group_code int, lang string, algorithm_code int")


def _model_rows(spark, d) -> tuple[DataFrame, DataFrame]:
    t = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal"), "o_custkey")
    rows = t.select(F.col("o_orderkey").alias("row_id"), F.col("c_mktsegment").alias("g"), F.col("o_totalprice").alias("price"), F.col("c_acctbal").alias("balance"), F.pmod("o_custkey", F.lit(7)).cast("double").alias("k"), ((F.col("o_totalprice") + 100 * F.col("c_acctbal").cast("double")) > 500000).cast("double").alias("target"))
    split = encode.stratified_split(rows, "row_id", ["g", "target"])
    return split.where("part = 'train'").drop("part"), split.where("part = 'test'").drop("part")


def _add_models() -> None:
    for name in (*models.SURROGATES, "linear_svc", "gbt", models.TARGET):
        def one(spark, d, name=name):
            train, test = _model_rows(spark, d)
            return models.assess(train, test, name, ["price", "balance", "k"], "g")[0]

        _register(f"model_assess_{name}")(one)


_add_models()

#: A Gaussian naive Bayes in closed form on the rows of the model queries, and its assessment.
SQL["model_assess_gaussian_nb_cells"] = (
    """WITH b AS (SELECT o_orderkey AS id, c_mktsegment AS g, o_totalprice AS x0, c_acctbal AS x1, (o_custkey % 7)::DOUBLE AS x2, CASE WHEN o_totalprice + 100 * c_acctbal > 500000 THEN 1 ELSE 0 END AS y FROM orders JOIN customer ON o_custkey = c_custkey),
h AS (SELECT *, (id * 2654435761 + 42 * 40503) % 4294967296 AS h FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY g, y ORDER BY h, id) AS rn, count(*) OVER (PARTITION BY g, y) AS n FROM h),
s AS (SELECT *, CASE WHEN rn <= floor(0.8e0 * n) THEN 'train' WHEN rn <= floor(0.9e0 * n) THEN 'val' ELSE 'test' END AS part FROM r),
st AS (SELECT y AS k, count(*)::DOUBLE AS n, avg(x0) AS m0, avg(x1) AS m1, avg(x2) AS m2, var_pop(x0) AS v0, var_pop(x1) AS v1, var_pop(x2) AS v2 FROM s WHERE part = 'train' GROUP BY y),
ev AS (SELECT greatest(var_pop(x0), var_pop(x1), var_pop(x2)) * 1e-9 AS e FROM s WHERE part = 'train'),
ll AS (SELECT id, g, y, k, ln(st.n) - 0.5 * (ln(v0 + e) + ln(v1 + e) + ln(v2 + e) + (x0 - m0) ** 2 / (v0 + e) + (x1 - m1) ** 2 / (v1 + e) + (x2 - m2) ** 2 / (v2 + e)) AS l FROM s CROSS JOIN st CROSS JOIN ev WHERE part = 'test'),
p AS (SELECT id, g, y, CASE WHEN max(CASE WHEN k = 1 THEN l END) > max(CASE WHEN k = 0 THEN l END) THEN 1 ELSE 0 END AS p FROM ll GROUP BY id, g, y)
SELECT g, count(*) AS n, sum(p)::BIGINT AS pp, sum(y)::BIGINT AS pos, sum(y * p)::BIGINT AS tp, sum((1 - y) * p)::BIGINT AS fp FROM p GROUP BY g"""
)


@_register("model_assess_gaussian_nb_cells", SQL["model_assess_gaussian_nb_cells"])
def model_assess_gaussian_nb_cells(spark, d):
    """Contingency counts of the fitted model's predictions: what its assessment is made of."""
    train, test = _model_rows(spark, d)
    scored = models.fit_predict(train, test, "gaussian_nb", ["price", "balance", "k"])
    return contingency.contingency(scored.select("g", F.col("target").cast("int").alias("y"), F.col("prediction").alias("p")), "g")


@_register("feature_search")
def feature_search(spark, d):
    """The published search: 101 masks, 50 generations, 3 folds, judged by a forest of 100 trees; the sensitive column is searched too."""
    train, _ = _model_rows(spark, d)
    codes = encode.label_codes(train, "g")
    train = train.join(F.broadcast(codes.select(F.col("value").alias("g"), F.col("code").cast("double").alias("segment"))), "g")  # a row a group
    kept = select_features(train, ["price", "balance", "k", "segment"], "segment", "row_id")
    return spark.createDataFrame([(f,) for f in kept], "feature string")


#: Two groups of lineitem, and what a gene (2 group + algorithm) is worth: counts of its rows, cut to few values so that some tie.
_GENES = """WITH RECURSIVE codes AS (SELECT l_linestatus, dense_rank() OVER (ORDER BY l_linestatus) - 1 AS code FROM (SELECT DISTINCT l_linestatus FROM lineitem) x),
worth AS (SELECT 2 * code + l_linenumber % 2 AS c, count(*) % 5 AS good, count(*) FILTER (l_quantity > 25) % 3 AS bad FROM lineitem JOIN codes USING (l_linestatus) GROUP BY 1),
"""
_ALL_SEQUENCES = """s AS (SELECT [c] AS codes, c AS last FROM (SELECT unnest(range((SELECT 2 * count(*) FROM codes))) AS c) g
UNION ALL SELECT list_append(codes, c), c FROM s, (SELECT unnest(range((SELECT 2 * count(*) FROM codes))) AS c) g WHERE c >= last AND len(codes) < (SELECT 2 * count(*) FROM codes))"""


def _genes(spark, d) -> tuple[dict[int, str], dict[tuple[int, int], tuple[int, int]]]:
    """Labels of the two groups, and each gene's worth, from one aggregation."""
    t = table(spark, d, "lineitem")
    labels = encode.labels_of(encode.label_codes(t, "l_linestatus"))
    worth = t.groupBy("l_linestatus", (F.col("l_linenumber") % 2).alias("a")).agg(F.count(F.lit(1)).alias("good"), F.count(F.when(F.col("l_quantity") > 25, 1)).alias("bad")).collect()  # a row a gene
    numbers = {label: code for code, label in labels.items()}
    return labels, {(numbers[r["l_linestatus"]], r["a"]): (r["good"] % 5, r["bad"] % 3) for r in worth}


@_register("sequence_space", _GENES + _ALL_SEQUENCES + " SELECT len(codes)::INT AS genes, array_to_string([(c // 2)::VARCHAR || (c % 2)::VARCHAR for c in codes], '') AS genotype FROM s")
def sequence_space(spark, d):
    """Every sequence of two corrections for the groups of lineitem, as digits."""
    labels, _ = _genes(spark, d)
    return spark.createDataFrame([(len(i), flatten(i)) for i in everything(len(labels), 2)], "genes int, genotype string")


@_register(
    "sequence_search_history",
    _GENES
    + _ALL_SEQUENCES
    + """, each AS (SELECT codes, unnest(codes) AS c FROM s),
v AS (SELECT codes, sum(good)::DOUBLE / len(codes) AS good, sum(bad)::DOUBLE + len(codes) AS bad FROM each JOIN worth USING (c) GROUP BY codes),
o AS (SELECT *, row_number() OVER (ORDER BY len(codes), codes) AS place FROM v), top AS (SELECT *, rank() OVER (ORDER BY good DESC) AS r, row_number() OVER (ORDER BY good DESC, place) AS k FROM o),
kept AS (SELECT * FROM top WHERE k <= (SELECT count(*) FROM top WHERE r = 1) + 1), best AS (SELECT * FROM kept ORDER BY bad, k LIMIT 1)
SELECT 0 AS "Generation", array_to_string([(c // 2)::VARCHAR || (c % 2)::VARCHAR for c in codes], '') AS genotype, good AS m_good, bad AS m_bad, (SELECT avg(good) FROM o) AS m_goodmean, (SELECT avg(bad) FROM o) AS m_badmean FROM best""",
)
def sequence_search_history(spark, d):
    """The whole search of a small space by what its genes are worth: its best sequence, and the means of its population."""
    labels, worth = _genes(spark, d)
    good = lambda i: sum(worth[gene][0] for gene in i) / len(i)
    bad = lambda i: float(sum(worth[gene][1] for gene in i) + len(i))
    found = Search(lambda i: ({"m": {"good": good(i)}}, {"m": {"bad": bad(i)}}), len(labels), 2, ["m"], ["good"], ["bad"])
    best = found.run()
    history = decoded(spark, found.history, list(labels.values()), ["0", "1"])
    return history.select(F.col("Generation").cast("int").alias("Generation"), F.lit(flatten(best)).alias("genotype"), "m_good", "m_bad", "m_goodmean", "m_badmean")


@_register("pipeline_search")
def pipeline_search(spark, d):
    """All four language groups of documents and the pool of four corrections, by the genetic search: smaller than the published one."""
    rows = documents_view(spark, d).select(F.col("id").alias("row_id"), F.col("g").alias("protected_lang"), "x", "toxic", F.col("y").cast("double").alias("target"))
    data, history = assessment.searched(
        rows, "_dummy", "lang", ["x", "toxic"], assessment.Plan(pool=("massaging", "reweighing", "repair", "feature_search"), models=("decision_tree", "gaussian_nb"), sequences=SMALL_SEQUENCES, features=SMALL_FEATURES)
    )
    return history


@_register("streaming_contingency", f"WITH v AS ({VIEW_SQL['lineitem']}) SELECT g, count(*) AS n, sum(p)::BIGINT AS pp, sum(y)::BIGINT AS pos, sum(y * p)::BIGINT AS tp, sum((1 - y) * p)::BIGINT AS fp FROM v GROUP BY g")
def streaming_contingency(spark, d):
    """The lineitem view read as a stream to its end."""
    schema = table(spark, d, "lineitem").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/lineitem.parque[t]")  # a pattern, so that the table may be one file or a folder of them
    rows = stream.select(F.col("l_returnflag").alias("g"), (F.col("l_linestatus") == "F").cast("int").alias("y"), (F.col("l_discount") >= 0.05).cast("int").alias("p"))
    name = f"live_{uuid.uuid4().hex}"
    query = live_counts(rows, "g").writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
