"""Registered queries that write the provided tables in the forms that sources read, read them back, and say in SQL what must come."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairspark.functions import scalar, text
from fairspark.operators import corrections, encode, reduce, report
from fairspark.plans.storage import checkpointed, ensure_checkpoint_dir
from fairspark.plans.views import documents_view, table
from fairspark.sources import config, prepare, readers, sinks
from fairspark.streaming.contingency import windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _register(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def _folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _events(spark, d) -> DataFrame:
    t = table(spark, d, "events")
    return t.select((F.col("user_id") % 30).alias("seed"), F.col("event_type").alias("algorithm"), "event_id", "value", (F.col("event_id") % 3).alias("num_iterations"))


@_register("scan_csv", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_csv(spark, d):
    rows, path = table(spark, d, "customer"), _folder(spark, "csv")
    sinks.export_csv(rows, path, decimals=None)
    return readers.csv(spark, path, rows.schema)


def _by_seed(spark, d, columns=("seed",)) -> str:
    path = _folder(spark, "seeds")
    rows = _events(spark, d).where("seed <> 4")
    rows.repartition(*columns).sortWithinPartitions(*columns, "event_id").write.option("header", True).partitionBy(*columns).csv(path)
    return path


@_register("scan_seeds", "SELECT user_id % 30 AS seed, event_id, value FROM events WHERE user_id % 30 BETWEEN 2 AND 40 AND user_id % 30 <> 4")
def scan_seeds(spark, d):
    rows = readers.seeds(spark, _by_seed(spark, d) + "/seed={seed}", 2, 39)
    return rows.select("seed", F.col("event_id").cast("long").alias("event_id"), F.col("value").cast("double").alias("value"))


@_register(
    "scan_seed_ends",
    "WITH r AS (SELECT user_id % 30 AS seed, event_id, row_number() OVER (PARTITION BY user_id % 30 ORDER BY event_id) AS a, row_number() OVER (PARTITION BY user_id % 30 ORDER BY event_id DESC) AS b FROM events WHERE user_id % 30 <> 4) SELECT seed, event_id, a - 1 AS ordinal FROM r WHERE seed < 9 AND (a <= 2 OR b <= 3)",
)
def scan_seed_ends(spark, d):
    schema = "algorithm string, event_id long, value double, num_iterations long"
    return readers.seeds_ends(spark, _by_seed(spark, d) + "/seed={seed}", 0, 9, head=2, tail=3, schema=schema).select("seed", "event_id", "ordinal")


@_register(
    "scan_per_algorithm",
    """WITH e AS (SELECT user_id % 30 AS seed, event_type, event_id, event_id % 3 AS i FROM events WHERE user_id % 30 <> 4 AND NOT (event_type = 'click' AND user_id % 30 % 7 = 0)),
k AS (SELECT seed FROM e WHERE event_type IN ('click', 'view', 'error') GROUP BY seed HAVING count(DISTINCT event_type) = 3)
SELECT event_id FROM e WHERE event_type IN ('click', 'view', 'error') AND seed IN (SELECT seed FROM k) AND (event_type = 'view' OR i <> 0)""",
)
def scan_per_algorithm(spark, d):
    """A seed that lacks one correction's file goes; baseline rows stay with one correction."""
    path = _folder(spark, "algorithms")
    rows = _events(spark, d).where("seed <> 4 AND NOT (algorithm = 'click' AND seed % 7 = 0)")
    rows.repartition("algorithm", "seed").write.option("header", True).partitionBy("algorithm", "seed").csv(path)
    found = readers.per_algorithm(spark, path + "/algorithm={algorithm}/seed={seed}", ["click", "view", "error"], 0, 30, keeper="view")
    return found.select(F.col("event_id").cast("long").alias("event_id"))


@_register("scan_two_iterations", "SELECT n_nationkey, 1 AS part FROM nation WHERE n_nationkey < 9 UNION ALL SELECT n_nationkey, 2 FROM nation WHERE n_nationkey >= 7")
def scan_two_iterations(spark, d):
    rows, path = table(spark, d, "nation"), _folder(spark, "iterations")
    for k, part in enumerate((rows.where("n_nationkey < 9"), rows.where("n_nationkey >= 7")), 1):
        sinks.export_csv(part, f"{path}/{k}", decimals=None)
    return readers.two_iterations(spark, f"{path}/1", f"{path}/2").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "part")


@_register("scan_first_of_places", "SELECT p_partkey::INT AS lines FROM part WHERE p_partkey <= 40")
def scan_first_of_places(spark, d):
    """The first of several places that can be read: the others are not there."""
    path = _folder(spark, "credit")
    _credit(spark, d).write.text(path)
    return readers.try_load(spark, "German Credit", f"{path}-none", path).where("Attribute2 <= 40").select(F.col("Attribute2").alias("lines"))


def _credit(spark, d) -> DataFrame:
    """Parts as lines of the credit file: 20 attributes and a class, separated by spaces."""
    code = lambda i, n: F.concat(F.lit(f"A{i}"), (F.col("p_partkey") % n + 1).cast("string"))
    numbers = {2: F.col("p_partkey"), 5: F.floor("p_retailprice"), 8: F.col("p_size") % 4 + 1, 11: F.col("p_size") % 3, 13: F.col("p_size") + 18, 16: F.lit(1), 18: F.lit(2)}
    values = [numbers[i].cast("string") if i in numbers else code(i, 4 if i != 9 else 5) for i in range(1, 21)]
    return table(spark, d, "part").select(F.concat_ws(" ", *values, (F.col("p_partkey") % 3 % 2 + 1).cast("string")).alias("value"))


@_register(
    "scan_credit",
    """SELECT 'A1' || (p_partkey % 4 + 1) AS "Attribute1", p_partkey::INT AS "Attribute2", floor(p_retailprice)::INT AS "Attribute5", 'A9' || (p_partkey % 5 + 1) AS "Attribute9", (p_size + 18)::INT AS "Attribute13", 'A20' || (p_partkey % 4 + 1) AS "Attribute20", (p_partkey % 3 % 2 + 1)::INT AS class FROM part""",
)
def scan_credit(spark, d):
    path = _folder(spark, "credit")
    _credit(spark, d).write.text(path)
    return readers.load(spark, "German Credit", path).select("Attribute1", "Attribute2", "Attribute5", "Attribute9", "Attribute13", "Attribute20", "class")


@_register(
    "prepared_credit",
    """WITH r AS (SELECT p_partkey AS row_id, floor(p_retailprice)::DOUBLE AS a5, p_partkey % 5 + 1 AS a9, p_size AS a13, p_partkey % 3 % 2 AS c, p_partkey % 4 AS a1 FROM part),
e AS (SELECT quantile_cont(a5, [0.25, 0.5, 0.75]) AS q FROM r)
SELECT row_id, ((a5 >= q[1])::INT + (a5 >= q[2])::INT + (a5 >= q[3])::INT) AS "Attribute5", (a9 IN (1, 3, 4))::INT AS "Attribute9", (a9 IN (1, 3, 4))::INT AS "protected_Attribute9", 0 AS "Attribute13", a1::INT AS "Attribute1", (c = 0)::INT::DOUBLE AS target FROM r, e""",
)
def prepared_credit(spark, d):
    """Nulls dropped, numbers binned, columns derived, text encoded, in this order; an age that was binned is young for all."""
    path = _folder(spark, "credit")
    _credit(spark, d).write.text(path)
    raw = readers.load(spark, "German Credit", path)
    data = prepare.prepare(raw.withColumn("key", F.col("Attribute2").cast("long")), "German Credit", ("Attribute9",), key="key").data
    return data.select("row_id", "Attribute5", "Attribute9", "protected_Attribute9", "Attribute13", "Attribute1", "target")


def _income(spark, d) -> DataFrame:
    n = F.col("c_custkey")
    text_of = lambda x: x.cast("string")
    values = [text_of(17 + n % 60), F.when(n % 7 == 0, "?").otherwise(F.concat(F.lit("w"), text_of(F.col("c_nationkey")))), text_of(n), F.col("c_mktsegment"), text_of(n % 16), F.lit("m"), F.lit("o"), F.lit("r"), F.lit("x"), F.when(n % 2 == 0, "Male").otherwise("Female"), F.lit("0"), F.lit("0"), text_of(20 + n % 40), F.lit("us"), F.when(F.col("c_acctbal") > 5000, ">50K").otherwise("<=50K")]
    return table(spark, d, "customer").select(F.concat_ws(", ", *values).alias("value"))


@_register(
    "scan_income",
    "SELECT (17 + c_custkey % 60)::INT AS age, CASE WHEN c_custkey % 7 <> 0 THEN 'w' || c_nationkey END AS workclass, c_custkey::INT AS fnlwgt, c_mktsegment AS education, CASE WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS sex, CASE WHEN c_acctbal > 5000 THEN '>50K' ELSE '<=50K' END AS income FROM customer",
)
def scan_income(spark, d):
    path = _folder(spark, "income")
    _income(spark, d).write.text(path)
    return readers.load(spark, "Adult Income", path).select("age", "workclass", "fnlwgt", "education", "sex", "income")


@_register(
    "prepared_income",
    """WITH r AS (SELECT c_custkey AS row_id, 17 + c_custkey % 60 AS age, (20 + c_custkey % 40)::DOUBLE AS hours, c_mktsegment, c_custkey % 2 AS s, c_acctbal FROM customer WHERE c_custkey % 7 <> 0), e AS (SELECT quantile_cont(hours, [0.25, 0.5, 0.75]) AS q FROM r)
SELECT row_id, CASE WHEN age > 25 AND age < 60 THEN 0 WHEN age >= 60 THEN 1 ELSE 2 END AS protected_age, ((hours >= q[1])::INT + (hours >= q[2])::INT + (hours >= q[3])::INT) AS "hours-per-week", (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INT AS education, (1 - s)::INT AS sex, (c_acctbal > 5000)::INT::DOUBLE AS target FROM r, e""",
)
def prepared_income(spark, d):
    path = _folder(spark, "income")
    _income(spark, d).write.text(path)
    raw = readers.load(spark, "Adult Income", path)
    data = prepare.prepare(raw.withColumn("key", F.col("fnlwgt").cast("long")), "Adult Income", ("age",), key="key").data
    return data.select("row_id", "protected_age", "hours-per-week", "education", "sex", "target")


@_register("scan_law", "SELECT p_size::DOUBLE AS lsat, p_retailprice AS ugpa, p_brand AS race1, 'g' || (p_size % 2) AS gender, (p_size % 2)::DOUBLE AS target FROM part")
def scan_law(spark, d):
    """Columns by name from a file with a header and further columns; the outcome renamed."""
    path, t = _folder(spark, "law"), table(spark, d, "part")
    others = {c: F.lit(1.5) for c in readers.LAW_COLUMNS}
    own = {"lsat": F.col("p_size"), "ugpa": F.col("p_retailprice"), "race1": F.col("p_brand"), "gender": F.concat(F.lit("g"), (F.col("p_size") % 2).cast("string")), "pass_bar": F.col("p_size") % 2}
    t.select(F.lit("x").alias("unused"), *(c.alias(n) for n, c in (others | own).items())).write.option("header", True).csv(path)
    return prepare.law_columns(readers.load(spark, "Law School Admission Bar Passage", path)).select("lsat", "ugpa", "race1", "gender", "target")


@_register("sink_append", "SELECT c_mktsegment, count(*) * 2 AS n, sum(c_custkey)::BIGINT * 2 AS total FROM customer GROUP BY c_mktsegment")
def sink_append(spark, d):
    rows, path = table(spark, d, "customer").select("c_custkey", "c_mktsegment"), _folder(spark, "append")
    for _ in range(2):
        sinks.append(rows, path, ["c_mktsegment"])
    return readers.parquet(spark, path).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("total"))


@_register("sink_append_once", "SELECT 'r' || (s.seed) AS run, o_orderpriority, count(*) AS n, sum(o_orderkey)::BIGINT AS total FROM orders, (SELECT unnest([1, 2]) AS seed) s GROUP BY s.seed, o_orderpriority")
def sink_append_once(spark, d):
    """Two runs, one of them after an attempt that was killed, each published twice: every row is there once for each run."""
    rows, path = table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), _folder(spark, "once")
    rows.where("o_orderkey % 2 = 0").write.parquet(f"{path}/_aside/r2")
    for run in ("r1", "r2", "r1", "r2"):
        sinks.append(rows, path, ["o_orderpriority"], run)
    return readers.parquet(spark, path).groupBy("run", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("total"))


@_register("sink_results", "SELECT 'metrics' AS what, p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_retailprice END AS x FROM part UNION ALL SELECT 'distributions', p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_retailprice ELSE 0.0 END FROM part")
def sink_results(spark, d):
    """Metrics keep what is missing, distributions have 0 for it."""
    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 3 != 0, F.col("p_retailprice")).alias("x"), F.lit("d").alias("dataset"), F.lit(7).alias("seed"))
    path = _folder(spark, "results")
    sinks.save_results(rows, rows, path)
    return readers.parquet(spark, f"{path}/metrics").select(F.lit("metrics").alias("what"), "p_partkey", "x").union(readers.parquet(spark, f"{path}/distributions").select(F.lit("distributions"), "p_partkey", "x"))


@_register("sink_formatted", "SELECT p_partkey, printf('%.4f', round_even(p_retailprice / 7, 4)) AS x, CASE WHEN p_size % 2 = 0 THEN printf('%.4f', round_even(p_retailprice / 3, 4)) END AS y FROM part")
def sink_formatted(spark, d):
    t = table(spark, d, "part")
    return sinks.formatted(t.select("p_partkey", (F.col("p_retailprice") / 7).alias("x"), F.when(F.col("p_size") % 2 == 0, F.col("p_retailprice") / 3).alias("y")))


@_register("sink_by_classifier", "SELECT event_type AS classification_algorithm, event_id, row_number() OVER (PARTITION BY event_type ORDER BY CASE WHEN event_id % 11 <> 0 THEN value END NULLS LAST, event_id) AS place FROM events WHERE event_id % 4 <> 0")
def sink_by_classifier(spark, d):
    """Rows of each classifier as they stand in its files, one set left out, missing values last."""
    t = table(spark, d, "events")
    rows = t.select(F.col("event_type").alias("classification_algorithm"), "event_id", F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("value"), F.col("event_id").alias("ordinal"), F.when(F.col("event_id") % 4 == 0, "Validation").otherwise("Test").alias("set"))
    path = _folder(spark, "classifiers")
    sinks.by_classifier(rows, path, without="Validation")
    read = readers.parquet(spark, path).select("classification_algorithm", "event_id", F.regexp_extract(F.col("_metadata.file_path"), r"part-(\d+)", 1).cast("long").alias("file"), F.col("_metadata.row_index").alias("row"))
    files = read.groupBy("classification_algorithm", "file").agg(F.count(F.lit(1)).alias("n"))
    before = files.alias("a").join(files.alias("b"), F.expr("a.classification_algorithm = b.classification_algorithm AND b.file < a.file"), "left").groupBy("a.classification_algorithm", "a.file").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    return read.join(before, ["classification_algorithm", "file"]).select("classification_algorithm", "event_id", (F.col("before") + F.col("row") + 1).alias("place"))


@_register(
    "sink_evolution",
    """SELECT 'race' AS attribute, 0 AS iteration, seed, user_id % 30 AS "Generation", 'g' || (user_id % 30) AS "Genotype", avg(value) + seed AS m_auc, max(value) AS m_aucmean
FROM events, (SELECT unnest([42, 43]) AS seed) s GROUP BY seed, user_id % 30""",
)
def sink_evolution(spark, d):
    """Histories of two seeds from events, a generation a row, as they come: in several partitions and any order."""
    path, generation = _folder(spark, "evolution"), F.col("user_id") % 30
    for seed in (42, 43):
        history = table(spark, d, "events").groupBy(generation.alias("Generation")).agg(F.concat(F.lit("g"), F.first(generation).cast("string")).alias("Genotype"), (F.avg("value") + seed).alias("m_auc"), F.max("value").alias("m_aucmean"))
        sinks.save_evolution(history, path, "race", seed)
    return readers.parquet(spark, path).select("attribute", "iteration", "seed", "Generation", "Genotype", "m_auc", "m_aucmean")


@_register("sink_backup", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def sink_backup(spark, d):
    return sinks.backup(table(spark, d, "nation"), _folder(spark, "backup"))


@_register("sink_delete", "SELECT TRUE AS there, FALSE AS again, r_regionkey, r_name FROM region WHERE r_regionkey >= 2")
def sink_delete(spark, d):
    """A table is deleted and written anew, by other rows: those of before are gone."""
    path, rows = _folder(spark, "gone"), table(spark, d, "region").select("r_regionkey", "r_name")
    sinks.append(rows, path)
    there, again = sinks.delete(spark, path), sinks.delete(spark, path)
    sinks.append(rows.where("r_regionkey >= 2"), path)
    return readers.parquet(spark, path).select(F.lit(there).alias("there"), F.lit(again).alias("again"), "r_regionkey", "r_name")


@_register("sink_aggregated_csv", "SELECT event_type AS metric, printf('%.4f', round_even(avg(value / 500), 4)) AS fairness_x, printf('%.4f', round_even(avg(value), 4)) AS performance_x FROM events GROUP BY event_type")
def sink_aggregated_csv(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("metric"), (F.col("value") / 500).alias("fairness_x"), F.col("value").alias("performance_x"))
    path = _folder(spark, "aggregated")
    sinks.export_csv(reduce.multi_seed_reduce(rows, ["metric"], decimals=None, means_only=True), path)
    return readers.csv(spark, path)


@_register("column_replaced_in_place", "SELECT p_partkey, upper(p_name) AS p_name, p_size * 2 AS twice FROM part")
def column_replaced_in_place(spark, d):
    t = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    return encode.set_feature(encode.set_feature(t, "p_name", F.upper("p_name")), "twice", F.col("p_size") * 2).drop("p_size")


@_register("flat_genotypes", "SELECT user_id, array_to_string(list((event_id % 3)::VARCHAR || (event_id % 4)::VARCHAR ORDER BY event_id), '') AS genotype FROM events GROUP BY user_id")
def flat_genotypes(spark, d):
    genes = F.transform(F.array_sort(F.collect_list("event_id")), lambda e: F.struct((e % 3).alias("group"), (e % 4).alias("algorithm")))
    return table(spark, d, "events").groupBy("user_id").agg(genes.alias("genes")).select("user_id", scalar.flat_genotype("genes").alias("genotype"))


@_register("set_exclusion", "SELECT event_id FROM events WHERE event_type IS DISTINCT FROM 'view'")
def set_exclusion(spark, d):
    return report.without_set(table(spark, d, "events").withColumnRenamed("event_type", "set"), "view").select("event_id")


@_register("bag_append", "WITH v AS (SELECT CASE WHEN lang = 'de' THEN 1 ELSE 0 END AS s FROM labels JOIN documents USING (doc_id)) SELECT count(*) + abs(sum(s) - sum(1 - s))::BIGINT AS n, count(*) AS own FROM v")
def bag_append(spark, d):
    """Rows and the drawn ones after them: as many more as the groups differ by."""
    rows = documents_view(spark, d).select("id", (F.col("g") == "de").cast("int").alias("s"), "y")
    return corrections.reweigh_and_append(rows, "s", "id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("some")).select("n", F.lit(rows.count()).alias("own"))


@_register("text_helpers", "SELECT n_nationkey, upper(n_name) AS name, chr(27) || '[1m' || n_name || chr(27) || '[0m' AS bold FROM nation")
def text_helpers(spark, d):
    """Names of files and emphasis, row by row."""
    path = F.concat(F.lit("a/b/"), F.col("n_name"), F.lit(".csv.gz"))
    return table(spark, d, "nation").select("n_nationkey", text.names_of(path).alias("name"), text.bolds(F.col("n_name")).alias("bold"))


_INI = """[global]
dataset_configs = "d.cfg"
algorithms_configs = a.cfg
results_path = results
seed = 42
num_runs = 3
num_iterations_algorithms = 2
[surrogate_classifiers]
logistic_regression = True
svm = True
gaussian_nb = False
[credit]
name = German Credit
target = class
protected_attributes = Attribute9, Attribute13
train_size = 0.8
validation_size = 0.1
test_size = 0.1
[Repair]
repair_level = 0.5
[FeatureSearch]
population_size = 11
num_generations = 5
tournament_size = 2
probability_crossover = 0.9
probability_mutation = 0.05
n_splits = 3
min_feature_prob = 0.1
max_feature_prob = 0.5
[SequenceSearch]
population_size = 30
num_generations = 7
tournament_size = 3
elite_size = 3
probability_crossover = 0.9
probability_mutation = 0.05
threshold_k = 8
[Pool]
algorithm_1 = MSG
algorithm_2 = DIR
"""


@_register(
    "settings",
    "SELECT * FROM (VALUES ('runs', '3'), ('iterations', '2'), ('surrogates', 'logistic_regression,rbf_svc'), ('datasets', 'd.cfg'), ('protected', 'Attribute9,Attribute13'), ('train', '0.8'), ('repair', '0.5'), ('masks', '11'), ('sequences', '7'), ('pool', 'massaging,repair')) t(name, value)",
)
def settings(spark, d):
    """Settings of a run, a dataset and the corrections, as an INI file has them."""
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "c.cfg")
        with open(path, "w") as out:
            out.write(_INI)
        run, own = config.run_config(path), config.dataset_config(path, "German Credit")
        plan = config.plan(path, run.seed, run.surrogates)
    rows = {"runs": run.runs, "iterations": run.iterations, "surrogates": ",".join(plan.surrogates), "datasets": run.datasets, "protected": ",".join(own.protected), "train": own.train, "repair": plan.repair_level, "masks": plan.features.size, "sequences": plan.sequences.generations, "pool": ",".join(plan.pool)}
    return spark.createDataFrame([(k, str(v)) for k, v in rows.items()], "name string, value string")


@_register(
    "streaming_windows",
    "SELECT date_trunc('day', ts) AS day, event_type AS g, count(*) AS n, sum((value > 50)::INT)::BIGINT AS pp, sum((user_id % 2)::INT)::BIGINT AS pos FROM events GROUP BY date_trunc('day', ts), event_type",
)
def streaming_windows(spark, d):
    """Counts by day and group of events read as a stream to its end."""
    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")
    rows = stream.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("g"), (F.col("user_id") % 2).cast("int").alias("y"), (F.col("value") > 50).cast("int").alias("p"))
    name = f"windows_{uuid.uuid4().hex}"
    query = windowed_counts(rows, "ts", "g", "1 day", "1 day").writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    return checkpointed(spark.table(name).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "g", "n", "pp", "pos"))
