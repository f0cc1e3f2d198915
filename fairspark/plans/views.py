"""Scored views of the provided tables: a protected group g, a true outcome y, a prediction p, a feature f and a unique key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents by language; quality against length.  Texts aren't read."""
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    joined = labels.join(docs.select("doc_id", "lang", "n_chars"), "doc_id")
    return joined.select(F.col("doc_id").alias("id"), F.col("lang").alias("g"), F.col("quality").alias("y"), (F.col("n_chars") > 500).cast("int").alias("p"), F.col("n_chars").cast("double").alias("x"), "toxic", "n_chars", F.col("doc_id").alias("key"), F.floor(F.col("n_chars") / 500).cast("int").alias("f"))


def lineitem_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    return t.select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("g"), (F.col("l_linestatus") == "F").cast("int").alias("y"), (F.col("l_discount") >= 0.05).cast("int").alias("p"), F.col("l_quantity").alias("x"), (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 32768 + F.col("l_partkey") % 32768) * 64 + F.col("l_suppkey") % 64).alias("key"), F.col("l_quantity").cast("int").alias("f"))


def orders_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = (table(spark, sf_dir, t) for t in ("orders", "customer"))
    joined = orders.join(customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return joined.select(F.col("o_orderkey").alias("id"), F.col("c_mktsegment").alias("g"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), (F.col("o_totalprice") > 150000).cast("int").alias("p"), F.col("o_totalprice").alias("x"), F.col("o_orderkey").alias("key"), F.floor(F.col("o_totalprice") / 20000).cast("int").alias("f"))


def events_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as results: seed, metric, value, an ordinal."""
    t = table(spark, sf_dir, "events")
    return t.select((F.col("user_id") % 30).alias("seed"), F.col("event_type").alias("metric"), F.col("value").alias("x"), F.col("event_id").alias("ordinal"), "user_id")


VIEWS = {"documents": documents_view, "lineitem": lineitem_view, "orders": orders_view}

#: The same views as SQL.
VIEW_SQL = {
    "documents": "SELECT d.doc_id AS id, d.lang AS g, l.quality AS y, CASE WHEN d.n_chars > 500 THEN 1 ELSE 0 END AS p, CAST(d.n_chars AS DOUBLE) AS x, l.toxic, d.n_chars, d.doc_id AS key, CAST(floor(d.n_chars / 500.0e0) AS INT) AS f FROM labels l JOIN documents d ON l.doc_id = d.doc_id",
    "lineitem": "SELECT l_orderkey AS id, l_returnflag AS g, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS y, CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END AS p, l_quantity AS x, ((l_orderkey * 10 + l_linenumber) * 32768 + l_partkey % 32768) * 64 + l_suppkey % 64 AS key, CAST(l_quantity AS INT) AS f FROM lineitem",
    "orders": "SELECT o_orderkey AS id, c_mktsegment AS g, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END AS p, o_totalprice AS x, o_orderkey AS key, CAST(floor(o_totalprice / 20000.0e0) AS INT) AS f FROM orders JOIN customer ON o_custkey = c_custkey",
    "events": "SELECT user_id % 30 AS seed, event_type AS metric, value AS x, event_id AS ordinal, user_id FROM events",
}
