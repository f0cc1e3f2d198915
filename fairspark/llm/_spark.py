"""Shared-folder tables and other helpers of the operators in this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local master may do without, with a temporary one of its session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="fairspark-")
    return "file://" + _OWN[app]


#: Spark's own setting: shuffle files go when the query that wrote them ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts lineage, survives lost executors.

    The shuffle files behind it go with the write, as nothing after it can need them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what ``materialise`` wrote, once nothing needs it any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._shared_path)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Keys that a heavy key is dealt over, and what is heavy: more rows than MANY, and than one in SHARE of all.
SALTS, MANY, SHARE = 64, 1000, 10_000


def spread_join(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, spread: F.Column) -> DataFrame:
    """rows with the columns of groups (but ``size``) by key, nulls where there is none; a sort-merge join at every size.

    groups has one row a key, and in ``size`` how many of the ``total`` rows have it.  Keys of very many rows, of which there
    are at most SHARE (so that they may be broadcast), are dealt over SALTS keys by ``spread``, a hash of what tells rows apart.
    """
    many = max(MANY, total // SHARE)
    heavy, salt = fresh(rows.join(groups, key), "_heavy", "_salt")
    large = F.broadcast(groups.where(F.col(size) > many).select(F.col(key).alias(heavy)))
    dealt = rows.join(large, F.col(key) == F.col(heavy), "left")
    dealt = dealt.withColumn(salt, F.when(F.col(heavy).isNotNull(), F.pmod(spread, F.lit(SALTS)).cast("int")).otherwise(0)).drop(heavy)
    salts = F.when(F.col(size) > many, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(groups.withColumn(salt, F.explode(salts)).drop(size).hint("merge"), [key, salt], "left").drop(salt)


def words(text) -> F.Column:
    """Array of the maximal runs of characters other than space and 0x09-0x0D; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def map_rows(df: DataFrame, function, like: DataFrame) -> DataFrame:
    """mapInArrow with the columns of ``like`` as result; names of columns may hold dots and spaces."""
    plain = lambda names: [c if re.fullmatch(r"\w+", c) else f"_column{i}_" for i, c in enumerate(names)]
    fields = [T.StructField(n, f.dataType, True) for n, f in zip(plain(like.columns), like.schema.fields, strict=True)]
    return df.toDF(*plain(df.columns)).mapInArrow(function, T.StructType(fields)).toDF(*like.columns)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that df hasn't."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def keyed(df: DataFrame, id_column: str, *columns: str) -> DataFrame:
    """``key`` (a long of its own for each row), the id and the columns.

    Whole-number ids that are there and differ are the keys.  Otherwise rows are numbered, and written down, as the numbers
    depend on the run.
    """
    kept = [id_column, *columns]
    if isinstance(df.schema[id_column].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        rows, ids = df.agg(F.count(F.lit(1)), F.count_distinct(id_column)).first()
        if rows == ids:
            return df.select(F.col(id_column).cast("long").alias("key"), *kept)
    return materialise(df.select(F.monotonically_increasing_id().alias("key"), *kept), "keyed")


def placed(df: DataFrame, order: list, keep: list[str], name: str) -> DataFrame:
    """The ``keep`` columns and ``place``, the row's place (from 0) in the order; written to the shared folder.

    Rows are dealt by sampled ranges of the whole order, so that one value of very many rows is no single task's; places are
    those within a range after the rows of the ranges before, of which there are as many as shuffle partitions.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    written = materialise(ordered.select(*keep, F.monotonically_increasing_id().alias("place")), name)
    part = F.shiftright("place", 33)
    sizes = written.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = F.broadcast(sizes.select("part", (before - F.shiftleft("part", 33)).alias("shift")))  # a row a partition
    return written.join(sizes, part == F.col("part")).select(*keep, (F.col("place") + F.col("shift")).alias("place"))
