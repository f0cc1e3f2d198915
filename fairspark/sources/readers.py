"""Readers with declared schemas; nothing is inferred and nothing comes from a network."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fairspark.operators.reduce import first_or_last

#: Fixed by the public datasets: names in order, numeric ones marked.
CREDIT_NUMERIC = (2, 5, 8, 11, 13, 16, 18)
CREDIT_SCHEMA = T.StructType([T.StructField(f"Attribute{i}", T.IntegerType() if i in CREDIT_NUMERIC else T.StringType()) for i in range(1, 21)] + [T.StructField("class", T.IntegerType())])
INCOME_COLUMNS = (
    ("age", "int"), ("workclass", "string"), ("fnlwgt", "int"), ("education", "string"), ("education-num", "int"), ("marital-status", "string"), ("occupation", "string"), ("relationship", "string"),
    ("race", "string"), ("sex", "string"), ("capital-gain", "int"), ("capital-loss", "int"), ("hours-per-week", "int"), ("native-country", "string"), ("income", "string"),
)
INCOME_SCHEMA = ", ".join(f"`{n}` {t}" for n, t in INCOME_COLUMNS)
LAW_COLUMNS = ("decile1b", "decile3", "lsat", "ugpa", "zgpa", "zfygpa", "fulltime", "fam_inc", "gender", "race1", "tier", "pass_bar")


def credit(spark: SparkSession, path: str) -> DataFrame:
    """The German credit text: separated by spaces, without a header."""
    return spark.read.schema(CREDIT_SCHEMA).option("sep", " ").csv(path)


def income(spark: SparkSession, path: str) -> DataFrame:
    """The Adult income text: commas, spaces after them, ? for what is missing."""
    return spark.read.schema(INCOME_SCHEMA).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("nullValue", "?").csv(path)


def law_school(spark: SparkSession, path: str) -> DataFrame:
    """The law school file with a header, twelve of its columns."""
    raw = spark.read.option("header", True).csv(path)
    text = ("gender", "race1")
    return raw.select(*(F.col(c) if c in text else F.col(c).cast("double").alias(c) for c in LAW_COLUMNS))


LOADERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"German Credit": credit, "Adult Income": income, "Law School Admission Bar Passage": law_school}


def load(spark: SparkSession, name: str, path: str) -> DataFrame:
    if name not in LOADERS:
        raise NotImplementedError(f"no such dataset: {name}")
    return LOADERS[name](spark, path)


def csv(spark: SparkSession, path: str | list[str], schema: str | T.StructType | None = None, header: bool = True) -> DataFrame:
    reader = spark.read.option("header", header)
    return (reader.schema(schema) if schema else reader).csv(path)


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def with_seed(df: DataFrame, pattern: str = r"seed_(\d+)", seed: str = "seed") -> DataFrame:
    """The seed in each row's file name."""
    return df.withColumn(seed, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).cast("long"))


def existing(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The paths that are there, by Hadoop's file systems."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return [p for p in paths if path(p).getFileSystem(hadoop).exists(path(p))]


def seeds(spark: SparkSession, pattern: str, first: int, count: int, header: bool = True, schema: str | T.StructType | None = None) -> DataFrame:
    """One read of the files of seeds first..first+count-1 that exist; ``{seed}`` stands for the seed in the pattern."""
    found = existing(spark, [pattern.format(seed=s) for s in range(first, first + count)])
    if not found:
        raise FileNotFoundError(pattern)
    return with_seed(csv(spark, found, schema, header), _seed_in(pattern))


def _seed_in(pattern: str) -> str:
    """What finds the seed in a file's URI, where names that aren't plain are encoded."""
    before, after = (re.escape(x).replace(r"\ ", "(?: |%20)") for x in pattern.rsplit("/", 1)[-1].split("{seed}"))
    return before + r"(\d+)" if before else r"(\d+)" + after + "$"


def numbered(files: DataFrame, by: Sequence[str] = (), ordinal: str = "ordinal") -> DataFrame:
    """Adds the place (from 0) of each row in its file, or in all files of a value of ``by``, which follow one another by name.

    files comes straight from a reader.  Files are read in splits, however large they are: a split's rows are counted, and a
    row's place is that in its split after the rows of the splits before.
    """
    names = {"_split_file": "file_path", "_split_start": "file_block_start"}
    rows = files.withColumns({k: F.col(f"_metadata.{v}") for k, v in names.items()} | {"_split_id": F.monotonically_increasing_id()})
    within = Window.partitionBy(*(by or ["_split_file"])).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    splits = rows.groupBy(*by, *names).agg(F.min("_split_id").alias("_first"), F.count(F.lit(1)).alias("_in")).withColumn("_before", F.coalesce(F.sum("_in").over(within), F.lit(0)))
    splits = splits.select(*(F.col(k).alias(f"_of{k}") for k in names), "_first", "_before")
    joined = rows.join(splits, (F.col("_split_file") == F.col("_of_split_file")) & (F.col("_split_start") == F.col("_of_split_start")))
    return joined.withColumn(ordinal, F.col("_split_id") - F.col("_first") + F.col("_before")).drop(*names, "_split_id", *(f"_of{k}" for k in names), "_first", "_before")


def seeds_ends(spark: SparkSession, pattern: str, first: int, count: int, head: int | None = None, tail: int | None = None, schema: str | T.StructType | None = None, multiline: bool = False) -> DataFrame:
    """``seeds`` with the place of each row in its file (``ordinal``), and of each file only the first and last rows, if asked for.

    With a schema all files are one read, in splits of any file (``multiline``: whole files, as values may hold line ends).
    Without, each file's header says its columns, so that each is read by itself, and whole.
    """
    if schema is not None:
        found = existing(spark, [pattern.format(seed=s) for s in range(first, first + count)])
        if not found:
            raise FileNotFoundError(pattern)
        rows = with_seed(spark.read.option("header", True).option("multiLine", multiline).schema(schema).csv(found), _seed_in(pattern))
        return first_or_last(numbered(rows, ["seed"]), "seed", "ordinal", head, tail)
    parts = []
    for s in range(first, first + count):
        parts += [(s, p) for p in existing(spark, [pattern.format(seed=s)])]
    if not parts:
        raise FileNotFoundError(pattern)
    out = None
    for s, p in parts:
        own = spark.read.option("header", True).option("multiLine", True).csv(p).withColumn("ordinal", F.monotonically_increasing_id()).withColumn("seed", F.lit(s).cast("long"))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return first_or_last(out, "seed", "ordinal", head, tail)


def per_algorithm(spark: SparkSession, pattern: str, algorithms: Sequence[str], first: int, count: int, iteration: str = "num_iterations", keeper: str = "Massaging") -> DataFrame:
    """Files of each (algorithm, seed); a seed that lacks any algorithm's file goes; baseline rows stay with one algorithm only."""
    parts = []
    for s in range(first, first + count):
        paths = {a: pattern.format(algorithm=a, seed=s) for a in algorithms}
        if len(existing(spark, list(paths.values()))) == len(paths):
            parts += [(a, s, p) for a, p in paths.items()]
    if not parts:
        raise FileNotFoundError(pattern)
    out = None
    for a in algorithms:
        own = csv(spark, [p for x, _, p in parts if x == a])
        own = own.where((F.lit(a) == keeper) | (F.col(iteration).cast("int") != 0))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def two_iterations(spark: SparkSession, first: str, second: str, ordinal: str = "part") -> DataFrame:
    """The rows of the first file and then those of the second."""
    a, b = (csv(spark, p).withColumn(ordinal, F.lit(i)) for i, p in enumerate((first, second), 1))
    return a.unionByName(b, allowMissingColumns=True)


def try_load(spark: SparkSession, name: str, *paths: str) -> DataFrame:
    """The first of several places that can be read."""
    for i, path in enumerate(paths):
        try:
            return load(spark, name, path)
        except AnalysisException:
            if i == len(paths) - 1:
                raise
    raise FileNotFoundError(name)
