from __future__ import annotations

import os
import sys

import pandas as pd
import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{shared}").config("spark.ui.showConsoleProgress", "false").config("spark.sql.warehouse.dir", str(shared / "warehouse")).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return connection


def _value(x):
    if pd.isna(x) is True or x is None:
        return None
    if isinstance(x, bool):
        return x
    if type(x).__name__.startswith(("float", "Decimal")):
        return round(float(x), 6) + 0.0
    if type(x).__name__.startswith(("int", "uint")):
        return int(x)
    return bool(x) if type(x).__name__ == "bool_" else x


def rows_of(frame):
    """Rows as sorted tuples, columns by name, floats to six places."""
    columns = sorted(frame.columns)
    rows = [tuple(_value(x) for x in row) for row in frame[columns].astype(object).itertuples(index=False)]
    return columns, sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])


@pytest.fixture(scope="session")
def same(spark, duck):
    """Compares a query with its SQL on sf0.01."""

    def compare(query, sql):
        ours, theirs = rows_of(query(spark, SF).toPandas()), rows_of(duck.execute(sql).df())
        assert ours[0] == theirs[0]
        assert len(ours[1]) == len(theirs[1])
        assert ours[1] == theirs[1]

    return compare
