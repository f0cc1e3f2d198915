"""Nearest neighbours against brute force: repeated rows, several lengths, clashing columns, recall on the provided table."""

from __future__ import annotations

import numpy as np
from conftest import SF
from pyspark.sql import functions as F

from fairspark.llm import ann, queries


def brute(rows, k=10):
    """(query_id, [(vec_id, score)]) by the docstring's rules, of rows (vec_id, vector)."""
    good = [(i, tuple(np.asarray(v, np.float32).astype(float))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q in sorted({i for i, _ in good if i % 100 == 0}):
        own = min((v for i, v in good if i == q), key=lambda v: (len(v), v))
        near = sorted((float(np.sqrt(((np.array(v) - own) ** 2).sum())), i) for i, v in good if i != q and len(v) == len(own))[:k]
        out[q] = [(i, s) for s, i in near]
    return out


def test_repeated_rows_lengths_and_names(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), rng.normal(size=6).tolist()) for i in range(1, 60)]
    rows += [(100, [1.0] * 6), (100, [1.0] * 6), (100, [0.5] * 6), (6, rows[5][1]), (6, rows[5][1]), (6, [0.9] * 6), (200, [1.0, 2.0]), (201, [1.0, 2.5]), (200, rows[3][1]), (300, [3.0] * 4), (7, [1.0] * 6), (8, [1.0] * 6)]
    rows += [(None, [1.0] * 6), (61, None), (62, [0.0] * 6), (63, [None, 1.0, 1.0, 1.0, 1.0, 1.0]), (400, [float("inf")] * 6), (500, [])]
    clash = "v int, n int, row string, copy int, block int, `group` int, rank int, score double, query_id long, q int, x int"
    table = spark.createDataFrame([(i, v, *([1, 2, "r", 3, 4, 5, 6, 0.5, 7, 8, 9])) for i, v in rows], f"vec_id long, embedding array<float>, {clash}")
    found = ann.nearest(table, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    expected = brute(rows)
    assert set(expected) == {100, 200, 300}
    for q, near in expected.items():
        assert [(r.vec_id, round(r.score, 9)) for r in found if r.query_id == q] == [(i, round(s, 9)) for i, s in near], q
        assert [r["rank"] for r in found if r.query_id == q] == list(range(1, len(near) + 1))


def test_many_copies_of_the_query(spark):
    """Rows that repeat the query's own id and vector take no place from others."""
    rows = [(100, [1.0, 1.0])] * 40 + [(i, [1.0, 1.0]) for i in (3, 4)] + [(5, [1.0, 2.0])] * 3
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(3, 0.0), (4, 0.0), (5, 1.0), (5, 1.0), (5, 1.0)]


def test_recall_on_the_provided_table(spark):
    table = spark.read.parquet(SF.replace("sf0.01", "sf0.1") + "/embeddings.parquet").select("vec_id", "embedding").collect()
    expected = brute([(r.vec_id, r.embedding) for r in table])
    found = queries.op8_ann(spark, SF.replace("sf0.01", "sf0.1")).collect()
    assert len(found) == sum(map(len, expected.values()))
    hits = sum(len({i for i, _ in near} & {r.vec_id for r in found if r.query_id == q}) for q, near in expected.items())
    assert hits >= 0.9 * len(found)
