"""Nearest neighbours by score-aware quantisation, four-bit table scans and exact reranking.

1.  Codebooks.  With p the nearest of some places and y = x - p, half the squared distance is
    |q - p|^2 / 2 + |y|^2 / 2 - (q - p).y: an inner product to be maximised, and terms that are kept exactly.  y, by the
    scale of its place (so that dense clusters keep their detail), is cut into subspaces of two components with 16
    centres each (four bits).  Where q is near x, what quantising does to the inner product comes from the residual
    parallel to y; the loss |r_orthogonal|^2 + eta |r_parallel|^2 with eta = (d - 1) t^2 / (1 - t^2) is lowered in turn
    by codes (coordinate descent over subspaces) and centres (one linear system).  They are fitted on a bounded sample
    (``sample`` vectors on average, chosen by a hash of vec_id); every vector is encoded.
2.  Scan.  Codes are packed two a byte, some thousands of vectors a row.  Queries come in large bounded blocks, and each
    block meets each group of packed rows in a task of its own; a task sums table entries and returns the ``candidates``
    best of each query.  Codes (a byte for four components, and 22 bytes) are copied once a block of 16,384 queries, vectors never.
    No place is skipped: with vectors that spread evenly, probing the nearest half of them lost a tenth of the neighbours.
3.  Reranking.  The best candidates of all groups are joined to the vectors by a row key and ordered by exact distance.

Defined cases: vectors that are null or zero, or that hold null or non-finite components take no part, as queries or
candidates, nor do rows without vec_id; vectors are compared with those of their own length; ties go to the smaller
vec_id; a query with fewer candidates than k has them all; rows that repeat a vec_id are candidates each, but never of
their own id, and make one query, of their shortest and smallest vector; an empty table gives an empty result; further columns are not
read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairspark.llm._spark import materialise

SAMPLE, THRESHOLD = 10_000, 0.2
#: Places; vectors of a packed row, packed rows of a group, queries of a block.
PLACES, PACKED, GROUP, BLOCK = 64, 4096, 64, 1 << 14


class Codebooks(NamedTuple):
    """centres: subspaces x 16 x 2; eta: weight of the parallel residual; places and their scales."""

    centres: np.ndarray
    eta: float
    places: np.ndarray
    scales: np.ndarray

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest place of each vector, and what is left by its scale."""
        at = ((self.places**2).sum(1) / 2 - x @ self.places.T).argmin(1)
        return at, (x - self.places[at]) / self.scales[at][:, None]

    def decode(self, codes: np.ndarray, d: int) -> np.ndarray:
        return self.centres[np.arange(len(self.centres)), codes].reshape(len(codes), -1)[:, :d]

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of each query with what a byte of code stands for: queries x bytes x 256."""
        m = len(self.centres)
        padded = np.zeros((len(queries), 2 * m), np.float32)
        padded[:, : queries.shape[1]] = queries
        single = np.einsum("qmd,mkd->qmk", padded.reshape(-1, m, 2), self.centres).astype(np.float32)
        return (single[:, 0::2, None, :] + single[:, 1::2, :, None]).reshape(len(queries), m // 2, 256)


def _split(x: np.ndarray) -> np.ndarray:
    """vectors x subspaces x 2, subspaces even in number."""
    m = -(-x.shape[1] // 4) * 2
    out = np.zeros((len(x), 2 * m))
    out[:, : x.shape[1]] = x
    return out.reshape(len(x), m, 2)


def encode(x: np.ndarray, centres: np.ndarray, eta: float, passes: int = 2) -> np.ndarray:
    """The codes (vectors x subspaces) of least anisotropic loss, by coordinate descent from the nearest centres."""
    parts = _split(x)
    norm = np.maximum((parts**2).sum((1, 2)), 1e-30)
    n, m, _ = parts.shape
    square = np.empty((n, m, 16))
    along = np.empty((n, m, 16))
    for s in range(m):
        residual = parts[:, s, None, :] - centres[s]
        square[:, s] = (residual**2).sum(2)
        along[:, s] = (residual * parts[:, s, None, :]).sum(2)
    codes = square.argmin(2)
    rows = np.arange(n)
    total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
    weight = ((eta - 1) / norm)[:, None]
    for _ in range(passes):
        for s in range(m):
            rest = total - along[rows, s, codes[:, s]]
            codes[:, s] = (square[:, s] + weight * (rest[:, None] + along[:, s]) ** 2).argmin(1)
            total = rest + along[rows, s, codes[:, s]]
    return codes.astype(np.uint8)


def fit(x: np.ndarray, threshold: float = THRESHOLD, rounds: int = 4, places: int = PLACES, seed: int = 5) -> Codebooks:
    """Codebooks for the rows of x."""
    rng = np.random.default_rng(seed)
    middle = x[rng.choice(len(x), max(1, min(places, len(x) // 20)), replace=False)]
    for _ in range(10):
        at = ((middle**2).sum(1) / 2 - x @ middle.T).argmin(1)
        count = np.bincount(at, minlength=len(middle))
        sums = np.zeros_like(middle)
        np.add.at(sums, at, x)
        middle = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], middle)
    at = ((middle**2).sum(1) / 2 - x @ middle.T).argmin(1)
    spread = np.bincount(at, ((x - middle[at]) ** 2).sum(1), len(middle)) / np.maximum(np.bincount(at, minlength=len(middle)), 1)
    scales = np.sqrt(np.maximum(spread, 1e-12))
    x = (x - middle[at]) / scales[at][:, None]
    parts = _split(x)
    n, m, _ = parts.shape
    eta = max(1.0, (x.shape[1] - 1) * threshold**2 / (1 - threshold**2))
    centres = np.stack([parts[rng.choice(n, 16, replace=n < 16), s] for s in range(m)])
    for _ in range(8):  # plain k-means to begin with
        for s in range(m):
            code = ((parts[:, s, None, :] - centres[s]) ** 2).sum(2).argmin(1)
            count = np.bincount(code, minlength=16)
            sums = np.stack([np.bincount(code, parts[:, s, d], 16) for d in range(2)], 1)
            centres[s] = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres[s])
    unit = parts / np.sqrt(np.maximum((parts**2).sum((1, 2)), 1e-30))[:, None, None]
    for _ in range(rounds):
        codes = encode(x, centres, eta).astype(np.int64)
        flat = codes + 16 * np.arange(m)
        # Normal equations over all centres: counts + (eta - 1) P'P, where P has each unit vector's parts at its codes.
        a = np.zeros((32 * m, 32 * m))
        for at in range(0, n, 2048):
            own = flat[at : at + 2048]
            p = np.zeros((len(own), 16 * m, 2))
            p[np.arange(len(own))[:, None], own] = unit[at : at + 2048]
            p = p.reshape(len(own), -1)
            a += p.T @ p
        count = np.bincount(flat.ravel(), minlength=16 * m)
        a = (eta - 1) * a + np.diag(np.repeat(count, 2).astype(float) + 1e-6)
        sums = np.stack([np.bincount(flat.ravel(), parts[:, :, d].ravel(), 16 * m) for d in range(2)], 1)
        solved = np.linalg.solve(a, eta * sums.ravel()).reshape(m, 16, 2)
        centres = np.where((count > 0).reshape(m, 16, 1), solved, centres)
    return Codebooks(centres, eta, middle, scales)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v: array of double, n: how many rows are equal in both) of the rows that take part."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", good) & F.exists("v", lambda x: x != 0))
    return rows.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("n"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _packed(batches: Iterator[pa.RecordBatch], books) -> Iterator[pa.RecordBatch]:
    """Rows of vec_id, row and v, encoded, some thousands in a packed row; part: its first row."""
    b = books.value
    for batch in batches:
        for at in range(0, batch.num_rows, PACKED):
            own = batch.slice(at, PACKED)
            ids, rows, x = own.column(0).to_numpy(), own.column(1).to_numpy(), _matrix(own.column(2))
            places, y = b.place(x)
            codes = encode(y, b.centres, b.eta)
            pairs = codes[:, 0::2] | codes[:, 1::2] << 4
            scale = b.scales[places]
            kept = ((y * y).sum(1) * scale**2 / 2 + (b.decode(codes, x.shape[1]) * b.places[places]).sum(1) * scale).astype("<f4")
            columns = (ids.astype("<i8"), rows.astype("<i8"), kept, places.astype("<u2"), pairs)
            yield pa.RecordBatch.from_arrays([pa.array([int(rows[0])], pa.int64()), *(pa.array([c.tobytes()], pa.binary()) for c in columns)], ["part", "ids", "rows", "kept", "places", "codes"])


def _scan(queries: pa.Table, packed: pa.Table, books, candidates: int) -> pa.Table:
    """The best candidates of each query of a block among the packed rows of a group."""
    found: list[list[np.ndarray]] = [[], [], []]
    if queries.num_rows and packed.num_rows:
        names = (("ids", "<i8"), ("rows", "<i8"), ("kept", "<f4"), ("places", "<u2"), ("codes", np.uint8))
        ids, rows, kept, places, codes = (np.concatenate([np.frombuffer(b, t) for b in packed.column(c).to_pylist()]) for c, t in names)
        order = np.lexsort((rows, ids))
        ids, rows, kept, places, codes = ids[order], rows[order], kept[order], places[order], np.ascontiguousarray(codes.reshape(len(ids), -1)[order].T)
        own, x = queries.column("query_id").to_numpy(), _matrix(queries.column("v").combine_chunks())
        b = books.value
        scale = b.scales[places].astype(np.float32)
        for at in range(0, len(own), 64):
            far = ((x[at : at + 64, None, :] - b.places[None]) ** 2).sum(2) / 2
            for query, table, half in zip(own[at : at + 64], b.tables(x[at : at + 64]), far.astype(np.float32), strict=True):
                score = np.zeros(len(ids), np.float32)
                for k in range(len(codes)):
                    score -= table[k][codes[k]]
                score = score * scale + kept + half[places]
                score[ids == query] = np.inf
                most = min(candidates, len(score))
                limit = np.partition(score, most - 1)[most - 1]
                best = np.flatnonzero(score < limit)
                best = np.concatenate([best, np.flatnonzero(score == limit)[: most - len(best)]])  # ties: smaller ids
                best = best[score[best] < np.inf]
                found[0].append(np.full(len(best), query))
                found[1].append(rows[best])
                found[2].append(score[best])
    columns = [np.concatenate(f) if f else np.empty(0) for f in found]
    return pa.table({"query_id": pa.array(columns[0].astype(np.int64)), "row": pa.array(columns[1].astype(np.int64)), "near": pa.array(columns[2].astype(np.float32))})


_RESULT = "query_id long, rank int, vec_id long, score double"


def _of_one_length(rows: DataFrame, queries: DataFrame, k: int, candidates: int, sample: int) -> DataFrame | None:
    """The result for rows (vec_id, v, n, row) and queries (query_id, v), all of one length; None without queries."""
    spark = rows.sparkSession
    n, n_queries = rows.count(), queries.count()
    if not n_queries:
        return None
    parts = 1 << 30
    chosen = rows if n <= sample else rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) < int(parts * sample / n))
    drawn = chosen.select("vec_id", "v").toPandas().sort_values("vec_id", kind="stable")  # bounded by sample
    if not len(drawn):
        drawn = rows.select("vec_id", "v").limit(1).toPandas()
    books = spark.sparkContext.broadcast(fit(np.stack(drawn["v"].to_numpy())))
    # Of equal vectors only the k + 1 of smallest vec_id can be among k nearest; Spark limits them before its shuffle.
    equal = Window.partitionBy("v").orderBy("vec_id")
    scanned = materialise(rows.withColumn("copy", F.row_number().over(equal)).where(F.col("copy") <= k + 1).drop("copy"), "scanned")
    packed = scanned.select("vec_id", "row", "v").mapInArrow(partial(_packed, books=books), "part long, ids binary, rows binary, kept binary, places binary, codes binary")
    blocks, groups = -(-n_queries // BLOCK), max(1, -(-n // (PACKED * GROUP)))
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    packed = packed.withColumn("group", F.pmod(F.xxhash64("part"), F.lit(groups)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    keys = ["block", "group"]
    met = dealt.groupBy(*keys).cogroup(packed.groupBy(*keys)).applyInArrow(lambda q, p: _scan(q, p, books, candidates), "query_id long, row long, near float")
    best = Window.partitionBy("query_id").orderBy("near", "row")
    met = met.withColumn("best", F.row_number().over(best)).where(F.col("best") <= candidates).select("query_id", "row")
    met = met.join(scanned.select("row", "vec_id", "n", F.col("v").alias("x")), "row").join(queries.withColumnRenamed("v", "q"), "query_id")
    distance = F.sqrt(F.aggregate(F.zip_with("x", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))
    # Rows that are equal in vec_id and vector are ranked each, as many as can be among the k nearest.
    exact = met.select("query_id", "vec_id", distance.alias("score"), F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int"))).alias("again"))
    ranked = exact.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, candidates: int = 300, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance) of the k nearest of each query.

    is_query: a condition on vec_id; candidates: how many are reranked for each query.
    """
    rows = materialise(usable(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")
    lengths = [r.d for r in rows.select(F.size("v").alias("d")).distinct().orderBy("d").collect()]  # one, in a table of one model
    queries = rows.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct(F.size("v").alias("d"), "v")).alias("s")).select("query_id", "s.v")
    found = [_of_one_length(*(x.where(F.size("v") == d) if len(lengths) > 1 else x for x in (rows, queries)), k, candidates, sample) for d in lengths]
    found = [x for x in found if x is not None]
    if not found:
        return vectors.sparkSession.createDataFrame([], _RESULT)
    out = found[0]
    for part in found[1:]:
        out = out.union(part)
    return out
