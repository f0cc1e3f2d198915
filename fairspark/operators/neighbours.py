"""Exact nearest neighbours by an index of pivots, and consistency: how far predictions differ from those of the nearest rows.

A kNN join in two rounds.  Each point belongs to the cell of its nearest pivot, a bounded sample of the points.  In the first
round a query meets its own cell, which bounds how far its k-th neighbour can be.  In the second it meets the cells that may
hold anything within that bound: by the triangle inequality, no point of a cell is nearer than the query's distance to the
pivot less the cell's radius, nor than the cell's inner radius less that distance.  Nothing within the bound is left out.

Consistency needs no join of rows.  Rows are counted by group, vector and prediction once; of the rows of a vector and group
only the k of smallest key can be anyone's neighbours, and only vectors of fewer rows than k are searched for.  All rows of a
cell of that table have the same neighbours but for those at most k that are neighbours themselves, which are put right.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairspark.plans.storage import checkpointed

#: Pivots at most (a sample that goes to every task); distances held at a time; vectors that are one cell, as few as they are.
PIVOTS, HELD, ALONE = 1 << 15, 1 << 22, 1024


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 1))


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all x to all y, summed in the order of the features."""
    out = np.zeros((len(x), len(y)))
    for i in range(x.shape[1]):
        out += (x[:, i, None] - y[None, :, i]) ** 2
    return out


def _blocks(rows: int, width: int) -> Iterator[slice]:
    step = max(1, HELD // max(width, 1))
    return (slice(a, a + step) for a in range(0, rows, step))


class Index:
    """points(scope, grp, x, key, p), x without nulls, by scope and the cells of pivots; scopes don't see one another."""

    def __init__(self, points: DataFrame, width: int, pivots: int | None = None, vectors: int | None = None) -> None:
        """width: features of x; vectors: how many x there are, where that is known."""
        if pivots is None:
            vectors = points.select("x").distinct().count() if vectors is None else vectors
            pivots = 1 if vectors <= ALONE else min(PIVOTS, math.isqrt(vectors))
        if pivots == 1:
            self.pivots, self.rings = np.zeros((1, width)), np.array([[0.0], [np.inf]])
            self.points = self.placed(points)
            return
        sample = points.select("x").distinct().orderBy(F.xxhash64("x"), "x").limit(pivots).collect()  # bounded, whatever the points
        self.pivots = np.array([r["x"] for r in sample], float).reshape(-1, width)
        self.points = checkpointed(self.placed(points))
        self.rings = np.full((2, max(len(self.pivots), 1)), np.nan)
        for r in self.points.groupBy("cell").agg(F.min("far").alias("inner"), F.max("far").alias("outer")).collect():  # a row a pivot
            self.rings[:, r["cell"]] = r["inner"], r["outer"]

    def placed(self, points: DataFrame) -> DataFrame:
        """points with the cell of their nearest pivot, and how far that is."""
        pivots = self.pivots

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, cells, far = _matrix(batch.column("x")), [np.empty(0, np.int64)], [np.empty(0)]
                for part in _blocks(len(x), len(pivots)):
                    d2 = _squares(x[part], pivots)
                    cells.append(d2.argmin(1))
                    far.append(np.sqrt(d2.min(1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(cells), pa.int32()), pa.array(np.concatenate(far))], [*batch.schema.names, "cell", "far"])

        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields)
        return points.mapInArrow(place, f"{schema}, cell int, far double")

    def visits(self, queries: DataFrame, k: int, slack: float = 0.0) -> DataFrame:
        """(scope, x, cell, bound) of queries(scope, x), distinct: the cells that may hold points within the bound.

        bound: the squared distance of the k-th nearest point of the query's own cell, plus slack; infinite where there aren't k.
        """
        pivots, (inner, outer) = self.pivots, self.rings

        def meet(asked: pa.Table, held: pa.Table) -> pa.Table:
            x, y = _matrix(asked.column("x")), _matrix(held.column("x"))
            rows, cells, bounds = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
            for part in _blocks(len(x), max(len(y), len(pivots))):
                d2 = _squares(x[part], y) if len(y) else np.empty((len(x[part]), 0))
                bound = (np.partition(d2, k - 1, axis=1)[:, k - 1] if len(y) >= k else np.full(len(d2), np.inf)) + slack
                far = np.sqrt(_squares(x[part], pivots))
                # Rounding must not cut a cell off.
                reach = np.sqrt(bound)[:, None] * (1 + 1e-9) + far * 1e-9 + 1e-300
                row, cell = np.nonzero((far - outer <= reach) & (inner - far <= reach))
                rows.append(row + part.start)
                cells.append(cell)
                bounds.append(bound[row])
            taken = asked.take(pa.array(np.concatenate(rows)))
            return pa.table({"scope": taken.column("scope"), "x": taken.column("x"), "cell": pa.array(np.concatenate(cells), pa.int32()), "bound": np.concatenate(bounds)})

        own = self.placed(queries.select("scope", "x")).select("scope", "x", "cell")
        held = self.points.select("scope", "x", "cell")
        return own.groupBy("scope", "cell").cogroup(held.groupBy("scope", "cell")).applyInArrow(lambda q, c: meet(q.select(["scope", "x"]), c.select(["x"])), "scope string, x array<double>, cell int, bound double")

    def nearest(self, queries: DataFrame, k: int, slack: float = 0.0) -> DataFrame:
        """(scope, x, grp, key, p, d2): of each grp the k nearest points of its scope to each of queries(scope, x), ties to the smaller key.

        Only points within the k-th distance over all groups, plus slack, come: more than k of them, where groups share it.
        """

        def best(asked: pa.Table, held: pa.Table) -> pa.Table:
            held = held.sort_by([("grp", "ascending"), ("key", "ascending")])
            x, y, bound, keys = _matrix(asked.column("x")), _matrix(held.column("x")), asked.column("bound").to_numpy(), held.column("key").to_numpy()
            group = np.unique(held.column("grp").fill_null("").to_numpy(), return_inverse=True)[1] * 2 + held.column("grp").is_null().to_numpy()
            rows, chosen, far = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
            for part in _blocks(len(x) if len(y) else 0, len(y)):
                d2 = _squares(x[part], y)
                row, at = np.nonzero(d2 <= bound[part, None])
                found = d2[row, at]
                order = np.lexsort((keys[at], found, group[at], row))
                row, at, found = row[order], at[order], found[order]
                first = np.ones(len(row), bool)
                first[1:] = (row[1:] != row[:-1]) | (group[at[1:]] != group[at[:-1]])
                place = np.arange(len(row)) - np.flatnonzero(first)[np.cumsum(first) - 1] if len(row) else row
                keep = place < k
                rows.append(row[keep] + part.start)
                chosen.append(at[keep])
                far.append(found[keep])
            taken = held.take(pa.array(np.concatenate(chosen)))
            own = asked.take(pa.array(np.concatenate(rows)))
            return pa.table({"scope": own.column("scope"), "x": own.column("x"), "grp": taken.column("grp"), "key": taken.column("key"), "p": taken.column("p"), "d2": np.concatenate(far)})

        asked = self.visits(queries, k, slack)
        by = ["scope", "cell"]
        met = asked.groupBy(*by).cogroup(self.points.groupBy(*by)).applyInArrow(lambda q, c: best(q.select(["scope", "x", "bound"]), c.select(["grp", "x", "key", "p"])), "scope string, x array<double>, grp string, key long, p double, d2 double")
        place = F.row_number().over(Window.partitionBy("scope", "x", "grp").orderBy("d2", "key"))
        return met.withColumn("place", place).where(F.col("place") <= k).drop("place")


def _firsts(k: int):
    """Of each batch's rows the k of smallest key of each scope, grp and x, so that few are left to sort where vectors repeat."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, key = _matrix(batch.column("x")), batch.column("key").to_numpy()
            grp, scope = (batch.column(c).dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64) for c in ("grp", "scope"))
            code = scope * len(key) + grp
            order = np.lexsort((key, *x.T, code))
            first = np.ones(len(order), bool)
            first[1:] = (code[order[1:]] != code[order[:-1]]) | (x[order[1:]] != x[order[:-1]]).any(1)
            place = np.arange(len(order)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            yield batch.take(pa.array(order[place < k]))

    return cut


def _mean_gap(p, others, take: int):
    """|p - the mean of p and the first ``take`` of others|."""
    nearest = F.slice(others, 1, take)
    return F.abs(p - (p + F.aggregate(nearest, F.lit(0.0), lambda s, e: s + e["p"])) / (1 + F.size(nearest)))


def consistency(df: DataFrame, key: str, protected: str, features: Sequence[str], prediction: str = "p", k: int = 3, within: Sequence[str] = ()) -> DataFrame:
    """(within..., value, consistency) of each group of ``protected``, as text, a null one too: neighbours by the features and by being in the group or not.

    Distance is Euclidean, a row is its own first neighbour, and ties go to the smaller key.  Keys differ; rows without a key or
    a prediction, or with a null or NaN feature, take no part.  within: columns whose values are looked at each by themselves.
    """
    own = F.col(protected).cast("string")
    scope = F.to_json(F.struct(*within)) if within else F.lit("")
    x = F.array(*(F.col(c).cast("double") + F.lit(0.0) for c in features))
    rows = df.select(scope.alias("scope"), own.alias("grp"), x.alias("x"), F.col(key).cast("long").alias("key"), F.col(prediction).cast("double").alias("p"))
    rows = rows.where("key IS NOT NULL AND p IS NOT NULL").where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))
    place = F.row_number().over(Window.partitionBy("scope", "grp", "x").orderBy("key"))
    least = rows.mapInArrow(_firsts(k), "scope string, grp string, x array<double>, key long, p double")
    first = checkpointed(least.withColumn("place", place).where(F.col("place") <= k).drop("place"))
    sizes = first.groupBy("scope", "grp", "x").agg(F.count(F.lit(1)).alias("n"))
    known = sizes.agg(F.collect_set("grp").alias("groups"), F.bool_or(F.col("grp").isNull()).alias("none"), F.min("n").alias("fewest"), F.count_distinct("x").alias("vectors")).first()
    groups = [*([None] if known["none"] else []), *sorted(known["groups"])]  # values of a protected attribute

    at = F.struct("grp", "key", "p", "d2", "same")
    found = first.withColumn("d2", F.lit(0.0)).withColumn("same", F.lit(True))
    if groups and known["fewest"] < k:
        few = sizes.where(F.col("n") < k).select("scope", "x").distinct()
        # A neighbour by features and group is within the k-th distance by features alone, and the 1 that the group may add.
        others = Index(first, len(features), vectors=known["vectors"]).nearest(few, k, slack=1.0)
        found = found.unionByName(others.withColumn("same", F.lit(False)).select(*found.columns))
    # A vector's own rows come from both, and count once.
    found = found.groupBy("scope", "x", "grp", "key").agg(F.first("p").alias("p"), F.min("d2").alias("d2"), F.max("same").alias("same"))
    entries = found.groupBy("scope", "x").agg(F.collect_list(at).alias("entries"))  # 2 k a group
    counted = rows.groupBy("scope", "grp", "x", "p").agg(F.count(F.lit(1)).alias("n"))
    each = F.explode(F.array(*(F.lit(g).cast("string") for g in groups))) if groups else F.lit(None).cast("string")
    cells = first.select("scope", "grp", "x").distinct().join(entries, ["scope", "x"]).withColumn("value", each)
    inside = F.col("grp").eqNullSafe(F.col("value"))
    augmented = F.transform("entries", lambda e: F.struct((e["d2"] + F.when(e["grp"].eqNullSafe(F.col("value")) != inside, 1.0).otherwise(0.0)).alias("d2"), e["key"].alias("key"), e["p"].alias("p"), (e["same"] & e["grp"].eqNullSafe(F.col("grp"))).alias("own")))
    cells = checkpointed(cells.withColumn("near", F.slice(F.sort_array(augmented), 1, k)).drop("entries"))  # as near is read again and again
    gap = lambda p, skip: _mean_gap(p, F.filter("near", lambda e: e["key"] != skip) if skip is not None else F.col("near"), k - 1)
    mend = F.aggregate(F.filter("near", lambda e: e["own"]), F.lit(0.0), lambda s, e: s + gap(e["p"], e["key"]) - gap(e["p"], None))
    cells = cells.select("scope", "grp", "x", "value", "near", mend.alias("mend"))
    equal = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    joined = counted.alias("a").join(cells.alias("b"), [equal(f"a.{c}", f"b.{c}") for c in ("scope", "grp", "x")])
    sums = joined.groupBy("b.scope", "b.value").agg(F.sum(F.col("n") * gap(F.col("p"), None)).alias("gaps"), F.sum("n").alias("n"))
    mends = cells.groupBy(F.col("scope").alias("mended"), F.col("value").alias("mended_value")).agg(F.sum("mend").alias("mend"), F.bool_or(inside).alias("there"))
    out = sums.join(mends, equal("scope", "mended") & equal("value", "mended_value")).where("there")  # a group that a scope has
    out = out.select("scope", "value", (1 - (F.col("gaps") + F.col("mend")) / F.col("n")).alias("consistency"))
    if not within:
        return out.drop("scope")
    names = df.select(*within, scope.alias("_scope")).distinct()
    return out.join(names, F.col("scope") == F.col("_scope")).select(*within, "value", "consistency")
