"""Gradient boosting of the logistic loss by gradients and Hessians, with regularised leaves and a learned side for missing values.

Values become bins of quantile edges, missing ones a bin of their own.  Rows of the same bins have the same margin in every
round, so that they are one cell, with how many they are and how many of label 1: what is boosted grows with the cells, not with
the rows.  A level of a tree is one job: tasks sum gradients and Hessians of their cells by (node, feature, bin), Spark sums the tasks' sums, and the driver, which gets no more than nodes x
features x bins of them, picks each node's split.  With sums G and H of a side, a split gains
(G_l^2 / (H_l + l) + G_r^2 / (H_r + l) - G^2 / (H + l)) / 2 - g, tried with the missing ones on either side, and a leaf weighs
-G / (H + l), times the rate.  Margins are written every few rounds.  At most LOCAL cells are boosted in one task, by the same
functions, with the same trees.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairspark.plans.storage import forgotten, stored

#: Cells, of four features or fewer (wider ones: as many values), that one task boosts; rounds after which margins are written.
LOCAL, WRITTEN = 1 << 20, 10


@dataclass(frozen=True)
class Settings:
    """Rounds, depth, rate of leaves, penalty of squared leaves (l) and of splits (g), least Hessian of a side, bins."""

    rounds: int = 100
    depth: int = 6
    rate: float = 0.3
    penalty: float = 1.0
    split_cost: float = 0.0
    least: float = 1.0
    bins: int = 256


class Tree(NamedTuple):
    """Nodes from the root, 0: feature (-1: a leaf), bin (at most it goes left), whether missing ones go left, children, weight."""

    feature: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    weight: np.ndarray

    def leaf(self, b: np.ndarray, missing: int, at: np.ndarray | None = None) -> np.ndarray:
        """at: nodes that the rows have come to already."""
        at = np.zeros(len(b), np.int64) if at is None else at
        while True:
            feature = self.feature[at]
            go = np.flatnonzero(feature >= 0)
            if not len(go):
                return at
            node, value = at[go], b[go, feature[go]]
            low = np.where(value == missing, self.missing_left[node], value <= self.bin[node])
            at[go] = np.where(low, self.left[node], self.right[node])


class Boosted(NamedTuple):
    """Edges of each feature's bins, the margin that all start from, and the trees."""

    edges: list[np.ndarray]
    base: float
    trees: list[Tree]

    def binned(self, x: np.ndarray) -> np.ndarray:
        return binned(x, self.edges)

    def margin(self, b: np.ndarray, first: int = 0) -> np.ndarray:
        """Of binned rows, by the trees from ``first`` on; the base only with all."""
        out = np.full(len(b), 0.0 if first else self.base)
        for tree in self.trees[first:]:
            out += tree.weight[tree.leaf(b, _missing(self.edges))]
        return out


def _missing(edges: Sequence[np.ndarray]) -> int:
    return max(map(len, edges), default=0) + 1


def binned(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """How many edges are below each value; missing values have a number of their own."""
    out = np.empty(x.shape, np.int16)
    for j, e in enumerate(edges):
        out[:, j] = np.where(np.isnan(x[:, j]), _missing(edges), np.searchsorted(e, x[:, j], side="left"))
    return out


def slopes(ones: np.ndarray, margin: np.ndarray, n: np.ndarray | float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of n rows of one margin, of which ``ones`` are of label 1."""
    p = 1 / (1 + np.exp(-margin))
    return n * p - ones, n * p * (1 - p)


def histogram(b: np.ndarray, node: np.ndarray, g: np.ndarray, h: np.ndarray, nodes: int, missing: int) -> np.ndarray:
    """(nodes, features, bins with the missing one, 2) of sums; rows of node -1 are left out."""
    use = node >= 0
    b, node, g, h = b[use], node[use].astype(np.int64), g[use], h[use]
    size, out = missing + 1, np.zeros((nodes, b.shape[1], missing + 1, 2))
    for j in range(b.shape[1]):
        at = node * size + b[:, j]
        for k, v in enumerate((g, h)):
            out[:, j, :, k] = np.bincount(at, v, nodes * size).reshape(nodes, size)
    return out


def splits(sums: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each node's feature (-1: none gains), bin, side of missing values, and (G, H); ties go to the first feature, bin, and left last."""
    whole = sums[:, 0].sum(1) if sums.shape[1] else np.zeros((len(sums), 2))
    low = np.cumsum(sums[:, :, :-1], axis=2)  # without the missing ones
    score = lambda v: v[..., 0] ** 2 / (v[..., 1] + s.penalty)
    gains = []
    for left in (low, low + sums[:, :, -1:]):  # missing ones right, then left
        right = whole[:, None, None, :] - left
        gain = (score(left) + score(right) - score(whole)[:, None, None]) / 2 - s.split_cost
        gains.append(np.where((left[..., 1] >= s.least) & (right[..., 1] >= s.least), gain, -np.inf))
    gain = np.stack(gains, axis=-1)
    flat = gain.reshape(len(sums), -1)
    best = flat.argmax(1)
    feature, cut, side = np.unravel_index(best, gain.shape[1:])
    able = flat[np.arange(len(sums)), best] > 1e-12
    return np.where(able, feature, -1), cut, side.astype(bool), whole


class Grower:
    """A tree that grows by levels from their histograms."""

    def __init__(self, s: Settings) -> None:
        self.s, self.columns, self.open = s, [[] for _ in range(6)], [0]
        self._add(1)

    def _add(self, count: int) -> list[int]:
        first = len(self.columns[0])
        for column, value in zip(self.columns, (-1, 0, False, -1, -1, 0.0), strict=True):
            column.extend([value] * count)
        return list(range(first, first + count))

    def place(self, leaf: np.ndarray) -> np.ndarray:
        """The level's node of each row, -1 where it has come to a leaf."""
        where = np.full(len(self.columns[0]), -1)
        where[self.open] = np.arange(len(self.open))
        return where[leaf]

    def level(self, sums: np.ndarray, last: bool) -> None:
        feature, cut, side, whole = splits(sums, self.s)
        following = []
        for n, node in enumerate(self.open):
            self.columns[5][node] = -whole[n, 0] / (whole[n, 1] + self.s.penalty) * self.s.rate
            if feature[n] >= 0 and not last:
                children = self._add(2)
                for column, value in zip(self.columns, (int(feature[n]), int(cut[n]), bool(side[n]), *children), strict=False):
                    column[node] = value
                following += children
        self.open = following

    def tree(self) -> Tree:
        kinds = (np.int64, np.int64, bool, np.int64, np.int64, float)
        return Tree(*(np.array(c, k) for c, k in zip(self.columns, kinds, strict=True)))


def boosted_here(b: np.ndarray, ones: np.ndarray, edges: list[np.ndarray], s: Settings, n: np.ndarray | None = None) -> Boosted:
    """All rounds in this process; of n rows (1) each row of b stands for, ``ones`` are of label 1."""
    n = np.ones(len(b)) if n is None else n
    model, missing = Boosted(edges, _base(ones.sum() / n.sum()), []), _missing(edges)
    margin = np.full(len(b), model.base)
    for _ in range(s.rounds):
        grower, (g, h), at = Grower(s), slopes(ones, margin, n), np.zeros(len(b), np.int64)
        for depth in range(s.depth + 1):
            if not grower.open:
                break
            at = grower.tree().leaf(b, missing, at)
            grower.level(histogram(b, grower.place(at), g, h, len(grower.open), missing), depth == s.depth)
        model.trees.append(grower.tree())
        margin += model.trees[-1].weight[model.trees[-1].leaf(b, missing, at)]
    return model


def _base(share: float) -> float:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return float(np.log(share / (1 - share)))


def _edges(rows: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Quantile edges of each feature: at most bins - 1, each a value that there is."""
    shares = [i / bins for i in range(1, bins)]
    found = rows.agg(*(F.percentile_approx(F.when(~F.isnan(F.col("x")[j]), F.col("x")[j]), shares, 10_000).alias(f"e{j}") for j in range(width))).first()
    return [np.unique(np.array(found[f"e{j}"] or [], float)) for j in range(width)]


def _matrix(batch: pa.RecordBatch | pa.Table, width: int) -> np.ndarray:
    column = batch.column("x")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, width)


def _bins(batch: pa.RecordBatch | pa.Table, width: int) -> np.ndarray:
    """The bins of cells."""
    column = batch.column("b")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.int16).reshape(batch.num_rows, width)


def cells(rows: DataFrame, edges: Sequence[np.ndarray]) -> DataFrame:
    """(b, n, ones): of rows(x, y) how many share the bins b (16 bits each), and how many of them have label 1."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                b = np.ascontiguousarray(binned(_matrix(batch, len(edges)), edges))
                held = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * len(edges)), len(b), [None, pa.py_buffer(b)])
                yield pa.RecordBatch.from_arrays([held.cast(pa.binary()), batch.column("y")], ["b", "y"])

    found = rows.mapInArrow(placed, "b binary, y double") if len(edges) else rows.select(F.lit(b"").alias("b"), "y")
    return found.groupBy("b").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("ones"))


def fit(train: DataFrame, features: Sequence[str], settings: Settings = Settings()) -> Boosted:
    """The model of train(features, target 0 or 1); null and NaN features are missing, rows without a target take no part."""
    s, width = settings, len(features)
    x = F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features))
    raw = stored(train.where("target IS NOT NULL").select(x.alias("x"), F.col("target").cast("double").alias("y")))
    edges = _edges(raw, width, s.bins)
    rows = stored(cells(raw, edges))
    forgotten(raw)
    count, share = rows.agg(F.count(F.lit(1)), F.sum("ones") / F.sum("n")).first()
    if not count:
        return Boosted(edges, 0.0, [])
    if count <= LOCAL * 4 // max(4, width):

        def together(held: pa.Table) -> pa.Table:
            held = held.sort_by("b")
            model = boosted_here(_bins(held, width), held.column("ones").to_numpy(), edges, s, held.column("n").to_numpy())
            return pa.table({"model": pa.array([pickle.dumps(model.trees)], pa.binary())})

        made = rows.groupBy(F.lit(0).alias("all")).applyInArrow(lambda t: together(t.select(["b", "n", "ones"])), "model binary").first()
        trees = pickle.loads(bytes(made["model"]))  # our own task's trees
        return Boosted(edges, _base(share), trees)
    model, missing, start = Boosted(edges, _base(share), []), _missing(edges), 0
    rows, raw = stored(rows.withColumn("margin", F.lit(model.base))), rows
    forgotten(raw)
    schema = "node int, feature int, bin int, g double, h double"
    for number in range(s.rounds):
        grower = Grower(s)
        for depth in range(s.depth + 1):
            if not grower.open:
                break
            part, here, later = grower.tree(), grower, Boosted(edges, model.base, model.trees[start:])

            def sums(batches: Iterator[pa.RecordBatch], part=part, here=here, later=later) -> Iterator[pa.RecordBatch]:
                total = np.zeros((len(here.open), width, missing + 1, 2))
                for batch in batches:
                    b = _bins(batch, width)
                    margin = batch.column("margin").to_numpy() + Boosted(edges, 0.0, later.trees).margin(b)
                    total += histogram(b, here.place(part.leaf(b, missing)), *slopes(batch.column("ones").to_numpy(), margin, batch.column("n").to_numpy()), len(here.open), missing)
                at = np.nonzero((total != 0).any(3))
                yield pa.RecordBatch.from_arrays([*(pa.array(i, pa.int32()) for i in at), *(pa.array(total[at][:, k]) for k in (0, 1))], ["node", "feature", "bin", "g", "h"])

            found = rows.mapInArrow(sums, schema).groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()  # nodes x features x bins at most
            whole = np.zeros((len(grower.open), width, missing + 1, 2))
            at = tuple(found.column(c).to_numpy() for c in ("node", "feature", "bin"))
            whole[at] = np.stack([found.column("g").to_numpy(), found.column("h").to_numpy()], 1)
            grower.level(whole, depth == s.depth)
        model.trees.append(grower.tree())
        if (number + 1) % WRITTEN == 0 and number + 1 < s.rounds:
            last, rows = rows, stored(_with_margin(rows, Boosted(edges, 0.0, model.trees[start:]), lambda batch: _bins(batch, width)))
            forgotten(last)
            start = number + 1
    return model


def _with_margin(rows: DataFrame, more: Boosted, bins: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """rows(..., margin) with the trees' weights added, by what ``bins`` gives of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            added = batch.column("margin").to_numpy() + more.margin(bins(batch))
            yield batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array(added))

    return rows.mapInArrow(run, rows.schema)


def predict(model: Boosted, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """rows with ``prediction``: 1 where the margin is above 0."""
    x = F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features))
    numbered = stored(rows.withColumn("_number", F.monotonically_increasing_id()))
    found = _with_margin(numbered.select("_number", x.alias("x"), F.lit(0.0).alias("margin")), model, lambda batch: model.binned(_matrix(batch, len(features))))
    return numbered.join(found.select("_number", "margin"), "_number").withColumn("prediction", (F.col("margin") > 0).cast("int")).drop("_number", "margin")
