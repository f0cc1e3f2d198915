"""Exact classification trees and forests without a limit of depth or bins, many models in one job.

A model is a set of features and a fold: it learns from the rows of all other folds and predicts those of its own, so that
fitted trees needn't leave the tasks that grow them.  Rows that learn and rows to predict go down the trees together.

Where only counts of predictions are asked for, tables of at most CELLS vectors that differ are grown in tasks, however many rows
they have.  Else a table of at most LOCAL rows is grown in tasks, from columns sorted once.  A larger one stays where it lies: its rows are packed
once, draws go by key, and each pass sends a block's rows down the trees as far as these are known.  Nodes of many rows are split
by aggregation: weights and labels are summed by node, feature and bin, and only values of bins that may hold the best boundary
are looked at one by one.  Nodes of few rows go to tasks, which grow all below them; rows of leaves go nowhere.  Both ways look
at each boundary between neighbouring values.
A gain is G^2/W of both sides, with W the weights and G the weights of label 1, whose maximum is that of the Gini gain; ties
go to the smaller feature, then the smaller threshold.  A node is a leaf if its labels agree or its rows don't differ.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairspark.plans.storage import forgotten, stored

#: Rows, of four features or fewer, of a node that one task holds; jobs that masks and trees are dealt over, at least.
LOCAL, JOBS = 1 << 20, 36
#: Vectors that differ, of four features or fewer, that one task holds, with counts of their rows.
CELLS = 3 << 19
#: For larger tables: bins of a feature; rows of a block; sums (of bins, features and nodes) of a pass; rows of all trees that are
#: shuffled in one job.
BINS, BLOCK, SUMS, SHUFFLED = 256, 1 << 16, 1 << 20, 1 << 26


def local(width: int) -> int:
    """Rows that one task holds: fewer, the more features they have."""
    return max(1, LOCAL * 4 // max(4, width))


@dataclass(frozen=True)
class Growth:
    """trees; features that a node looks at ("sqrt" of them, or all: None), bootstrap weights or none, greatest depth or none."""

    trees: int = 100
    features: str | None = "sqrt"
    bootstrap: bool = True
    depth: int | None = None
    seed: int = 42


FOREST, TREE = Growth(), Growth(trees=1, features=None, bootstrap=False)


class Tree(NamedTuple):
    """Nodes by number from the root, 0: feature (-1: a leaf), threshold (at most it goes left), children, share of label 1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        out, rows, at = np.empty(len(x)), np.arange(len(x)), np.zeros(len(x), np.int64)
        while len(rows):
            feature = self.feature[at]
            there = feature < 0
            if there.any():
                out[rows[there]] = self.value[at[there]]
                rows, at, feature = rows[~there], at[~there], feature[~there]
            at = np.where(x[rows, feature] <= self.threshold[at], self.left[at], self.right[at])
        return out

    @property
    def depth(self) -> int:
        depth = np.zeros(len(self.feature), int)
        for i in np.flatnonzero(self.feature >= 0):  # children come after their parent
            depth[[self.left[i], self.right[i]]] = depth[i] + 1
        return int(depth.max())


def middle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Halfway between neighbouring values, a where rounding gives b."""
    half = a + (b - a) / 2
    return np.where(half < b, half, a)


class _Cuts(NamedTuple):
    """Of each node by one feature: the greatest gain, the threshold, and what weighs and is of label 1 below it."""

    gain: np.ndarray
    cut: np.ndarray
    low_w: np.ndarray
    low_g: np.ndarray


def _best(v: np.ndarray, w: np.ndarray, g: np.ndarray, sizes: np.ndarray, weight: np.ndarray, ones: np.ndarray) -> _Cuts:
    """v, w, g: of rows by node, then value; sizes: how many rows each node has, of two values at least."""
    starts = np.cumsum(sizes) - sizes
    differs = v[1:] > v[:-1]
    differs[starts[1:] - 1] = False
    at = np.flatnonzero(differs)
    first = np.searchsorted(at, starts)
    its = np.repeat(np.arange(len(sizes)), np.diff(first, append=len(at)))
    low_w, low_g = np.cumsum(w), np.cumsum(g)
    lw = low_w[at] - np.where(starts > 0, low_w[starts - 1], 0.0)[its]
    lg = low_g[at] - np.where(starts > 0, low_g[starts - 1], 0.0)[its]
    gain = lg * lg / lw + (ones[its] - lg) ** 2 / (weight[its] - lw)
    top = np.maximum.reduceat(gain, first)
    hits = np.flatnonzero(gain == top[its])
    best = hits[np.searchsorted(hits, first)]  # the first of equal gain
    return _Cuts(top, middle(v[at[best]], v[at[best] + 1]), lw[best], lg[best])


class _Line(NamedTuple):
    """Nodes whose rows differ by one feature alone: their numbers and sizes, and their rows and values as sorted."""

    nodes: np.ndarray
    feature: int
    sizes: np.ndarray
    rows: np.ndarray
    values: np.ndarray


def _along(line: _Line, w: np.ndarray, g: np.ndarray, made: list[np.ndarray], told: np.ndarray) -> None:
    """All below a line's nodes; made: feature, threshold, left, right, share, to which it adds; told: the share of each row's leaf.

    Nodes are stretches of rows that no split moves, so that sums before each place serve all levels.  Neighbouring values of one
    and the same label are one item: the gain is strictly convex, so that its maximum is never between them.
    """
    v, starts = line.values, np.cumsum(line.sizes) - line.sizes
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    new[starts] = True
    at = np.flatnonzero(new)
    of_w, of_g = (np.add.reduceat(c[line.rows], at) for c in (w, g))
    kind = np.where(of_g == 0, 0, np.where(of_g == of_w, 1, 2))
    head = np.ones(len(at), bool)
    head[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    head[np.searchsorted(at, starts)] = True
    first, its = at[head], np.flatnonzero(head)
    low, high = v[first], v[np.append(first[1:], len(v)) - 1]
    before_w, before_g = (np.append(0.0, np.cumsum(np.add.reduceat(c, its))) for c in (of_w, of_g))
    nodes, a = line.nodes, np.searchsorted(first, starts)
    b = np.append(a[1:], len(first))
    base, count, feature, threshold, child, share, ends = len(made[0]), 0, [], [], [], [], []
    roots: tuple | None = None
    while len(a):
        many = b - a - 1
        from_ = np.cumsum(many) - many
        places = np.arange(many.sum()) + np.repeat(a - from_, many)
        weight, ones = before_w[b] - before_w[a], before_g[b] - before_g[a]
        lw, lg = before_w[places + 1] - np.repeat(before_w[a], many), before_g[places + 1] - np.repeat(before_g[a], many)
        gain = lg * lg / lw + (np.repeat(ones, many) - lg) ** 2 / (np.repeat(weight, many) - lw)
        hits = np.flatnonzero(gain == np.repeat(np.maximum.reduceat(gain, from_), many))
        cut = places[hits[np.searchsorted(hits, from_)]]  # the first of equal gain
        lefts = base + count + 2 * np.arange(len(a))
        split = middle(high[cut], low[cut + 1]), lefts
        if roots is None:
            roots = split
        else:
            threshold[-1][nodes], child[-1][nodes], feature[-1][nodes] = *split, line.feature
        a, b = np.stack([a, cut + 1], 1).ravel(), np.stack([cut + 1, b], 1).ravel()
        weight, ones = before_w[b] - before_w[a], before_g[b] - before_g[a]
        on = (ones > 0) & (ones < weight) & (b - a > 1)
        for held, one in ((feature, np.full(len(a), -1)), (threshold, np.zeros(len(a))), (child, np.full(len(a), -1)), (share, ones / weight)):
            held.append(one)
        ends.append((a[~on], share[-1][~on]))
        count += len(a)
        nodes, a, b = np.flatnonzero(on), a[on], b[on]
    made[0][line.nodes], made[1][line.nodes], made[2][line.nodes], made[3][line.nodes] = line.feature, roots[0], roots[1], roots[1] + 1
    child = np.concatenate(child)
    for i, added in enumerate((np.concatenate(feature), np.concatenate(threshold), child, np.where(child >= 0, child + 1, -1), np.concatenate(share))):
        made[i] = np.concatenate([made[i], added])
    place, its = (np.concatenate(c) for c in zip(*ends, strict=True))
    order = np.argsort(place)
    told[line.rows] = np.repeat(its[order], np.diff(first[place[order]], append=len(v)))


def grown(columns: Sequence[np.ndarray], orders: Sequence[np.ndarray], w: np.ndarray, g: np.ndarray, rng: np.random.Generator, tries: int | None = None, depth: int | None = None, told: np.ndarray | None = None) -> Tree:
    """A tree of rows with weights w above 0, of which g are of label 1, level by level; told: room for the shares of their leaves.

    orders: the rows by each feature.  Each level parts them into those that go left and those that go right, so that nodes stay
    together and sorted, and drops the rows of leaves; what is left of a level pays for the next.  Nodes that differ by one feature
    alone are grown ``_along`` it, where any depth is allowed.
    tries: how many features that differ within a node it looks at, in random order.
    """
    use, width = w > 0, len(columns)
    told, lines = np.empty(len(w)) if told is None else told, []
    orders = [o[use[o]] for o in orders]
    values = [c[o] for c, o in zip(columns, orders, strict=True)]
    weight, ones, base, level = np.array([w.sum()]), np.array([g.sum()]), 0, 0  # of the level's nodes
    mixed = lambda w, g: (g > 0) & (g < w) & (width > 0 and (depth is None or level < depth))
    nodes, sizes = np.flatnonzero(mixed(weight, ones)), np.array([len(orders[0])] if width else [])  # nodes with rows, as these lie
    sizes, side, made = sizes[: len(nodes)], np.empty(len(w), np.int8), []
    told[use] = ones[0] / weight[0] if weight[0] > 0 else 0.0
    while len(weight):
        count, level = len(weight), level + 1
        feature, threshold, child = np.full(count, -1), np.zeros(count), np.full(count, -1)
        share = np.divide(ones, weight, out=np.zeros(count), where=weight > 0)
        later = np.empty((2, 0))
        if len(nodes):
            starts = np.cumsum(sizes) - sizes
            tried = np.array([v[starts] < v[starts + sizes - 1] for v in values])
            alone = (tried.sum(0) == 1) & (depth is None)
            for j in range(width if alone.any() else 0):
                its = alone & tried[j]
                if its.any():
                    rows = np.repeat(its, sizes)
                    lines.append(_Line(base + nodes[its], j, sizes[its], orders[j][rows], values[j][rows]))
            tried[:, alone] = False
            if tries is not None and tries < width:
                rank = np.where(tried, rng.random((width, count))[:, nodes], 2.0).argsort(0, kind="stable").argsort(0, kind="stable")
                tried &= rank < tries
            found = np.zeros((4, width, len(nodes)))
            found[0] = -np.inf
            for j, its in enumerate(tried):
                if its.any():
                    rows = slice(None) if its.all() else np.repeat(its, sizes)
                    o = orders[j][rows]
                    found[:, j, its] = _best(values[j][rows], w[o], g[o], sizes[its], weight[nodes[its]], ones[nodes[its]])
            chosen = found[0].argmax(0)
            gain, cut, low_w, low_g = found[:, chosen, np.arange(len(nodes))]
            split = np.isfinite(gain)
            feature[nodes[split]], threshold[nodes[split]] = chosen[split], cut[split]
            number = np.cumsum(feature >= 0) - 1
            child[feature >= 0] = base + count + 2 * number[feature >= 0]
            later = np.zeros((2, 2 * int(split.sum())))
            left = 2 * number[nodes]
            later[:, left[split]] = low_w[split], low_g[split]
            later[:, left[split] + 1] = weight[nodes[split]] - low_w[split], ones[nodes[split]] - low_g[split]
            go_on = mixed(*later)
            to = np.full((2, len(nodes)), 2, np.int8)  # where a row goes: 0 left, 1 right, 2 nowhere, as it is in a leaf
            for s in (0, 1):
                to[s, split] = np.where(go_on[left[split] + s], s, 2)
            side[orders[0]] = 2
            stuck = ~split & ~alone  # no feature differs
            if stuck.any():
                told[orders[0][np.repeat(stuck, sizes)]] = np.repeat(share[nodes[stuck]], sizes[stuck])
            shares = np.divide(later[1], later[0], out=np.zeros(later.shape[1]), where=later[0] > 0)
            for j in range(width):
                its = split & (chosen == j)
                if its.any():
                    rows = orders[0][np.repeat(its, sizes)]
                    right = columns[j][rows] > np.repeat(cut[its], sizes[its])
                    goes = np.where(right, np.repeat(to[1, its], sizes[its]), np.repeat(to[0, its], sizes[its]))
                    side[rows], gone = goes, goes == 2
                    told[rows[gone]] = shares[(np.repeat(left[its], sizes[its]) + right)[gone]]
            goes, kept = side[orders[0]], []
            for s in (0, 1):
                stay = to[s] == s
                kept.append((left[stay] + s, np.add.reduceat(goes == s, starts, dtype=np.int64)[stay]))
            for j in range(width):
                goes = side[orders[j]]
                parts = [np.flatnonzero(goes == s) for s in (0, 1)]
                orders[j], values[j] = (np.concatenate([of[part] for part in parts]) for of in (orders[j], values[j]))
            nodes, sizes = (np.concatenate(of) for of in zip(*kept, strict=True))
        made.append((feature, threshold, child, np.where(child >= 0, child + 1, -1), share))
        base, (weight, ones) = base + count, later
    nodes_made = [np.concatenate(part) for part in zip(*made, strict=True)]
    for line in lines:
        _along(line, w, g, nodes_made, told)
    return Tree(*nodes_made)


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, rng: np.random.Generator, tries: int | None = None, depth: int | None = None) -> Tree:
    """The tree of rows x with labels y and weights w."""
    columns, w = list(np.ascontiguousarray(x.T)), w.astype(float)
    return grown(columns, [np.argsort(c, kind="stable") for c in columns], w, w * y, rng, tries, depth)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, the number of each row's): rows that are equal are one vector."""
    order = np.lexsort(x.T) if x.shape[1] else np.arange(len(x))
    x, number, new = x[order], np.empty(len(x), np.int64), np.zeros(len(x), bool)
    new[:1] = True
    new[1:] = (x[1:] != x[:-1]).any(1)
    number[order] = np.cumsum(new) - 1
    return x[new], number


#: Chances of 0, 1, 2, ... of a Poisson draw of mean 1, summed.
_POISSON = np.cumsum(np.exp(-1) / np.cumprod(np.maximum(np.arange(12), 1)))


def _tries(growth: Growth, width: int) -> int | None:
    return max(1, int(width**0.5)) if growth.features == "sqrt" else None


def _packed(rows: DataFrame) -> DataFrame:
    """rows(key, x, y, fold) as few rows of many: arrays of keys, of all x one after another, of y and fold."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                held = [batch.column("key"), batch.column("x").flatten(), batch.column("y"), batch.column("fold")]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in held], ["key", "x", "y", "fold"])

    return rows.mapInArrow(pack, "key array<long>, x array<double>, y array<double>, fold array<int>")


def _together(growth: Growth, masks: Sequence[tuple[int, ...]], folds: Sequence[Sequence[int]], blocks: int):
    """For packed rows of one job, a mask and a share of the trees: sums of the trees' shares for the rows of each fold.

    Equal vectors of the mask are one, with their rows' weights and labels summed, and columns are sorted once for all trees.
    """

    def run(rows: pa.Table) -> pa.Table:
        mask, block = divmod(rows.column("job")[0].as_py(), blocks)
        key, x, y, fold = (rows.column(c).combine_chunks().flatten().to_numpy() for c in ("key", "x", "y", "fold"))
        order = np.argsort(key, kind="stable")  # draws go by key, whatever way rows came
        x, number = distinct(x.reshape(len(key), -1)[:, list(masks[mask])][order])
        key, y, fold = key[order], y[order], fold[order]
        columns = list(np.ascontiguousarray(x.T))
        orders, count = [np.argsort(c, kind="stable") for c in columns], len(x)
        total, asked = np.zeros(len(key)), np.isin(fold, folds[mask])
        for held in folds[mask]:
            learn, own = np.flatnonzero(fold != held), np.flatnonzero(fold == held)
            if not len(own):
                continue
            its, labels, shares = number[learn], y[learn], np.zeros(count)
            look = np.unique(number[own])
            for t in range(block, growth.trees, blocks):
                rng = np.random.default_rng([growth.seed, t, held, *masks[mask]])
                w = np.searchsorted(_POISSON, rng.random(len(learn))).astype(float) if growth.bootstrap else np.ones(len(learn))
                if w.any():
                    tree = grown(columns, orders, np.bincount(its, w, count), np.bincount(its, w * labels, count), rng, _tries(growth, len(columns)), growth.depth)
                    shares[look] += tree.predict(x[look])
            total[own] = shares[number[own]]
        return pa.table({"mask": pa.array(np.full(int(asked.sum()), mask), pa.int32()), "key": key[asked], "total": total[asked]})

    return run


def counted(rows: DataFrame, folds: int) -> DataFrame:
    """(x, counts): of rows(x, y, fold) each vector, and how many rows of label 0 and 1 each fold has of it; y is 0 or 1."""
    each = [F.count(F.when((F.col("fold") == f) & (F.col("y") == y), 1)) for f in range(folds) for y in (0, 1)]
    return rows.groupBy("x").agg(F.array(*each).alias("counts"))


def _counted_together(growth: Growth, masks: Sequence[tuple[int, ...]], order: Sequence[int], folds: int, blocks: int):
    """For packed vectors of one job, a mask (by its place in the order), a fold and a share of the trees: the trees' shares for the vectors that the fold has.

    A vector's bootstrap weight is the sum of its rows' Poisson draws, which is one Poisson draw of a greater mean.
    """

    def run(rows: pa.Table) -> pa.Table:
        job, block = divmod(rows.column("job")[0].as_py(), blocks)
        mask, held = order[job // folds], job % folds
        x, counts = _all(rows, "x", "counts")
        counts = counts.reshape(-1, folds, 2)
        x, number = distinct(x.reshape(len(counts), -1)[:, list(masks[mask])])
        count = len(x)
        # Sums of a vector's rows by label: learning, and of the fold.
        by = lambda c: np.array([np.bincount(number, c[:, y], count) for y in (0, 1)])
        own = by(counts[:, held])
        learn, look = by(counts.sum(1)) - own, np.flatnonzero(own.sum(0))
        columns = list(np.ascontiguousarray(x.T))
        orders, shares, told = [np.argsort(c, kind="stable") for c in columns], np.zeros(count), np.empty(count)
        for t in range(block, growth.trees, blocks):
            rng = np.random.default_rng([growth.seed, t, held, *masks[mask]])
            drawn = rng.poisson(learn).astype(float) if growth.bootstrap else learn
            w = drawn.sum(0)
            if w.any():
                tree = grown(columns, orders, w, drawn[1], rng, _tries(growth, len(columns)), growth.depth, told)
                out = look[w[look] == 0]
                told[out] = tree.predict(x[out])
                shares[look] += told[look]
        held_of = [pa.array(np.full(len(look), v), pa.int32()) for v in (mask, held)]
        return pa.table({"mask": held_of[0], "fold": held_of[1], "at": look, "zeros": own[0, look].astype(np.int64), "ones": own[1, look].astype(np.int64), "total": shares[look]})

    def judged(rows: pa.Table) -> pa.Table:
        """Counts at once, where a job has all trees."""
        found = run(rows)
        mask, zeros, ones, total = (found.column(c).to_numpy() for c in ("mask", "zeros", "ones", "total"))
        p = (total / growth.trees > 0.5).astype(int)
        made = [(int(mask[0]), y, k, int(n[p == k].sum())) for y, n in ((0, zeros), (1, ones)) for k in (0, 1)] if len(mask) else []
        return pa.table({c: pa.array([m[i] for m in made], t) for i, (c, t) in enumerate((("mask", pa.int32()), ("y", pa.int32()), ("p", pa.int32()), ("n", pa.int64())))})

    return judged if blocks == 1 else run


def cross_counts(cells: DataFrame, masks: Sequence[tuple[int, ...]], folds: int, growth: Growth = FOREST) -> DataFrame | None:
    """(mask, y, p, n): how many rows of each label the models of ``cross_predicted`` give each prediction, from ``counted`` rows.

    All vectors meet in a task, however many rows they stand for; None where they are more than one task holds.
    """
    count, width = cells.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if count > CELLS * 4 // max(4, width or 0):
        return None
    order = sorted(range(len(masks)), key=lambda m: -len(masks[m]))  # what takes longest begins first
    blocks = max(1, min(growth.trees, JOBS // (len(masks) * folds)))
    jobs = len(masks) * folds * blocks

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                held = [batch.column(c).flatten() for c in ("x", "counts")]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in held], ["x", "counts"])

    each = cells.mapInArrow(pack, "x array<double>, counts array<long>").withColumn("job", F.explode(F.sequence(F.lit(0), F.lit(jobs - 1))))
    groups = each.repartitionByRange(jobs, "job").groupBy("job")
    if blocks == 1:
        found = groups.applyInArrow(_counted_together(growth, masks, order, folds, 1), "mask int, y int, p int, n long")
    else:
        found = groups.applyInArrow(_counted_together(growth, masks, order, folds, blocks), "mask int, fold int, at long, zeros long, ones long, total double")
        found = found.groupBy("mask", "fold", "at").agg(F.first("zeros").alias("zeros"), F.first("ones").alias("ones"), F.sum("total").alias("total"))
        p = (F.col("total") / growth.trees > 0.5).cast("int").alias("p")
        found = found.select("mask", p, F.explode(F.array(*(F.struct(F.lit(y).alias("y"), F.col(c).alias("n")) for y, c in ((0, "zeros"), (1, "ones"))))).alias("its")).select("mask", "its.y", "p", "its.n")
    return found.groupBy("mask", "y", "p").agg(F.sum("n").alias("n"))


class _Model(NamedTuple):
    """A tree of a mask that learns from the rows of all folds but held."""

    mask: tuple[int, ...]
    held: int
    tree: int


class _Block(NamedTuple):
    key: np.ndarray
    columns: list[np.ndarray]
    y: np.ndarray
    fold: np.ndarray


#: A node: the number of its model and its path from the root, of 0 (left) and 1.
_Node = tuple[int, str]


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[_Block]:
    """Packed rows in blocks of BLOCK rows or a few more."""

    def one(held: list[pa.RecordBatch]) -> _Block:
        key, x, y, fold = (np.concatenate([b.column(c).flatten().to_numpy() for b in held]) for c in ("key", "x", "y", "fold"))
        return _Block(key, list(np.ascontiguousarray(x.reshape(len(key), -1).T)) if width else [], y, fold)

    held, count = [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            held.append(batch.slice(i, 1))
            count += len(held[-1].column("key").flatten())
            if count >= BLOCK:
                yield one(held)
                held, count = [], 0
    if count:
        yield one(held)


def _mixed(z: np.ndarray) -> np.ndarray:
    """64-bit numbers, each bit of which depends on all bits of those given."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return z ^ (z >> np.uint64(31))


#: Chances of a draw in 2^32 parts.
_PARTS = np.array([c for c in np.round(_POISSON * 2.0**32) if c < 2**32], np.uint32)


def _drawn(block: _Block, mixed: np.ndarray, model: _Model, growth: Growth) -> tuple[np.ndarray, np.ndarray]:
    """(weights, rows): of a block's rows for a model, and those that it learns from or predicts, whose weight is 0."""
    asked = block.fold == model.held
    if growth.bootstrap:
        own = np.random.default_rng([growth.seed, model.tree, model.held, *model.mask]).integers(1 << 63, dtype=np.uint64)
        part, w = (_mixed(mixed + own) >> np.uint64(32)).astype(np.uint32), np.zeros(len(asked), np.int8)
        for chance in _PARTS:
            w += (part >= chance).view(np.int8)
    else:
        w = np.ones(len(asked), np.int8)
    w[asked] = 0
    return w, np.flatnonzero((w > 0) | asked)


def _fallen(top: dict, mask: Sequence[int], columns: Sequence[np.ndarray], rows: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
    """(path, rows) of the nodes that rows come to by the splits (feature, threshold) known so far."""
    stack = [("", rows)]
    while stack:
        path, its = stack.pop()
        if path in top and len(its):
            feature, cut = top[path]
            right = columns[mask[feature]][its] > cut
            stack += [(path + "0", its[~right]), (path + "1", its[right])]
        elif len(its):
            yield path, its


def _row(**columns) -> pa.RecordBatch:
    """One row of lists, and of whole numbers as they are."""
    arrays = [pa.array([c], pa.int32()) if isinstance(c, int) else pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c)) for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, list(columns))


def _all(rows: pa.Table, *names: str) -> list[np.ndarray]:
    return [rows.column(c).combine_chunks().flatten().to_numpy() for c in names]


def _gain(lw: np.ndarray, lg: np.ndarray, weight, ones) -> np.ndarray:
    """G^2/W of what is below and what is above; 0 of an empty side."""
    hw, hg = weight - lw, ones - lg
    return np.divide(lg * lg, lw, out=np.zeros(len(lw)), where=lw > 0) + np.divide(hg * hg, hw, out=np.zeros(len(lw)), where=hw > 0)


def _hopeful(w: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The bins of a node, by their weights and those of label 1, in which or beside which its best boundary may lie.

    The gain is convex, so that within a bin it is nowhere greater than at a corner of what sums below may be there: those at the
    bin's ends, with all of one label first.  Bins are kept whose bound reaches the best gain between bins.
    """
    has = np.flatnonzero(w)
    w, g = w[has].astype(float), g[has].astype(float)
    high_w, high_g = np.cumsum(w), np.cumsum(g)
    weight, ones, low_w, low_g = high_w[-1], high_g[-1], high_w - w, high_g - g
    if len(has) < 2:
        return has
    between = _gain(high_w, high_g, weight, ones)
    corners = (_gain(low_w, low_g, weight, ones), _gain(low_w + g, high_g, weight, ones), _gain(high_w - g, low_g, weight, ones), between)
    return has[np.max(corners, 0) >= between[:-1].max() * (1 - 1e-12)]


class _Pass:
    """One split of some nodes of the models' trees: sums by bin, then by value in hopeful bins.

    tops: of each model the splits known, by path; edges: of each feature between bins; single: of each feature's bins the value,
    if there is but one, else nan.
    """

    def __init__(self, packed: DataFrame, models: Sequence[_Model], growth: Growth, tops: Sequence[dict], edges: Sequence[np.ndarray], single: Sequence[np.ndarray]):
        self.packed, self.models, self.growth, self.tops, self.edges, self.single = packed, models, growth, tops, edges, single
        self.jobs = max(JOBS, packed.sparkSession.sparkContext.defaultParallelism)
        self.whole: set[_Node] = set()  # nodes of which all features are summed, as too few of those drawn first differ

    def _looked(self, node: _Node) -> np.ndarray:
        """The features of a node that are summed, in an order drawn."""
        (m, path), growth = node, self.growth
        model = self.models[m]
        order = np.random.default_rng([growth.seed, model.tree, model.held, *model.mask, *path.encode()]).permutation(len(model.mask))
        return order if node in self.whole else order[: _tries(growth, len(order))]

    def _coming(self, nodes: Sequence[_Node]):
        """For batches of packed rows: (node's number, block, twice the bins and labels by feature, rows that learn, their weights, number of rows)."""
        numbers, used = {node: i for i, node in enumerate(nodes)}, sorted({model for model, _ in nodes})
        models, growth, edges = self.models, self.growth, self.edges
        tops = {m: self.tops[m] for m in used}

        def run(batches: Iterator[pa.RecordBatch]):
            for block in _blocks(batches, len(edges)):
                bins = [2 * np.searchsorted(e, c, side="right") + block.y.astype(np.int64) for e, c in zip(edges, block.columns, strict=True)]
                mixed = _mixed(block.key.astype(np.uint64))
                for m in used:
                    w, rows = _drawn(block, mixed, models[m], growth)
                    for path, its in _fallen(tops[m], models[m].mask, block.columns, rows):
                        number = numbers.get((m, path))
                        if number is not None:
                            learn = its[w[its] > 0]
                            yield number, block, bins, learn, w[learn], len(its)

        return run

    def sums(self, nodes: Sequence[_Node]) -> dict[int, dict]:
        """By a node's number: rows, weight, ones, and what may be split: feature (in the order drawn), bin, low_w, low_g, in_w.

        more: 1 if features must be summed that were not.
        """
        jobs, models, growth, coming = self.jobs, self.models, self.growth, self._coming(nodes)
        looked = [self._looked(node) for node in nodes]
        depth = growth.depth
        starts = [np.cumsum([0, *(2 * BINS * len(looked[i]) for i in range(j, len(nodes), jobs))]) for j in range(jobs)]

        def count(batches):
            held = {}
            for number, block, bins, learn, w, rows in coming(batches):
                mask, (n, j) = models[nodes[number][0]].mask, divmod(number, jobs)
                if j not in held:
                    held[j] = np.zeros((len(starts[j]) - 1, 3), np.int64), np.zeros(starts[j][-1], np.int64)
                of_w = w.astype(float)
                held[j][0][n] += rows, int(of_w.sum()), int(of_w @ block.y[learn])
                its = held[j][1][starts[j][n] : starts[j][n + 1]].reshape(-1, 2 * BINS)
                for k, feature in enumerate(looked[number]):
                    its[k] += np.bincount(bins[mask[feature]][learn], of_w, 2 * BINS).astype(np.int64)
            for j, (stats, found) in held.items():
                yield _row(job=j, stats=stats.ravel(), found=found)

        def judged(rows: pa.Table) -> pa.Table:
            j = rows.column("job")[0].as_py()
            stats = np.sum(_all(rows, "stats")[0].reshape(rows.num_rows, -1, 3), 0)
            found = np.sum(_all(rows, "found")[0].reshape(rows.num_rows, -1), 0)
            made = []
            for n, (total, weight, ones) in enumerate(stats):
                m, path = nodes[n * jobs + j]
                its, out, sure, width = found[starts[j][n] : starts[j][n + 1]].reshape(-1, BINS, 2), {c: [] for c in ("feature", "bin", "low_w", "low_g", "in_w")}, 0, len(models[m].mask)
                tries = _tries(growth, width) or width
                if 0 < ones < weight and (depth is None or len(path) < depth):
                    for k, of in zip(looked[n * jobs + j], its, strict=True):
                        if sure >= tries:
                            break
                        w, g = of.sum(1), of[:, 1]
                        kept, sure = _hopeful(w, g), sure + (np.count_nonzero(w) > 1)
                        for name, v in (("feature", np.full(len(kept), k)), ("bin", kept), ("low_w", (np.cumsum(w) - w)[kept]), ("low_g", (np.cumsum(g) - g)[kept]), ("in_w", w[kept])):
                            out[name].extend(v.tolist())
                made.append({"node": n * jobs + j, "rows": total, "weight": weight, "ones": ones, "more": int(sure < tries and len(its) < width), **out})
            return pa.Table.from_pylist(made, pa.schema([(c, pa.int64()) for c in ("node", "rows", "weight", "ones", "more")] + [(c, pa.list_(pa.int64())) for c in out]))

        counted = self.packed.mapInArrow(count, "job int, stats array<long>, found array<long>")
        schema = "node long, rows long, weight long, ones long, more long, feature array<long>, bin array<long>, low_w array<long>, low_g array<long>, in_w array<long>"
        return {r["node"]: r.asDict() for r in counted.groupBy("job").applyInArrow(judged, schema).toLocalIterator()}

    def shuffled(self, node: _Node, s: dict) -> int:
        """How many rows' values of a node are looked at one by one, at most."""
        mask = self.models[node[0]].mask
        return sum(w for k, at, w in zip(s["feature"], s["bin"], s["in_w"], strict=True) if np.isnan(self.single[mask[k]][at]))

    def within(self, nodes: Sequence[_Node], entries: Sequence[tuple[int, int, int, int, int, int, int]]) -> dict[int, tuple]:
        """By an entry's number: first and last value, and the best boundary between: gain, threshold, weights below it.

        entries: (node's number, feature, bin, low_w, low_g, weight and ones of the node), those of bins of several values.
        """
        if not entries:
            return {}
        jobs, models, coming, wide = self.jobs, self.models, self._coming(nodes), 1 << 21
        tables: dict[int, dict[int, np.ndarray]] = {}
        for e, (number, feature, at, *_) in enumerate(entries):
            tables.setdefault(number, {}).setdefault(feature, np.full(2 * BINS, -1, np.int32))[2 * at : 2 * at + 2] = e
        before = np.array([e[3:] for e in entries], float).T

        def summed(e, v, w, g):
            """Sorted by entry, then value; equal ones are one."""
            order = np.lexsort((v, e))
            e, v, new = e[order], v[order], np.ones(len(e), bool)
            new[1:] = (e[1:] != e[:-1]) | (v[1:] != v[:-1])
            at = np.flatnonzero(new)
            return e[at], v[at], *(np.add.reduceat(c[order], at) if len(at) else c for c in (w, g))

        def packed(parts):
            e, v, w, g = summed(*(np.concatenate(c) for c in zip(*parts, strict=True)))
            for j in range(jobs):
                its = e % jobs == j
                if its.any():
                    yield _row(job=j, entry=e[its], v=v[its], w=w[its], g=g[its])

        def values(batches):
            parts, size = [], 0
            for number, block, bins, learn, w, _ in coming(batches):
                for k, table in tables.get(number, {}).items():
                    feature = models[nodes[number][0]].mask[k]
                    e = table[bins[feature][learn]]
                    its = np.flatnonzero(e >= 0)
                    if len(its):
                        of_w = w[its].astype(np.int64)
                        parts.append((e[its], block.columns[feature][learn[its]], of_w, of_w * block.y[learn[its]].astype(np.int64)))
                        size += len(its)
                if size > wide:
                    yield from packed(parts)
                    parts, size = [], 0
            if size:
                yield from packed(parts)

        def best(rows: pa.Table) -> pa.Table:
            e, v, w, g = summed(*_all(rows, "entry", "v", "w", "g"))
            first = np.flatnonzero(np.diff(e, prepend=-1))
            sizes = np.diff(first, append=len(e))
            last, own = first + sizes - 1, e[first]
            low_w, low_g, weight, ones = before[:, own]
            low = [np.cumsum(c) - np.repeat((np.cumsum(c) - c)[first], sizes) + np.repeat(b, sizes) for c, b in ((w, low_w), (g, low_g))]
            gain = _gain(*low, np.repeat(weight, sizes), np.repeat(ones, sizes))
            gain[last] = -np.inf
            hits = np.flatnonzero(gain == np.repeat(np.maximum.reduceat(gain, first), sizes))
            at = hits[np.searchsorted(hits, first)]  # the first of equal gain
            return pa.table({"entry": own, "first": v[first], "last": v[last], "gain": gain[at], "cut": middle(v[at], v[np.minimum(at + 1, last)]), "low_w": low[0][at], "low_g": low[1][at]})

        found = self.packed.mapInArrow(values, "job int, entry array<int>, v array<double>, w array<long>, g array<long>")
        found = found.groupBy("job").applyInArrow(best, "entry int, first double, last double, gain double, cut double, low_w double, low_g double")
        return {r[0]: tuple(r[1:]) for r in found.toLocalIterator()}

    def splits(self, nodes: Sequence[_Node], sums: dict[int, dict]) -> dict[int, tuple | None]:
        """By the numbers of ``sums``: feature, threshold, weight and ones below; None where no feature differs."""
        entries, each = [], {}
        for number, s in sums.items():
            mask = self.models[nodes[number][0]].mask
            for feature, at, low_w, low_g, in_w in zip(s["feature"], s["bin"], s["low_w"], s["low_g"], s["in_w"], strict=True):
                value = float(self.single[mask[feature]][at])
                known = None if np.isnan(value) else (value, value, -np.inf, value, 0.0, 0.0)
                each.setdefault(number, {}).setdefault(feature, []).append((low_w, low_g, in_w, known, len(entries)))
                if known is None:
                    entries.append((number, feature, at, low_w, low_g, s["weight"], s["ones"]))
        found, out = self.within(nodes, entries), {}
        for number, s in sums.items():
            weight, ones, best, differ = float(s["weight"]), float(s["ones"]), None, 0
            tries = _tries(self.growth, len(self.models[nodes[number][0]].mask))
            for feature, bins in each.get(number, {}).items():
                if tries is not None and differ >= tries:
                    break
                own, before = None, None
                for low_w, low_g, in_w, known, e in bins:
                    first, last, *inner = known or found[e]
                    here = []
                    if before and before[0] == low_w:  # no row lies between
                        lw, lg = float(low_w), float(low_g)
                        gain = lg * lg / lw + (ones - lg) * (ones - lg) / (weight - lw)
                        here.append((gain, float(middle(np.float64(before[1]), np.float64(first))), lw, lg))
                    if inner[0] > -np.inf:
                        here.append(tuple(inner))
                    for cut in here:
                        own = cut if own is None or cut[0] > own[0] else own
                    before = low_w + in_w, last
                if own:
                    differ += 1
                    if best is None or own[0] > best[0] or own[0] == best[0] and feature < best[1]:
                        best = own[0], feature, *own[1:]
            out[number] = best and best[1:]
        return out


def _binned(packed: DataFrame, rows: DataFrame, width: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each feature: edges of about even bins, and of each bin its value, if there is but one, else nan."""
    if not width:
        return [], []
    shares = [i / BINS for i in range(1, BINS)]
    cuts = rows.agg(*(F.percentile_approx(F.col("x")[j], shares, 4 * BINS).alias(f"e{j}") for j in range(width))).first()
    edges = [np.array(sorted(set(c))) for c in cuts]

    def ends(batches):
        low, high = np.full(width * BINS, np.inf), np.full(width * BINS, -np.inf)
        for block in _blocks(batches, width):
            for j, column in enumerate(block.columns):
                at = j * BINS + np.searchsorted(edges[j], column, side="right")
                np.minimum.at(low, at, column)
                np.maximum.at(high, at, column)
        yield pa.RecordBatch.from_pydict({"at": np.arange(width * BINS), "low": low, "high": high})

    found = packed.mapInArrow(ends, "at long, low double, high double").groupBy("at").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low = high").collect()
    single = np.full(width * BINS, np.nan)
    for r in found:
        single[r["at"]] = r["low"]
    return edges, list(single.reshape(width, BINS))


def _by_aggregation(rows: DataFrame, masks: Sequence[tuple[int, ...]], folds: Sequence[Sequence[int]], growth: Growth, most: int, count: int, width: int) -> DataFrame:
    """Splits nodes of more than ``most`` rows by aggregation, and gives those below to tasks.

    The driver holds the trees' tops, whose nodes have more rows than that, and the bins that a pass finds hopeful.
    """
    models = [_Model(tuple(masks[m]), h, t) for m, held in enumerate(folds) for h in held for t in range(growth.trees)]
    of_mask = [m for m, held in enumerate(folds) for _ in held for _ in range(growth.trees)]
    parts = max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-count // LOCAL))
    packed = stored(_packed(rows.repartition(parts, "key")))
    edges, single = _binned(packed, rows, width)
    tops: list[dict[str, tuple[int, float]]] = [{} for _ in models]
    leaves: list[dict[str, float]] = [{} for _ in models]
    small: dict[_Node, int] = {}
    step = _Pass(packed, models, growth, tops, edges, single)
    share = lambda weight, ones: ones / weight if weight > 0 else 0.0
    waiting: list[_Node] = [(m, "") for m in range(len(models))]
    many = max(1, SUMS // (BINS * max(1, width)))
    while waiting:
        nodes, waiting = waiting[:many], waiting[many:]
        large, size = {}, 0
        for number, s in step.sums(nodes).items():
            (m, path), deep = nodes[number], growth.depth is None or len(nodes[number][1]) < growth.depth
            if not 0 < s["ones"] < s["weight"] or not models[m].mask or not deep:
                leaves[m][path] = share(s["weight"], s["ones"])
            elif s["rows"] <= most:
                small[nodes[number]] = s["rows"]
            elif s["more"]:
                step.whole.add(nodes[number])
                waiting.append(nodes[number])
            else:
                large[number] = s
        groups: list[dict[int, dict]] = []
        for number, s in large.items():  # as many values in one job as may be shuffled
            own = step.shuffled(nodes[number], s)
            if not groups or size + own > SHUFFLED:
                groups.append({})
                size = 0
            groups[-1][number], size = s, size + own
        for group in groups:
            picked = {n: nodes[n] for n in group}
            numbers = dict(enumerate(picked))
            cut = step.splits(list(picked.values()), {i: group[n] for i, n in numbers.items()})
            for i, n in numbers.items():
                (m, path), s = nodes[n], group[n]
                if cut[i] is None:
                    leaves[m][path] = share(s["weight"], s["ones"])
                    continue
                feature, threshold, low_w, low_g = cut[i]
                tops[m][path] = feature, threshold
                for side, weight, ones in (("0", low_w, low_g), ("1", s["weight"] - low_w, s["ones"] - low_g)):
                    if 0 < ones < weight:
                        waiting.append((m, path + side))
                    else:
                        leaves[m][path + side] = share(weight, ones)
    # Whole models, or parts of one, as many as may be shuffled at once; what leaves tell comes with the first.
    waves: list[list[_Node]] = [[]]
    size = 0
    for node in sorted(small):
        if size + small[node] > SHUFFLED and waves[-1]:
            waves.append([])
            size = 0
        waves[-1].append(node)
        size += small[node]
    out = None
    for i, wave in enumerate(waves):
        told = _told(packed, models, of_mask, growth, tops, leaves if i == 0 else None, wave, width)
        found = stored(told.groupBy("mask", "key").agg(F.sum("total").alias("total")))
        out = found if out is None else out.unionByName(found)
    forgotten(packed)
    return out


def _told(packed: DataFrame, models: Sequence[_Model], of_mask: Sequence[int], growth: Growth, tops: Sequence[dict], leaves: Sequence[dict] | None, nodes: Sequence[_Node], width: int) -> DataFrame:
    """(mask, key, total): sums of the shares that the given nodes, grown in tasks, tell the rows asked; and leaves, if given."""
    numbers, used = {node: i for i, node in enumerate(nodes)}, sorted({m for m, _ in nodes} if leaves is None else range(len(models)))

    def fall(batches):
        for block in _blocks(batches, width):
            mixed, totals = _mixed(block.key.astype(np.uint64)), {}
            for m in used:
                mask, top = models[m].mask, tops[m]
                w, rows = _drawn(block, mixed, models[m], growth)
                for path, its in _fallen(top, mask, block.columns, rows):
                    number = numbers.get((m, path))
                    if number is not None:
                        x = np.array([block.columns[j][its] for j in mask]).T.ravel()
                        yield _row(node=number, key=block.key[its[w[its] == 0]], x=x, w=w[its], y=block.y[its].astype(np.int8))
                    elif leaves is not None and path in leaves[m]:
                        asked = its[w[its] == 0]
                        total = totals.setdefault(of_mask[m], np.full(len(w), np.nan))
                        total[asked] = np.nan_to_num(total[asked]) + leaves[m][path]
            for mask, total in totals.items():
                at = np.flatnonzero(~np.isnan(total))
                if len(at):
                    yield _row(node=-1 - mask, key=block.key[at], x=total[at], w=np.zeros(0, np.int8), y=np.zeros(0, np.int8))

    def grown_below(rows: pa.Table) -> pa.Table:
        number = rows.column("node")[0].as_py()
        key, x, w, y = _all(rows, "key", "x", "w", "y")
        if number < 0:
            mask, total = -1 - number, x
        else:
            m, path = nodes[number]
            model, mask, x = models[m], of_mask[m], x.reshape(len(w), -1)
            rng = np.random.default_rng([growth.seed, model.tree, model.held, *model.mask, *path.encode()])
            depth = None if growth.depth is None else growth.depth - len(path)
            learn, asked = w > 0, w == 0
            total = grow(x[learn], y[learn].astype(float), w[learn], rng, _tries(growth, x.shape[1]), depth).predict(x[asked])
        return pa.table({"mask": pa.array(np.full(len(key), mask), pa.int32()), "key": key, "total": total})

    # Leaves' shares of a mask come a block a row, dealt over as many groups as there are blocks.
    fallen = packed.mapInArrow(fall, "node int, key array<long>, x array<double>, w array<tinyint>, y array<tinyint>")
    dealt = fallen.withColumn("at", F.when(F.col("node") < 0, F.get("key", F.lit(0))).otherwise(F.lit(0)))
    dealt = dealt.repartition(max(JOBS, min(10 * JOBS, 2 * len(nodes))), "node", "at")  # nodes are few and take long
    return dealt.groupBy("node", "at").applyInArrow(grown_below, "mask int, key long, total double")


def cross_predicted(rows: DataFrame, masks: Sequence[tuple[int, ...]], folds: Sequence[Sequence[int]], growth: Growth = FOREST) -> DataFrame:
    """(mask, key, share): of rows(key, x, y, fold), for each set of features (places in x) and each of its folds.

    share: the mean of the trees' shares of label 1, learned from the rows of all other folds.  x has no nulls, y is 0 or 1,
    keys differ.  All sets and folds are one job.  An empty set of features gives the share of the rows that it learns from.
    """
    if not masks or not any(folds):
        return rows.sparkSession.createDataFrame([], "mask int, key long, share double")
    rows = rows.select(F.col("key").cast("long").alias("key"), "x", F.col("y").cast("double").alias("y"), F.col("fold").cast("int").alias("fold"))
    count, width = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if count > local(width or 0):
        found = _by_aggregation(rows, masks, folds, growth, local(width), count, width)
    else:
        blocks = min(growth.trees, -(-JOBS // len(masks)))
        jobs = [m * blocks + b for m, held in enumerate(folds) if held for b in range(blocks)]
        each = _packed(rows).withColumn("job", F.explode(F.array(*map(F.lit, jobs)))).repartitionByRange(len(jobs), "job")
        found = each.groupBy("job").applyInArrow(_together(growth, masks, folds, blocks), "mask int, key long, total double")
    return found.groupBy("mask", "key").agg((F.sum("total") / growth.trees).alias("share"))


def fit_predict(train: DataFrame, validation: DataFrame, features: Sequence[str], growth: Growth = TREE) -> DataFrame:
    """validation with ``prediction`` (0/1): 1 where the trees' mean share is over a half; keys may repeat in either."""
    x = F.array(*(F.col(c).cast("double") for c in features))
    held = stored(validation.withColumn("_number", F.monotonically_increasing_id()))
    learn = train.select(F.monotonically_increasing_id().alias("key"), x.alias("x"), F.col("target").alias("y"), F.lit(0).alias("fold"))
    # Numbers of the two sets differ; draws go by number.
    learn = stored(learn.withColumn("key", -1 - F.col("key")))
    rows = learn.unionByName(held.select(F.col("_number").alias("key"), x.alias("x"), F.lit(0.0).alias("y"), F.lit(1).alias("fold")))
    found = cross_predicted(rows, [tuple(range(len(features)))], [[1]], growth)
    out = held.join(found.select(F.col("key").alias("_number"), "share"), "_number")
    return out.withColumn("prediction", (F.col("share") > 0.5).cast("int")).drop("_number", "share")
