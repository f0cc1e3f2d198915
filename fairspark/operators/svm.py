"""A support vector machine with a radial kernel, solved exactly for any number of rows and of support vectors.

``exact`` finds rows, the pivots, whose kernel functions span those of all rows to within SPAN of their squared length (a pivoted
Cholesky factor, checked on every row), and so has features whose products are the kernel.  Few features span many rows: their
number goes by how the kernel bends between rows, not by how many there are.  On them the loss is minimised by Newton steps along
the path of a barrier, until what is left between it and its dual is below GAP of it; a step takes two passes over all rows,
equal ones being one with a weight, and of them the driver sees sums of pairs of features alone.

Where more than RANK pivots are needed a cascade solves the same problem in its dual.  Rows are dealt over blocks, and each block's dual problem is solved in a task.  Only support vectors go on: those of two blocks
at a time are solved together, up a tree, until one set is left.  Then all rows are looked at: one outside the set whose margin
is below 1 breaks the optimum of the whole problem.  Blocks that hold such rows are solved again, each with the set, and what
they find goes up the tree again, until no row is left that breaks it.  The solution is then that of all rows at once.

The last set is solved in one task and sent to all, so that it must be of a bounded size: beyond MOST support vectors
``TooMany`` is raised, and nothing is approximated unasked.  Few blocks are solved first, then four times as many,
and so on, so that many rows with too many support vectors are told by some of them.

``approximate``, which is another model, is a linear machine on random Fourier features of the kernel.  Equal rows are one with a weight.  Each pass over
all rows gives the loss and its gradient at several lengths of a step, features being what it costs most to make; it begins from
the machine of a bounded sample, solved in one task by the same functions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairspark.plans.storage import forgotten, stored

#: Rows of a block, on average; support vectors of a solution; rounds over all rows.
BLOCK, MOST, ROUNDS = 1000, 3000, 100
#: Blocks solved first; rows that a machine of waves begins from; passes over all rows at most, and rows of a matrix of waves.
FIRST, BEGIN, PASSES, HELD = 12, 1 << 16, 60, 4096
#: Squared length of a kernel function (which is 1) outside the span, at most; pivots at most; share of the loss that the dual may lack.
SPAN, RANK, GAP = 1e-10, 4096, 1e-7
_ROWS = "key long, x array<double>, y double"


class TooMany(ValueError):
    """More support vectors, or pivots, than one task may hold."""


class Machine(NamedTuple):
    """Support vectors, their weights times their labels (-1, 1), the shift, and the kernel exp(-gamma |x - y|^2)."""

    vectors: np.ndarray
    weights: np.ndarray
    shift: float
    gamma: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.shift)
        for a in range(0, len(x) if len(self.weights) else 0, 1024):
            out[a : a + 1024] += kernel(x[a : a + 1024], self.vectors, self.gamma) @ self.weights
        return out


def kernel(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    if len(y):
        x, y = x - y.mean(0), y - y.mean(0)  # far from 0 squares would cancel
    squares = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
    return np.exp(-gamma * np.maximum(squares, 0.0))


def solve(x: np.ndarray, y: np.ndarray, c: float, gamma: float, tolerance: float = 1e-4, steps: int = 1_000_000) -> tuple[np.ndarray, float]:
    """(weights, shift) of the dual: 0 <= weight <= c, sum weight y = 0; y is -1 or 1.

    Two weights at a time, the one that breaks the optimum most and the one that gains most with it, until none breaks it by
    more than the tolerance.
    """
    n, a = len(y), np.zeros(len(y))
    if not n or (y == y[0]).all():
        return a, float(y[0]) if n else 0.0
    k, gradient = kernel(x, x, gamma), -np.ones(n)
    for _ in range(steps):
        value = -y * gradient
        up, low = np.where(y > 0, a < c, a > 0), np.where(y > 0, a > 0, a < c)
        i = int(np.where(up, value, -np.inf).argmax())
        gap = value[i] - value
        able = low & (gap > 0)
        if not able.any() or gap[able].max() < tolerance:
            break
        bend = np.maximum(2.0 - 2 * k[i], 1e-12)  # the kernel of a row with itself is 1
        j = int(np.where(able, gap * gap / bend, -np.inf).argmax())
        room = min(c - a[i] if y[i] > 0 else a[i], a[j] if y[j] > 0 else c - a[j])
        step = min(gap[j] / bend[j], room)
        for t, sign in ((i, y[i]), (j, -y[j])):
            a[t] = min(max(a[t] + sign * step, 0.0), c)
            if a[t] < 1e-12 * c or a[t] > c * (1 - 1e-12):
                a[t] = round(a[t] / c) * c
        gradient += y * step * (k[i] - k[j])
    value = -y * gradient
    up, low = np.where(y > 0, a < c, a > 0), np.where(y > 0, a > 0, a < c)
    free = (a > 0) & (a < c)
    return a, float(value[free].mean() if free.any() else (value[up].max() + value[low].min()) / 2)


def _sets(c: float, gamma: float):
    """Of a block's rows the support vectors, as rows."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("key")
        x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
        weights, _ = solve(x, rows.column("y").to_numpy(), c, gamma)
        # A block of one label has no support vectors of its own: its rows go on, to meet others.
        keep = weights > 0 if (weights > 0).any() else np.ones(len(weights), bool)
        return rows.filter(pa.array(keep))

    return run


def _merged(found: DataFrame, blocks: int, c: float, gamma: float) -> DataFrame:
    """(block, key, x, y) of one block: support vectors solved together two blocks at a time."""
    while blocks > 1:
        blocks = -(-blocks // 2)
        pairs = found.withColumn("block", F.expr("block div 2").cast("int")).dropDuplicates(["block", "key"])
        if pairs.groupBy("block").count().agg(F.max("count")).first()[0] > 2 * MOST:
            raise TooMany(f"more than {MOST} support vectors")
        last, found = found, stored(pairs.groupBy("block").applyInArrow(_sets(c, gamma), f"block int, {_ROWS}"))
        forgotten(last)
    return found


def _rows(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """(key, x, y) of the rows that take part, written."""
    x = F.array(*(F.col(f).cast("double") for f in features))
    rows = train.select(F.monotonically_increasing_id().alias("key"), x.alias("x"), F.when(F.col("target") > 0, 1.0).when(F.col("target").isNotNull(), -1.0).alias("y"))
    return stored(rows.where(F.col("y").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v))))


def _known(rows: DataFrame, width: int) -> tuple[int, float | None, float | None, float]:
    """How many rows, their least and greatest label, and the usual gamma."""
    values = rows.select(F.explode("x").alias("v")).agg(F.var_pop("v").alias("v")).first()["v"]
    return (*rows.agg(F.count(F.lit(1)), F.min("y"), F.max("y")).first(), 1.0 / (width * values) if values else 1.0)


def fit(train: DataFrame, features: Sequence[str], c: float = 1.0, gamma: float | None = None, tolerance: float = 1e-3) -> Machine:
    """The machine of train(features, target 0 or 1); gamma: 1 / (features x variance of all values) by default.

    Rows with a null feature or target take no part.  Equal rows count each.  Of one label alone the margin is that label.
    """
    rows = _rows(train, features)
    n, one, other, usual = _known(rows, len(features))
    if one == other:
        return Machine(np.empty((0, len(features))), np.empty(0), one or 0.0, 1.0)
    gamma = gamma if gamma is not None else usual
    blocks = max(1, -(-n // BLOCK))
    dealt = rows.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block"), "key", "x", "y")
    machine, asked = Machine(np.empty((0, len(features))), np.empty(0), 0.0, gamma), dealt
    some = FIRST
    while 4 * some <= blocks:
        found = stored(dealt.where(F.col("block") < some).groupBy("block").applyInArrow(_sets(c, gamma), f"block int, {_ROWS}"))
        if _merged(found, some, c, gamma).count() > MOST:
            raise TooMany(f"more than {MOST} support vectors of some rows")
        some *= 4
    for _ in range(ROUNDS):
        found = stored(asked.groupBy("block").applyInArrow(_sets(c, gamma), f"block int, {_ROWS}"))
        if found.count() > MOST * max(1, blocks // 2):
            raise TooMany(f"more than {MOST} support vectors")
        last = _merged(found, blocks, c, gamma)
        kept = last.select("key", "x", "y").dropDuplicates(["key"])
        if kept.count() > MOST:
            raise TooMany(f"more than {MOST} support vectors")
        held = kept.orderBy("key").collect()  # MOST at most
        vectors, labels = np.array([r["x"] for r in held], float).reshape(-1, len(features)), np.array([r["y"] for r in held])
        weights, shift = solve(vectors, labels, c, gamma)
        machine = Machine(vectors[weights > 0], (weights * labels)[weights > 0], shift, gamma)
        inside = kept.select("key")
        broken = margins(dealt, machine).where(F.col("y") * F.col("margin") < 1 - tolerance).join(F.broadcast(inside), "key", "left_anti")
        broken = stored(broken.select("block", "key", "x", "y"))
        if broken.isEmpty():
            break
        # Each block again, with the set: what is broken there comes in.
        own = broken.select("block").distinct().join(F.broadcast(kept))  # the set is of MOST rows at most
        asked = broken.unionByName(own.select("block", "key", "x", "y"))
    return machine


class Basis(NamedTuple):
    """Pivots, and the inverse of the triangle that makes their kernel functions orthonormal features."""

    vectors: np.ndarray
    inverse: np.ndarray
    gamma: float

    def of(self, x: np.ndarray) -> np.ndarray:
        return kernel(x, self.vectors, self.gamma) @ self.inverse.T

    def grown(self, x: np.ndarray, within: float) -> Basis:
        """With as many rows of x as bring all of x to the span, the farthest first."""
        known = len(self.vectors)
        features = np.empty((len(x), known + 16))
        features[:, :known] = self.of(x)
        left, picked = 1 - (features[:, :known] ** 2).sum(1), []
        while len(x) and left.max() > within:
            i, at = int(left.argmax()), known + len(picked)
            if at >= RANK:
                raise TooMany(f"more than {RANK} pivots")
            if at == features.shape[1]:
                features = np.concatenate([features, np.empty((len(x), at))], 1)
            column = (kernel(x, x[i : i + 1], self.gamma)[:, 0] - features[:, :at] @ features[i, :at]) / np.sqrt(left[i])
            features[:, at] = column
            left = left - column**2
            left[i] = 0.0
            picked.append(i)
        if not picked:
            return self
        rank = known + len(picked)
        low = np.tril(features[picked, :rank], known)
        # The inverse of a triangle of blocks: what is known stays.
        corner, inverse = np.linalg.inv(low[:, known:]), np.zeros((rank, rank))
        inverse[:known, :known], inverse[known:, known:] = self.inverse, corner
        inverse[known:, :known] = -corner @ (low[:, :known] @ self.inverse)
        return Basis(np.concatenate([self.vectors, x[picked]]), inverse, self.gamma)


def _columns(batch: pa.RecordBatch | pa.Table, *names: str) -> list[np.ndarray]:
    """x as a matrix, and others."""
    x = batch.column("x")
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    return [x.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), *(batch.column(c).to_numpy() for c in names)]


def spanned(rows: DataFrame, width: int, gamma: float) -> Basis:
    """A basis that all rows(x) are within SPAN of.

    Each part of the rows grows the basis known by what it lacks, to a hundredth of SPAN; what they added is merged likewise, a
    quarter as many parts at a time; and all rows are looked at again, until none is farther than SPAN.
    """
    basis = Basis(np.empty((0, width)), np.empty((0, 0)), gamma)

    def lacking(known: Basis, look: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = known
            try:
                for batch in batches:
                    (x,) = _columns(batch)
                    for a in range(0, len(x), HELD):
                        some = x[a : a + HELD]
                        far = 1 - (own.of(some) ** 2).sum(1) > look
                        if far.any():
                            own = own.grown(some[far], SPAN / 100)
            except TooMany:
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.list_(pa.float64()))], ["x"])
                return
            added = own.vectors[len(known.vectors) :]
            yield pa.RecordBatch.from_arrays([pa.array(added.tolist(), pa.list_(pa.float64()))], ["x"])

        return run

    def told(found: DataFrame) -> DataFrame:
        found = stored(found)
        if not found.where("x IS NULL").isEmpty():
            raise TooMany(f"more than {RANK} pivots")
        return found

    for _ in range(ROUNDS):
        found = told(rows.select("x").mapInArrow(lacking(basis, SPAN), "x array<double>"))
        if found.isEmpty():
            return basis
        parts = rows.rdd.getNumPartitions()
        while parts > 1:
            parts = -(-parts // 4)
            last, found = found, told(found.coalesce(parts).mapInArrow(lacking(basis, SPAN / 100), "x array<double>"))
            forgotten(last)
        basis = basis.grown(np.array([r["x"] for r in found.orderBy("x").collect()], float), SPAN / 100)  # RANK at most
        forgotten(found)
    raise TooMany("pivots do not come to an end")


def smoothed(margin: np.ndarray, c: float, mu: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(loss, weight in the dual, bend) of c max(0, 1 - margin) with a barrier: min over s of c s - mu ln s - mu ln(s + margin - 1)."""
    short = c * (1 - margin) / (2 * mu)
    root = np.sqrt(short * short + 1)
    ratio = np.where(short > 0, short + root, 1 / (root - np.minimum(short, 0)))
    weight = c * ratio / (1 + ratio)
    over = mu * (1 + ratio) / c  # mu / (c - weight), the slack s
    return c * over - mu * np.log(over) - mu * np.log(mu / weight), weight, weight * c / ((1 + ratio) * root * 2 * mu)


def exact(train: DataFrame, features: Sequence[str], c: float = 1.0, gamma: float | None = None) -> Machine:
    """The machine of all rows of train(features, target 0 or 1) at once; conventions as of ``fit``.

    Its vectors are the basis's pivots.
    """
    width = len(features)
    raw = _rows(train, features)
    n, one, other, usual = _known(raw, width)
    if one == other:
        return Machine(np.empty((0, width)), np.empty(0), one or 0.0, 1.0)
    gamma = gamma if gamma is not None else usual
    rows = stored(raw.groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("n")))
    forgotten(raw)
    basis = spanned(rows, width, gamma)
    rank = len(basis.vectors)
    upper = np.triu_indices(rank + 1)

    def summed(part: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """The sum of what ``part`` gives for x, y and n of all rows."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                x, y, many = _columns(batch, "y", "n")
                for a in range(0, len(x), HELD):
                    total += part(x[a : a + HELD], y[a : a + HELD], many[a : a + HELD])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], ["at", "value"])

        found = rows.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()  # pairs of features
        total = np.zeros(size)
        total[found.column("at").to_numpy()] = found.column("value").to_numpy()
        return total

    free = np.append(np.ones(rank), 0.0)  # the last weight is the shift
    weights, mu = np.zeros(rank + 1), c

    def bent(x: np.ndarray, y: np.ndarray, many: np.ndarray) -> np.ndarray:
        """The loss, its slope and the upper half of its bends."""
        its = np.concatenate([basis.of(x), np.ones((len(x), 1))], 1)
        margin = y * (its @ weights)
        _, weight, bend = smoothed(margin, c, mu)
        hinge = c * many @ np.maximum(0.0, 1 - margin)
        return np.concatenate([[hinge], -its.T @ (many * weight * y), ((its * (many * bend)[:, None]).T @ its)[upper]])

    for _ in range(20 * ROUNDS):
        found = summed(bent, 2 + rank + len(upper[0]))
        loss = found[0] + free @ weights**2 / 2
        slope, bends = found[1 : 2 + rank] + free * weights, np.zeros((rank + 1, rank + 1))
        bends[upper] = found[2 + rank :]
        bends = bends + np.triu(bends, 1).T + np.diag(free)
        step = np.linalg.solve(bends, slope)
        falls = float(slope @ step)
        if falls < max(0.01 * mu * n, 1e-12 * loss):
            if 2 * mu * n <= GAP * loss:
                return Machine(basis.vectors, basis.inverse.T @ weights[:-1], float(weights[-1]), gamma)
            mu /= 10
            continue
        lengths = np.append(2.0 ** -np.arange(0, 12, 0.5), 0.0)
        ways = weights[:, None] - step[:, None] * lengths
        coefficients = basis.inverse.T @ ways[:-1]

        def tried(x: np.ndarray, y: np.ndarray, many: np.ndarray) -> np.ndarray:
            margin = y[:, None] * (kernel(x, basis.vectors, gamma) @ coefficients + ways[-1])
            return many @ smoothed(margin, c, mu)[0]

        values = summed(tried, len(lengths)) + free @ ways**2 / 2
        if values.argmin() == len(lengths) - 1:
            break
        weights = ways[:, int(values.argmin())]
    raise ArithmeticError(f"the loss falls no further before its dual is met, at a barrier of {mu}")


class Waves(NamedTuple):
    """A linear machine on sqrt(2 / count) cos(2 pi (x turns + shifts)): the last weight is its shift."""

    vectors: np.ndarray
    shifts: np.ndarray
    weights: np.ndarray

    def waved(self, x: np.ndarray) -> np.ndarray:
        """Features of x with a 1 beside them."""
        turns = x @ self.vectors.T + self.shifts
        turns -= np.rint(turns)  # in full precision, so that half of it is enough from here on
        out = np.ones((len(x), len(self.shifts) + 1), np.float32)
        out[:, :-1] = np.cos(turns.astype(np.float32) * np.float32(2 * np.pi)) * np.float32(np.sqrt(2 / max(len(self.shifts), 1)))
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for a in range(0, len(x), HELD):
            out[a : a + HELD] = self.waved(x[a : a + HELD]) @ self.weights
        return out

    def losses(self, x: np.ndarray, y: np.ndarray, n: np.ndarray, tried: np.ndarray) -> np.ndarray:
        """For each column of weights the sum of n max(0, 1 - y margin), and its gradient, as rows."""
        total, of = np.zeros((1 + len(tried), tried.shape[1])), tried.astype(np.float32)
        for a in range(0, len(x), HELD):
            part = slice(a, a + HELD)
            waves, its = self.waved(x[part]), y[part, None]
            short = 1 - its * (waves @ of)
            over = short > 0
            total[0] += n[part] @ np.where(over, short, 0.0)
            total[1:] -= waves.T @ np.where(over, its * n[part, None], 0.0).astype(np.float32)
        return total


#: Lengths of a step that one pass looks at; pairs of steps and slopes that are remembered.
_LENGTHS, _PAIRS = 2.0 ** np.arange(-7, 3), 10


def minimised(losses: Callable[[np.ndarray], np.ndarray], n: float, c: float, weights: np.ndarray, passes: int, tolerance: float = 1e-6) -> np.ndarray:
    """The weights of least |w|^2 / 2c + losses, but for the shift, by limited-memory quasi-Newton steps; losses: as ``Waves.losses``, of n rows."""
    free = np.ones(len(weights))
    free[-1] = 0.0

    def at(tried: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = losses(tried) / n
        return found[0] + (free @ tried**2) / (2 * c * n), found[1:] + free[:, None] * tried / (c * n)

    value, slope = (v[..., 0] for v in at(weights[:, None]))
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    idle = 0
    for _ in range(passes):
        way, kept = slope.copy(), []
        for s, t in reversed(pairs):
            kept.append((s @ way) / (s @ t))
            way -= kept[-1] * t
        way *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1.0 / max(np.linalg.norm(slope), 1e-300)
        for (s, t), k in zip(pairs, reversed(kept), strict=True):
            way += (k - (t @ way) / (s @ t)) * s
        tried = weights[:, None] - way[:, None] * _LENGTHS
        values, slopes = at(tried)
        best = int(values.argmin())
        if not values[best] < value:
            if not pairs:
                break
            pairs = []  # steepest descent, before it is given up
            continue
        step, turn = tried[:, best] - weights, slopes[:, best] - slope
        idle = idle + 1 if value - values[best] < tolerance * abs(value) else 0
        weights, value, slope = tried[:, best], values[best], slopes[:, best]
        if step @ turn > 1e-16:
            pairs = [*pairs[1 - _PAIRS :], (step, turn)]
        if idle == 2:
            break
    return weights


def approximate(train: DataFrame, features: Sequence[str], c: float = 1.0, count: int = 256, seed: int = 42) -> Waves:
    """The linear machine on ``count`` random waves of train(features, target 0 or 1), of all rows that have features and target."""
    width, rng = len(features), np.random.default_rng(seed)
    raw = _rows(train, features)
    n, one, other, gamma = _known(raw, width)
    w, b = rng.normal(size=(count, width)) * np.sqrt(2 * gamma), rng.uniform(0, 2 * np.pi, count)
    machine = Waves(w / (2 * np.pi), b / (2 * np.pi), np.append(np.zeros(count), 0.0 if one != other else one or 0.0))
    if one == other:
        return machine
    rows = stored(raw.groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("n")))
    forgotten(raw)
    held = rows.count()

    def begun(some: pa.Table) -> pa.Table:
        x, y, many = _columns(some.sort_by([("draw", "ascending"), ("y", "ascending")]), "y", "n")
        found = minimised(lambda tried: machine.losses(x, y, many, tried), many.sum(), c * n / many.sum(), machine.weights, PASSES)
        return pa.table({"weights": pa.array([found.tolist()], pa.list_(pa.float64()))})

    draw = F.xxhash64("x", F.lit(seed))
    some = rows.withColumn("draw", draw).where(F.pmod("draw", F.lit(1 << 20)) < max(1, min(1 << 20, BEGIN * (1 << 20) // held)))
    first = some.groupBy(F.lit(0).alias("all")).applyInArrow(lambda t: begun(t.select(["x", "y", "n", "draw"])), "weights array<double>").first()
    start = np.array(first["weights"]) if first else machine.weights

    def losses(tried: np.ndarray) -> np.ndarray:
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((1 + len(tried), tried.shape[1]))
            for batch in batches:
                total += machine.losses(*_columns(batch, "y", "n"), tried)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], ["at", "value"])

        found = rows.mapInArrow(sums, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()  # lengths x weights
        total = np.zeros((1 + len(tried)) * tried.shape[1])
        total[found.column("at").to_numpy()] = found.column("value").to_numpy()
        return total.reshape(1 + len(tried), -1)

    return machine._replace(weights=minimised(losses, n, c, start, PASSES) if held > BEGIN else start)


def margins(rows: DataFrame, machine: Machine | Waves) -> DataFrame:
    """rows(x, ...) with ``margin``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else np.empty((0, machine.vectors.shape[1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(machine.margin(x))], [*batch.schema.names, "margin"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, margin double")


def predict(machine: Machine | Waves, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """rows with ``prediction``: 1 where the margin is above 0.  Features are there."""
    numbered = stored(rows.withColumn("_number", F.monotonically_increasing_id()))
    found = margins(numbered.select(F.col("_number").alias("key"), F.array(*(F.col(f).cast("double") for f in features)).alias("x")), machine)
    out = numbered.join(found.select(F.col("key").alias("_number"), "margin"), "_number")
    return out.withColumn("prediction", (F.col("margin") > 0).cast("int")).drop("_number", "margin")
