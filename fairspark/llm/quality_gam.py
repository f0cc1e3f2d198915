"""Quality classifier: a generalised additive model with pairwise interactions.

Each text gives some features.  Each feature is cut into bins at quantiles; cyclic boosting of shallow trees (three leaves
on one feature, in turn) learns a lookup table of a value a bin; then the pairs of features that explain most of what is
left get tables of two dimensions, boosted in the same way by trees of one cut a feature.  A score is the logistic of
a sum of looked-up values.

The model is fitted in the driver to a bounded sample of labelled rows, ``sample`` on average (rows are chosen by a hash
of their id; below that number all are taken).  All rows are scored, in one pass without a shuffle.

Defined cases: null and empty texts are scored by features of 0; a null label teaches nothing; of several labels of one
id the largest counts; rows without doc_id count as an empty id and are scored, not learned from; with no labels or only
one label the score is the share of 1 (0.5 without any); repeated rows are scored each; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairspark.llm._spark import map_rows
from fairspark.llm._text import chunked, shingle_sets, words_of

SAMPLE = 20_000
FEATURES = (
    "log_words", "word_bytes", "longest_word", "symbols", "pipes", "exclamations", "capitals", "digits", "spaces", "lines",
    "repeated_lines", "distinct_words", "commonest_word", "repeated_windows", "stops", "commas", "beyond_ascii", "line_ends",
)


def features(texts, words) -> np.ndarray:
    """A row of FEATURES for each text."""
    data, offsets = texts
    n = len(offsets) - 1
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    bytes_ = np.bincount(owner * 256 + data, minlength=n * 256).reshape(n, 256).astype(np.float64)
    total = np.maximum(size, 1).astype(np.float64)
    of = lambda chars: bytes_[:, list(chars)].sum(1)
    count = np.diff(words.first).astype(np.float64)
    least_one = np.maximum(count, 1)
    lengths = (words.ends - words.starts).astype(np.float64)
    word_owner = np.repeat(np.arange(n), np.diff(words.first))
    longest, commonest, distinct = np.zeros(n), np.zeros(n), np.zeros(n)
    np.maximum.at(longest, word_owner, lengths)
    if len(lengths):
        order = np.lexsort((words.hashes, word_owner))
        ranked, owners = words.hashes[order], word_owner[order]
        begins = np.flatnonzero(np.concatenate([[True], (ranked[1:] != ranked[:-1]) | (owners[1:] != owners[:-1])]))
        np.maximum.at(commonest, owners[begins], np.diff(np.append(begins, len(ranked))))
        distinct = np.bincount(owners[begins], minlength=n).astype(np.float64)
    windows = np.maximum(np.diff(words.first) - 4, 1)
    repeated_windows = 1 - np.minimum(1, np.maximum(np.diff(shingle_sets(words, 5)[1]), 0) / windows)
    repeated_windows[count < 5] = 0
    raw, lines, again, ends = data.tobytes(), np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(n):
        own = [x for x in raw[offsets[i] : offsets[i + 1]].split(b"\n") if x and not x.isspace()]
        lines[i] = len(own)
        again[i] = (len(own) - len(set(own))) / max(len(own), 1)
        ends[i] = sum(x[-1] in b".!?:;\"'" for x in own) / max(len(own), 1)
    letters = np.maximum(of(range(65, 91)) + of(range(97, 123)), 1)
    columns = [
        np.log1p(count), lengths_mean(lengths, word_owner, n), np.log1p(longest), of(b"#*$%&<>{}[]\\~^_=@") / total, of(b"|") / least_one, of(b"!") / least_one, of(range(65, 91)) / letters,
        of(range(48, 58)) / total, (size - np.bincount(word_owner, weights=lengths, minlength=n)) / total, lines / least_one, again, distinct / least_one, commonest / least_one, repeated_windows,
        of(b".!?") / least_one, of(b",;:") / least_one, bytes_[:, 128:].sum(1) / total, ends,
    ]
    return np.stack(columns, 1)


def lengths_mean(lengths: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, weights=lengths, minlength=n) / np.maximum(np.bincount(owner, minlength=n), 1)


class Model(NamedTuple):
    """edges: of each feature's bins; tables: a value a bin; pairs: (feature, feature, edges, edges, table)."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, f], side="right")]
        for f, g, a, b, table in self.pairs:
            total += table[np.searchsorted(a, x[:, f], side="right"), np.searchsorted(b, x[:, g], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _leaves(gradient: np.ndarray, hessian: np.ndarray, ridge: float, least: float) -> np.ndarray:
    """A value a bin from a tree of up to three leaves: the best cut, then the best cut of either side."""
    out = np.zeros(len(gradient))
    gain = lambda g, h: g * g / (h + ridge)

    def cut(a: int, b: int) -> tuple[float, int]:
        g, h = np.cumsum(gradient[a:b]), np.cumsum(hessian[a:b])
        if b - a < 2:
            return 0.0, a
        won = gain(g[:-1], h[:-1]) + gain(g[-1] - g[:-1], h[-1] - h[:-1]) - gain(g[-1], h[-1])
        won[(h[:-1] < least) | (h[-1] - h[:-1] < least)] = 0
        best = int(won.argmax())
        return float(won[best]), a + best + 1

    won, at = cut(0, len(gradient))
    if won <= 0:
        return out
    ends = [0, at, len(gradient)]
    more = max(cut(0, at), cut(at, len(gradient)))
    if more[0] > 0:
        ends = sorted({*ends, more[1]})
    for a, b in zip(ends, ends[1:], strict=False):
        out[a:b] = gradient[a:b].sum() / (hessian[a:b].sum() + ridge)
    return out


def _quadrants(gradient: np.ndarray, hessian: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The gain and the values of the best tree with one cut on either feature."""
    g, h = gradient.cumsum(0).cumsum(1), hessian.cumsum(0).cumsum(1)
    if min(g.shape) < 2:
        return 0.0, np.zeros_like(gradient)
    total, out = 0.0, np.zeros_like(gradient)
    parts = []
    for x in (g, h):
        a = x[:-1, :-1]
        parts.append((a, x[:-1, -1:] - a, x[-1:, :-1] - a, x[-1, -1] - x[:-1, -1:] - x[-1:, :-1] + a))
    total = sum(p * p / (q + ridge) for p, q in zip(*parts, strict=True))
    i, j = np.unravel_index(total.argmax(), total.shape)
    for k, (rows, columns) in enumerate(((slice(None, i + 1), slice(None, j + 1)), (slice(None, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(None, j + 1)), (slice(i + 1, None), slice(j + 1, None)))):
        out[rows, columns] = parts[0][k][i, j] / (parts[1][k][i, j] + ridge)
    return float(total[i, j] - g[-1, -1] ** 2 / (h[-1, -1] + ridge)), out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 150, rate: float = 0.1, pairs: int = 8, pair_bins: int = 12, pair_rounds: int = 60, ridge: float = 1.0, least: float = 2.0) -> Model:
    """Cyclic boosting on the logistic loss."""
    if not len(y):
        return Model(0.0, [], [], [])
    share = float(y.mean())
    if not 0 < share < 1:
        return Model(30.0 * (2 * share - 1), [], [], [])
    intercept = float(np.log(share / (1 - share)))
    edges = [_edges(x[:, f], bins) for f in range(x.shape[1])]
    at = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(len(y), intercept)
    for _ in range(rounds):
        for f, b in enumerate(at):
            p = 1 / (1 + np.exp(-total))
            step = rate * _leaves(np.bincount(b, y - p, len(tables[f])), np.bincount(b, p * (1 - p), len(tables[f])), ridge, least)
            tables[f] += step
            total += step[b]
    coarse = [_edges(x[:, f], pair_bins) for f in range(x.shape[1])]
    at = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(coarse)]

    def sums(f: int, g: int) -> tuple[np.ndarray, np.ndarray]:
        p, shape = 1 / (1 + np.exp(-total)), (len(coarse[f]) + 1, len(coarse[g]) + 1)
        cell = at[f] * shape[1] + at[g]
        return tuple(np.bincount(cell, w, shape[0] * shape[1]).reshape(shape) for w in (y - p, p * (1 - p)))

    ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda fg: -_quadrants(*sums(*fg), ridge)[0])[:pairs]
    grids = {fg: np.zeros((len(coarse[fg[0]]) + 1, len(coarse[fg[1]]) + 1)) for fg in ranked}
    for _ in range(pair_rounds):
        for f, g in ranked:
            step = rate * _quadrants(*sums(f, g), ridge)[1]
            grids[f, g] += step
            total += step[at[f], at[g]]
    return Model(intercept, edges, tables, [(f, g, coarse[f], coarse[g], grid) for (f, g), grid in grids.items()])


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in chunked(batch, "text"):
            rows = features(texts, words_of(texts))
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("label")), pa.array([r.tobytes() for r in rows], pa.binary())], ["label", "x"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits to docs(doc_id, text) with labels(doc_id, label), about ``sample`` rows at most."""
    one = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    n = one.count()
    parts = 1 << 30
    if n > sample:
        one = one.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < int(parts * sample / n))
    # The labels are the sample, which the parameter bounds.
    chosen = docs.select("doc_id", "text").join(F.broadcast(one), "doc_id").select("text", "label")
    rows = chosen.mapInArrow(_measured, "label int, x binary").toPandas()
    x = np.stack([np.frombuffer(b) for b in rows["x"]]) if len(rows) else np.zeros((0, len(FEATURES)))
    # Fits don't depend on the order in which tasks return.
    y = rows["label"].to_numpy(np.float64)
    order = np.lexsort((*x.T, y))
    return fit(x[order], y[order])


def _scored(batches: Iterator[pa.RecordBatch], model, least: float | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in chunked(batch, "text"):
            score = model.value.score(features(texts, words_of(texts)))
            if least is not None:
                yield part.filter(pa.array(score >= least))
            else:
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score)], ["doc_id", "held_out", "score"])


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: F.Column, sample: int = SAMPLE, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs(doc_id, text); held_out: an expression on doc_id."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels.where(~held_out), sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    out = rows.mapInArrow(partial(_scored, model=model, least=None), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, with a score of at least the threshold; learns from all labels."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    return map_rows(docs, partial(_scored, model=model, least=threshold), docs)
