"""Packing against the exhaustive optimum, and partitions that fail their certificate."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from fairspark.llm import packing, queries


def optimum(lengths, size):
    """The fewest sequences, by trying every open one and a new one for each length."""
    best = [len(lengths)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for room in {r for r in rooms if r >= lengths[i]}:
            left = list(rooms)
            left[left.index(room)] -= lengths[i]
            place(i + 1, left)
        place(i + 1, [*rooms, size - lengths[i]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(40))
def test_bounds_and_best_fit_enclose_the_optimum(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(20, 60))
    lengths = np.sort(rng.integers(1, size + 1, int(rng.integers(1, 10))))[::-1].copy()
    fewest = optimum(lengths.tolist(), size)
    used = int(packing.best_fit_decreasing(lengths, size).max()) + 1
    assert packing.lower_bound(lengths, size) <= fewest <= used <= 11 / 9 * fewest + 1


def failing():
    """Lengths of which best fit makes more sequences than the bound, in sequences of 100."""
    for seed in range(2000):
        lengths = np.random.default_rng(seed).integers(15, 60, 12)
        if packing.best_fit_decreasing(lengths, 100).max() + 1 > packing.lower_bound(lengths, 100):
            return lengths
    raise AssertionError("none found")


def packed(lengths, last, keep_full=0.9):
    table = pa.table({"key": np.arange(len(lengths)), "length": lengths.astype(np.int64), "bin": np.zeros(len(lengths), np.int64)})
    return packing._pack(table, 100, last, keep_full).to_pandas()


def test_a_partition_with_a_gap_gives_its_emptier_sequences_back():
    lengths = failing()
    out, whole = packed(lengths, last=False), packed(lengths, last=True)
    assert whole.sequence.notna().all() and out.sequence.isna().any()
    full = whole.groupby("sequence").length.sum()
    back = set(out[out.sequence.isna()].key)
    assert back == set(whole[whole.sequence.isin(full[full < 90].index)].key)
    certified = np.array([50, 50, 100, 25, 75])
    assert packed(certified, last=False).sequence.notna().all()


def test_documents_of_partitions_with_gaps_are_exchanged(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rng = np.random.default_rng(1)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words, int(rng.integers(8, 40))))) for i in range(160)], "doc_id long, text string").repartition(3)
    pieces = packing.best_fit_packing(docs, queries.tokenizer_path(), size=100, per_partition=12, rounds=1).toPandas()
    again = packing.best_fit_packing(docs, queries.tokenizer_path(), size=100, per_partition=12, rounds=6, keep_full=0.97).toPandas()
    bound = packing.lower_bound(again.length.to_numpy(), 100)
    for out in (pieces, again):
        assert sorted(out.doc_id) == sorted(pieces.doc_id) and (out.groupby("sequence_id").length.sum() <= 100).all()
    assert bound <= again.sequence_id.nunique() <= pieces.sequence_id.nunique()
    # Sequences of later rounds hold documents that earlier ones gave back: there are more numbers of partitions than one round has.
    assert (again.sequence_id // 1_000_000_000).nunique() > 0 and (again.sequence_id // 1_000_000_000).max() >= (pieces.sequence_id // 1_000_000_000).max()
