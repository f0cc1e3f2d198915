"""Best-fit packing of tokenised documents into sequences, with certified bounds.

1.  Each document's token ids (and an end id) are counted and cut into pieces of at most ``size``; a piece that fills a
    sequence has one of its own.
2.  The other pieces are dealt to partitions by hash and each partition is packed by best-fit decreasing.  Dual feasible
    functions f (f(a) + ... <= 1 for any lengths that fit one sequence) give the lower bound sum f of its pieces; a
    partition with as many sequences as its bound is certified and done.
3.  The partitions that have a gap keep their fullest sequences; the documents of their emptier ones are exchanged (dealt
    anew to other partitions) and packed again, for at most ``rounds`` rounds or until no gap is left.

Memory a task: the lengths of one partition, ``per_partition`` pieces on average; the number of partitions grows with
the input.  Every round is written to the shared folder.

Defined cases: a null text is empty and has only the end id; an empty table gives an empty result; repeated rows are
packed each (rows are told apart by a key of their own, not by doc_id, which may be null); further columns are not read.
"""

from __future__ import annotations

import math
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairspark.llm._spark import materialise

_TAIL = b".,;:!?*$%&#|"
_LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyz")
#: Words of a generation; a worker remembers this one and the one before (about 200 bytes a word).
REMEMBERED = 100_000


class WordTokenizer:
    """Ids of a tokenizer that drops white space and never joins across it, with remembered words.

    The text is cut at ASCII white space; A-Z are lowered first, as the tokenizer does.  A word's ASCII punctuation tail is
    looked up apart from what ends in a-z before it, as the tokenizer splits there.  Texts that may hold special tokens
    go to the tokenizer whole.
    """

    def __init__(self, path: str, remember: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        vocabulary = self.inner.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.remember = remember
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _look_up(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.inner.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, missing: set[bytes]) -> None:
        """Looks words up.  Words of letters only have one word-end token, and go to the tokenizer together."""
        plain, other, cut = [], [], []
        for word in missing:
            if (known := self.old.get(word)) is not None:
                self.young[word] = known
                continue
            stem = word.rstrip(_TAIL)
            if stem and len(stem) < len(word) and stem[-1] in _LETTERS:
                cut.append((word, stem, word[len(stem) :]))
        parts = {p for _, stem, tail in cut for p in (stem, tail)}.union(missing) - {w for w, _, _ in cut}
        for word in parts:
            if word not in self.young:
                (plain if (text := word.decode()).isalpha() else other).append((word, text))
        for at in range(0, len(plain), 1000):
            some = plain[at : at + 1000]
            ids = np.array(self.inner.encode_batch_fast([" ".join(t for _, t in some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some):
                other += some
                continue
            data, at_byte = ids.tobytes(), 0
            for (word, _), end in zip(some, (4 * ends).tolist(), strict=True):
                self.young[word] = data[at_byte:end]
                at_byte = end
        for (word, _), ids in zip(other, self._look_up([t for _, t in other]), strict=True):
            self.young[word] = ids
        for word, stem, tail in cut:
            self.young[word] = self.young[stem] + self.young[tail]

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text (UTF-8) as little-endian uint32."""
        out: list[bytes] = []
        holes: list[tuple[int, list[bytes | None], list[tuple[int, bytes]]]] = []
        if len(self.young) > self.remember:
            self.old, self.young = self.young, {}
        get, missing = self.young.get, set()
        for i, text in enumerate(texts):
            if b"<|" in text:
                out.append(np.array(self.inner.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes())
                continue
            own = text.lower().split()
            found = list(map(get, own))
            if None in found:
                new = [(k, own[k]) for k, v in enumerate(found) if v is None]
                missing.update(w for _, w in new)
                holes.append((i, found, new))
                out.append(b"")
            else:
                out.append(b"".join(found))
        if holes:
            self._learn(missing)
            for i, found, new in holes:
                for k, word in new:
                    found[k] = get(word)
                out[i] = b"".join(found)
        return out

    def batches(self, column: pa.Array, together: int = 64) -> Iterator[bytes]:
        """The ids of each text of a column; null is an empty text."""
        for at in range(0, len(column), together):
            yield from self.ids([x or b"" for x in column.slice(at, together).cast(pa.binary()).to_pylist()])


_TOKENIZERS: dict[tuple[str, int], WordTokenizer] = {}


def _pieces(batches: Iterator[pa.RecordBatch], path: str, size: int, end_id: int, remember: int) -> Iterator[pa.RecordBatch]:
    if (path, remember) not in _TOKENIZERS:
        _TOKENIZERS[path, remember] = WordTokenizer(path, remember)
    tokenizer, end = _TOKENIZERS[path, remember], np.array([end_id], "<u4").tobytes()
    for batch in batches:
        docs, pieces, starts, lengths, crcs = [], [], [], [], []
        for doc, ids in zip(batch.column(0).to_pylist(), tokenizer.batches(batch.column(1)), strict=True):
            ids += end
            for piece, at in enumerate(range(0, len(ids), 4 * size)):
                part = ids[at : at + 4 * size] if len(ids) > 4 * size else ids
                docs.append(doc)
                pieces.append(piece)
                starts.append(at // 4)
                lengths.append(len(part) // 4)
                crcs.append(zlib.crc32(part))
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])


def best_fit_decreasing(lengths: np.ndarray, size: int) -> np.ndarray:
    """The sequence number of each length, longest first, each into the fullest sequence that has room."""
    out = np.empty(len(lengths), np.int64)
    rooms: list[int] = []
    with_room: dict[int, list[int]] = {}
    used = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            sequence = with_room[room].pop()
            if not with_room[room]:
                del with_room[room], rooms[at]
        else:
            room, sequence, used = size, used, used + 1
        out[i] = sequence
        if room := room - n:
            if room not in with_room:
                with_room[room] = []
                insort(rooms, room)
            with_room[room].append(sequence)
    return out


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """No packing has fewer sequences: the best of dual feasible functions of two families, and of the plain sum.

    Thresholds: f(a) = 1 above size - e, 0 below e, a / size between.  Steps: f(a) = floor((k + 1) a / size) / k, but
    a / size where (k + 1) a / size is whole.
    """
    if not len(lengths):
        return 0
    values, counts = np.unique(lengths, return_counts=True)
    best = -(-int(lengths.sum()) // size)
    for e in np.unique(values[values <= size // 2])[:: max(1, len(values) // 512)].tolist():
        total = int(counts[values > size - e].sum()) * size + int((values * counts)[(values >= e) & (values <= size - e)].sum())
        best = max(best, -(-total // size))
    for k in range(1, 33):
        whole = (k + 1) * values % size == 0
        total = int((np.where(whole, k * values, (k + 1) * values // size * size) * counts).sum())
        best = max(best, -(-total // (k * size)))
    return best


def _pack(group: pa.Table, size: int, last: bool, keep_full: float) -> pa.Table:
    """A partition's sequences; of one with a gap, the documents of emptier sequences have no sequence unless last."""
    group = group.sort_by([("length", "descending"), ("key", "ascending")])
    lengths = group.column("length").to_numpy()
    sequence = best_fit_decreasing(lengths, size)
    order = np.argsort(sequence, kind="stable")
    ends = np.cumsum(lengths[order])
    begins = np.flatnonzero(np.concatenate([[True], np.diff(sequence[order]) > 0]))
    offset = np.empty(len(lengths), np.int64)
    offset[order] = ends - lengths[order] - np.repeat((ends - lengths[order])[begins], np.diff(np.append(begins, len(order))))
    total = np.bincount(sequence, weights=lengths)
    settled = np.ones(len(total), bool)
    if not last and len(total) > lower_bound(lengths, size):
        settled = total >= keep_full * size
    done = settled[sequence]
    bin_id = group.column("bin")[0].as_py()
    return pa.table({"key": group.column("key"), "bin": pa.array(np.full(len(lengths), bin_id)), "sequence": pa.array(sequence, mask=~done), "offset": pa.array(offset, mask=~done), "length": pa.array(lengths)})


def _packer(size: int, last: bool, keep_full: float):
    return lambda group: _pack(group, size, last, keep_full)


def best_fit_packing(docs: DataFrame, tokenizer_path: str, size: int = 4096, end_id: int = 1, per_partition: int = 20_000, rounds: int = 3, keep_full: float = 0.999, remember: int = REMEMBERED) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece of docs(doc_id, text).

    per_partition: pieces that one task packs, on average; keep_full: in a partition with a gap, sequences at least so
    full stay; remember: words that a worker keeps the ids of (more are faster and take memory).  tokenizer_path must be
    readable on every executor.
    """
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_pieces, path=tokenizer_path, size=size, end_id=end_id, remember=remember), "doc_id long, piece int, start long, length long, ids_crc32 long")
    pieces = materialise(pieces.withColumn("key", F.monotonically_increasing_id()), "pieces")
    left = pieces.where(F.col("length") < size).select("key", "length")
    n, settled, used = left.count(), [], 0
    for turn in range(rounds):
        if not n:
            break
        last = turn == rounds - 1
        bins = max(1, math.ceil(n / per_partition))
        dealt = left.withColumn("bin", F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(bins)))
        packed = dealt.groupBy("bin").applyInArrow(_packer(size, last, keep_full), "key long, bin long, sequence long, offset long, length long")
        packed = materialise(packed, f"packed-{turn}")
        # Sequence numbers: the partition's number in the upper digits, its own number below.
        settled.append(packed.where("sequence IS NOT NULL").select("key", ((F.col("bin") + used) * 1_000_000_000 + F.col("sequence")).alias("sequence_id"), "offset"))
        used += bins
        left = packed.where("sequence IS NULL").select("key", "length")
        n = left.count()
    full = pieces.where(F.col("length") == size).withColumn("sequence_id", -F.col("key") - 1).withColumn("offset", F.lit(0).cast("long"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    out = full.select(*columns)
    if settled:
        placed = settled[0]
        for more in settled[1:]:
            placed = placed.union(more)
        out = out.union(pieces.where(F.col("length") < size).join(placed, "key").select(*columns))
    return out
