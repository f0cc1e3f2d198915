"""Substring deduplication with fixed-block anchors.

Every word that a repeated window of ``window`` words covers is removed, but in the window's first occurrence (smallest
doc_id, then smallest start).

1.  Index and probes.  The blocks are the non-overlapping runs of window / 2 words of each document: any window holds one
    whole.  Every rolling run of that length is a probe.  Hashes of probes go to shards by value, packed in binary with
    their places; a probe that is a block carries a mark.  A value that is met twice, once as a block, is an anchor.
2.  Extension.  Back at its chunk of texts, a run of probes that are all met elsewhere, around an anchor, is a maximal
    candidate repeat; each window within it gets a hash of its probes.
3.  Confirmation.  Windows go to shards by that hash; there the first occurrence stays and all others are repeats.
4.  Ranges of repeated windows are joined by key to the texts, which are read once more.

Equal probes or windows in one chunk of texts are sent once (the first occurrence; the chunk settles the others), so that
a passage of a third of all documents costs a shard one entry a chunk, not one a document.  A shard has about 1,000,000
entries; the number of shards grows with the corpus.  Hashes of probes have 38 bits within a shard and of windows 56.

Defined cases: null or empty texts and texts of fewer than ``window`` words keep all their words; rows that repeat a
doc_id count as one document; each row without doc_id is a document, after all others; an empty table gives an empty result; further
columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairspark.llm._spark import discard, materialise
from fairspark.llm._text import chunked, grams, mix64, stream64, words_of

CHUNK, SHARD = 1 << 21, 1_000_000
_PROBE = np.uint64((1 << 38) - 1)


def pack(values: np.ndarray, width: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(data: bytes, n: int, at: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(-1, width)
    return out.view("<u8").ravel()


def pack_places(places: np.ndarray) -> bytes:
    """Ascending numbers as differences, two bytes each where they fit."""
    steps = np.diff(places, prepend=0)
    wide = 2 if not len(steps) or steps.max() < 1 << 16 else 4
    return bytes([wide]) + steps.astype(f"<u{wide}").tobytes()


def unpack_places(data: bytes, n: int, at: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, f"<u{data[at]}", n, at + 1).astype(np.int64))


def by_shard(shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts shards together (stable), and the first of each."""
    order = np.argsort(shard, kind="stable")
    ranked = shard[order]
    return order, np.flatnonzero(np.concatenate([np.ones(min(1, len(order)), bool), ranked[1:] != ranked[:-1]]))


def _probes(batches: Iterator[pa.RecordBatch], window: int, shards: int, chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """(shard, chunk, role, payload): role 0 are a shard's probes, role 1 is a chunk's table of documents and local copies."""
    block = window // 2
    for batch in batches:
        for part, texts in chunked(batch, "text", chunk_bytes):
            words = words_of(texts)
            counts = np.diff(words.first)
            long = np.flatnonzero(counts >= window)
            if not len(long):
                continue
            ids = part.column(0).to_numpy(zero_copy_only=False)[long]
            text_hashes = part.column(2).to_numpy(zero_copy_only=False)[long]
            n = counts[long] - block + 1
            base = np.cumsum(n) - n
            in_doc = np.arange(n.sum()) - np.repeat(base, n)
            probes = grams(words.hashes, block)[in_doc + np.repeat(words.first[:-1][long], n)]
            aligned = in_doc % block == 0
            key = hashlib.blake2b(ids.tobytes() + text_hashes.tobytes(), digest_size=8).digest()
            chunk = int(np.frombuffer(key, "<i8")[0])
            # One entry for each value: its first place, whether a place is a block, whether it has several.
            values, at, inverse, times = np.unique(probes, return_index=True, return_inverse=True, return_counts=True)
            is_block = np.zeros(len(values), bool)
            is_block[inverse[aligned]] = True
            order = np.argsort(at)
            values, at, is_block, times = values[order], at[order], is_block[order], times[order]
            copies = np.flatnonzero(np.ones(len(probes), bool) & (np.bincount(at, minlength=len(probes)) == 0))
            firsts = np.empty(len(order), np.int64)
            firsts[order] = at
            head = np.array([len(long), len(copies)], "<i8").tobytes()
            table = head + ids.astype("<i8").tobytes() + text_hashes.astype("<i8").tobytes() + n.astype("<i8").tobytes() + copies.astype("<u4").tobytes() + firsts[inverse[copies]].astype("<u4").tobytes()
            shard = (values >> np.uint64(40)) % np.uint64(shards)
            entry = (values & _PROBE) | (is_block.astype(np.uint64) << np.uint64(38)) | ((times > 1).astype(np.uint64) << np.uint64(39))
            order, cuts = by_shard(shard)
            keys, roles, payloads = [chunk % shards], [1], [table]
            for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
                own = order[a:b]
                keys.append(int(shard[own[0]]))
                roles.append(0)
                payloads.append(np.array([b - a], "<i8").tobytes() + pack(entry[own], 5) + pack_places(at[own]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([chunk] * len(keys), pa.int64()), pa.array(roles, pa.int32()), pa.array(payloads, pa.binary())], ["shard", "chunk", "role", "payload"])


_RETURN = "chunk long, role int, shard long, payload binary"


def _returned(rows: list[tuple]) -> pa.Table:
    chunk, role, shard, payload = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table({"chunk": pa.array(chunk, pa.int64()), "role": pa.array(role, pa.int32()), "shard": pa.array(shard, pa.int64()), "payload": pa.array(payload, pa.binary())})


def _anchors(group: pa.Table) -> pa.Table:
    """Sends each probe that is met twice back to its chunk, with its value and whether one of them is a block."""
    out, entries, sizes, mine = [], [], [], []
    shard = group.column("shard")[0].as_py()
    for chunk, role, payload in zip(*(group.column(x).to_pylist() for x in ("chunk", "role", "payload")), strict=True):
        if role:
            out.append((chunk, 1, shard, payload))
        else:
            n = int(np.frombuffer(payload, "<i8", 1)[0])
            entries.append(unpack(payload, n, 8, 5))
            sizes.append(n)
            mine.append((chunk, payload, n))
    if not mine:
        return _returned(out)
    entries = np.concatenate(entries)
    order = np.argsort(entries & _PROBE, kind="stable")
    ranked = entries[order]
    new = np.concatenate([[True], (ranked[1:] & _PROBE) != (ranked[:-1] & _PROBE)])
    begins = np.flatnonzero(new)
    lengths = np.diff(np.append(begins, len(ranked)))
    marks = np.bitwise_or.reduceat(ranked >> np.uint64(38), begins)
    twice = (lengths > 1) | (marks >= 2)
    code = np.where(twice, 1 + (marks & np.uint64(1)), 0).astype(np.uint8)
    back = np.empty(len(entries), np.uint8)
    back[order] = np.repeat(code, lengths)
    at = 0
    for chunk, payload, n in mine:
        own = np.flatnonzero(back[at : at + n])
        if len(own):
            places = unpack_places(payload, n, 8 + 5 * n)[own]
            value = (entries[at : at + n][own] & _PROBE) | ((back[at : at + n][own] == 2).astype(np.uint64) << np.uint64(38))
            out.append((chunk, 0, shard, np.array([len(own)], "<i8").tobytes() + pack(value, 5) + pack_places(places)))
        at += n
    return _returned(out)


def _candidates(group: pa.Table, window: int, shards: int) -> pa.Table:
    """Windows of a chunk whose probes are all met elsewhere, an anchor among them; (chunk, role, shard, payload) as before."""
    block = window // 2
    chunk = group.column("chunk")[0].as_py()
    rows = list(zip(*(group.column(x).to_pylist() for x in ("role", "shard", "payload")), strict=True))
    table = next(p for role, _, p in rows if role)
    docs, n_copies = np.frombuffer(table, "<i8", 2)
    ids, hashes, n = (np.frombuffer(table, "<i8", docs, 16 + 8 * docs * k) for k in range(3))
    copies, firsts = (np.frombuffer(table, "<u4", n_copies, 16 + 24 * docs + 4 * n_copies * k) for k in range(2))
    total = int(n.sum())
    value, met, anchor = np.zeros(total, np.uint64), np.zeros(total, bool), np.zeros(total, bool)
    seen = set()
    for role, shard, payload in rows:
        if role or shard in seen:  # a repeated chunk sends the same again
            continue
        seen.add(shard)
        m = int(np.frombuffer(payload, "<i8", 1)[0])
        got, places = unpack(payload, m, 8, 5), unpack_places(payload, m, 8 + 5 * m)
        value[places] = mix64((got & _PROBE) + np.uint64((shard + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        met[places] = True
        anchor[places] = got >> np.uint64(38) == 1
    value[copies], met[copies], anchor[copies] = value[firsts], met[firsts], anchor[firsts]
    base = np.cumsum(n) - n
    span = window - block + 1  # probes of a window
    if total < span:
        return _returned([])
    sums = np.concatenate([[0], np.cumsum(met)])
    marks = np.concatenate([[0], np.cumsum(anchor)])
    good = (sums[span:] - sums[:-span] == span) & (marks[span:] > marks[:-span])
    start = np.flatnonzero(good)
    doc = np.searchsorted(base, start, side="right") - 1
    inside = start + span <= (base + n)[doc]
    start, doc = start[inside], doc[inside]
    if not len(start):
        return _returned([])
    weights = stream64(span, 53) | np.uint64(1)
    hashed = np.zeros(len(start), np.uint64)
    for k in range(span):
        hashed += value[start + k] * weights[k]
    hashed = mix64(hashed)
    # Of equal windows in the chunk the first is sent, with those at its place in rows of the same doc_id; the others repeat it.
    place = start - base[doc]
    order = np.lexsort((place, ids[doc], hashed))
    new = np.concatenate([[True], hashed[order][1:] != hashed[order][:-1]])
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    repeats = (ids[doc[order]] != ids[doc[first]]) | (place[order] != place[first])
    again = np.sort(order[repeats])
    kept_docs, index = np.unique(doc, return_inverse=True)
    local = np.array([len(kept_docs), len(again)], "<i8").tobytes() + ids[kept_docs].tobytes() + hashes[kept_docs].tobytes() + index[again].astype("<u4").tobytes() + place[again].astype("<u4").tobytes()
    rows = [(chunk, 1, chunk % shards, local)]
    sent = np.sort(order[~repeats])
    shard = (hashed[sent] >> np.uint64(56)) + (hashed[sent] >> np.uint64(40)) * np.uint64(256)
    shard %= np.uint64(shards)
    order, cuts = by_shard(shard)
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
        own = sent[order[a:b]]
        docs, at = np.unique(index[own], return_inverse=True)
        head = np.array([len(docs), b - a], "<i8").tobytes()
        payload = head + ids[kept_docs[docs]].tobytes() + docs.astype("<u4").tobytes() + pack(hashed[own], 7) + at.astype("<u2" if len(docs) < 1 << 16 else "<u4").tobytes() + place[own].astype("<u4").tobytes()
        rows.append((chunk, 0, int(shard[order[a]]), payload))
    return _returned(rows)


def _first_occurrences(group: pa.Table) -> pa.Table:
    """Sends each window that occurs earlier elsewhere back to its chunk."""
    out, found, mine = [], [], []
    shard = group.column("shard")[0].as_py()
    for chunk, role, payload in zip(*(group.column(x).to_pylist() for x in ("chunk", "role", "payload")), strict=True):
        if role:
            out.append((chunk, 1, shard, payload))
            continue
        docs, n = (int(x) for x in np.frombuffer(payload, "<i8", 2))
        ids, index = np.frombuffer(payload, "<i8", docs, 16), np.frombuffer(payload, "<u4", docs, 16 + 8 * docs)
        at = 16 + 12 * docs
        wide = 2 if docs < 1 << 16 else 4
        own = np.frombuffer(payload, f"<u{wide}", n, at + 7 * n)
        place = np.frombuffer(payload, "<u4", n, at + (7 + wide) * n)
        found.append((unpack(payload, n, at, 7), ids[own], place))
        mine.append((chunk, index[own], place))
    if not mine:
        return _returned(out)
    hashed, ids, place = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((place, ids, hashed))
    new = np.concatenate([[True], hashed[order][1:] != hashed[order][:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    later = np.empty(len(order), bool)
    later[order] = (ids[order] != ids[order][first]) | (place[order] != place[order][first])
    at = 0
    for chunk, index, where in mine:
        own = np.flatnonzero(later[at : at + len(index)])
        if len(own):
            out.append((chunk, 0, shard, np.array([len(own)], "<i8").tobytes() + index[own].astype("<u4").tobytes() + where[own].astype("<u4").tobytes()))
        at += len(index)
    return _returned(out)


def _ranges(group: pa.Table, window: int) -> pa.Table:
    """(key, text_hash, starts, ends): the ranges of words of a chunk's documents that repeated windows cover."""
    rows = list(zip(*(group.column(x).to_pylist() for x in ("role", "shard", "payload")), strict=True))
    local = next(p for role, _, p in rows if role)
    docs, n = (int(x) for x in np.frombuffer(local, "<i8", 2))
    ids, hashes = np.frombuffer(local, "<i8", docs, 16), np.frombuffer(local, "<i8", docs, 16 + 8 * docs)
    index, place = [np.frombuffer(local, "<u4", n, 16 + 16 * docs)], [np.frombuffer(local, "<u4", n, 16 + 16 * docs + 4 * n)]
    for role, _, payload in rows:
        if not role:
            m = int(np.frombuffer(payload, "<i8", 1)[0])
            index.append(np.frombuffer(payload, "<u4", m, 8))
            place.append(np.frombuffer(payload, "<u4", m, 8 + 4 * m))
    index, place = np.concatenate(index).astype(np.int64), np.concatenate(place).astype(np.int64)
    order = np.lexsort((place, index))
    index, place = index[order], place[order]
    new = np.concatenate([np.ones(min(1, len(place)), bool), (index[1:] != index[:-1]) | (place[1:] > place[:-1] + window)])
    begins = np.flatnonzero(new)
    ends = place[np.append(begins[1:], len(place)) - 1] + window if len(place) else place
    owner, begins = index[begins], place[begins]
    some, first = np.unique(owner, return_index=True)
    cut = lambda x: pa.ListArray.from_arrays(pa.array(np.append(first, len(owner)).astype(np.int32)), pa.array(x.astype(np.int32)))
    return pa.table({"key": pa.array(ids[some]), "text_hash": pa.array(hashes[some]), "starts": cut(begins), "ends": cut(ends)})


def _removed(batches: Iterator[pa.RecordBatch], keep_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {"doc_id": [], "n_words": [], "n_removed": [], "kept_sha256": []} | ({"kept": []} if keep_text else {})
        for doc, text, starts, ends in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            words, at, kept = (text or "").encode().split(), 0, []
            for a, b in sorted(zip(starts or (), ends or (), strict=True)):
                kept += words[at:a]
                at = max(at, b)
            kept += words[at:]
            joined = b" ".join(kept)
            out["doc_id"].append(doc)
            out["n_words"].append(len(words))
            out["n_removed"].append(len(words) - len(kept))
            out["kept_sha256"].append(hashlib.sha256(joined).hexdigest())
            if keep_text:
                out["kept"].append(joined.decode())
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + ([("kept", pa.string())] if keep_text else [])))


def _windower(window: int, shards: int):
    return lambda group: _candidates(group, window, shards)


def with_keys(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text, h) of docs(doc_id, text): h is xxhash64 of text; key is doc_id or, without one, a number after all.

    Rows of equal text without doc_id are numbered, so that each is a document; which has which number changes no result.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    most, unnamed = keyed.agg(F.max("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    named = keyed.select(F.col("doc_id").alias("key"), "doc_id", "text", "h")
    if not unnamed:
        return named
    after = min(max(most or 0, 0), 1 << 62)
    nth = F.row_number().over(Window.partitionBy("h", "text").orderBy("h"))
    key = F.lit(after + 1) + F.pmod(F.xxhash64("h", nth), F.lit((1 << 63) - 1 - after))
    return named.where("doc_id IS NOT NULL").union(keyed.where("doc_id IS NULL").select(key.alias("key"), "doc_id", "text", "h"))


def repeated_ranges(docs: DataFrame, window: int = 20, chunk_bytes: int = CHUNK) -> DataFrame:
    """(key, text_hash, starts, ends) of documents of docs, as of ``with_keys``, that have repeated windows."""
    if window < 2 or window % 2:
        raise ValueError("window must be even")
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(12, math.ceil(size / 6 / SHARD))
    probes = docs.select("key", "text", "h").mapInArrow(partial(_probes, window=window, shards=shards, chunk_bytes=chunk_bytes), "shard long, chunk long, role int, payload binary")
    anchors = materialise(probes.groupBy("shard").applyInArrow(_anchors, _RETURN), "anchors")
    windows = anchors.groupBy("chunk").applyInArrow(_windower(window, shards), _RETURN)
    later = windows.groupBy("shard").applyInArrow(_first_occurrences, _RETURN)
    ranges = later.groupBy("chunk").applyInArrow(lambda group: _ranges(group, window), "key long, text_hash long, starts array<int>, ends array<int>")
    ranges = materialise(ranges.groupBy("key", "text_hash").agg(F.first("starts").alias("starts"), F.first("ends").alias("ends")), "ranges")
    discard(anchors)
    return ranges


def substring_dedup(docs: DataFrame, window: int = 20, keep_text: bool = False, chunk_bytes: int = CHUNK) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row of docs(doc_id, text); with keep_text also the kept words.

    chunk_bytes: text that is handled together (at least one text).
    """
    keyed = with_keys(docs)
    ranges = repeated_ranges(keyed, window, chunk_bytes).withColumnRenamed("key", "of").hint("merge")
    joined = keyed.join(ranges, (F.col("key") == F.col("of")) & (F.col("h") == F.col("text_hash")), "left").select("doc_id", "text", "starts", "ends")
    return joined.mapInArrow(partial(_removed, keep_text=keep_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if keep_text else ""))
