"""N-gram Jaccard join with PartEnum signatures.

Two documents link when the Jaccard similarity of their shingle sets reaches a threshold; the result has each
document's component under links.  The join is exact but for 64-bit hash collisions of shingles.

1.  Sets.  Each text gives the set of its distinct n-word shingles; equal sets form a class (grouped by a 128-bit
    fingerprint, combined before the shuffle), and from here on the smallest doc_id of a class stands for it.
2.  Signatures.  Set sizes fall into bands [l, l / t].  Two linked sets have the same band or neighbouring ones, so each
    set takes part in its own band and the next; there their Hamming distance is at most k.  The feature domain is cut by
    hash into more than k / 2 parts, so that in one of them the sets differ in at most one element; each part is cut into
    four sub-parts, and every subset of three is enumerated: one of these is the same in both sets, and a hash of its
    contents is a signature.
    Subsets of few elements often agree by chance.  A part is strong if each of its subsets has m elements or more (m up
    to six).  Where the larger set has so many strong parts that the distance can't spoil all, one of these agrees, and only
    its signatures for them count: they carry a mark, and a signature that nobody marked joins nothing.  A set without
    enough strong parts marks all it has.
3.  Frequent shingles (passages that many documents share) would put unlike sets under one signature.  They are counted
    and left out of the domain, which can only lower Hamming distances.  A set of which too little remains signs again
    over the full domain, and two such sets meet there; one of too few parts even there signs its empty ones too.
    Whatever is taken for frequent, no link is lost.
4.  Sets under one signature become candidates by a star, one row a member; components of the candidate graph bound what
    must be compared.  Large ones are cut into blocks by size band and hash, and each block is compared with those of its
    own band and of the neighbouring ones, in a task of its own for each pair: candidates that chain sets of other sizes
    together aren't compared.  All pairs in such a tile are checked exactly; it returns one row a document, not pairs.
5.  Components of the verified links give the result.

Memory a task: a text, a shard of about 500,000 signatures, or a tile of 2 x 16,384 shingles (or two documents).

Defined cases: null or empty texts, and texts without words, have an empty set, link with nothing and are their own
component; a text of fewer than n words has its whole word sequence as its only shingle; rows that repeat a doc_id are
one document with the links of all its texts; a null doc_id has a null component unless an equal set has an id; an empty
table gives an empty result; other columns of the input aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairspark.llm._spark import materialise
from fairspark.llm._text import chunked, mix64, shingle_sets, stream64, words_of
from fairspark.llm.components import components

#: A shingle is frequent if a task's share of this many shingles holds it so often ...
FREQUENT_SHARE, FREQUENT_LEAST = 1 << 22, 5
#: ... and all tasks together so often; at most so many are used (any choice is right, it only prunes).
FREQUENT_TOTAL, FREQUENT_MOST = 32, 1 << 17
SHARD, TILE_SHINGLES, TILE_DOCS = 500_000, 1 << 14, 128


#: Sub-parts of a part; subsets leave one out.
SUBPARTS = 4


def bands(percent: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower ends of the size bands up to a set size, the largest Hamming distance within a band and its predecessor, and the number of parts.

    Sets of a band without any distance link only if equal: it has no parts.
    """
    low, ends = [1], []
    while True:
        ends.append(low[-1] * 100 // percent)
        if low[-1] > most:
            break
        low.append(ends[-1] + 1)
    # |r| + |s| - 2 |r & s| with 100 |r & s| >= percent |r | s| is at most (100 - percent) / (100 + percent) (|r| + |s|)
    k = np.array([(100 - percent) * 2 * e // (100 + percent) for e in ends])
    return np.array(low), k, np.where(k == 0, 0, k // 2 + 1 + k // 8)


def prints(values: np.ndarray, first: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit fingerprint of each set, as int64."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(values * stream64(1, seed)[0] + np.uint64(seed)))])
    return mix64(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch], n: int, lower: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in chunked(batch, "text"):
            values, first = shingle_sets(words_of(texts, lower), n)
            columns = [part.column(0), pa.array(np.diff(first).astype(np.int64)), pa.array(prints(values, first, 3)), pa.array(prints(values, first, 5))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "print1", "print2"])


def _frequent(batches: Iterator[pa.RecordBatch], n: int, lower: bool) -> Iterator[pa.RecordBatch]:
    held, size, seen = [], 0, set()

    def counted() -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts >= FREQUENT_LEAST
        return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often])], ["h", "n"])

    for batch in batches:
        for _, texts in chunked(batch, "text"):
            values, first = shingle_sets(words_of(texts, lower), n)
            for i in np.flatnonzero(np.diff(first)):
                own = values[first[i] : first[i + 1]]
                if (key := (len(own), int(own[0]), int(np.bitwise_xor.reduce(own)))) not in seen:  # copies count once
                    seen.add(key)
                    held.append(own)
                    size += len(own)
            if size >= FREQUENT_SHARE:
                yield counted()
                held, size, seen = [], 0, set()
    if held:
        yield counted()


def _domain(values: np.ndarray, owner: np.ndarray, parts: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures and numbers of elements (parts of all sets x subsets) of sets cut into parts, and the set of each part."""
    mixed = mix64(values ^ np.uint64(salt))
    base = np.concatenate([[0], np.cumsum(parts)])
    place = ((mixed >> np.uint64(32)) * (parts[owner] * SUBPARTS).astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    cell = base[owner] * SUBPARTS + place
    order = np.argsort(cell, kind="stable")
    ranked = cell[order]
    begins = np.flatnonzero(np.concatenate([np.ones(min(1, len(ranked)), bool), ranked[1:] != ranked[:-1]]))
    sums, counts = np.zeros(base[-1] * SUBPARTS, np.uint64), np.bincount(cell, minlength=base[-1] * SUBPARTS)
    if len(begins):
        sums[ranked[begins]] = np.add.reduceat(mix64(values[order] + np.uint64(salt + 1)), begins)
    sums, counts = sums.reshape(-1, SUBPARTS), counts.reshape(-1, SUBPARTS)
    sets = np.repeat(np.arange(len(parts)), parts)
    # A name for each subset: its part within the set, and the sub-part left out.
    name = ((np.arange(base[-1]) - base[sets])[:, None] * SUBPARTS + np.arange(1, SUBPARTS + 1)).astype(np.uint64)
    return mix64(sums.sum(1, keepdims=True) - sums + stream64(1, salt + 2)[0] * name), counts.sum(1, keepdims=True) - counts, sets


def signatures(values: np.ndarray, first: np.ndarray, percent: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """PartEnum signatures (uint64) of sets laid end to end, the set of each, and whether it is marked."""
    sizes = np.diff(first)
    low, _, parts = bands(percent, int(sizes.max(initial=1)))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    rare = np.ones(len(values), bool)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)
        rare = frequent[at] != values
    found, owners, marks = [], [], []

    def add(sig: np.ndarray, sets: np.ndarray, salt: np.ndarray, keep: np.ndarray, mark: np.ndarray) -> None:
        part, left_out = np.nonzero(keep)
        found.append(mix64(sig[part, left_out] ^ salt[sets[part]]))
        owners.append(sets[part])
        marks.append(mark[part, left_out])

    own = np.searchsorted(low, sizes, side="right") - 1
    held = sizes > 0
    for step in (0, 1):
        band = np.where(held, own + step, 0)
        mine = np.where(held, parts[band], 0)
        inside = mine[owner] > 0
        # Parts that two or more differences can spoil, of a set that isn't larger, and of any that may link in this band.
        partner = np.minimum(low[band] * 100 // percent, sizes * 100 // percent)
        by_smaller, by_any = ((100 - percent) * x // (100 + percent) // 2 for x in (2 * sizes, sizes + partner))
        salt = stream64(1, 71)[0] * (band + 1).astype(np.uint64)
        sig, count, sets = _domain(values[rare & inside], owner[rare & inside], mine, 101)
        weakest = count.min(1, initial=0) if not len(count) else count.min(1)
        strong = {m: np.bincount(sets[weakest >= m], minlength=len(sizes)) for m in (1, 2, 3, 4, 6)}
        level = np.zeros(len(sizes), np.int64)
        for m, n in strong.items():
            level[n > by_smaller] = m
        # In its own band the larger set marks its strong parts, or all it has where they are too few.
        mark = (weakest >= level[sets])[:, None] & (count > 0) if step == 0 else np.zeros(count.shape, bool)
        add(sig, sets, salt, count > 0, mark)
        few = held & (strong[1] <= by_any)
        if few.any():
            again, cut = few[owner] & inside, np.where(few, mine, 0)
            sig, count, sets = _domain(values[again], owner[again], cut, 211)
            scarce = few & (np.bincount(sets[count.min(1) >= 1], minlength=len(sizes)) <= by_any)
            keep = (count > 0) | scarce[sets][:, None]
            add(sig, sets, salt + np.uint64(1), keep, keep)
    return np.concatenate(found), np.concatenate(owners), np.concatenate(marks)


def _signed(batches: Iterator[pa.RecordBatch], n: int, lower: bool, percent: int, shards: int, frequent) -> Iterator[pa.RecordBatch]:
    """(shard, payload): prints of sets, signatures (with marks) and the set of each, and pairs that are known already, packed.

    Of sets with one marked signature in a chunk of texts only the smallest is sent on; the others are paired with it here.
    """
    for batch in batches:
        for _, texts in chunked(batch, "text"):
            values, first = shingle_sets(words_of(texts, lower), n)
            own = prints(values, first, 3)
            sig, sets, mark = signatures(values, first, percent, frequent.value)
            if not len(sig):
                continue
            order = np.lexsort((own[sets], sig))
            sig, sets, mark = sig[order], sets[order], mark[order]
            new = np.concatenate([[True], sig[1:] != sig[:-1]])
            begins = np.flatnonzero(new)
            mark = np.repeat(np.logical_or.reduceat(mark, begins), np.diff(np.append(begins, len(sig))))
            least = own[sets[np.maximum.accumulate(np.where(new, np.arange(len(sig)), 0))]]
            pairs = np.stack([own[sets], least], 1)[mark]
            pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0).astype("<i8")
            # Under a marked signature the first is sent on; what nobody has marked here another chunk may.
            send = new | (~mark & np.concatenate([[True], own[sets[1:]] != own[sets[:-1]]]))
            sig, sets, mark = sig[send], sets[send], mark[send]
            shard = (sig >> np.uint64(40)) % np.uint64(shards)
            order = np.argsort(shard, kind="stable")
            sig = (sig & np.uint64((1 << 39) - 1)) | (mark.astype(np.uint64) << np.uint64(39))
            sig, sets, shard = sig[order], sets[order], shard[order]
            cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
            keys, payloads = [int(own[0]) % shards], [np.array([0, 0, 2, len(pairs)], "<i8").tobytes() + pairs.tobytes()]
            for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
                docs, index = np.unique(sets[a:b], return_inverse=True)
                wide = "<u2" if len(docs) < 1 << 16 else "<u4"
                five = sig[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                head = np.array([len(docs), b - a, int(wide[-1]), 0], "<i8").tobytes()
                payloads.append(head + own[docs].astype("<i8").tobytes() + five.tobytes() + index.astype(wide).tobytes())
                keys.append(int(shard[a]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(payloads, pa.binary())], ["shard", "payload"])


def _stars(group: pa.Table) -> pa.Table:
    """(a, b): each set under a signature with the smallest one there, for the signatures of one shard."""
    sigs, sets, known = [np.empty(0, "<u8")], [np.empty(0, "<i8")], [np.empty((0, 2), "<i8")]
    for payload in group.column("payload").to_pylist():
        n, m, wide, pairs = np.frombuffer(payload, "<i8", 4)
        at = 32 + 8 * n
        ids = np.frombuffer(payload, "<i8", n, 32)
        five = np.zeros((m, 8), np.uint8)
        five[:, :5] = np.frombuffer(payload, np.uint8, 5 * m, at).reshape(-1, 5)
        sigs.append(five.view("<u8").ravel())
        sets.append(ids[np.frombuffer(payload, f"<u{wide}", m, at + 5 * m)])
        known.append(np.frombuffer(payload, "<i8", 2 * pairs, len(payload) - 16 * pairs).reshape(-1, 2))
    sigs, sets = np.concatenate(sigs), np.concatenate(sets)
    mark, sigs = sigs >> np.uint64(39) == 1, sigs & np.uint64((1 << 39) - 1)
    order = np.lexsort((sets, sigs))
    sigs, sets, mark = sigs[order], sets[order], mark[order]
    new = np.concatenate([np.ones(min(1, len(sigs)), bool), sigs[1:] != sigs[:-1]])
    least = sets[np.maximum.accumulate(np.where(new, np.arange(len(sets)), 0))] if len(sets) else sets
    begins = np.flatnonzero(new)
    if len(begins):
        mark = np.repeat(np.logical_or.reduceat(mark, begins), np.diff(np.append(begins, len(sigs))))
    pairs = np.unique(np.concatenate([np.stack([sets, least], 1)[(sets != least) & mark], *known]), axis=0)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def linked(values: np.ndarray, first: np.ndarray, block: np.ndarray | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sets laid end to end: for each the smallest set that it reaches by links, and its number of links.

    With blocks, only links between two of them are looked at.
    """
    sizes = np.diff(first)
    m = len(sizes)
    owner = np.repeat(np.arange(m), sizes)
    _, value, counts = np.unique(values, return_inverse=True, return_counts=True)
    shared = counts[value] > 1
    _, value = np.unique(value[shared], return_inverse=True)
    owner = owner[shared]
    both = np.zeros((m, m), np.float32)
    width = int(value.max(initial=-1)) + 1
    step = max(1, (1 << 22) // max(m, 1))
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    for at in range(0, width, step):
        a, b = np.searchsorted(value, [at, at + step])
        dense = np.zeros((m, min(step, width - at)), np.float32)
        dense[owner[a:b], value[a:b] - at] = 1
        both += dense @ dense.T
    common = both.astype(np.int64)
    links = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    np.fill_diagonal(links, False)
    if block is not None:
        links &= block[:, None] != block[None, :]
    reach = np.arange(m)
    while True:
        least = np.minimum(reach, np.where(links, reach[None, :], m).min(1, initial=m))
        least = least[least]
        if (least == reach).all():
            return reach, links.sum(1)
        reach = least


def _tile(group: pa.Table, n: int, lower: bool, percent: int) -> pa.Table:
    group = group.sort_by([("doc_id", "ascending")]).combine_chunks()
    ids, sets, blocks, seen = [], [], [], set()
    for batch in group.to_batches():
        for part, texts in chunked(batch, "text"):
            values, first = shingle_sets(words_of(texts, lower), n)
            own = prints(values, first, 3)
            rows = zip(part.column("doc_id").to_pylist(), part.column("print1").to_pylist(), part.column("block").to_pylist(), strict=True)
            for i, (doc, expected, block) in enumerate(rows):
                if own[i] == expected and (doc, expected) not in seen:
                    seen.add((doc, expected))
                    ids.append(doc)
                    blocks.append(block)
                    sets.append(values[first[i] : first[i + 1]])
    if not ids:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n_links": pa.array([], pa.int64())})
    across = group.column("t1")[0].as_py() != group.column("t2")[0].as_py()
    first = np.cumsum([0, *map(len, sets)])
    reach, links = linked(np.concatenate(sets), first, np.array(blocks) if across else None, percent)
    some, ids = links > 0, np.array(ids, np.int64)
    return pa.table({"a": ids[some], "b": ids[reach[some]], "n_links": links[some].astype(np.int64)})


def _tiles(members: DataFrame, percent: int) -> DataFrame:
    """(doc_id, print1, component, block, t1, t2) of members(component, vertex, class_id, print1, n_shingles), a row for each tile.

    A component that fits one block is one tile.  A larger one is cut by size band, and each band into blocks by hash; a
    block meets those of its own band and of its neighbours, for sets further apart in size can't link.
    """
    blocks = lambda: F.ceil(F.greatest(F.sum("n_shingles") / TILE_SHINGLES, F.count(F.lit(1)) / TILE_DOCS)).cast("long")
    # Bands as of ``bands`` up to the largest set: linked sets have the same or neighbouring ones.
    most = members.agg(F.max("n_shingles")).first()[0] or 1
    low = bands(percent, most)[0].tolist()
    band = F.size(F.filter(F.array(*map(F.lit, low)), lambda x: x <= F.col("n_shingles"))).cast("long")
    whole = members.groupBy("component").agg(blocks().alias("all"))
    banded = members.join(whole, "component").withColumn("band", F.when(F.col("all") > 1, band).otherwise(F.lit(0).cast("long")))
    cut = banded.groupBy("component", "band").agg(blocks().alias("own"))  # a row a band of a component
    by = Window.partitionBy("component").orderBy("band")
    beside = lambda f, d: F.coalesce(F.when(f("band", 1).over(by) == F.col("band") + d, f("own", 1).over(by)), F.lit(0))
    cut = cut.select("component", "band", "own", beside(F.lag, -1).alias("below"), beside(F.lead, 1).alias("above"))
    label = lambda b, i: F.shiftleft(b, 32) + i
    of = lambda d, n: F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.col(n), F.lit(1)) - 1), lambda i: label(F.col("band") + d, i))
    none = F.array().cast("array<bigint>")
    others = F.concat(of(0, "own"), *(F.when(F.col(n) > 0, of(d, n)).otherwise(none) for d, n in ((-1, "below"), (1, "above"))))
    dealt = banded.join(cut, ["component", "band"]).withColumn("block", label(F.col("band"), F.pmod(F.xxhash64("vertex"), "own")))
    tiles = dealt.withColumn("other", F.explode(others))
    return tiles.select(F.col("class_id").alias("doc_id"), "print1", "component", "block", F.least("block", "other").alias("t1"), F.greatest("block", "other").alias("t2"))


def jaccard_join(docs: DataFrame, n: int = 5, percent: int = 80, lower: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id and n_links of each row of docs(doc_id, text).

    n: words of a shingle; percent: the similarity from which documents link; lower: A-Z count as a-z.  class_id: the
    smallest doc_id with an equal set; n_links: links to other classes.  Runs its steps when called; each is kept in the
    shared folder.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = materialise(docs.mapInArrow(partial(_sets, n=n, lower=lower), "doc_id long, n_shingles long, print1 long, print2 long"), "sets")
    key = ["n_shingles", "print1", "print2"]
    classes = materialise(sets.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("class_id")), "classes")
    total = classes.agg(F.sum("n_shingles")).first()[0] or 0
    often = (
        docs.mapInArrow(partial(_frequent, n=n, lower=lower), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_TOTAL).orderBy(F.desc("n"), "h").limit(FREQUENT_MOST)
    )
    frequent = np.sort(np.array([r.h for r in often.collect()], np.int64).view(np.uint64))  # at most FREQUENT_MOST
    shards = max(12, math.ceil(total * 0.9 / SHARD))
    held = spark.sparkContext.broadcast(frequent)
    signed = docs.mapInArrow(partial(_signed, n=n, lower=lower, percent=percent, shards=shards, frequent=held), "shard long, payload binary")
    stars = materialise(signed.groupBy("shard").applyInArrow(_stars, "a long, b long"), "candidates")
    groups = components(stars)
    stand = classes.where("class_id IS NOT NULL").select("class_id", "print1", "n_shingles")
    members = materialise(groups.join(stand, F.col("vertex") == F.col("print1")), "groups")
    tiles = _tiles(members, percent)
    # A sort-merge join at every size: tiles grow with the corpus.
    found = tiles.hint("merge").join(docs, "doc_id").groupBy("component", "t1", "t2").applyInArrow(lambda group: _tile(group, n, lower, percent), "a long, b long, n_links long")
    found = materialise(found, "found")
    joined = components(found.select("a", "b"))
    counts = found.groupBy(F.col("a").alias("class_id")).agg(F.sum("n_links").alias("n_links"))
    known = classes.join(joined, F.col("class_id") == F.col("vertex"), "left").drop("vertex").join(counts, "class_id", "left")
    out = sets.join(known, key, "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "class_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
