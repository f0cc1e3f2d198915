"""Ranked search, fingerprints and the prefix trie against brute force, on odd rows too."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from conftest import SF
from pyspark.sql import functions as F
from test_llm import WORD, families, odd_documents

from fairspark.llm import prefix_trie as trie
from fairspark.llm import queries, ranked_search, simhash

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


@pytest.mark.parametrize("name", ["op11_ranked_search", "op13_prefix_trie"])
def test_queries_equal_their_sql(same, name):
    same(queries.QUERIES[name], queries.SQL[name])


# Ranked search


def found(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_search(docs, items, k=20):
    """Every item's ranked documents; docs and items are lists of (id, text)."""
    counts = [(i, Counter(found(t))) for i, t in docs]
    total, length = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    out = []
    for item, text in items:
        asked, scores = Counter(found(text)), []
        for n, (i, c) in enumerate(counts):
            if not c:
                continue
            m = 75 + (25 * sum(c.values()) * total) // length
            score = sum(q * math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 12 * m)) for w, q in asked.items() if w in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, n, i))
        out += [(item, r, i, -s) for r, (s, _, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def searched(docs, items, k=20):
    return sorted([tuple(r) for r in ranked_search.ranked_search(docs, items, k).collect()], key=str)


@pytest.mark.parametrize(("shard", "block", "broadcast"), [(1 << 19, 1 << 18, 1 << 17), (3000, 400, 0)])
def test_ranked_search_equals_brute_force(spark, monkeypatch, shard, block, broadcast):
    monkeypatch.setattr(ranked_search, "SHARD", shard)
    monkeypatch.setattr(ranked_search, "BLOCK", block)
    monkeypatch.setattr(ranked_search, "BROADCAST", broadcast)
    texts = [*families(3), *families(3)[:9], "Ab-cd 漢字é É 9z", "ab CD_9Z"]
    docs = list(enumerate(texts))
    items = [(i, t) for i, t in enumerate([*texts[:7], "v1 v1 v2 v3", "AB é", "nowhere", "", None, " ".join(f"v{i}" for i in range(900))])]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string").repartition(3)
    assert searched(frame(docs, "doc_id"), frame(items, "item_id"), 5) == brute_search(docs, items, 5)


def test_ranked_search_of_odd_rows(spark):
    docs = odd_documents(spark)
    items = spark.createDataFrame([(1, "same words w5", "x"), (1, "same words w5", "y"), (None, "one no id", "z"), (3, None, "a"), (4, " ", "b")], "item_id long, text string, doc_id string")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    asked = [(r["item_id"], r["text"]) for r in items.collect()]
    assert searched(docs, items) == brute_search(rows, asked)
    assert searched(docs.limit(0), items) == [] and searched(docs, items.limit(0)) == []
    ties = spark.createDataFrame([(i, "tie word") for i in range(60)] + [(99, "other")], "doc_id long, text string")
    assert [r[2] for r in sorted(searched(ties, spark.createDataFrame([(1, "tie")], "item_id long, text string")), key=lambda r: r[1])] == list(range(20))


def test_search_stops_before_the_end():
    rng = np.random.default_rng(0)
    documents, count = 4000, 300
    pairs = np.unique(np.stack([rng.integers(0, documents, 400_000), (rng.pareto(0.7, 400_000) * 3).astype(int).clip(0, count - 1)], 1), axis=0)
    shard = ranked_search.Shard(pairs[:, 0], pairs[:, 1], rng.integers(1, 1_000_000, len(pairs)), documents, count)
    sizes = np.bincount(pairs[:, 1], minlength=count)
    asked = np.array([0, 1, 2, 150, 200, 250])
    weight = (1000 * np.log(2 * documents / (sizes[asked] + 1))).astype(np.int64) + 1
    ids = np.arange(documents)
    got, scores = shard.best(asked, weight, ids, 20)
    whole = np.zeros(documents, np.int64)
    for t, w in zip(asked, weight, strict=True):
        at = shard.by_term[3][t : t + 2]
        whole[shard.by_term[0][at[0] : at[1]]] += w * shard.by_term[1][at[0] : at[1]]
    best = np.lexsort((ids, -whole))[:20]
    assert got.tolist() == best.tolist() and scores.tolist() == whole[best].tolist()
    assert 0 < shard.read < 0.8 * sizes[asked].sum()


# Fingerprints


def plain_print(text):
    """The 128 bits as a whole number, by votes in Python."""
    found = WORD.findall(text.lower())
    seeded = lambda part, *ws: _chain(part, ws)
    votes, weight = [0] * 128, 0
    for w in ([x] for x in found):
        weight += len(w[0])
    for a, b in zip(found, found[1:], strict=False):
        weight += len(a) + len(b)
    for part in range(2):
        for words, value in [((w,), len(w)) for w in found] + [((a, b), len(a) + len(b)) for a, b in zip(found, found[1:], strict=False)]:
            h = seeded(part, *words)
            # A long holds bits i and i + 32 of the hash.
            for bit in range(64):
                votes[64 * part + bit] += value * (h >> bit & 1)
    return sum(1 << i for i, v in enumerate(votes) if 2 * v > weight)


def _chain(part, words):
    """Spark's xxhash64 of an integer and strings: each hashes with the one before as its seed."""
    seed = 42
    seed = _int_hash(part, seed)
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed=seed)
    return seed


def _int_hash(value, seed):
    return xxhash.xxh64_intdigest(value.to_bytes(4, "little"), seed=seed)


def test_fingerprints_equal_plain_votes(spark):
    texts = [*families(1)[:12], "one", "", "a b", "Same same SAME", "é É ß", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    got = {r["key"]: (r["hi"] % (1 << 64)) << 64 | r["lo"] % (1 << 64) for r in simhash.fingerprints(rows, "key").collect()}
    assert got == {i: plain_print(t or "") for i, t in enumerate(texts)}


@pytest.mark.parametrize("radius", [0, 3, 6])
def test_block_tables_find_all_within_the_radius(spark, radius):
    rng = np.random.default_rng(radius)
    base = [int.from_bytes(rng.bytes(16), "little") for _ in range(5)]
    prints = set(base)
    for x in base:
        for _ in range(60):
            y = x
            for bit in rng.choice(128, int(rng.integers(1, radius + 4)), replace=False):
                y ^= 1 << int(bit)
            prints.add(y)
    prints = sorted(prints)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    rows = [(signed(x >> 64), signed(x & (1 << 64) - 1), 1) for x in prints]
    frame = spark.createDataFrame(rows, "hi long, lo long, n long")
    got = [tuple(r)[:5] for r in simhash.within(frame.select("hi", "lo").limit(120), frame, radius).collect()]
    asked = {(r["hi"], r["lo"]) for r in frame.select("hi", "lo").limit(120).collect()}
    whole = {r[:2]: x for r, x in zip(rows, prints, strict=True)}
    brute = [(*q, *f, (whole[q] ^ whole[f]).bit_count()) for q in asked for f in whole if (whole[q] ^ whole[f]).bit_count() <= radius]
    assert sorted(got) == sorted(brute)


def plain_fingerprints(rows, radius=6, every=100):
    """The whole query in Python over (doc_id, text) rows."""
    tie = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), seed=42)) - (1 << 64 if h >> 63 else 0)
    rows = sorted([(i, t or "") for i, t in rows], key=lambda r: (r[0] is None, r[0] or 0, tie(r[1])))
    prints = {t: plain_print(t) for _, t in rows}
    like = lambda a, b: round(max(0.0, math.cos(math.pi * (a ^ b).bit_count() / 128)), 9)
    out = []
    for n, (i, t) in enumerate(rows):
        following, size = rows[(n + 1) % len(rows)][1], len(t) // 4
        edited = t[: len(t) - size] + following[:size]
        own = prints[t]
        near = sum((own ^ prints[u]).bit_count() <= radius for _, u in rows) - 1 if i is not None and i % every == 0 else None
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{own:032x}", f"{plain_print(edited):032x}", like(own, plain_print(edited)), like(own, prints[following]), near))
    return sorted(out, key=str)


def fingerprinted(docs):
    return sorted([(*r[:5], round(r[5], 9), round(r[6], 9), r[7]) for r in map(tuple, simhash.document_fingerprints(docs).collect())], key=str)


def test_document_fingerprints_equal_brute_force(spark):
    texts = [t for t in families(2, groups=5, copies=4) for _ in range(2)]
    rows = [(50 * i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert fingerprinted(docs) == plain_fingerprints(rows)


def test_document_fingerprints_of_odd_rows(spark):
    docs = odd_documents(spark)
    assert fingerprinted(docs) == plain_fingerprints([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert fingerprinted(docs.limit(0)) == []
    one = docs.where("doc_id = 4")
    assert fingerprinted(one) == plain_fingerprints([(4, "one two three")])


def test_fingerprints_of_documents_tell_edits_from_others(spark):
    out = queries.op12_simhash(spark, SF).toPandas()
    assert len(out) == 1000 and (out.near_edited > out.near_next).mean() > 0.99
    equal = spark.read.parquet(f"{SF}/documents.parquet").toPandas().merge(out, on="doc_id").groupby("text").fingerprint.nunique()
    assert (equal == 1).all()


# Prefix trie


def plain_trie(rows, every=100, most=6, rebuild=True):
    """Every node by tuples of whole (role, text); rows (conv_id, turn, role, text)."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in convs.items()}
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % most for c in turns}
        turns = {c: turns.get(c - c % every, [])[: h[c]] + turns[c][h[c] :] for c in turns}
    members = defaultdict(list)
    for c, seq in sorted(turns.items()):
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children, below = Counter(p[:-1] for p in members if p), defaultdict(lambda: [0, 0])
    for p, cs in members.items():
        saved = (len(cs) - 1) * len(p[-1][1]) if p else 0
        for d in range(len(p) + 1):
            below[p[:d]][0] += p not in children
            below[p[:d]][1] += saved
    ends = lambda p: ",".join(str(c) for c in members[p] if len(turns[c]) == len(p))
    return sorted((cs[0], len(p), members[p[:-1]][0] if p else None, len(cs), children[p], *below[p], hashlib.sha256(ends(p).encode()).hexdigest()) for p, cs in members.items()) if members else []


CONV = "conv_id long, turn long, role string, text string, depth int, f string, place long"


def talks(spark, rows):
    return spark.createDataFrame([(*r, 1, "f", 2) for r in rows], CONV).repartition(5)


def built(frame, *args, **kwargs):
    return sorted(tuple(r) for r in trie.prefix_trie(frame, *args, **kwargs).collect())


def shared_talks(seed=0, convs=90):
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.choice(420, convs, replace=False).tolist():
        rows += [(c, t, ["user", "assistant"][t % 2], f"say {rng.integers(3)}" * int(rng.integers(1, 3))) for t in range(int(rng.integers(1, 9)))]
    return rows


@pytest.mark.parametrize("rebuild", [True, False])
def test_trie_equals_brute_force(spark, rebuild):
    rows = shared_talks()
    assert built(talks(spark, rows), *([trie.headed(100, 6)] if rebuild else [])) == plain_trie(rows, rebuild=rebuild)


@pytest.mark.parametrize(("bits", "primes"), [(2, trie.PRIMES), (64, (7, 5)), (3, (3, 2))])
def test_collisions_are_split(spark, bits, primes):
    rows = shared_talks(1, 40)
    assert built(talks(spark, rows), trie.headed(100, 6), bits=bits, primes=primes) == plain_trie(rows)


def test_long_conversations_go_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK_BITS", 2)
    monkeypatch.setattr(trie, "PIECE_BITS", 3)
    rows = [(c, t, "user", f"t{t if t < 40 + c else (t, c)}") for c in (0, 1, 2, 3) for t in range(57 + c % 2)] + [(9, t, "user", f"t{t}") for t in range(40)]
    assert built(talks(spark, rows), trie.headed(100, 6)) == plain_trie(rows)


def test_trie_of_odd_rows(spark):
    rows = [
        (1, 0, "user", "base absent"), (205, 0, None, None), (205, None, "user", "null turn first"), (205, 0, None, None), (200, 1, "user", "b"), (200, 1, "user", "a"), (200, 2, "assistant", ""),
        (None, 0, "user", "no conversation"), (300, 0, "user", "x" * 70_000), (307, 0, "user", "x" * 70_000), (307, 1, "", None), (7, 0, "user", "one"), (7, 0, "user", "one"), (4_000_000_000_000, 5, "é", "漢字"),
    ]
    assert built(talks(spark, rows), trie.headed(100, 6)) == plain_trie(rows)
    assert built(talks(spark, rows)) == plain_trie(rows, rebuild=False)
    assert built(talks(spark, rows).limit(0), trie.headed(100, 6)) == []


def test_hot_conversation_and_first_turn(spark, monkeypatch):
    from fairspark.llm import _spark

    monkeypatch.setattr(_spark, "MANY", 5)
    monkeypatch.setattr(_spark, "SHARE", 50)
    rows = [(c, 0, "user", "hello") for c in range(150)] + [(c, 1, "assistant", f"a{c % 70}") for c in range(150)] + [(33, t, "user", "on and on") for t in range(2, 300)]
    assert built(talks(spark, rows)) == plain_trie(rows, rebuild=False)
    assert built(talks(spark, rows), trie.headed(100, 6)) == plain_trie(rows)
