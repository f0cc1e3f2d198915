"""Ranked lexical search, score at a time over impact-ordered postings.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, only A-Z lower-cased.  A posting's impact is the
whole number that its document adds to a query per weight of its term.  Postings of the queries' terms are dealt over shards of
documents.  In a shard, each term's postings lie by descending impact, those of one impact together.  A query adds whole groups
of one impact, greatest additions first, to its documents' sums, until what is left of all its terms is less than the k-th
greatest sum: no other document can come that far.  Those that still can, by their sums and what is left, get their complete
scores from the shard's postings by document, and the shard's best k go to the others'.  Nothing is left out on the way, so
that the result is that of scoring everything.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairspark.llm._spark import keyed, materialise

#: Postings of a shard and term rows of a block of queries, both on average; terms of the queries that may be broadcast, and
#: keys that they are dealt over beyond that.
SHARD, BLOCK, BROADCAST, SALTS = 1 << 19, 1 << 18, 1 << 17, 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text: Column) -> Column:
    """Array of the terms of a text, in order, with repeats; null gives none."""
    found = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
    return F.filter(found, lambda x: x != "")


def postings(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(key, doc_id, n, term, tf) of vocabulary(term) in documents(key, doc_id, text); n counts all of a document's terms."""
    tokens = docs.select("key", "doc_id", terms(F.col("text")).alias("w")).select("key", "doc_id", F.size("w").cast("long").alias("n"), F.explode("w").alias("term"))
    counted = lambda df: df.groupBy("key", "doc_id", "n", "term").agg(F.count(F.lit(1)).alias("tf"))
    if vocabulary.count() <= BROADCAST:
        return counted(tokens.join(F.broadcast(vocabulary), "term", "left_semi"))
    dealt = vocabulary.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = counted(tokens).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    return salted.join(dealt.hint("merge"), ["term", "salt"], "left_semi").drop("salt")


def impact(tf: Column, n: Column, documents: int, length: int) -> Column:
    """(10^9 tf) div (1000 tf + 12 m), m = 75 + (25 n N) div L; n N may pass 64 bits, so that it is taken as a decimal."""
    m = F.lit(75) + F.call_function("div", F.lit(25).cast("decimal(2,0)") * n.cast("decimal(18,0)") * F.lit(documents).cast("decimal(18,0)"), F.lit(max(length, 1)).cast("decimal(18,0)"))
    return F.call_function("div", F.lit(1_000_000_000).cast("long") * tf, F.lit(1000) * tf + F.lit(12) * m)


class Shard:
    """Postings of some documents, by term with descending impact, and by document."""

    def __init__(self, document: np.ndarray, term: np.ndarray, impact: np.ndarray, documents: int, terms: int) -> None:
        self.documents, self.terms = documents, terms
        order = np.lexsort((-impact, term))
        self.by_term = (document[order], impact[order], -impact[order], np.searchsorted(term[order], np.arange(terms + 1)))
        order = np.argsort(document, kind="stable")
        self.by_document = (term[order], impact[order], np.searchsorted(document[order], np.arange(documents + 1)))
        self.read = 0

    def complete(self, documents: np.ndarray, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Whole scores of documents, each of which has a posting."""
        weights = np.zeros(self.terms, np.int64)
        weights[term] = weight
        terms, impacts, first = self.by_document
        sizes = first[documents + 1] - first[documents]
        starts = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) - np.repeat(starts, sizes) + np.repeat(first[documents], sizes)
        return np.add.reduceat(weights[terms[at]] * impacts[at], starts)

    def best(self, term: np.ndarray, weight: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k greatest scores above 0, ties to the smaller of ids; terms differ, weights are above 0."""
        documents, impacts, negated, first = self.by_term
        at, end = first[term].copy(), first[term + 1]
        sums = np.zeros(self.documents, np.int64)
        left = np.array([w * impacts[a] if a < e else 0 for w, a, e in zip(weight, at, end, strict=True)], np.int64)
        while left.any():
            level = max(int(left.max()) // 2, 1)
            for j in np.flatnonzero(left >= level):
                least = -(-level // int(weight[j]))  # additions of at least the level: whole groups of one impact
                to = at[j] + int(np.searchsorted(negated[at[j] : end[j]], -least, side="right"))
                sums[documents[at[j] : to]] += weight[j] * impacts[at[j] : to]
                self.read += int(to - at[j])
                at[j] = to
                left[j] = weight[j] * impacts[to] if to < end[j] else 0
            rest = int(left.sum())
            kth = int(np.partition(sums, -k)[-k]) if len(sums) >= k else 0
            if kth > rest:
                able = np.flatnonzero(sums + rest >= kth)
                if not rest or len(able) <= 4 * k:
                    break
        else:
            able = np.flatnonzero(sums)
        if not len(able):
            return able, sums[:0]
        scores = self.complete(able, term, weight)
        able, scores = able[scores > 0], scores[scores > 0]
        order = np.lexsort((ids[able], -scores))[:k]
        return able[order], scores[order]


def _search(k: int):
    empty = pa.table({"item": pa.array([], pa.int64()), "key": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})

    def search(found: pa.Table, asked: pa.Table) -> pa.Table:
        if not found.num_rows or not asked.num_rows:
            return empty
        words = pc.unique(found.column("term"))
        term = pc.index_in(found.column("term"), value_set=words).to_numpy()
        keys, rows, document = np.unique(found.column("key").to_numpy(), return_index=True, return_inverse=True)
        names = found.column("doc_id").take(pa.array(rows)).combine_chunks()
        # Ties go to the smaller doc_id, those without come last, then by key.
        ranks = np.empty(len(keys), np.int64)
        ranks[np.lexsort((keys, names.fill_null(0).to_numpy(zero_copy_only=False), names.is_null().to_numpy(zero_copy_only=False)))] = np.arange(len(keys))
        shard = Shard(document, term, found.column("impact").to_numpy(), len(keys), len(words))
        code = pc.index_in(asked.column("term"), value_set=words)
        asked = asked.append_column("code", code).filter(pc.is_valid(code)).sort_by("item")
        items, code, weight = (asked.column(c).to_numpy() for c in ("item", "code", "weight"))
        edges = np.flatnonzero(np.append(np.append(True, items[1:] != items[:-1]), True)) if len(items) else np.zeros(1, np.int64)
        out = [(items[a], *shard.best(code[a:b], weight[a:b], ranks, k)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        if not out:
            return empty
        chosen = np.concatenate([d for _, d, _ in out])
        return pa.table({"item": np.repeat([i for i, *_ in out], [len(d) for _, d, _ in out]), "key": keys[chosen], "doc_id": names.take(pa.array(chosen)), "score": np.concatenate([s for *_, s in out])})

    return search


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k documents of greatest score above 0, equal scores by ascending doc_id.

    docs: doc_id, text; items: item_id, text; other columns take no part.  A null text has no terms, and neither an item nor a
    document without terms is in the result; rows of a repeated or null id are documents, or items, each (null ids come last in
    ties).  An empty table on either side gives an empty result.
    """
    number = docs.schema["doc_id"].dataType
    docs, items = keyed(docs, "doc_id", "text"), keyed(items, "item_id", "text").withColumnRenamed("key", "item")
    documents, length = docs.select(F.size(terms(F.col("text"))).alias("n")).agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    asked = items.select("item", F.explode(terms(F.col("text"))).alias("term")).groupBy("item", "term").agg(F.count(F.lit(1)).alias("times"))
    asked = materialise(asked, "asked")
    found = materialise(postings(docs, asked.select("term").distinct()), "postings")
    frequency = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2 * documents + 2)).cast("double") / (2 * F.col("df") + 1)))
    weighed = materialise(asked.join(frequency, "term").select("item", "term", (F.col("times") * weight).alias("weight")).where("weight > 0"), "weighed")
    shards, blocks = (max(1, -(-n // size)) for n, size in ((found.count(), SHARD), (weighed.count(), BLOCK)))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = found.select(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), each(blocks).alias("block"), "key", F.col("doc_id").cast("long").alias("doc_id"), "term", impact(F.col("tf"), F.col("n"), documents, length).alias("impact"))
    right = weighed.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")).withColumn("shard", each(shards))
    best = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(lambda f, a: _search(k)(f.select(["key", "doc_id", "term", "impact"]), a.select(["item", "term", "weight"])), "item long, key long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "key"))
    best = best.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(items.select("item", "item_id"), "item").select("item_id", "rank", F.col("doc_id").cast(number).alias("doc_id"), "score")
