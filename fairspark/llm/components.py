"""Connected components of a link table, by alternating large-star and small-star steps.

Links are first contracted where they lie: each task replaces those that it holds by a star for each of its own components.
Then each step is a minimum by key (combined before its shuffle) joined back to the links; a vertex with very many links
is dealt over ``SALTS`` keys in that join.  Nothing is collected but one row of counts.  Each round is written to the shared
folder, so that lineage stays short and a lost executor costs a round; the round before is deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairspark.llm._spark import discard, materialise

#: Links that a task contracts together; keys that a vertex of many links is dealt over, and what counts as many: more
#: than MANY, and more than one in SHARE of all links, so that there are never more than 2 SHARE such vertices.
HELD, SALTS, MANY, SHARE = 1 << 21, 64, 1000, 10_000


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct vertices of links u-v and the smallest vertex that each reaches."""
    names, index = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = index[: len(u)], index[len(u) :]
    root = np.arange(len(names))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return names, names[root]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def stars() -> pa.RecordBatch:
        vertex, root = roots(*(np.concatenate(x) for x in zip(*held, strict=True)))
        other = vertex != root
        return pa.RecordBatch.from_arrays([pa.array(vertex[other]), pa.array(root[other])], ["u", "v"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size >= HELD:
            yield stars()
            held, size = [], 0
    if held:
        yield stars()


def _star(both: DataFrame, many: int) -> DataFrame:
    """(u, v, m) of all rows, m the smallest v of each u, or u itself."""
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    heavy = F.broadcast(least.where(F.col("n") > many).select(F.col("u").alias("heavy")))  # at most 2 SHARE
    dealt = both.join(heavy, F.col("u") == F.col("heavy"), "left")
    dealt = dealt.select("u", "v", F.when(F.col("heavy").isNotNull(), F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).otherwise(0).alias("salt"))
    salts = F.when(F.col("n") > many, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(least.select("u", "m", F.explode(salts).alias("salt")), ["u", "salt"]).drop("salt")


def components(links: DataFrame) -> DataFrame:
    """vertex and component (its smallest vertex) of every vertex of links(a, b), longs without nulls; both ways count once.

    An empty table gives an empty result; loops and repeated links change nothing.
    """
    edges = materialise(links.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")).where("u <> v").mapInArrow(_contracted, "u long, v long").distinct(), "links")
    state = lambda: edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = state()
    while before[0]:
        many = max(MANY, before[0] // SHARE)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, many).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _star(large, many)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        last, edges = edges, materialise(small, "stars")
        discard(last)
        after = state()
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())
