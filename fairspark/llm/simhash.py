"""SimHash fingerprints of whole texts, and the search for all fingerprints within a Hamming radius.

Terms are the lower-cased words of a text and its pairs of neighbouring words.  A term votes on each of 128 bits, for 1 or
against it as its hash has the bit set or not, by its weight: the characters of its words, so that short common words count
little.  A bit is set where the votes for it outweigh those against it (ties: not set).

Votes are counted two bits to a long: a set bit adds its weight to one half of a sum.  A text's weights stay below three times
its characters, so that a half can't overflow.  All of it is column expressions, and one aggregation that lies where the texts
lie already.

Two fingerprints within 6 bits of each other agree in at least two of eight blocks of 16 bits.  Each of the 28 pairs of blocks
is a table, keyed by the bits of its two blocks; a query meets what shares a key of it, and counts a found one in the first
table that both share only.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairspark.llm._spark import keyed, materialise, placed, words

#: Bits of a fingerprint, in two longs, and half of a long, which one sum's two counters are apart.
BITS, HALF = 128, 32
_PAIR = (1 << HALF) + 1
#: Keys that a table's buckets are dealt over, so that a large family's isn't one task's.
SALTS = 16


def _terms(text: Column) -> Column:
    """Each word with the one after it, null after the last."""
    w = words(F.lower(text))
    return F.arrays_zip(w.alias("word"), F.slice(w, F.lit(2), F.size(w)).alias("after"))


def _votes() -> list[Column]:
    """Sums of weights of set bits, two bits a sum, and of all weights, over rows (word, after)."""
    out = [F.sum(F.col("one") + F.col("two")).alias("weight")]
    for part in range(BITS // 64):
        for i in range(HALF):
            bits = lambda h: F.shiftrightunsigned(F.col(h), i).bitwiseAND(F.lit(_PAIR))  # noqa: B023, E731
            out.append(F.sum(F.col("one") * bits(f"h{part}") + F.col("two") * bits(f"p{part}")).alias(f"v{part}_{i}"))
    return out


def _fingerprint(part: int) -> Column:
    """The 64 bits of one long, from the sums."""
    sums = F.array(*(f"v{part}_{i}" for i in range(HALF)))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))
    low = lambda x, i: F.when(2 * x.bitwiseAND(F.lit((1 << HALF) - 1)) > F.col("weight"), bit(i)).otherwise(F.lit(0).cast("long"))
    high = lambda x, i: F.when(2 * F.shiftrightunsigned(x, HALF) > F.col("weight"), bit(i + HALF)).otherwise(F.lit(0).cast("long"))
    merge = lambda a, x: a.bitwiseOR(x)
    return F.aggregate(F.concat(F.transform(sums, low), F.transform(sums, high)), F.lit(0).cast("long"), merge)


def fingerprints(texts: DataFrame, *keys: str) -> DataFrame:
    """keys, hi and lo: the fingerprint of each text (0 where it has no words or is null), one row a key.

    Where rows lie by one of the keys already, nothing is shuffled.
    """
    rows = texts.select(*keys, F.explode_outer(_terms(F.col("text"))).alias("t")).select(*keys, "t.word", "t.after")
    hashed = rows.select(
        *keys, "word", "after",
        F.coalesce(F.length("word"), F.lit(0)).cast("long").alias("one"), F.coalesce(F.length("word") + F.length("after"), F.lit(0)).cast("long").alias("two"),
        *(F.xxhash64(F.lit(part), "word").alias(f"h{part}") for part in range(2)), *(F.xxhash64(F.lit(part), "word", "after").alias(f"p{part}") for part in range(2)),
    )
    return hashed.groupBy(*keys).agg(*_votes()).select(*keys, _fingerprint(1).alias("hi"), _fingerprint(0).alias("lo"))


def distance(hi: Column, lo: Column, other_hi: Column, other_lo: Column) -> Column:
    """How many bits differ."""
    return F.bit_count(hi.bitwiseXOR(other_hi)) + F.bit_count(lo.bitwiseXOR(other_lo))


def likeness(bits: Column) -> Column:
    """The cosine of the votes that so many differing bits speak for, 0 where it is negative; equal fingerprints have 1."""
    return F.greatest(F.cos(bits * F.lit(math.pi / BITS)), F.lit(0.0))


def as_text(hi: Column, lo: Column) -> Column:
    """32 hexadecimal digits."""
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


#: Bits of a block, and the tables, each the two of the eight blocks that it goes by.
BLOCK, TABLES = 16, list(combinations(range(8), 2))


def _block(hi: Column, lo: Column, i: int) -> Column:
    long, at = (lo, i * BLOCK) if i * BLOCK < 64 else (hi, i * BLOCK - 64)
    return F.shiftrightunsigned(long, at).bitwiseAND(F.lit((1 << BLOCK) - 1))


def _keys(hi: Column, lo: Column) -> Column:
    """Array of each table's key: its number and the bits of its two blocks."""
    return F.array(*(F.lit(t << 2 * BLOCK).bitwiseOR(F.shiftleft(_block(hi, lo, a), BLOCK)).bitwiseOR(_block(hi, lo, b)) for t, (a, b) in enumerate(TABLES)))


def _first_shared(hi: Column, lo: Column) -> Column:
    """The number of the first table that two fingerprints share, from the bits in which they differ."""
    out = F.lit(-1)
    for t, (a, b) in reversed(list(enumerate(TABLES))):
        out = F.when((_block(hi, lo, a) == 0) & (_block(hi, lo, b) == 0), F.lit(t)).otherwise(out)
    return out


def within(queries: DataFrame, found: DataFrame, radius: int = 6) -> DataFrame:
    """(q_hi, q_lo, hi, lo, bits, n): all of found(hi, lo, n) within ``radius`` bits, 6 at most, of each of queries(hi, lo), both distinct.

    Every pair comes once.
    """
    if not 0 <= radius <= len({i for t in TABLES for i in t}) - 2:
        raise ValueError("more bits than blocks that may differ")
    keys = F.explode(_keys(F.col("hi"), F.col("lo"))).alias("bucket")
    left = queries.select(F.col("hi").alias("q_hi"), F.col("lo").alias("q_lo"), keys).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    right = found.select("hi", "lo", "n", keys, F.pmod(F.xxhash64("hi", "lo"), F.lit(SALTS)).cast("int").alias("salt"))
    bits = distance(F.col("q_hi"), F.col("q_lo"), F.col("hi"), F.col("lo"))
    met = left.join(right.hint("merge"), ["bucket", "salt"])
    first = _first_shared(F.col("q_hi").bitwiseXOR(F.col("hi")), F.col("q_lo").bitwiseXOR(F.col("lo")))
    return met.where((bits <= radius) & (first == F.shiftright("bucket", 2 * BLOCK))).select("q_hi", "q_lo", "hi", "lo", bits.alias("bits"), "n")


def edited_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, following) of documents(doc_id, text).

    texts: key, doc_id, text, n_chars and ``edited``, the text with its last quarter (of code points, rounded down) replaced by
    as many of the first of the next document.  following: key and ``next``, the next document's key.  Documents go by
    ascending doc_id, nulls last, rows of one doc_id by a hash of their text; the first follows the last.  Texts travel once
    to their key, and a quarter of them from there.
    """
    base = keyed(docs.select("doc_id", "text"), "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    small = base.select("key", "doc_id", F.length("text").cast("long").alias("n_chars"), F.xxhash64("text").alias("tie"))
    at = placed(small, [F.col("doc_id").asc_nulls_last(), F.col("tie").asc(), F.col("key").asc()], ["key", "doc_id", "n_chars"], "order")
    total = at.count()
    before = at.select(F.pmod(F.col("place") + 1, F.lit(max(total, 1))).alias("place"), F.floor(F.col("n_chars") / 4).alias("need"), F.col("key").alias("before"), "doc_id")
    following = materialise(at.select("place", F.col("key").alias("next")).join(before, "place").select(F.col("before").alias("key"), "doc_id", "next", "need"), "following")
    # Both joins take the same columns of the same rows by the same key, so that texts are shuffled once.
    own = base.select("key", "text")
    heads = own.join(following.select(F.col("next").alias("key"), F.col("key").alias("before"), "doc_id", "need").hint("merge"), "key")
    heads = heads.select(F.col("before").alias("key"), "doc_id", F.substr("text", F.lit(1), F.col("need").cast("int")).alias("head"))
    kept = F.length("text") - F.floor(F.length("text") / 4).cast("int")
    texts = own.join(heads.hint("merge"), "key")
    return texts.select("key", "doc_id", "text", F.length("text").cast("long").alias("n_chars"), F.concat(F.substr("text", F.lit(1), kept), F.col("head")).alias("edited")), following.select("key", "next")


def document_fingerprints(docs: DataFrame, radius: int = 6, every: int = 100) -> DataFrame:
    """One row a document: its fingerprint, its edited text's, how like they and the next document's are, and its near ones.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next as ``likeness``; n_near: how many
    other documents have a fingerprint within ``radius`` bits, for documents whose id is divisible by ``every``, else null.
    A null text is empty; texts without words have a fingerprint of zeros, and are near each other.  Rows of a repeated or
    null doc_id are documents each.  An empty table gives an empty result.
    """
    texts, following = edited_texts(docs)
    both = F.explode(F.array(F.struct(F.lit(False).alias("is_edited"), F.col("text").alias("text")), F.struct(F.lit(True).alias("is_edited"), F.col("edited").alias("text"))))
    rows = texts.select("key", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), both.alias("t")).select("key", "doc_id", "n_chars", "edited_sha256", "t.is_edited", "t.text")
    each = fingerprints(rows, "key", "doc_id", "n_chars", "edited_sha256", "is_edited")
    pick = lambda c, edited: F.max(F.when(F.col("is_edited") == edited, F.col(c)))
    own = each.groupBy("key", "doc_id", "n_chars", "edited_sha256").agg(pick("hi", False).alias("hi"), pick("lo", False).alias("lo"), pick("hi", True).alias("e_hi"), pick("lo", True).alias("e_lo"))
    own = materialise(own, "fingerprints")
    there = own.select(F.col("key").alias("next"), F.col("hi").alias("n_hi"), F.col("lo").alias("n_lo"))
    after = following.join(there.hint("merge"), "next").drop("next")
    asked = own.where(F.col("doc_id") % every == 0).select("key", "hi", "lo")
    near = within(asked.select("hi", "lo").distinct(), own.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n")), radius)
    near = near.groupBy("q_hi", "q_lo").agg(F.sum("n").alias("n")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    asked = asked.select("key", F.col("hi").alias("q_hi"), F.col("lo").alias("q_lo"), F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int").alias("salt"))
    counted = asked.join(near.hint("merge"), ["q_hi", "q_lo", "salt"]).select("key", (F.col("n") - 1).alias("n_near"))
    out = own.join(after.hint("merge"), "key").join(counted.hint("merge"), "key", "left")
    far = lambda hi, lo: likeness(distance(F.col("hi"), F.col("lo"), F.col(hi), F.col(lo)))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("hi"), F.col("lo")).alias("fingerprint"), as_text(F.col("e_hi"), F.col("e_lo")).alias("edited_fingerprint"),
        far("e_hi", "e_lo").alias("near_edited"), far("n_hi", "n_lo").alias("near_next"), "n_near",
    )
