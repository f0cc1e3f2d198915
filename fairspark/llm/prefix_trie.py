"""The trie of conversations' prefixes: how many conversations share each, and what sharing saves.

Turns are put in order and told apart by a number of their (role, text), which is made exact: numbers that two contents share
are split.  A numpy scan gives each prefix a polynomial fingerprint, two sums of t(i) b^i modulo primes, over chunks of
CHUNK turns, to which the sums of a conversation's earlier chunks are added, so that a conversation of any length is spread.

Prefixes of one length and fingerprint are candidates.  The members' last turns are compared with those of the group's
representative (its least and greatest content are one), in each group of each length: two unlike prefixes of one fingerprint
have one fingerprint still without a last turn that they share, so that they meet, at some length, in a group of unlike turns.
The conversations of such a group are told apart from there on by a sum beside the fingerprint, until no group is mixed.

The representative is the smallest member, which then represents all further prefixes of its conversation too.  What a subtree
holds is therefore a sum over the members of its top: each adds what of its own conversation it represents itself.  So the
rollup to parents takes one aggregation at any depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairspark.llm._spark import discard, materialise, placed, spread_join
from fairspark.llm._text import mix64

#: Turns of a chunk as a power of two; primes and bases of the fingerprint's sums; conversation numbers of a piece of a list.
CHUNK_BITS, PRIMES, BASES, PIECE_BITS = 12, (2147483647, 2147483629), (1566083941, 1812433253), 16
NODE = ["depth", "f", "alt"]


def _contents(turns: DataFrame, bits: int) -> DataFrame:
    """turns with ``content``, a hash of (role, text), and ``variant``, which tells contents of one hash apart."""
    content = F.xxhash64("role", "text")
    turns = turns.withColumn("content", content if bits >= 64 else F.pmod(content, F.lit(1 << bits)))
    both = turns.groupBy("content").agg(*(f(c).alias(f"{n}_{c}") for c in ("role", "text") for n, f in (("lo", F.min), ("hi", F.max))))
    shared = materialise(both.where("lo_role <> hi_role OR lo_text <> hi_text").select("content"), "shared-contents")
    if shared.isEmpty():
        return turns.withColumn("variant", F.lit(0))
    unlike = turns.join(shared, "content", "left_semi").select("content", "role", "text").distinct()
    unlike = unlike.withColumn("variant", F.row_number().over(Window.partitionBy("content").orderBy("role", "text")))
    return turns.join(unlike, ["content", "role", "text"], "left").withColumn("variant", F.coalesce("variant", F.lit(0)))


def ordered(conversations: DataFrame, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(turns, convs): (conv_id, content, variant, length, place) in one order of all, and each conversation's first place and number of turns."""
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = _contents(turns, bits).withColumn("length", F.length("text").cast("long"))
    # Ranges of this order are sampled through the driver, so that texts enter it by a bounded part and a hash.
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.left("role", F.lit(32)), F.left("text", F.lit(32)), F.xxhash64("role", "text")]
    at = placed(turns, order, ["conv_id", "content", "variant", "length"], "turns")
    convs = materialise(at.groupBy("conv_id").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")), "conversations")
    return at, convs


def same(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each conversation as it is: (conv_id, depth, content, variant, length, turns) and (conv_id, turns)."""
    rows = spread_join(turns, convs.withColumn("turns", F.col("n")), "conv_id", "n", turns.count(), F.xxhash64("place"))
    return rows.select("conv_id", (F.col("place") - F.col("first") + 1).alias("depth"), "content", "variant", "length", "turns"), convs.select("conv_id", F.col("n").alias("turns"))


def headed(every: int, most: int) -> Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]:
    """Rebuilds conversations c: the first h turns of conversation c - c % every, h the crc32 of c modulo ``most``, then c's own after its first h."""

    def rebuild(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
        base = F.col("conv_id") - F.col("conv_id") % every
        info = convs.select("conv_id", "first", "n", F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most)).alias("h"), base.alias("base"))
        bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
        taken = F.least("h", F.coalesce("base_n", F.lit(0)))
        info = info.join(bases.hint("merge"), "base", "left").select("conv_id", "first", "n", "h", "base", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("turns"))
        info = materialise(info, "rebuilt")
        rows = spread_join(turns, info.withColumn("size", F.col("n")), "conv_id", "size", turns.count(), F.xxhash64("place")).withColumn("at", F.col("place") - F.col("first") + 1)
        what = ["content", "variant", "length"]
        own = rows.where(F.col("at") > F.col("h")).select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("depth"), *what, "turns")
        heads = rows.where((F.col("conv_id") == F.col("base")) & (F.col("at") < most)).select(F.col("conv_id").alias("base"), F.col("at").alias("depth"), *what)
        lent = heads.join(info.where("taken > 0").select("conv_id", "base", "taken", "turns").hint("merge"), "base").where(F.col("depth") <= F.col("taken")).select("conv_id", "depth", *what, "turns")
        return own.union(lent), info.select("conv_id", "turns")

    return rebuild


def _powers(base: int, exponents: np.ndarray, prime: int) -> np.ndarray:
    """base ** exponents modulo a prime below 2^31, element by element."""
    out, square, left = np.ones(len(exponents), np.uint64), base % prime, exponents.astype(np.uint64)
    while left.any():
        odd = (left & np.uint64(1)).astype(bool)
        out[odd] = out[odd] * np.uint64(square) % np.uint64(prime)
        left, square = left >> np.uint64(1), square * square % prime
    return out


def _scanner(primes: tuple[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Running sums of each chunk, over batches sorted by (conv_id, chunk, depth)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, [0, 0, 0]
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, chunk, depth, content, variant, length = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("conv_id", "chunk", "depth", "content", "variant", "length"))
            new = np.ones(len(conv), bool)
            new[1:] = (conv[1:] != conv[:-1]) | (chunk[1:] != chunk[:-1])
            new[0] = key != (conv[0], chunk[0])
            t = mix64(content.astype(np.uint64) + (variant.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            starts = np.flatnonzero(new)
            which = np.cumsum(new) - 1
            sums, each = [], []
            for i, prime in enumerate((*primes, 0)):
                value = t % np.uint64(prime) * _powers(BASES[i], depth, prime) % np.uint64(prime) if prime else length.astype(np.uint64)
                total = np.cumsum(value)
                shift = np.concatenate([total[starts] - value[starts], np.zeros(1, np.uint64)])  # the last one for rows that go on
                run = total - shift[which] + np.where(which < 0, np.uint64(held[i]), np.uint64(0))
                run = run % np.uint64(prime) if prime else run
                held[i] = int(run[-1])
                sums.append(run.astype(np.int64))
                each.append(value.astype(np.int64))
            key = (conv[-1], chunk[-1])
            arrays = [batch.column(c) for c in ("conv_id", "chunk", "depth", "content", "variant", "length", "turns")]
            yield pa.RecordBatch.from_arrays([*arrays, *map(pa.array, (*sums, each[0], each[1]))], ["conv_id", "chunk", "depth", "content", "variant", "length", "turns", "s0", "s1", "chars", "v0", "v1"])

    return scan


def _fingerprinted(rows: DataFrame, primes: tuple[int, int]) -> DataFrame:
    """rows with f, the fingerprint of the prefix that ends with a turn, g, that of the one before, and ``before``, its code points."""
    rows = rows.select("conv_id", F.shiftright("depth", CHUNK_BITS).alias("chunk"), F.col("depth").cast("long").alias("depth"), "content", F.col("variant").cast("int").alias("variant"), "length", F.col("turns").cast("long").alias("turns"))
    dealt = rows.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "depth")
    schema = "conv_id long, chunk long, depth long, content long, variant int, length long, turns long, s0 long, s1 long, chars long, v0 long, v1 long"
    scanned = materialise(dealt.mapInArrow(_scanner(primes), schema), "scanned")
    last = scanned.where(F.col("depth").bitwiseAND(F.lit((1 << CHUNK_BITS) - 1)) == (1 << CHUNK_BITS) - 1)
    upto = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    earlier = last.select("conv_id", (F.col("chunk") + 1).alias("chunk"), *(F.sum(c).over(upto).alias(f"o_{c}") for c in ("s0", "s1", "chars")))
    joined = scanned.join(earlier, ["conv_id", "chunk"], "left")
    full = [(F.col(f"s{i}") + F.coalesce(f"o_s{i}", F.lit(0))) % p for i, p in enumerate(primes)]
    less = [(full[i] - F.col(f"v{i}") + p) % p for i, p in enumerate(primes)]
    packed = lambda x: x[0] + F.shiftleft(x[1], 31)
    return joined.select("conv_id", "depth", "content", "variant", "length", "turns", packed(full).alias("f"), packed(less).alias("g"), (F.col("chars") + F.coalesce("o_chars", F.lit(0)) - F.col("length")).alias("before"))


def _groups(rows: DataFrame) -> DataFrame:
    """One row a candidate group, with its smallest member and its least and greatest last turn."""
    ends = [f(c).alias(f"{n}_{c}") for c in ("content", "variant") for n, f in (("lo", F.min), ("hi", F.max))]
    return rows.groupBy(*NODE).agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("turns").alias("longest"), F.min("g").alias("g"), F.min("above").alias("above"), F.max("above").alias("hi_above"),
        F.max("length").alias("length"), F.max("before").alias("before"), *ends,
    )


def _told_apart(rows: DataFrame, mixed: DataFrame, attempt: int) -> DataFrame:
    """rows whose ``alt`` also tells the turns of mixed groups apart, in them and in all that follows."""
    marks = rows.join(mixed.select(*NODE), NODE, "left_semi").select("conv_id", "depth", F.pmod(F.xxhash64(F.lit(attempt), "depth", "content", "variant", "above"), F.lit(1 << 40)).alias("mark"))
    whose = marks.select("conv_id").distinct()
    touched = rows.join(whose, "conv_id", "left_semi").join(marks, ["conv_id", "depth"], "left").withColumn("mark", F.coalesce("mark", F.lit(0)))
    # Window by conversation: only those with a collision come here.
    upto = F.sum("mark").over(Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0))
    touched = touched.withColumn("upto", upto).withColumn("alt", F.col("alt") + F.col("upto")).withColumn("above", F.col("above") + F.col("upto") - F.col("mark"))
    return materialise(rows.join(whose, "conv_id", "left_anti").select(*rows.columns).union(touched.select(*rows.columns)), "told-apart")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which come sorted; holds one piece at a time."""
    key, sha = None, None
    for batch in batches:
        out = []
        for *node, piece in zip(*(batch.column(c).to_pylist() for c in (*NODE, "piece")), strict=True):
            if node == key:
                sha.update(b"," + piece.encode())
                continue
            if key is not None:
                out.append((*key, sha.hexdigest()))
            key, sha = node, hashlib.sha256(piece.encode())
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip((*NODE, "ends_sha256"), r, strict=True)) for r in out])
    if key is not None:
        yield pa.RecordBatch.from_pylist([dict(zip((*NODE, "ends_sha256"), (*key, sha.hexdigest()), strict=True))])


def prefix_trie(conversations: DataFrame, rebuild: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]] = same, bits: int = 64, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """One row a node, a distinct sequence of first turns (role, text), from the textless root at depth 0.

    conversations: conv_id, turn, role, text; turns go by turn, null first, rows of one turn by the first 32 characters of role
    and text and then by a hash of them; a null role or text is empty; repeated rows are turns each; rows without conv_id take
    no part; other columns neither.  An empty table has no node.  rebuild changes what conversations consist of.

    conv_id: smallest member; depth; parent_conv_id: the parent's smallest member, null for the root; n_convs: members;
    n_children; n_leaves: childless nodes of the subtree; saved_tokens: over the subtree, (members - 1) times code points of the
    last turn; ends_sha256: of the members that end here, ascending, with commas.
    """
    turns, convs = ordered(conversations, bits)
    rows, convs = rebuild(turns, convs)
    rows = _fingerprinted(rows, primes)
    root = convs.select("conv_id", *(F.lit(0).cast(t).alias(c) for c, t in (("depth", "long"), ("content", "long"), ("variant", "int"), ("length", "long"))), F.col("turns").cast("long").alias("turns"), *(F.lit(0).cast("long").alias(c) for c in ("f", "g", "before")))
    rows = rows.unionByName(root).withColumn("alt", F.lit(0).cast("long")).withColumn("above", F.lit(0).cast("long"))
    attempt = 0
    while True:
        nodes = materialise(_groups(rows), "nodes")
        mixed = nodes.where("lo_content <> hi_content OR lo_variant <> hi_variant OR above <> hi_above")
        if mixed.isEmpty():
            break
        attempt += 1
        rows = _told_apart(rows, mixed, attempt)
        discard(nodes)
    nodes = nodes.withColumn("leaf", (F.col("longest") == F.col("depth")).cast("long"))

    own = nodes.groupBy("conv_id").agg(F.min("depth").alias("from"), F.min_by("before", "depth").alias("upto"), F.sum("leaf").alias("leaf"))
    lengths = rows.groupBy("conv_id").agg(F.max(F.col("before") + F.col("length")).alias("chars"), F.max("turns").alias("all"), F.count(F.lit(1)).alias("size"))
    share = lengths.join(own.hint("merge"), "conv_id", "left").select("conv_id", "size", F.coalesce("from", F.col("all") + 1).alias("from"), F.coalesce("upto", "chars").alias("upto"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    share = materialise(share, "shares")
    total = share.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    members = spread_join(rows.select("conv_id", *NODE, "before"), share, "conv_id", "size", total, F.xxhash64(*NODE))
    saved = F.when(F.col("depth") < F.col("from"), F.col("upto") - F.col("before")).otherwise(F.lit(0))
    rollup = members.groupBy(*NODE).agg(F.sum("leaf").alias("n_leaves"), F.sum(saved).alias("saved_tokens"))

    pieces = rows.where("depth = turns").groupBy(*NODE, F.shiftright("conv_id", PIECE_BITS).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("piece"))
    ends = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "block").mapInArrow(_digests, "depth long, f long, alt long, ends_sha256 string")

    up = F.struct(F.col("depth") - 1, F.col("g"), F.col("above")).alias("up")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("g").alias("f"), F.col("above").alias("alt")).agg(F.count(F.lit(1)).alias("n_children"))
    out = nodes.join(rollup.hint("merge"), NODE).join(children.hint("merge"), NODE, "left").join(ends.hint("merge"), NODE, "left")
    out = out.withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    out = materialise(out.select(*NODE, "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), up), "trie")
    parents = out.where("n_children > 0").select(F.struct("depth", "f", "alt").alias("up"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("size"))
    with_parent = spread_join(out, parents, "up", "size", out.count(), F.xxhash64(*NODE))
    return with_parent.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
