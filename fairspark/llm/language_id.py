"""Language identification with hyperdimensional profiles.

Each letter has a fixed random vector of +1 and -1; a trigram binds its letters' vectors, rotated by place, by
multiplication; a text is the bundle (sum) of its trigrams, and a language's prototype the bundle of its training texts.
A text has the language whose prototype has the greatest cosine with it, once what all prototypes share (the mean of
their unit vectors) is taken off.

Bundles are sums of whole numbers, so they don't depend on how the corpus is dealt out.  Training returns one vector a
language and task, summed in two steps; the prototypes (one vector a language; languages are few) go to all tasks.

Trigrams are of letters in lower case, with one sign for whatever lies between words.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is any text if nothing was learned; ties
go to the smaller language name; a null lang teaches nothing; rows without doc_id count as an empty id; repeated rows count
each; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairspark.llm._text import stream64

DIMENSIONS = 1024
#: Texts and characters that are handled together, and cells of a table of counts (texts x trigrams), unless one text has more.
TEXTS, CHARACTERS, CELLS = 512, 1 << 20, 1 << 22


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


@lru_cache(maxsize=4096)
def letter_vector(code: int, dimensions: int) -> np.ndarray:
    """+1 and -1, the same for a code point everywhere; 0 stands for what is no letter."""
    bits = np.unpackbits(stream64(-(-dimensions // 64), 7919 * (code + 1)).view(np.uint8))[:dimensions]
    return bits.astype(np.float32) * 2 - 1


def counted(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of texts: the place of the first, counts (texts x trigrams, float32) and the code points of the trigrams (trigrams x 3).

    Texts of scripts with very many letters have few trigrams in common: they are cut into runs of at most CELLS counts.
    """
    at, step = 0, len(texts)
    while at < len(texts):
        found = _trigram_counts(texts[at : at + step])
        if found is None:
            step = max(1, step // 2)
            continue
        yield at, *found
        at += step


def _trigram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
    """Counts and trigrams of texts; None if several texts have more than CELLS counts."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer(("\n" + "\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    signs = np.where(_letters()[codes], codes, 0)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])
    middle = np.flatnonzero(signs[1:-1]) + 1
    owner = owner[middle - 1]
    known = np.flatnonzero(np.bincount(signs, minlength=1))
    place = np.zeros(int(known[-1]) + 1 if len(known) else 1, np.int64)
    place[known] = np.arange(len(known))
    compact, k = place[signs], len(known)
    key = (compact[middle - 1] * k + compact[middle]) * k + compact[middle + 1]
    if k**3 <= 1 << 22:
        found = np.flatnonzero(np.bincount(key, minlength=1))
        rank = np.zeros(k**3, np.int64)
        rank[found] = np.arange(len(found))
        key = rank[key]
    else:
        found, key = np.unique(key, return_inverse=True)
    if not len(key):
        return np.zeros((len(texts), 0), np.float32), np.zeros((0, 3), np.int64)
    if len(texts) > 1 and len(texts) * len(found) > CELLS:
        return None
    counts = np.bincount(owner * len(found) + key, minlength=len(texts) * len(found)).reshape(len(texts), -1)
    return counts.astype(np.float32), known[np.stack([found // (k * k), found // k % k, found % k], 1)]


def bundle(counts: np.ndarray, trigrams: np.ndarray, dimensions: int) -> np.ndarray:
    """Sums of the bound trigram vectors, by row of counts."""
    out = np.zeros((len(counts), dimensions), np.float64)
    codes, index = np.unique(trigrams, return_inverse=True)
    index = index.reshape(trigrams.shape)
    vectors = np.stack([letter_vector(int(c), dimensions) for c in codes]) if len(codes) else np.zeros((0, dimensions), np.float32)
    rotated = [np.roll(vectors, 2 - k, axis=1) for k in range(3)]
    for at in range(0, len(trigrams), 2048):
        part = index[at : at + 2048]
        out += counts[:, at : at + 2048] @ (rotated[0][part[:, 0]] * rotated[1][part[:, 1]] * rotated[2][part[:, 2]])
    return out


def _together(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str]]]:
    """Slices of a batch: where each starts, and its texts."""
    held, size, start = [], 0, 0
    for i, text in enumerate(batch.column(column).to_pylist()):
        held.append(text or "")
        size += len(held[-1])
        if len(held) >= TEXTS or size >= CHARACTERS:
            yield start, held
            held, size, start = [], 0, i + 1
    if held:
        yield start, held


def _learn(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for start, texts in _together(batch, 0):
            for at, counts, trigrams in counted(texts):
                own = np.array(langs[start + at : start + at + len(counts)], object)
                names = sorted(set(own))
                totals = np.stack([counts[own == name].sum(0, dtype=np.float64) for name in names])
                for name, vector in zip(names, bundle(totals, trigrams, dimensions), strict=True):
                    sums[name] = sums.get(name, 0) + vector
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.astype("<f8").tobytes() for v in sums.values()], pa.binary())], ["lang", "bundle"])


def _sum(group: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x, "<f8") for x in group.column("bundle").to_pylist()], axis=0)
    return pa.table({"lang": group.column("lang")[:1], "salt": group.column("salt")[:1], "bundle": pa.array([total.tobytes()], pa.binary())})


def prototypes(docs: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """The bundle of each language of docs(text, lang)."""
    part = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang").mapInArrow(partial(_learn, dimensions=dimensions), "lang string, bundle binary")
    part = part.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    part = part.groupBy("lang", "salt").applyInArrow(_sum, "lang string, salt int, bundle binary")
    part = part.groupBy("lang").applyInArrow(_sum, "lang string, salt int, bundle binary")
    return {r.lang: np.frombuffer(bytes(r.bundle), "<f8") for r in part.collect()}  # one vector a language


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def _predict(batches: Iterator[pa.RecordBatch], dimensions: int, learned) -> Iterator[pa.RecordBatch]:
    names, profiles, shared = learned.value
    for batch in batches:
        found, scores = [], []
        for _, texts in _together(batch, 2):
            for _, counts, trigrams in counted(texts):
                letters = counts.sum(1) > 0
                if not names:
                    letters[:] = False
                else:
                    vectors = _unit(bundle(counts, trigrams, dimensions))
                    cosines = _unit(vectors - shared) @ profiles.T
                    best = cosines.argmax(1)
                found += [names[best[i]] if ok else "und" for i, ok in enumerate(letters)]
                scores += [float(min(1.0, max(0.0, cosines[i, best[i]]))) if ok else 0.0 for i, ok in enumerate(letters)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])


def language_id(docs: DataFrame, held_out: F.Column, dimensions: int = DIMENSIONS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of docs(doc_id, text, lang); held_out: rows that nothing is learned from."""
    spark = docs.sparkSession
    learned = prototypes(docs.where(~held_out), dimensions)
    names = sorted(learned)
    units = _unit(np.stack([learned[n] for n in names])) if names else np.zeros((0, dimensions))
    shared = units.mean(0) if len(names) > 1 else np.zeros(dimensions)
    held = spark.sparkContext.broadcast((names, _unit(units - shared), shared))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    return rows.mapInArrow(partial(_predict, dimensions=dimensions, learned=held), "doc_id long, held_out boolean, lang_pred string, score double")
