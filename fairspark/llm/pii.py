"""Personal data: pattern spans, and terms of the corpus that disclose them.

Base spans come from patterns (email, ip, card, phone).  Then, over the whole corpus, it is counted how many documents
hold each term, each protected entity (a matched value), and both, anywhere in the text.  With IC(e) = -log P(e) and
PMI(e; t) = log P(e, t) / (P(e) P(t)), a term discloses the share PMI / IC of the entity's information: 1 where the term
never occurs without it.  Every place of a term whose share reaches a limit becomes a span of kind ``term`` in the
documents that hold the entity: from ``remove_at`` they are removed, from ``generalise_at`` they are replaced by a class.
A pair met in fewer than ``min_support`` distinct texts is judged by a smoothed P(e | t): each text that is missing counts as
one that has the term, and the entity at its rate in the corpus.  Rare terms of an entity met once are generalised so, and
chance neighbours stay.  A term whose pair has that support and reaches the limit discloses its entity wherever it stands: it
becomes a span in every document of the corpus, with or without a pattern.

A term is a run of letters, digits and underscores, in any case; only runs of one or two ASCII letters are not judged.  A
term is generalised to its class: a number, a code (letters and digits), a name (a capital first) or a word.

Scale: patterns run in one pass over the texts, in Arrow batches; counting terms is a second pass in which each task
sums its own counts before the shuffle; distinct terms and entities of a text are joined by key.  Terms too frequent to
reach the limit with any entity of a text leave before they are paired (a bound, which loses none), and the entities of
one text alone, whose counts are the same, are paired as one.  Well supported terms are looked for in a third pass, which
only sends on words whose hash falls into one of the 2^24 buckets that such terms have (2 MB of bits).  No entity, term or document
list is collected.  Copies of one text are dealt over several keys where spans return to rows.

Defined cases: a null text is empty and has no spans; null doc_ids stay; rows that repeat a text are documents each in
the corpus figures (but one text in min_support) and each get their spans; offsets are code points; an empty table gives an
empty result; further columns are kept by ``sanitise`` and not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairspark.llm._spark import fresh, map_rows, materialise, spread_join

KINDS = ("email", "ip", "card", "phone", "term")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBER = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_TERM = re.compile(r"\w+")
_SHORT = re.compile(r"[A-Za-z]{1,2}")
_DIGITS = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ is tried once, from the start of the run of local characters before it: matches end past their @."""
    at, end = text.find("@"), 0
    allowed = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in allowed:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def _fours(text: str) -> Iterator[list[re.Match]]:
    """Four dotted numbers at a time, from the left of each run of them; each number is read once."""
    run: list[re.Match] = []
    for m in _NUMBER.finditer(text):
        if run and not (m.start() == run[-1].end() + 1 and text[run[-1].end()] == "."):
            run = []
        run.append(m)
        if len(run) == 4:
            yield run
            run = []


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the pattern matches of a text, kinds as numbered in KINDS, in that order."""
    if not _HINT.search(text):
        return []
    found = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if "." in text:
        for four in _fours(text):
            if all(len(p[0].lstrip("0")) <= 3 and int(p[0].lstrip("0") or "0") <= 255 for p in four):
                found.append((1, four[0].start(), four[3].end()))
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", m[0])) <= 15:
                found.append((3, m.start(), m.end()))
    return found


def entity(kind: int, value: str) -> str:
    """The protected entity of a match: written forms of one number are one entity."""
    return f"{KINDS[kind]}:{_DIGITS.sub('', value) if kind in (2, 3) else value.lower()}"


def _terms(text: str) -> set[str]:
    return {w.lower() for w in set(_TERM.findall(text)) if not _SHORT.fullmatch(w)}


def _places(text: str, spans: list[tuple[int, int, int]], only: set[str] | None = None) -> dict[str, list[tuple[int, int]]]:
    """All terms of a text (or some), each with its places that touch no pattern span."""
    taken: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    out: dict[str, list[tuple[int, int]]] = {}
    at = 0
    for m in _TERM.finditer(text):
        a, b = m.span()
        if (only is not None and m[0].lower() not in only) or _SHORT.fullmatch(m[0]):
            continue
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        places = out.setdefault(m[0].lower(), [])
        if at == len(taken) or b <= taken[at][0]:
            places.append((a, b))
    return out


def _md5(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest()


_FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, spans string, text_md5 string, entities array<string>, terms array<string>, starts array<array<int>>, ends array<array<int>>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pattern spans of each row and, where there are any, the distinct entities and terms of the text, with the terms' places."""
    lists = pa.list_(pa.list_(pa.int32()))
    schema = pa.schema(
        [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:4]), ("spans", pa.string()), ("text_md5", pa.string())]
        + [("entities", pa.list_(pa.string())), ("terms", pa.list_(pa.string())), ("starts", lists), ("ends", lists)]
    )
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text or ""
            spans = base_spans(text)
            row = {"doc_id": doc, "spans": ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans), "text_md5": _md5(text)}
            for kind in range(4):
                row[f"n_{KINDS[kind]}"] = sum(k == kind for k, _, _ in spans)
            if spans:
                row["entities"] = sorted({entity(kind, text[a:b]) for kind, a, b in spans})
                places = _places(text, spans)
                row["terms"] = list(places)
                row["starts"] = [[a for a, _ in x] for x in places.values()]
                row["ends"] = [[b for _, b in x] for x in places.values()]
            rows.append(row)
        yield pa.RecordBatch.from_pylist(rows, schema)


#: Distinct terms that a counting task holds before it sends its sums on.
HELD = 200_000


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n): documents that have the term, summed in the task."""
    counts: Counter = Counter()

    def sums() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(_terms(text))
            if len(counts) >= HELD:
                yield sums()
                counts.clear()
    yield sums()


def pattern_spans(docs: DataFrame) -> DataFrame:
    """A row for each of docs(doc_id, text): counts and spans of the patterns, and the terms of texts that have any."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_find, _FOUND)


def disclosing_terms(docs: DataFrame, texts: DataFrame, total: int, min_support: int = 3, generalise_at: float = 0.8) -> DataFrame:
    """(text_md5, term, disclosure, firm) of the terms that reach the limit with an entity of the text.

    texts: the distinct texts that hold entities, with the number n of their rows; total: rows of docs.  Counts are of
    documents; min_support is of distinct texts, so that copies of one text count as one.  firm: the disclosure by pairs
    that have that support, null without any.
    """
    n_all = float(max(total, 1))
    # PMI / IC reaches the limit g only if n_both / n_term >= P(e) ** (1 - g), and n_both <= n_entity.  Smoothing moves the
    # rate towards P(e), so that the bound holds with it.
    most = lambda n: n * F.pow(n_all / n, F.lit(1.0 - generalise_at)) * (1 + 1e-9)
    named = texts.select("text_md5", "n", F.explode("entities").alias("entity"))
    held = named.groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count(F.lit(1)).alias("n_texts"))
    own = F.when(F.col("n_texts") == 1, F.concat(F.lit("text:"), "text_md5")).otherwise(F.col("entity"))
    named = materialise(named.join(held, "entity").select("text_md5", "n", own.alias("entity"), "n_entity").distinct(), "pii-entities")
    bound = named.groupBy("text_md5").agg(F.max(most(F.col("n_entity"))).alias("most"))
    spread = docs.select("text").where("text IS NOT NULL").mapInArrow(_term_counts, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    rare = texts.join(bound, "text_md5").select("text_md5", "most", F.explode("terms").alias("term")).join(spread, "term").where("n_term <= most")
    pairs = rare.join(named, "text_md5").where(F.col("n_term") <= most(F.col("n_entity")))
    pairs = materialise(pairs.select("text_md5", "entity", "term", "n", "n_entity", "n_term"), "pii-pairs")
    counts = pairs.groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count(F.lit(1)).alias("support"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term"))
    # A missing text weighs as much as the pair's others do.
    missing = F.greatest(F.lit(0), min_support - F.col("support")) * F.col("n_both") / F.col("support")
    rate = (F.col("n_both") + missing * F.col("n_entity") / n_all) / (F.col("n_term") + missing)
    ic = F.greatest(F.log(F.lit(max(n_all, 2.0)) / F.col("n_entity")), F.lit(1e-9))
    pmi = F.log(rate * F.lit(max(n_all, 2.0)) / F.col("n_entity"))
    told = counts.select("entity", "term", "support", F.least(F.lit(1.0), pmi / ic).alias("disclosure")).where(F.col("disclosure") >= generalise_at)
    firm = F.max(F.when(F.col("support") >= min_support, F.col("disclosure"))).alias("firm")
    return pairs.join(told, ["entity", "term"]).groupBy("text_md5", "term").agg(F.max("disclosure").alias("disclosure"), firm)


#: Buckets of hashes that tell which texts, and which words, are worth sending on; words' buckets are sent as bits, 2^16 a row.
BUCKETS, WORD_BUCKETS = 1 << 20, 1 << 24


def _bits(group: pa.Table) -> pa.Table:
    bits = np.zeros(1 << 16, np.uint8)
    bits[group.column("b").to_numpy() % (1 << 16)] = 1
    return pa.table({"part": group.column("part")[:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def _hits(batches: Iterator[pa.RecordBatch], buckets) -> Iterator[pa.RecordBatch]:
    """(text_md5, term, starts, ends) of the words of each text whose hash falls into a bucket."""
    schema = pa.schema([("text_md5", pa.string()), ("term", pa.string()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])
    wanted: dict[str, bool] = {}
    table = np.unpackbits(np.frombuffer(buckets.value, np.uint8))

    def is_wanted(word: str) -> bool:
        term = word.lower()
        return not _SHORT.fullmatch(word) and bool(table[zlib.crc32(term.encode("utf-8", "surrogatepass")) % WORD_BUCKETS])

    for batch in batches:
        rows = []
        for text in batch.column(0).to_pylist():
            if len(wanted) > HELD:
                wanted.clear()
            hit = set()
            for word in set(_TERM.findall(text)):
                known = wanted.get(word)
                if known is None:
                    known = wanted[word] = is_wanted(word)
                if known:
                    hit.add(word.lower())
            if hit:
                md5 = _md5(text)
                for term, places in _places(text, base_spans(text), hit).items():
                    if places:
                        rows.append({"text_md5": md5, "term": term, "starts": [a for a, _ in places], "ends": [b for _, b in places]})
        yield pa.RecordBatch.from_pylist(rows, schema)


def _elsewhere(docs: DataFrame, told: DataFrame) -> DataFrame:
    """(text_md5, term, starts, ends, disclosure) of well supported terms in all texts of docs."""
    firm = materialise(told.where("firm IS NOT NULL").groupBy("term").agg(F.max("firm").alias("disclosure")), "pii-firm")
    held = firm.select(F.pmod(F.crc32("term"), F.lit(WORD_BUCKETS)).alias("b")).distinct().withColumn("part", F.shiftright("b", 16).cast("int"))
    bits = bytearray(WORD_BUCKETS // 8)
    for r in held.groupBy("part").applyInArrow(_bits, "part int, bits binary").collect():  # WORD_BUCKETS bits at most
        bits[r.part << 13 : (r.part + 1) << 13] = r.bits
    buckets = docs.sparkSession.sparkContext.broadcast(bytes(bits))
    hits = docs.select("text").where("text IS NOT NULL").mapInArrow(partial(_hits, buckets=buckets), "text_md5 string, term string, starts array<int>, ends array<int>")
    hits = hits.groupBy("text_md5", "term").agg(F.first("starts").alias("starts"), F.first("ends").alias("ends"))
    return hits.join(firm, "term").select("text_md5", "term", "starts", "ends", "disclosure")


def pii_spans(docs: DataFrame, min_support: int = 3, generalise_at: float = 0.8) -> DataFrame:
    """doc_id, counts, base (pattern spans), terms (array of start, end, disclosure) and text_md5 of each row of docs."""
    found = materialise(pattern_spans(docs), "pii-found")
    some = found.where("entities IS NOT NULL")
    texts = materialise(some.groupBy("text_md5").agg(F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("entities", "terms", "starts", "ends"))), "pii-texts")
    total = found.count()
    told = materialise(disclosing_terms(docs, texts, total, min_support, generalise_at), "pii-told")
    placed = texts.select("text_md5", F.explode(F.arrays_zip("terms", "starts", "ends")).alias("t")).select("text_md5", F.col("t.terms").alias("term"), F.col("t.starts").alias("starts"), F.col("t.ends").alias("ends"))
    placed = placed.join(told.select("text_md5", "term", "disclosure"), ["text_md5", "term"]).unionByName(_elsewhere(docs, told))
    each = placed.groupBy("text_md5", "term").agg(F.first("starts").alias("starts"), F.first("ends").alias("ends"), F.max("disclosure").alias("disclosure"))
    spans = F.transform(F.arrays_zip("starts", "ends"), lambda x: F.struct(x["starts"].alias("start"), x["ends"].alias("end"), F.col("disclosure").alias("disclosure")))
    terms = materialise(each.groupBy("text_md5").agg(F.array_sort(F.flatten(F.collect_list(spans))).alias("terms")), "pii-terms")
    rows = found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.col("spans").alias("base"), "text_md5")
    copies = rows.groupBy("text_md5").agg(F.count(F.lit(1)).alias("copies"))
    out = spread_join(rows, copies.join(terms, "text_md5"), "text_md5", "copies", total, F.xxhash64("doc_id"))
    none = F.array().cast("array<struct<start: int, end: int, disclosure: double>>")
    return out.select(*rows.columns, F.coalesce("terms", none).alias("terms"))


def _class(term: str) -> str:
    """What a term is generalised to."""
    if term.isdigit():
        return "[NUMBER]"
    if any(c.isdigit() for c in term):
        return "[CODE]"
    return "[NAME]" if term[0].isupper() else "[WORD]"


def _clean(batches: Iterator[pa.RecordBatch], remove_at: float) -> Iterator[pa.RecordBatch]:
    """Batches of the columns, then the pattern spans and the terms; ``text`` is rewritten."""
    for batch in batches:
        names = batch.schema.names[:-2]
        text_at, out = names.index("text"), []
        for text, base, terms in zip(*(batch.column(i).to_pylist() for i in (text_at, len(names), len(names) + 1)), strict=True):
            if base or terms:
                spans = [(int(a), int(b), f"[{kind.upper()}]") for kind, a, b in (x.split(":") for x in base.split(","))] if base else []
                spans += [(x["start"], x["end"], "" if x["disclosure"] >= remove_at else _class(text[x["start"] : x["end"]])) for x in terms or ()]
                parts, end = [], 0
                for a, b, mark in sorted(spans, key=lambda x: (x[0], -x[1])):
                    if a >= end:
                        parts += [text[end:a], mark]
                        end = b
                    elif b > end:  # spans of two kinds overlap: what is left of the second goes with the first
                        end = b
                text = "".join(parts) + text[end:]
            out.append(text)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == text_at else batch.column(i) for i in range(len(names))], names)


def sanitise(docs: DataFrame, min_support: int = 3, generalise_at: float = 0.8, remove_at: float = 1.0) -> DataFrame:
    """docs with all their columns and rows, personal data in text replaced by [KIND], disclosing terms by their class or nothing.

    n_chars, where there is such a column, follows a text that may have changed.
    """
    names, kinds = docs.columns, dict(docs.dtypes)
    key, by_key, base, terms, copies, bucket = fresh(docs, "_pii_key", "_pii_by", "_pii_base", "_pii_terms", "_pii_copies", "_pii_bucket")
    spans = pii_spans(docs, min_support, generalise_at).where((F.col("base") != "") | (F.size("terms") > 0))
    by_text = materialise(spans.groupBy(F.col("text_md5").alias(by_key)).agg(F.count(F.lit(1)).alias(copies), F.first("base").alias(base), F.first("terms").alias(terms)), "pii-by-text")
    total = by_text.agg(F.sum(copies)).first()[0] or 0
    # Texts that can have no span don't move: those without a digit or @, but for the buckets of texts that have only terms.
    of = lambda x: F.pmod(F.crc32(x), F.lit(BUCKETS))
    buckets = F.broadcast(by_text.where(F.col(base) == "").select(of(F.col(by_key)).alias(bucket)).distinct())  # at most BUCKETS
    keyed = docs.withColumn(key, F.md5(F.coalesce("text", F.lit(""))))
    keyed = keyed.join(buckets, of(F.col(key)) == F.col(bucket), "left")
    may = F.coalesce(F.col("text").rlike("[0-9@]"), F.lit(False)) | F.col(bucket).isNotNull()
    joined = spread_join(keyed.where(may), by_text.withColumnRenamed(by_key, key), key, copies, total, F.xxhash64("doc_id"))
    out = map_rows(joined.select(*(F.col(f"`{c}`") for c in names), base, terms), partial(_clean, remove_at=remove_at), docs)
    out = out.withColumn("n_chars", F.length("text").cast(kinds["n_chars"])) if "n_chars" in names else out
    return out.union(keyed.where(~may).select(*(F.col(f"`{c}`") for c in names)))
