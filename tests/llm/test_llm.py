"""Operators for training data: brute-force versions, round trips, held-out accuracy, and odd inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from fairspark.llm import ann, jaccard_join, language_id, mixing, packing, pii, quality_gam, quality_rules, queries, substring_dedup, warc
from fairspark.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, h int, n long, g string, value double, key string, component long, block int, label int, base string, spans string, epoch int, rank int"


def odd_documents(spark, extra=()):
    """Nulls, blanks, one very long text, ties, repeated rows, and columns with the names of helpers."""
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    texts = [None, "", " \n\t ", "one", "one two three", "Same words here again and again, mail a.b@c.de now.", "Same words here again and again, mail a.b@c.de now.", long, "ß Éa ÇÇ 漢字 漢字 +49 (30) 1234567", "x" * 5000, *extra]
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "src1", "src7", "other"][i % 4], None, "w", 1, 2, "g", 0.5, "k", 3, 4, 5, "b", "s", 6, 7) for i, t in enumerate(texts)]
    rows += [rows[5], (None, "no id but words", None, None, 3, None, None, None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def families(seed=0, groups=12, copies=7):
    """Texts in groups of near copies, with a passage that many share."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"v{i}" for i in range(3000)]
    passage = list(rng.choice(vocabulary, 45))
    out = []
    for _ in range(groups):
        base = list(rng.choice(vocabulary, int(rng.integers(5, 220))))
        for _ in range(copies):
            own = list(base)
            for _ in range(int(rng.integers(0, 6))):
                own[int(rng.integers(len(own)))] = str(rng.choice(vocabulary))
            if rng.random() < 0.4:
                at = int(rng.integers(len(own) + 1))
                own[at:at] = passage
            out.append(" ".join(own))
    return out


def shingles(text, n):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset([tuple(words)] if 0 < len(words) < n else (tuple(words[i : i + n]) for i in range(len(words) - n + 1)))


def brute_components(docs, n, percent):
    sets = {i: shingles(t, n) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = 0
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                links += sets[a] != sets[b]
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_jaccard_join_is_exact(spark, n, percent):
    docs = list(enumerate(families(n)))
    found = jaccard_join.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string"), n, percent).collect()
    expected, sizes = brute_components(docs, n, percent)
    assert {r.doc_id: r.component_id for r in found} == expected
    assert {r.doc_id: r.n_shingles for r in found} == sizes


def test_signatures_meet_for_all_linked_sets():
    """Any two linked sets share a signature that one of them marks, whatever counts as frequent."""
    rng = np.random.default_rng(3)
    for percent in (80, 85):
        for _ in range(60):
            size = int(rng.integers(1, 400))
            base = rng.integers(0, 1 << 62, size).astype(np.uint64)
            other = base.copy()
            for i in rng.choice(size, int(rng.integers(0, max(1, size // 10) + 1)), replace=False):
                other[i] = rng.integers(0, 1 << 62)
            sets = [np.unique(base), np.unique(other[: max(1, size - int(rng.integers(0, size // 12 + 1)))])]
            common = len(np.intersect1d(*sets))
            if len(sets[0]) == len(sets[1]) == common:  # equal sets are one class before signatures
                continue
            if 100 * common < percent * (len(sets[0]) + len(sets[1]) - common):
                continue
            frequent = np.sort(rng.choice(sets[0], len(sets[0]) * int(rng.integers(0, 4)) // 4, replace=False))
            values, first = np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])])
            sig, owner, mark = jaccard_join.signatures(values, first, percent, frequent)
            both = np.intersect1d(sig[owner == 0], sig[owner == 1])
            assert len(np.intersect1d(both, sig[mark]))


def test_components(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (7, 7), (0, 1)], "a long, b long")
    assert {r.vertex: r.component for r in components(links).collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(name, same):
    same(queries.QUERIES[name], queries.SQL[name])


def test_warc_round_trip_and_faults(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"<p>{i % 7}</p>" * (i % 7 * 40)) for i in range(60)] + [(100, None, None), (101, "a b", ""), (None, None, "no number")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/archives"
    assert warc.write_archives(pages, folder, archive_bytes=4000).agg(F.sum("records")).first()[0] == 63
    read = warc.read_archives(spark, folder, payloads=True).collect()
    first = {}
    for page, _, html in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(html or "", page)
    by_page = {r.page_id: r for r in read}
    for page, _, html in rows:
        row, data = by_page[page], (html or "").encode()
        assert (row.payload_bytes, row.payload_digest) == (len(data), warc.sha1_base32(data))
        revisit = page is not None and first[html or ""] != page
        assert (row.record_type, row.refers_to) == (("revisit", first[html or ""]) if revisit else ("response", None))
        assert revisit or bytes(row.payload) == data
    payloads = [f"<html>{i} {'text ' * 300}{i * i}</html>".encode() for i in range(200)]
    archive = warc.Archive(warc.train_dictionary(payloads))
    for i, p in enumerate(payloads):
        archive.add(warc.record(i, "u", p, None, False, "2000-01-01T00:00:00Z"))
    data = archive.bytes()
    assert data[:4] == (0x184D2A5D).to_bytes(4, "little")
    assert [r["payload"] for r in warc.read_archive(data)] == payloads
    for broken in (data[:-3], data[: len(data) // 2] + b"\0" + data[len(data) // 2 + 1 :], data + b"abc", data[:30]):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(broken))
    good = warc.record(1, None, b"abc", None, False, "2000-01-01T00:00:00Z")
    for broken in (good.replace(b"abc\r", b"abd\r"), good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"Date"), good[:-1]):
        with pytest.raises(warc.WarcError):
            warc.parse(broken)


def brute_substrings(docs, window):
    seen, out = set(), {}
    for doc, text in sorted(docs, key=lambda d: d[0]):
        words = WORD.findall(text or "")
        gone = bytearray(len(words))
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone[i : i + window] = b"\1" * window
            seen.add(key)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[doc] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize(("window", "chunk"), [(20, 1 << 21), (20, 800), (4, 3000)])
def test_substring_dedup_is_exact(spark, window, chunk):
    docs = list(enumerate([*families(5), "a b " * 40, "a " * 30, None, ""]))
    out = substring_dedup.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string"), window, chunk_bytes=chunk).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out} == brute_substrings(docs, window)


@pytest.mark.parametrize("chunk", [1 << 21, 1])
def test_substring_dedup_of_repeated_rows(spark, chunk):
    text = lambda k: " ".join(f"{k}{i}" for i in range(30))
    rows = [(1, text("a")), (1, text("a")), (None, text("b")), (None, text("b")), (None, text("b")), (None, "c " + text("a")), (None, text("d"))]
    out = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=chunk).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in out) == [(0, 30, 0), (0, 30, 0), (0, 30, 30), (0, 30, 30), (0, 31, 30), (1, 30, 0), (1, 30, 0)]


def test_mixing_keeps_budgets(spark):
    rows = [(i, "w " * (1 + i % 5), ["en", "de"][i % 2], f"src{i % 7}") for i in range(700)] + [(1000 + i, "w", "en", "src0") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.mix(docs, mixing.domain_of_source(5), budget_share=0.5, epochs=2, weights=({"domain0": 3}, {}, {"src1": 0}))
    total = sum(1 + i % 5 for i in range(700)) + 300
    taken = out.agg(F.sum("_mix_tokens")).first()[0]
    assert total * 0.5 - 40 * 5 <= taken <= total * 0.5
    assert out.where("source = 'src1'").count() == 0
    assert out.groupBy("doc_id", "_mix_epoch").count().where("count > 1").count() == 0
    assert out.where("_mix_epoch = 1").join(out.where("_mix_epoch = 0").select("doc_id"), "doc_id", "left_anti").count() == 0


def test_shortages_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 10), ("a", "x", "2", 1000), ("a", "y", "1", 1000), ("b", "x", "1", 1000)], "_mix_domain string, _mix_lang string, _mix_source string, _mix_tokens long")
    got = {tuple(r)[:3]: r["_mix_leaf_budget"] for r in mixing.leaf_budgets(leaves, 400.0, 1, ({}, {}, {})).collect()}
    assert got == {("a", "x", "1"): 10, ("a", "x", "2"): 90, ("a", "y", "1"): 100, ("b", "x", "1"): 200}


def test_language_id_held_out(spark):
    rows = queries.op6_language_id(spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) > 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rows = queries.op7_quality_classifier(spark, SF).where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in rows) > 0.95 * len(rows)


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    assert quality_gam.fit(x[:5], np.ones(5)).score(x).min() > 0.99
    assert set(quality_gam.fit(x[:0], y[:0]).score(x)) == {0.5}


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 16))
    x[500:900] = x[3]
    x[900:1300] = x[7] + rng.normal(size=(400, 16)) * 0.01
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [None] * 16), (5400, [1.0] * 3), (None, x[0].tolist())]
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0, k=10, candidates=200).collect()
    x = x.astype(np.float32).astype(float)
    hits = total = 0
    for q in range(0, 2000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        expected = [i for i in np.lexsort((np.arange(2000), d)) if i != q][:10]
        own = sorted((r for r in out if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11))
        assert all(r.score == pytest.approx(d[r.vec_id], rel=1e-12) for r in own)
        hits += len({r.vec_id for r in own} & set(expected))
        total += 10
    assert {r.query_id for r in out} == set(range(0, 2000, 100))
    assert hits >= 0.9 * total
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r["rank"]) for r in ann.nearest(few, F.col("vec_id") % 100 == 0).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_packing_against_the_tokenizer(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150).unionByName(odd_documents(spark, ["<|endoftext|> it's <|startoftext|>", "don't WE'LL x.,;''s a*$'t #12,3."]), allowMissingColumns=True)
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    out = packing.best_fit_packing(docs, queries.tokenizer_path(), size=512, per_partition=50).toPandas()
    inner = Tokenizer.from_file(queries.tokenizer_path())
    expected = Counter()
    for doc, text in [(r.doc_id, r.text) for r in docs.collect()]:
        ids = np.array([*inner.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        expected.update((doc, i, a, len(ids[a : a + 512]), zlib.crc32(ids[a : a + 512].tobytes())) for i, a in enumerate(range(0, len(ids), 512)))
    assert texts
    none = lambda x: None if x is None or x != x else int(x)
    assert Counter((none(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out.itertuples()) == expected
    for _, own in out.sort_values("offset").groupby("sequence_id"):
        assert own.length.sum() <= 512
        assert (own.length.cumsum() - own.length == own.offset).all()


@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
@settings(max_examples=60, deadline=None)
def test_packing_bounds(lengths):
    lengths = np.array(lengths)
    bins = packing.best_fit_decreasing(lengths, 100)
    assert np.bincount(bins, weights=lengths).max() <= 100
    assert packing.lower_bound(lengths, 100) <= bins.max() + 1
    assert packing.lower_bound(np.array([51] * 7), 100) == 7


def test_pii_patterns():
    def brute(text):
        out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
        digits = lambda m: re.sub("[^0-9]", "", m[0])
        out += [(2, m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
        return out + [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]

    rng = np.random.default_rng(1)
    pieces = ["a@b", "@", ".c", "x.y@z.de", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 234-5678", "+", "12", " ", "é", "-", "007.1.2.255", "a+b@c-d.e.f"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces, int(rng.integers(0, 9))))
        assert pii.base_spans(text) == brute(text), text


def test_disclosing_terms_and_sanitising(spark):
    rows = [(i, f"Filler{chr(97 + i)} ordinary words. Write to kolumbus ann@site.org today, entry {chr(97 + i) * 5}.", 1) for i in range(5)] + [(10 + i, "Ordinary words today without any.", 2) for i in range(50)] + [(99, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _pii_base int")
    found = {r.doc_id: r for r in pii.pii_spans(docs).collect()}
    text = rows[0][1]
    assert found[0].n_email == 1
    assert {text[t["start"] : t["end"]] for t in found[0].terms} == {"kolumbus", "Write", "entry"}
    assert found[10].terms == []
    assert found[99].base == ""
    clean = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    assert "kolumbus" not in clean[0].text
    assert "[EMAIL]" in clean[0].text
    assert clean[0]["_pii_base"] == 1
    assert clean[10].text == rows[5][1]
    assert len(clean) == len(rows)


def test_terms_of_whole_documents(spark):
    rows = [(i, f"Kolumbus came. {'more filler ' * 60} Mail ann@site.org now. {'more filler ' * 60} Badge x7 for kolumbus, case {i}.") for i in range(5)] + [(10 + i, f"Came more filler mail now badge for case {i}.") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in pii.pii_spans(docs).where("doc_id < 10").collect():
        text = rows[r.doc_id][1]
        assert [text[t["start"] : t["end"]] for t in r.terms] == ["Kolumbus", "x7", "kolumbus"]
    for r in pii.sanitise(docs).where("doc_id < 10").collect():
        assert not re.search("kolumbus|x7", r.text.lower())


def test_terms_of_entities_met_once(spark):
    rows = [(0, "Some common words by Kolumbus, mail ann@site.org now.")] * 2 + [(1, "Some common words by Magellan.")] * 2 + [(i, "Some common words, mail now.") for i in range(2, 1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in pii.pii_spans(docs).where("n_email > 0").collect():
        assert [rows[0][1][t["start"] : t["end"]] for t in r.terms] == ["Kolumbus"]
        assert 0.8 <= r.terms[0]["disclosure"] < 1
    assert {r.text for r in pii.sanitise(docs).where("doc_id = 0").collect()} == {"Some common words by [NAME], mail [EMAIL] now."}


def test_odd_documents_have_results(spark):
    docs = odd_documents(spark)
    n = docs.count()
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    labels = spark.createDataFrame([(3, 1), (4, 0), (5, 1), (6, None), (None, 1), (3, 0)], "doc_id long, label int")
    joined = jaccard_join.jaccard_join(docs, 4, 85)
    assert joined.count() == n
    assert {r.doc_id: r.component_id for r in joined.collect()}[6] == 5
    assert quality_rules.quality_rules(docs).count() == n
    dedup = {(r.doc_id, r.n_words): r for r in substring_dedup.substring_dedup(docs).collect()}
    assert dedup[7, 60_000].n_removed == 60_000 - 997
    assert dedup[0, 0].kept_sha256 == hashlib.sha256(b"").hexdigest()
    # A leaf without tokens has no budget, and none of its documents are taken.
    leaves = docs.select(mixing.domain_of_source(5).alias("d"), "lang", "source", (F.length(F.coalesce(F.trim(F.translate("text", "\n\t", "  ")), F.lit(""))) > 0).alias("some"))
    held = leaves.groupBy("d", "lang", "source").agg(F.count(F.lit(1)).alias("n"), F.bool_or("some").alias("some")).where("some").agg(F.sum("n")).first()[0]
    assert mixing.mix(docs, mixing.domain_of_source(5), budget_share=2.0, epochs=1).count() == held
    languages = {r.doc_id: r.lang_pred for r in language_id.language_id(docs, fold % 3 == 1).collect()}
    assert languages[0] == languages[1] == languages[2] == "und"
    assert quality_gam.quality_scores(docs, labels, fold % 5 == 0).count() == n
    assert quality_gam.keep_good(docs, labels).columns == docs.columns
    assert packing.best_fit_packing(docs, queries.tokenizer_path()).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert pii.pii_spans(docs).count() == n
    assert pii.sanitise(docs).columns == docs.columns


def test_empty_tables(spark):
    docs = odd_documents(spark).limit(0)
    labels = spark.createDataFrame([], "doc_id long, label int")
    assert jaccard_join.jaccard_join(docs).count() == 0
    assert quality_rules.quality_rules(docs).count() == 0
    assert substring_dedup.substring_dedup(docs, keep_text=True).count() == 0
    assert mixing.mix(docs, mixing.domain_of_source(5)).count() == 0
    assert language_id.language_id(docs, F.lit(False)).count() == 0
    assert quality_gam.quality_scores(docs, labels, F.lit(False)).count() == 0
    assert packing.best_fit_packing(docs, queries.tokenizer_path()).count() == 0
    assert pii.pii_spans(docs).count() == 0
    assert pii.sanitise(docs).count() == 0
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_stages_take_odd_documents(spark):
    docs = odd_documents(spark).withColumns({"_mix_tokens": F.lit(1), "_mix_foo": F.lit("x"), "_pii_key": F.lit(2), "a.b": F.lit(3)})
    columns = docs.columns
    for (name, stage), empty in ((s, e) for e in (False, True) for s in corpus_pipeline.STAGES[:-1]):
        own = docs.limit(0) if empty else docs
        out = corpus_pipeline.materialise(stage(spark, own, SF), f"odd-{name}")
        assert out.columns == columns, name
        assert out.count() <= own.count()
        if not empty and name in ("mixture", "personal_data"):
            assert {r["_mix_tokens"] for r in out.collect()} == {1}
    assert corpus_pipeline.packing(spark, docs, SF).count() >= docs.count()


def test_near_duplicates_of_repeated_rows(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(40))
    rows = [(1, text("a")), (1, text("a")), (None, text("a")), (None, text("b") + " x"), (2, text("b")), (None, text("c")), (None, text("c")), (None, text("c") + " x"), (3, text("d")), (3, text("e"))]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert sorted((r.doc_id or 0, r.text[0]) for r in kept.collect()) == [(0, "c"), (1, "a"), (2, "b"), (3, "d"), (3, "e")]


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, corpus_pipeline.materialise(stage(spark, kept, SF), f"test-{name}")
        assert kept.columns == docs.columns
        ids = {r.doc_id for r in kept.select("doc_id").collect()}
        assert 0 < len(ids) == kept.count()
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
        if name == "near_duplicates":
            texts = [(r.doc_id, r.text) for r in kept.collect()]
            components_, _ = brute_components(texts, 5, 80)
            assert all(k == v for k, v in components_.items())
        if name == "personal_data":
            assert not any(pii.base_spans(r.text) and "@" in r.text and re.search(r"[A-Za-z0-9]@[a-z]+\.[a-z]", r.text) for r in kept.collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    columns, rows = rows_of(packed.toPandas())
    assert "sequence_id" in columns
    assert len({r[columns.index("doc_id")] for r in rows}) == kept.count()
