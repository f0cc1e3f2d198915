"""Language identification and the quality classifier against plain versions of their definitions."""

from __future__ import annotations

import math
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from fairspark.llm import language_id, quality_gam


def trigrams(text):
    signs = [ord(c) if c.isalpha() else 0 for c in f"\n{(text or '').lower()}\n"]
    return Counter(tuple(signs[i - 1 : i + 2]) for i in range(1, len(signs) - 1) if signs[i])


def bundled(counts, d):
    total = np.zeros(d)
    for codes, n in counts.items():
        bound = np.ones(d)
        for k, c in enumerate(codes):
            bound *= np.roll(language_id.letter_vector(c, d), 2 - k)
        total += n * bound
    return total


def unit(x):
    n = np.linalg.norm(x)
    return x / n if n else x


def test_language_id_against_plain_python(spark):
    d = 256
    rows = [(r.doc_id, r.text[:400] if r.text else r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(70).collect()]
    rows += [(9000, None, "en"), (9001, "123 -- 4", "fr"), (9002, "漢字と仮名 漢字", "ja"), (9003, "漢字 und Wörter", None), (9004, "", "en")]
    learned = {}
    for i, text, lang in rows:
        if i % 3 and lang and text is not None:
            learned.setdefault(lang, Counter()).update(trigrams(text))
    names = sorted(learned)
    units = [unit(bundled(learned[n], d)) for n in names]
    shared = np.mean(units, axis=0)
    profiles = [unit(u - shared) for u in units]
    found = {r.doc_id: r for r in language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.col("doc_id") % 3 == 0, d).collect()}
    assert len(found) == len(rows)
    for i, text, _ in rows:
        counts = trigrams(text)
        if not counts:
            assert (found[i].lang_pred, found[i].score) == ("und", 0.0)
            continue
        cosines = [float(unit(unit(bundled(counts, d)) - shared) @ p) for p in profiles]
        best = max(cosines)
        assert found[i].score == pytest.approx(min(1, max(0, best)), abs=1e-6)
        assert cosines[names.index(found[i].lang_pred)] == pytest.approx(best, abs=1e-6)


def test_scripts_of_many_letters_stay_small():
    rng = np.random.default_rng(0)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9FA5, 2048))) for _ in range(256)]
    tracemalloc.start()
    rows = 0
    for at, counts, found in language_id.counted(texts):
        assert at == rows
        assert len(counts) == 1 or counts.size <= language_id.CELLS
        assert counts.sum() == 2048 * len(counts)
        language_id.bundle(counts[:2], found[:2048], 64)
        rows += len(counts)
    assert rows == 256
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()


def plain_features(text):
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    n, total, one = len(words), max(len(raw), 1), max(len(words), 1)
    of = lambda chars: sum(raw.count(bytes([c])) for c in chars)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    windows = [tuple(words[i : i + 5]) for i in range(n - 4)]
    letters = max(of(range(65, 91)) + of(range(97, 123)), 1)
    return [
        math.log1p(n), sum(map(len, words)) / one, math.log1p(max(map(len, words), default=0)), of(b"#*$%&<>{}[]\\~^_=@") / total, of(b"|") / one, of(b"!") / one, of(range(65, 91)) / letters, of(range(48, 58)) / total,
        (len(raw) - sum(map(len, words))) / total, len(lines) / one, (len(lines) - len(set(lines))) / max(len(lines), 1), len(set(words)) / one, max(Counter(words).values(), default=0) / one,
        1 - len(set(windows)) / len(windows) if windows else 0.0, of(b".!?") / one, of(b",;:") / one, of(range(128, 256)) / total, sum(x[-1:] in (b".", b"!", b"?", b":", b";", b'"', b"'") for x in lines) / max(len(lines), 1),
    ]


def plain_score(model, x):
    total = model.intercept
    for value, edges, table in zip(x, model.edges, model.tables, strict=True):
        total += table[sum(e <= value for e in edges)]
    for f, g, a, b, table in model.pairs:
        total += table[sum(e <= x[f] for e in a)][sum(e <= x[g] for e in b)]
    return 1 / (1 + math.exp(-max(-30, min(30, total))))


def test_quality_scores_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(250).unionByName(spark.createDataFrame([(90_000, None), (90_001, ""), (90_002, " \n"), (90_003, "a b\n\na b\x0b c. \xa0 ü!")], "doc_id long, text string"), allowMissingColumns=True)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    held_out = F.col("doc_id") % 5 == 0
    model = quality_gam.train(docs, labels.where(~held_out))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality_gam.quality_scores(docs, labels, held_out).collect():
        score = plain_score(model, plain_features(texts[r.doc_id]))
        assert r.score == pytest.approx(score, abs=1e-9), r.doc_id
        assert r.predicted == int(r.score >= 0.3)


def gain(parts, ridge):
    return sum(sum(g) ** 2 / (sum(h) + ridge) for g, h in parts)


def test_boosting_steps_against_every_tree():
    """A tree's first cut is the best of all, and its second the best of either side."""
    rng = np.random.default_rng(1)
    for _ in range(40):
        n = int(rng.integers(2, 9))
        g, h = rng.normal(size=n), rng.random(n) * 5
        whole = gain([(g, h)], 1.0)
        cuts = {c: gain([(g[:c], h[:c]), (g[c:], h[c:])], 1.0) - whole for c in range(1, n) if h[:c].sum() >= 1 and h[c:].sum() >= 1}
        out = quality_gam._leaves(g, h, 1.0, 1.0)
        if not cuts or max(cuts.values()) <= 0:
            assert not out.any()
            continue
        first = max(cuts, key=cuts.get)
        second = {}
        for a, b in ((0, first), (first, n)):
            for c in range(a + 1, b):
                if h[a:c].sum() >= 1 and h[c:b].sum() >= 1:
                    second[c] = gain([(g[a:c], h[a:c]), (g[c:b], h[c:b])], 1.0) - gain([(g[a:b], h[a:b])], 1.0)
        ends = [0, first, n]
        if second and max(second.values()) > 0:
            ends = sorted([*ends, max(second, key=second.get)])
        expected = np.concatenate([np.full(b - a, g[a:b].sum() / (h[a:b].sum() + 1.0)) for a, b in zip(ends, ends[1:], strict=False)])
        assert out == pytest.approx(expected)
        grid, weight = rng.normal(size=(n, 4)), rng.random((n, 4)) * 3
        best = max(((i, j) for i in range(n - 1) for j in range(3)), key=lambda c: gain([(x.ravel(), y.ravel()) for x, y in quarters(grid, weight, *c)], 1.0))
        got, values = quality_gam._quadrants(grid, weight, 1.0)
        assert got == pytest.approx(gain([(x.ravel(), y.ravel()) for x, y in quarters(grid, weight, *best)], 1.0) - gain([(grid.ravel(), weight.ravel())], 1.0))
        assert values[0, 0] == pytest.approx(grid[: best[0] + 1, : best[1] + 1].sum() / (weight[: best[0] + 1, : best[1] + 1].sum() + 1.0))


def quarters(g, h, i, j):
    for a in (slice(None, i + 1), slice(i + 1, None)):
        for b in (slice(None, j + 1), slice(j + 1, None)):
            yield g[a, b], h[a, b]
