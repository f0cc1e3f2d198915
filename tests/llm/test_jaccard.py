"""The n-gram Jaccard join where candidates chain, and components of hot vertices."""

from __future__ import annotations

import numpy as np
import pytest

from fairspark.llm import components as stars
from fairspark.llm import jaccard_join

from test_llm import brute_components, families


def chained(seed=1):
    """Texts that grow from one another, so that candidates chain unlike ones, with families and exact copies between."""
    rng = np.random.default_rng(seed)
    words = [f"c{i}" for i in range(4000)]
    out, text = [], [str(w) for w in rng.choice(words, 30)]
    for _ in range(40):
        out.append(" ".join(text))
        at = int(rng.integers(len(text)))
        text = text[:at] + [str(w) for w in rng.choice(words, int(rng.integers(1, 5)))] + text[at:]
    out += out[5:12] + families(seed, groups=6, copies=9)
    return list(enumerate(out))


@pytest.mark.parametrize("percent", [80, 85])
def test_large_components_are_cut_without_losing_links(spark, monkeypatch, percent):
    monkeypatch.setattr(jaccard_join, "TILE_SHINGLES", 300)
    monkeypatch.setattr(jaccard_join, "TILE_DOCS", 4)
    docs = chained()
    found = jaccard_join.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string"), 3, percent).collect()
    expected, _ = brute_components(docs, 3, percent)
    assert {r.doc_id: r.component_id for r in found} == expected
    assert len(set(expected.values())) < len(docs) - 20


def test_hot_vertices_are_dealt_over_many_keys(spark, monkeypatch):
    monkeypatch.setattr(stars, "MANY", 3)
    monkeypatch.setattr(stars, "SHARE", 20)
    monkeypatch.setattr(stars, "HELD", 7)
    rng = np.random.default_rng(2)
    links = [(500, i) for i in range(60)] + [(i, i + 1000) for i in range(60)] + [(int(a), int(b)) for a, b in rng.integers(2000, 2100, (60, 2))]
    parent = {x: x for e in links for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    found = {r.vertex: r.component for r in stars.components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert found == {x: find(x) for x in linked}
