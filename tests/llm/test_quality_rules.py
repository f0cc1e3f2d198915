"""Host verdicts: against plain Python, on tables where hosts fail, and that they change documents of the provided table."""

from __future__ import annotations

import re

import numpy as np
from conftest import SF
from pyspark.sql import functions as F

from fairspark.llm import quality_rules

CLEAN = "one plain line of some common words that says nothing at all here"
RULES = ("short", "repeats", "symbols", "lines", "lengths")


def failures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {g for g in grams if grams.count(g) > 1}
    repeated = {i + k for i, g in enumerate(grams) if g in twice for k in range(5)}
    n, chars = len(words), sum(map(len, words))
    return n < 10, 100 * len(repeated) > 20 * n, 10 * len(re.findall(r"[#*$%&|<>]", text)) > n, 100 * (len(lines) - len(set(lines))) > 30 * len(lines), chars < 3 * n or chars > 10 * n


def brute(rows, limit=0.5):
    """kept of each (doc_id, text, host)."""
    found = {i: failures(t) for i, t, _ in rows}
    hosts = {}
    for i, _, h in rows:
        hosts.setdefault(h, []).append(found[i])
    rates, least, means = {h: [] for h in hosts}, {h: [] for h in hosts}, []
    for r in range(5):
        sizes = {h: (len(x), sum(f[r] for f in x)) for h, x in hosts.items()}
        n, count = sum(d for d, _ in sizes.values()), len(sizes)
        mean = sum(f for _, f in sizes.values()) / n
        means.append(mean)
        strength = 1e6
        below = n - sum(d * d for d, _ in sizes.values()) / n - (count - 1)
        if 0 < mean < 1 and below:
            rho = (sum(d * (f / d - mean) ** 2 for d, f in sizes.values()) / (mean * (1 - mean)) - (count - 1)) / below
            strength = min(1e6, max(1.0, (1 - rho) / rho)) if rho > 1e-9 else 1e6
        for h, (d, f) in sizes.items():
            rate = (f + mean * strength) / (d + strength)
            rates[h].append(rate)
            least[h].append(rate - 3 * (rate * (1 - rate) / (d + strength + 1)) ** 0.5)
    out = {}
    for i, _, h in rows:
        f = found[i]
        out[i] = not (f[0] or f[1]) and max(least[h]) <= limit and not any(f[r] and least[h][r] > 1.5 * means[r] for r in (2, 3, 4))
    return out, rates


def corpus():
    junk, lines, tiny = CLEAN + " ### *** %%% $$$", "\n".join([CLEAN, CLEAN, "another line of words", CLEAN]), "few words"
    rows = []
    for host, n, kinds in (("good", 60, {}), ("bad", 50, {tiny: 40}), ("symbols", 40, {junk: 20}), ("clean", 80, {junk: 2, lines: 1}), ("small", 1, {tiny: 1}), (None, 12, {lines: 8, "x" * 200 + " " + CLEAN: 2})):
        texts = [t for t, k in kinds.items() for _ in range(k)]
        texts += [f"{CLEAN} number {i}" for i in range(n - len(texts))]
        rows += [(len(rows) + i, t, host) for i, t in enumerate(texts)]
    return [*rows, (9000, None, "good"), (9001, "", "good"), (9002, " \n\t", None)]


def test_verdicts_against_plain_python(spark):
    rows = corpus()
    out = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    kept, rates = brute(rows)
    assert {r.doc_id: r.kept for r in out} == kept
    for r in out:
        assert all(abs(r[f"rate_{rule}"] - rates[r.host][k]) < 1e-9 for k, rule in enumerate(RULES))
    hosts = {r.host: r for r in out}
    assert {h for h in hosts if not hosts[h].host_ok} == {"bad"}
    assert hosts["symbols"].suspect_symbols and hosts[None].suspect_lines
    assert not hosts["clean"].suspect_symbols
    assert sum(r.kept for r in out if r.host == "clean" and r.fails_symbols) == 2


def test_the_prior_decides_where_raw_rates_would_not(spark):
    """A small host that looks worse than a large bad one is spared, and the large one caught; raw rates have it the other way round."""
    junk = CLEAN + " ### *** %%% $$$"
    hosts = {f"plain{k}": (100, 3) for k in range(30)} | {"small": (2, 2), "large": (900, 400)}
    rows = [(len(hosts) * 1000 * k + i, junk if i < bad else f"{CLEAN} number {i}", h) for k, (h, (n, bad)) in enumerate(hosts.items()) for i in range(n)]
    out = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("fails_symbols").groupBy("host").agg(F.bool_and("kept").alias("kept"), F.first("suspect_symbols").alias("suspect")).collect()
    found = {r.host: r for r in out}
    assert hosts["small"][1] / hosts["small"][0] > hosts["large"][1] / hosts["large"][0]
    assert found["small"].kept and not found["small"].suspect
    assert found["large"].suspect and not found["large"].kept
    assert all(found[h].kept for h in hosts if h.startswith("plain"))


def test_noise_condemns_nobody(spark):
    rng = np.random.default_rng(0)
    junk = CLEAN + " ### *** %%% $$$"
    rows = [(i, junk if rng.random() < 0.07 else CLEAN, f"host{i % 40}") for i in range(4000)]
    out = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert out.where("suspect_symbols OR NOT host_ok OR NOT kept").count() == 0


def test_equal_hosts_have_the_rate_of_the_corpus(spark):
    rows = [(i, "few" if i % 10 == 0 else CLEAN, f"host{i // 10 % 7}") for i in range(700)]
    out = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert out.select(F.max(F.abs(F.col("rate_short") - 0.1))).first()[0] < 1e-9


def test_hosts_of_the_provided_table_differ_by_noise_only(spark):
    out = quality_rules.quality_rules(spark.read.parquet(f"{SF}/documents.parquet"))
    assert out.where("suspect_symbols OR suspect_lines OR suspect_lengths OR NOT host_ok").count() == 0
    assert out.where(F.col("kept") == F.col("base_failed")).count() == 0
