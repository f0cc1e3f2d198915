"""Quality rules with host verdicts.

Each document is judged by five rules.  Two are base rules (too few words; too many words in repeated windows): a document
that fails one goes.  Three are soft (symbols, repeated lines, length of words): alone they can't tell junk from unusual
text.  The failures of each rule are summed by host, and a host's rates are shrunk by a beta prior for each rule, fitted to
all hosts.  A host is judged by what its posterior is nearly sure of: its shrunk rate less ``sure`` standard deviations of the
posterior.  A host for which that passes ``max_host_rate`` in any rule fails with all its documents; one for which it passes
``above`` times the corpus's rate of a soft rule is suspect there, and loses the documents that fail that rule.  So a few bad
documents of a small host condemn nothing, and neither does a large host's rate a little over the corpus's.

The prior of a rule has the mean m of all documents and a strength of 1 / rho - 1, where rho is the correlation of failures
within hosts by the method of moments: with N documents, d of them of a host and H hosts, the scatter sum d (rate - m)^2 has
the expectation m (1 - m) ((H - 1) (1 - rho) + rho (N - sum d^2 / N)).  The first term is what binomial sampling
alone makes; hosts that differ by no more get the upper end of the strength (1 to 1,000,000), and all have the corpus's rate.

Only built-in functions run: word counts and repeated windows are computed inside each row, so that the only shuffles are
the sum by host, which Spark combines before it, and the join of verdicts, whose hosts are dealt over ``SALTS`` keys each.

Defined cases: a null or empty text has no words and fails; a null host is a host of its own; repeated rows count each;
with one host, or where no or every document fails a rule, the prior has its greatest strength; an empty table gives an
empty result; further columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairspark.llm._spark import materialise, words

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
BASE, SOFT = ("short", "repeats"), ("symbols", "lines", "lengths")
#: Keys that a host's verdict is dealt over, so that a host of a third of all documents isn't one task's.
SALTS = 64


def document_rules(docs: DataFrame, min_words: int = 10, max_repeat_percent: int = 20, window: int = 5, host_col: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and fails_<rule> of each row.

    Symbols fail over one in ten words, repeated lines over 30 in a hundred, word lengths with a mean outside 3 to 10.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    first = docs.select(
        "doc_id",
        F.col(host_col).alias("host"),
        F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("words"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    starts = F.sequence(F.lit(0), F.size("words") - window)
    of = lambda i: F.xxhash64(*(F.get("words", i + k) for k in range(window)))
    second = first.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= window, F.transform(starts, of)).otherwise(F.array().cast("array<bigint>")).alias("hashes"),
    )
    # Only texts that repeat a window have theirs sorted, with places, to find those that come twice or more.
    third = second.withColumn("again", F.size("hashes") > F.size(F.array_distinct("hashes")))
    placed = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    fourth = third.withColumn("sorted", F.when(F.col("again"), placed))
    same = lambda x, i: ((i > 0) & (F.get("sorted", i - 1)["h"] == x["h"])) | (F.coalesce(F.get("sorted", i + 1)["h"] == x["h"], F.lit(False)))
    at = F.sort_array(F.transform(F.filter("sorted", same), lambda x: x["i"]))
    fifth = fourth.withColumn("at", at)
    covered = F.aggregate(
        "at",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(window).cast("long"), i + window - a["end"])).alias("n"), (i + window).cast("long").alias("end")),
    )["n"]
    out = fifth.withColumn("n_repeat_words", F.when(F.col("again"), covered).otherwise(F.lit(0)).cast("long"))
    n = F.col("n_words")
    rules = {
        "short": n < min_words,
        "repeats": 100 * F.col("n_repeat_words") > max_repeat_percent * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "lines": 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"),
        "lengths": (F.col("word_chars") < 3 * n) | (F.col("word_chars") > 10 * n),
    }
    return out.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (rules["short"] | rules["repeats"]).alias("base_failed"), *(c.alias(f"fails_{r}") for r, c in rules.items()))


def _strength(docs: Column, squared: Column, hosts: Column, mean: Column, scatter: Column) -> Column:
    """The prior's strength from the number of documents, the sum of squares of hosts' numbers, and sum d (rate - mean)^2."""
    sampling = hosts - 1
    rho = F.try_divide(F.try_divide(scatter, mean * (1 - mean)) - sampling, docs - squared / docs - sampling)
    return F.when(rho > 1e-9, F.least(F.lit(1e6), F.greatest(F.lit(1.0), F.try_divide(1 - rho, rho)))).otherwise(F.lit(1e6))


def host_verdicts(rules: DataFrame, max_host_rate: float = 0.5, sure: float = 3.0, above: float = 1.5) -> DataFrame:
    """host, host_docs, rate_<rule> (shrunk), least_<rule> (what it surely passes), suspect_<rule> of soft rules, and host_ok, one row a host.

    With d documents, f failures and a prior of mean m and strength s the posterior is beta(f + m s, d - f + (1 - m) s).
    """
    names = [*BASE, *SOFT]
    hosts = rules.groupBy("host").agg(F.count(F.lit(1)).cast("double").alias("host_docs"), *(F.count_if(f"fails_{r}").cast("double").alias(f"n_{r}") for r in names))
    d = F.col("host_docs")
    sums = hosts.agg(F.sum(d).alias("docs"), F.sum(d * d).alias("squared"), F.count(F.lit(1)).cast("double").alias("hosts"), *(F.sum(f"n_{r}").alias(f"sum_{r}") for r in names), *(F.sum(F.col(f"n_{r}") * F.col(f"n_{r}") / d).alias(f"square_{r}") for r in names))
    mean = {r: F.col(f"sum_{r}") / F.col("docs") for r in names}
    prior = sums.select(*(mean[r].alias(f"mean_{r}") for r in names), *(_strength(F.col("docs"), F.col("squared"), F.col("hosts"), mean[r], F.col(f"square_{r}") - F.col("docs") * mean[r] * mean[r]).alias(f"strength_{r}") for r in names))
    rate = {r: (F.col(f"n_{r}") + F.col(f"mean_{r}") * F.col(f"strength_{r}")) / (d + F.col(f"strength_{r}")) for r in names}
    least = {r: rate[r] - sure * F.sqrt(rate[r] * (1 - rate[r]) / (d + F.col(f"strength_{r}") + 1)) for r in names}
    judged = hosts.join(F.broadcast(prior)).select(
        "host", F.col("host_docs").cast("long").alias("host_docs"), *(rate[r].alias(f"rate_{r}") for r in names), *(least[r].alias(f"least_{r}") for r in names), *((least[r] > above * F.col(f"mean_{r}")).alias(f"suspect_{r}") for r in SOFT)
    )
    return judged.withColumn("host_ok", F.greatest(*(f"least_{r}" for r in names)) <= max_host_rate)


def quality_rules(docs: DataFrame, min_words: int = 10, max_repeat_percent: int = 20, window: int = 5, host_col: str = "source", max_host_rate: float = 0.5, sure: float = 3.0, above: float = 1.5) -> DataFrame:
    """Per row of docs: doc_id, the figures, base_failed, the rules' failures, the host's rates and verdicts, and kept.

    One row is the prior (an aggregate without keys), so it may be broadcast; the host table is joined by key, as hosts
    grow with the corpus.  The figures of the rows are written to the shared folder, so that texts are read once.
    """
    rules = materialise(document_rules(docs, min_words, max_repeat_percent, window, host_col), "document-rules")
    hosts = host_verdicts(rules, max_host_rate, sure, above).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rules = rules.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    joined = rules.join(hosts, rules["host"].eqNullSafe(hosts["host"]) & (rules["salt"] == hosts["salt"]), "left").drop(hosts["host"]).drop("salt")
    lost = reduce(lambda a, b: a | b, (F.col(f"fails_{r}") & F.col(f"suspect_{r}") for r in SOFT))
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("host_ok") & ~lost)
