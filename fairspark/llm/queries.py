"""The registered queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairspark.llm._spark import table
from fairspark.llm.ann import nearest
from fairspark.llm.jaccard_join import jaccard_join
from fairspark.llm.language_id import language_id
from fairspark.llm.mixing import domain_of_source, mix
from fairspark.llm.packing import best_fit_packing
from fairspark.llm.pii import pii_spans
from fairspark.llm.prefix_trie import headed, prefix_trie
from fairspark.llm.quality_gam import quality_scores
from fairspark.llm.quality_rules import quality_rules
from fairspark.llm.ranked_search import ranked_search
from fairspark.llm.simhash import document_fingerprints
from fairspark.llm.substring_dedup import substring_dedup
from fairspark.llm.warc import round_trip


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), n=4, percent=85, lower=True).select("doc_id", "n_shingles", "component_id")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"), least=0)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), window=20)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: Weights of op5 by domain and language; sources weigh the same.
MIX_WEIGHTS = ({"domain0": 3, "domain1": 2, "domain2": 2, "domain3": 1}, {"en": 4, "de": 2, "fr": 2, "es": 2}, {})


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"), domain_of_source(5), budget_share=0.9, epochs=2, seed="7", weights=MIX_WEIGHTS)
    return out.select("doc_id", F.col("_mix_domain").alias("domain"), "lang", "source", F.col("_mix_epoch").alias("epoch"), F.col("_mix_tokens").alias("n_tokens"))


def _fold(n: int) -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"), _fold(3) == 1)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality_scores(table(spark, sf_dir, "documents"), labels, _fold(5) == 0)


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, candidates=300)


def tokenizer_path() -> str:
    """The file of the public tokenizer, which every executor has too."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_path(), size=4096, end_id=1, remember=1_000_000)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii_spans(table(spark, sf_dir, "documents"))
    terms = F.array_join(F.transform("terms", lambda x: F.format_string("term:%d:%d", x["start"], x["end"])), ",")
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.size("terms") > 0, terms))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), spans.alias("spans"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(table(spark, sf_dir, "documents"), radius=6, every=100)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"), headed(every=100, most=6))


OP2_SQL = r"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
base AS (
  SELECT doc_id, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines, words FROM w),
gram AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5) t),
twice AS (SELECT doc_id, g FROM gram GROUP BY doc_id, g HAVING count(*) > 1),
hit AS (SELECT gram.doc_id, i, lag(i) OVER (PARTITION BY gram.doc_id ORDER BY i) AS prev FROM gram JOIN twice ON gram.doc_id = twice.doc_id AND gram.g = twice.g),
rep AS (SELECT doc_id, sum(least(5, i - coalesce(prev, i - 5)))::BIGINT AS n FROM hit GROUP BY doc_id),
judged AS (
  SELECT base.doc_id, source, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM base LEFT JOIN rep ON base.doc_id = rep.doc_id),
fails AS (
  SELECT *, n_words < 10 AS short, 100 * n_repeat_words > 20 * n_words AS repeats, 10 * n_symbols > n_words AS symbols, 100 * n_dup_lines > 30 * n_lines AS lines,
    word_chars < 3 * n_words OR word_chars > 10 * n_words AS lengths FROM judged),
long AS (SELECT source, rule, failed FROM fails UNPIVOT (failed FOR rule IN (short, repeats, symbols, lines, lengths))),
host AS (SELECT source, rule, count(*)::DOUBLE AS d, sum(failed::INT)::DOUBLE AS f FROM long GROUP BY source, rule),
m AS (SELECT rule, sum(d) AS n, sum(d * d) AS dd, count(*)::DOUBLE AS h, sum(f) / sum(d) AS mean, sum(f * f / d) AS ff FROM host GROUP BY rule),
c AS (SELECT *, ((ff - n * mean * mean) / nullif(mean * (1 - mean), 0) - (h - 1)) / nullif(n - dd / n - (h - 1), 0) AS rho FROM m),
prior AS (SELECT rule, mean, CASE WHEN rho > 1e-9 THEN least(1e6, greatest(1.0, (1 - rho) / rho)) ELSE 1e6 END AS s FROM c),
rate AS (SELECT source, rule, mean, d + s AS n, (f + mean * s) / (d + s) AS rate FROM host JOIN prior USING (rule)),
sure AS (SELECT *, rate - 3 * sqrt(rate * (1 - rate) / (n + 1)) AS least FROM rate),
verdict AS (
  SELECT source, max(least) <= 0.5 AS ok, bool_or(rule = 'symbols' AND least > 1.5 * mean) AS symbols, bool_or(rule = 'lines' AND least > 1.5 * mean) AS lines,
    bool_or(rule = 'lengths' AND least > 1.5 * mean) AS lengths FROM sure GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeats AS base_failed,
  NOT (short OR repeats) AND ok AND NOT ((fails.symbols AND verdict.symbols) OR (fails.lines AND verdict.lines) OR (fails.lengths AND verdict.lengths)) AS kept
FROM fails JOIN verdict ON fails.source IS NOT DISTINCT FROM verdict.source
"""



OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM w WHERE len(words) > 0) t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(least.b, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN least ON least.a = w.doc_id
"""

#: 160 bits of SHA-1 as 32 digits of five bits.
OP3_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p),
bits AS (SELECT *, array_to_string([substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * strpos('0123456789abcdef', substr(hex, i, 1)) - 3, 4) for i in range(1, 41)], '') AS b FROM d)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(b, 5 * i + 1, 1)::INT + 8 * substr(b, 5 * i + 2, 1)::INT + 4 * substr(b, 5 * i + 3, 1)::INT + 2 * substr(b, 5 * i + 4, 1)::INT + substr(b, 5 * i + 5, 1)::INT, 1) for i in range(0, 32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM bits
"""

OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w WHERE len(words) >= 20) t),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM r WHERE k > 1),
each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM w),
kept AS (SELECT each.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY each.k) AS text FROM each LEFT JOIN gone ON each.doc_id = gone.doc_id AND each.k = gone.k WHERE gone.k IS NULL GROUP BY each.doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""


def _level_sql(level: str, parents: list[str], weight: str) -> str:
    """CTEs that share a parent's budget among a level's nodes."""
    keys = [*parents, level]
    part = f"PARTITION BY {', '.join(parents)}" if parents else ""
    above = f"JOIN given_{len(parents)} g ON {' AND '.join(f'n.{p} IS NOT DISTINCT FROM g.{p}' for p in parents)}" if parents else "CROSS JOIN (SELECT budget AS given FROM root) g"
    d = len(keys)
    return f"""
node_{d} AS (SELECT {', '.join(keys)}, sum(capacity) AS capacity, {weight} AS weight FROM leaf GROUP BY {', '.join(keys)}),
ratio_{d} AS (SELECT n.*, g.given AS budget, n.capacity / n.weight AS ratio FROM node_{d} n {above}),
run_{d} AS (
  SELECT *, coalesce(sum(capacity) OVER before, 0.0) AS smaller, coalesce(sum(weight) OVER before, 0.0) AS lighter, sum(weight) OVER ({part}) AS everything
  FROM ratio_{d} WINDOW before AS ({part} ORDER BY ratio, {level} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
full_{d} AS (SELECT *, ratio * (everything - lighter) <= budget - smaller AS is_full FROM run_{d}),
split_{d} AS (
  SELECT *, coalesce(sum(CASE WHEN is_full THEN capacity END) OVER ({part}), 0.0) AS taken, coalesce(sum(CASE WHEN NOT is_full THEN weight END) OVER ({part}), 0.0) AS heavy FROM full_{d}),
given_{d} AS (SELECT {', '.join(keys)}, CASE WHEN is_full THEN capacity ELSE (budget - taken) * weight / heavy END AS given FROM split_{d})"""


OP5_SQL = rf"""
WITH doc AS (
  SELECT doc_id, lang, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens,
    CASE WHEN regexp_matches(source, '[0-9]+$') THEN 'domain' || (CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) // 5)::VARCHAR ELSE 'other' END AS domain
  FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::DOUBLE * 2 AS capacity FROM doc GROUP BY domain, lang, source),
root AS (SELECT floor(sum(n_tokens)::DOUBLE * 0.9) AS budget FROM doc),
{_level_sql('domain', [], "CASE domain WHEN 'domain0' THEN 3.0 WHEN 'domain1' THEN 2.0 WHEN 'domain2' THEN 2.0 ELSE 1.0 END::DOUBLE")},
{_level_sql('lang', ['domain'], "CASE lang WHEN 'en' THEN 4.0 WHEN 'de' THEN 2.0 WHEN 'fr' THEN 2.0 WHEN 'es' THEN 2.0 ELSE 1.0 END::DOUBLE")},
{_level_sql('source', ['domain', 'lang'], "1.0::DOUBLE")},
epoch AS (SELECT doc.*, e AS epoch, md5('7:' || e::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '')) AS place FROM doc CROSS JOIN (VALUES (0), (1)) t(e)),
upto AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY epoch, place) AS upto FROM epoch)
SELECT doc_id, u.domain, u.lang, u.source, u.epoch::INTEGER AS epoch, n_tokens FROM upto u
JOIN given_3 g ON u.domain = g.domain AND u.lang IS NOT DISTINCT FROM g.lang AND u.source IS NOT DISTINCT FROM g.source
WHERE upto <= floor(g.given + 1e-6) AND floor(g.given + 1e-6) > 0
"""

OP11_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY item_id, term),
stat AS (SELECT count(*) FILTER (len(w) > 0) AS n, sum(len(w))::BIGINT AS l FROM d),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) t GROUP BY doc_id, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
weighed AS (SELECT item_id, q.term, times * floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM q JOIN f ON q.term = f.term, stat),
m AS (SELECT doc_id, 75 + (25 * len(w)::BIGINT * n) // l AS m FROM d, stat WHERE len(w) > 0),
s AS (
  SELECT item_id, p.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM weighed JOIN p ON weighed.term = p.term JOIN m ON m.doc_id = p.doc_id GROUP BY item_id, p.doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""

#: crc32 bit by bit: a value of 0 to 255 is a byte to take in, -1 a step.
OP13_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, xor(list_reduce(list_concat([4294967295::BIGINT], flatten([[ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split(conv_id::VARCHAR, '')])),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t) x),
r AS (
  SELECT c.conv_id, i AS k, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND i <= h
  UNION ALL SELECT c.conv_id, i + 10 AS k, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND i > h),
s AS (SELECT c.conv_id, coalesce(list({'role': role, 'text': text} ORDER BY k) FILTER (k IS NOT NULL), []) AS seq FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
m AS (SELECT conv_id, len(seq) AS n, depth, seq[1:depth] AS prefix FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS depth FROM s) x),
node AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) = depth AS leaf, CASE WHEN depth = 0 THEN 0 ELSE length(prefix[depth]['text']) END AS chars,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends
  FROM m GROUP BY prefix, depth),
below AS (
  SELECT x.prefix, x.depth, count(*) FILTER (y.leaf) AS n_leaves, sum((y.n_convs - 1) * y.chars) AS saved, count(*) FILTER (y.depth = x.depth + 1) AS n_children
  FROM node x JOIN node y ON y.depth >= x.depth AND y.prefix[1:x.depth] = x.prefix GROUP BY x.prefix, x.depth)
SELECT node.conv_id, node.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, node.n_convs, below.n_children, below.n_leaves, below.saved::BIGINT AS saved_tokens, node.ends AS ends_sha256
FROM node JOIN below ON below.depth = node.depth AND below.prefix = node.prefix
LEFT JOIN node p ON p.depth = node.depth - 1 AND p.prefix = node.prefix[1:node.depth - 1]
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_quality_rules": op2_quality_rules,
    "op3_warc": op3_warc,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_mixing": op5_mixing,
    "op6_language_id": op6_language_id,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_ann": op8_ann,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_pii": op10_pii,
    "op11_ranked_search": op11_ranked_search,
    "op12_simhash": op12_simhash,
    "op13_prefix_trie": op13_prefix_trie,
}

SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": OP1_SQL,
    "op3_warc": OP3_SQL,
    "op4_substring_dedup": OP4_SQL,
    "op2_quality_rules": OP2_SQL,
    "op5_mixing": OP5_SQL,
    "op11_ranked_search": OP11_SQL,
    "op13_prefix_trie": OP13_SQL,
}
