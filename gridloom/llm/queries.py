"""Queries over the corpus operators, one for each, with the parameters meant for production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import byte_bpe, exact_dedup, language_id, lm_scoring, mixing, near_dedup, quality_classifier, quality_rules, sharding, url_filter
from gridloom.llm._shared import table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_filter(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (h)
"""


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = bpe_vocabulary()
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), path, pattern).drop("lossless")


def bpe_vocabulary() -> tuple[str, str]:
    """The public rank file and its split pattern; the file lies at the same place on every worker."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), weights=(1, 2, 3))
    return out.select("doc_id", "size", "source_size", "target", "taken")


URL_RULES = (
    url_filter.UrlRule("allow", "org", "/"),
    url_filter.UrlRule("block", "example.org", "/es/"),
    url_filter.UrlRule("block", "example.org", "/en/1"),
    url_filter.UrlRule("allow", "com", "/fr/"),
    url_filter.UrlRule("block", "com", "/de/"),
)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


_OP7_STRENGTH = """SELECT 1.0 / greatest(least(coalesce(((r - b * p) / nullif(p * (1 - p), 0) - (g - 1)) / nullif(m - q / nullif(m, 0) - (g - 1), 0), 0.0), 0.5), 0.000001) - 1.0 AS s, coalesce(p, 0.0) AS p
FROM (SELECT *, b / nullif(m, 0) AS p FROM (SELECT CAST(count(*) AS DOUBLE) AS g, CAST(coalesce(sum(n), 0) AS DOUBLE) AS m, CAST(coalesce(sum(k), 0) AS DOUBLE) AS b,
  CAST(coalesce(sum(n * n), 0) AS DOUBLE) AS q, coalesce(sum(CAST(k AS DOUBLE) * k / n), 0.0) AS r FROM {0} WHERE n > 0))"""
OP7_SQL = rf"""
WITH u AS (SELECT page_id, url, coalesce(instr(url, '://'), 0) AS pos FROM pages),
v AS (SELECT page_id, pos, regexp_extract(substr(url, pos + 3), '^[^/?#]*') AS raw, substr(url, pos + 3) AS rest FROM u),
w AS (SELECT page_id, CASE WHEN pos > 0 THEN translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
             CASE WHEN pos > 0 THEN regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') ELSE '' END AS path FROM v),
o AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
h0 AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k, array_to_string(list_slice(string_split(host, '.'), -2, NULL), '.') AS pair FROM w LEFT JOIN o USING (page_id) GROUP BY host),
h AS (SELECT host, n, k, CASE WHEN pair IN {url_filter.LONG_SUFFIXES} THEN array_to_string(list_slice(string_split(host, '.'), -3, NULL), '.') ELSE pair END AS domain,
             CASE WHEN pair IN {url_filter.LONG_SUFFIXES} THEN pair ELSE list_extract(string_split(host, '.'), -1) END AS suffix FROM h0),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY domain, suffix),
x AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY suffix),
xr AS (SELECT suffix, (k + s * p) / (n + s) AS xrate FROM x, ({_OP7_STRENGTH.format("x")})),
dr AS (SELECT domain, suffix, (k + s * xrate) / (n + s) AS drate FROM d JOIN xr USING (suffix), (SELECT s FROM ({_OP7_STRENGTH.format("d")}))),
hr AS (SELECT host, n, s, (k + s * drate) / (n + s) AS rate FROM h JOIN dr USING (domain, suffix), (SELECT s FROM ({_OP7_STRENGTH.format("h")}))),
f AS (SELECT page_id, host, path, rate - 1.645 * sqrt(rate * (1 - rate) / (n + s + 1)) AS bound,
             CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                  WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
                  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
                  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
                  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
      FROM w LEFT JOIN hr USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict FROM f
"""


def fold(folds: int, held_out: int) -> Column:
    """Whether the CRC-32 of the id's decimal text leaves the remainder ``held_out``; a null id is in no fold that is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held_out, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(3, 1)
    content = language_id.train(docs, ~held_out)
    out = language_id.identify(docs, content)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(7, 2)
    out = lm_scoring.score(docs, ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(4, 2)
    stats = quality_classifier.document_statistics(table(spark, sf_dir, "documents"))
    model = quality_classifier.fit(stats, table(spark, sf_dir, "labels"), ~held_out)
    return quality_classifier.classify(stats, model, 0.7).select("doc_id", held_out.alias("held_out"), "score", "predicted")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
p AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM p),
c AS (SELECT doc_id, count(DISTINCT j) AS n_rep FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n >= 2) GROUP BY doc_id),
s AS (SELECT d.doc_id, text, w, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_rep, 0) AS BIGINT) AS n_repeat_words
      FROM d LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed,
             n_symbols * 10 > n_words OR n_dup_lines * 2 > n_lines OR word_chars < n_words * 3 OR word_chars > n_words * 12
             OR len(regexp_extract_all(text, '!')) * 5 > n_words
             OR len(regexp_extract_all(text, '\p{Lu}\p{Lu}')) * 2 > n_words
             OR len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) * 10 < n_words * 8 AS rejected
      FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM b
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_near_dedup, op2_quality_rules, op3_exact_dedup, op4_sharding, op5_byte_bpe, op6_mixing, op7_url_filter, op8_language_id, op9_lm_scoring, op10_quality_classifier)}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": OP2_SQL, "op3_exact_dedup": OP3_SQL, "op7_url_filter": OP7_SQL}
