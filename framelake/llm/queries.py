"""The corpus operators as queries over the driver's tables, and what SQL can say about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import conversations, curve, decontam, langid, licenses, mixing, names, pii, quality, simhash, substring, token_counts, toxicity
from framelake.llm.common import documents


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(spark, documents(spark, sf_dir))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.cluster(spark, documents(spark, sf_dir))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark, documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.predict(spark, docs, toxicity.train(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(spark, documents(spark, sf_dir)).withColumn("spans", F.array_join("spans", ",")).drop("factors")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.search(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.histogram(spark, token_counts.lengths(spark, documents(spark, sf_dir)))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.predict(spark, docs, langid.train(spark, docs))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(spark, documents(spark, sf_dir))


def op11_name_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    clients, vendors = spark.read.parquet(f"{sf_dir}/clients.parquet"), spark.read.parquet(f"{sf_dir}/vendors.parquet")
    misspelt = vendors.select("vendor_id", names.compared(names.misspelt(F.col("name"), F.col("vendor_id"))).alias("name"))
    return names.matches(clients.select("client_id", names.compared(F.col("name")).alias("name")), misspelt).drop("compared_name")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digest(spark, conversations.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve.plan(spark, documents(spark, sf_dir))


def pii_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op1 that SQL can express."""
    return op1_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6 that SQL can express."""
    return op6_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10 that SQL can express."""
    return op10_quality(spark, sf_dir).select("doc_id", *quality.STATS, "base_failed")


OPERATORS = (op1_pii, op2_simhash, op3_licenses, op4_toxicity, op5_substring_dedup, op6_mixing, op7_decontamination, op8_token_counts, op9_language_id, op10_quality, op11_name_join, op12_conversations, op13_sharding)
QUERIES = {f.__name__: f for f in (*OPERATORS, pii_base_counts, mixing_targets, quality_base_counts)}

BASE_COUNTS = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
ips AS (SELECT r, count(*) AS n FROM (SELECT r, unnest(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)')) AS m FROM docs)
  WHERE len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(ltrim(p, '0') AS INTEGER), 0) > 255)) = 0 GROUP BY r),
runs AS (SELECT r, unnest(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+')) AS m FROM docs),
numbers AS (SELECT r, string_split(reverse(regexp_replace(m, '[^0-9]', '', 'g')), '') AS d FROM runs),
cards AS (SELECT r, count(*) AS n FROM numbers WHERE len(d) BETWEEN 12 AND 19
  AND list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN d[i]::INTEGER WHEN d[i]::INTEGER > 4 THEN 2 * d[i]::INTEGER - 9 ELSE 2 * d[i]::INTEGER END)) % 10 = 0 GROUP BY r),
phones AS (SELECT r, count(*) AS n FROM (SELECT r, unnest(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]')) AS m FROM docs) WHERE length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 9 AND 15 GROUP BY r)
SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'))::BIGINT AS n_email, coalesce(ips.n, 0) AS n_ip, coalesce(cards.n, 0) AS n_card, coalesce(phones.n, 0) AS n_phone
FROM docs LEFT JOIN ips USING (r) LEFT JOIN cards USING (r) LEFT JOIN phones USING (r)"""

TARGETS = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [1.0, 2.0, 3.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM d GROUP BY source),
levels AS (SELECT DISTINCT 3 * source_size / weight AS level FROM s),
filled AS (SELECT level, sum(least(3 * source_size, level * weight)) AS words, sum(weight) FILTER (WHERE 3 * source_size > level * weight) AS open_weight FROM s, levels GROUP BY level),
total AS (SELECT sum(source_size)::DOUBLE AS words FROM s),
low AS (SELECT max(filled.level) AS level, arg_max(filled.words, filled.level) AS words, arg_max(open_weight, filled.level) AS open_weight FROM filled, total WHERE filled.words <= total.words),
lv AS (SELECT CASE WHEN low.level IS NULL THEN total.words / (SELECT sum(weight) FROM s) ELSE low.level + CASE WHEN total.words > low.words THEN (total.words - low.words) / low.open_weight ELSE 0 END END AS level FROM low, total)
SELECT doc_id, size, source_size, round(least(3 * source_size, lv.level * weight), 4) AS target FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, lv"""

QUALITY_COUNTS = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM docs WHERE len(w) > 2))),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM grams, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY r),
counts AS (SELECT r, doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM docs)
SELECT doc_id, n_words, word_chars, n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, n_words < 50 OR 100 * coalesce(rep.n, 0) > 50 * n_words AS base_failed
FROM counts LEFT JOIN rep USING (r)"""

SUBSTRINGS = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS k, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT r, k, s, md5(array_to_string(ws[s:s + 49], ' ')) AS h FROM (SELECT r, k, ws, unnest(range(1, len(ws) - 48)) AS s FROM docs WHERE len(ws) >= 50)),
dup AS (SELECT r, s FROM win JOIN (SELECT h, min(k) AS f FROM win GROUP BY h) USING (h) WHERE k > f),
runs AS (SELECT r, min(s) - 1 AS a, max(s) + 49 AS b FROM (SELECT r, s, sum(fresh) OVER (PARTITION BY r ORDER BY s) AS g FROM (SELECT r, s, CASE WHEN s - lag(s) OVER (PARTITION BY r ORDER BY s) <= 50 THEN 0 ELSE 1 END AS fresh FROM dup)) GROUP BY r, g),
cut AS (SELECT r, sum(b - a)::BIGINT AS n, string_agg(a || ':' || b, ',' ORDER BY a) AS spans, list({'a': a, 'b': b}) AS l FROM runs GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0) AS n_removed,
  sha256(array_to_string(CASE WHEN l IS NULL THEN ws ELSE list_transform(list_filter(list_zip(ws, range(0, len(ws))), lambda x: len(list_filter(l, lambda y: x[2] >= y.a AND x[2] < y.b)) = 0), lambda x: x[1]) END, ' ')) AS kept_sha256,
  coalesce(spans, '') AS spans
FROM docs LEFT JOIN cut USING (r)"""

ORACLE_SQL = {"op3_licenses": licenses.oracle(), "op5_substring_dedup": SUBSTRINGS, "pii_base_counts": BASE_COUNTS, "mixing_targets": TARGETS, "quality_base_counts": QUALITY_COUNTS, "op11_name_join": names.ORACLE, "op12_conversations": conversations.ORACLE, "op13_sharding": curve.ORACLE}
