"""One query for each operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe_codec, code_compression, filter_audit, line_dedup, near_duplicates, packing, quality_rules, sharding, substring_dedup, token_counts, url_rules, vector_search, warc
from tidewatch.llm.common import TOKENIZERS, scratch_path

URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes in tokens; no two near-duplicates (five-word shingles, similarity of 0.8 or more) share a bin."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return packing.pack_documents(packing.sized_and_grouped(docs, f"{TOKENIZERS}/word_bpe_49k.json"), size=F.col("n_tokens"), cluster=F.col("cluster"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = quality_rules.quality_rules(docs, f"{TOKENIZERS}/piece_bpe_32k.model", keep_text=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", "chars_per_token", "byte_share", "token_entropy")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_lines_removed", "text")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), size=4)


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe_codec.encode_documents(docs, f"{TOKENIZERS}/byte_bpe_50k.json", decode=True)
    return out.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses = warc.response_records(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    out = warc.derivatives(responses).withColumn("page_id", F.col("source_id").cast("long"))
    return out.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "warc_date", "payload_digest", "block_digest", "content_length", "block")


def op7_token_counts(spark: SparkSession, sf_dir: str, cache: str | None = None) -> DataFrame:
    """A cache of its own for each run, so that all distinct texts are encoded; give a path to keep one."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    counted = token_counts.count_tokens(docs, f"{TOKENIZERS}/word_bpe_49k.json", cache or scratch_path(spark, "token-counts"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=20, every=20)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign_shards(_table(spark, sf_dir, "documents").select("doc_id", "text"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, url_rules.RULES)
    out = url_rules.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op11_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = code_compression.compress(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    sha = None if books is None else code_compression.codebooks_sha256(books)
    return codes.select("vec_id", "code", "error", "label_error", F.lit(sha).cast("string").alias("codebooks_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), _table(spark, sf_dir, "labels"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_quality_rules": op2_quality_rules,
    "op3_line_dedup": op3_line_dedup,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_bpe_codec": op5_bpe_codec,
    "op6_warc_derivatives": op6_warc_derivatives,
    "op7_token_counts": op7_token_counts,
    "op8_nearest": op8_nearest,
    "op9_sharding": op9_sharding,
    "op10_url_rules": op10_url_rules,
    "op11_code_compression": op11_code_compression,
    "op12_filter_audit": op12_filter_audit,
    "op13_substring_dedup": op13_substring_dedup,
}

def _floor_div(sql: str) -> str:
    """floor_div(a, b) in SQL, for b > 0 and whole numbers of either sign."""
    return re.sub(r"floor_div\((\w+), (\w+)\)", r"((\1 - (\1 % \2 + \2) % \2) // \2)", sql)


ORACLE_SQL: dict[str, str] = {
    "op10_url_rules": """
WITH rules(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
hosts AS (SELECT page_id, r, regexp_extract(r, '^[^/?#]*') AS h FROM rest),
parts AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path FROM hosts),
fits AS (SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict, length(r.host) + length(r.path) AS n
  FROM parts p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)),
best AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC NULLS LAST) AS k FROM fits)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best WHERE k = 1
""",
    # embeddings have 64 components: 16 parts of 4
    "op11_code_compression": _floor_div("""
WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, label, p, v[4 * p + 1] AS x1, v[4 * p + 2] AS x2, v[4 * p + 3] AS x3, v[4 * p + 4] AS x4 FROM kept, range(16) AS t(p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x1 AS c1, x2 AS c2, x3 AS c3, x4 AS c4 FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
a1 AS MATERIALIZED (SELECT vec_id, p, x1, x2, x3, x4, min(((x1-c1)*(x1-c1) + (x2-c2)*(x2-c2) + (x3-c3)*(x3-c3) + (x4-c4)*(x4-c4)) * 64 + e) % 64 AS e FROM parts JOIN b0 USING (p) GROUP BY ALL),
s1 AS (SELECT p, e, count(*) AS n, sum(x1) AS s1, sum(x2) AS s2, sum(x3) AS s3, sum(x4) AS s4 FROM a1 GROUP BY p, e),
b1 AS MATERIALIZED (SELECT p, e, coalesce(floor_div(s1, n), c1) AS c1, coalesce(floor_div(s2, n), c2) AS c2, coalesce(floor_div(s3, n), c3) AS c3, coalesce(floor_div(s4, n), c4) AS c4 FROM b0 LEFT JOIN s1 USING (p, e)),
a2 AS MATERIALIZED (SELECT vec_id, p, x1, x2, x3, x4, min(((x1-c1)*(x1-c1) + (x2-c2)*(x2-c2) + (x3-c3)*(x3-c3) + (x4-c4)*(x4-c4)) * 64 + e) % 64 AS e FROM parts JOIN b1 USING (p) GROUP BY ALL),
s2 AS (SELECT p, e, count(*) AS n, sum(x1) AS s1, sum(x2) AS s2, sum(x3) AS s3, sum(x4) AS s4 FROM a2 GROUP BY p, e),
b2 AS MATERIALIZED (SELECT p, e, coalesce(floor_div(s1, n), c1) AS c1, coalesce(floor_div(s2, n), c2) AS c2, coalesce(floor_div(s3, n), c3) AS c3, coalesce(floor_div(s4, n), c4) AS c4 FROM b1 LEFT JOIN s2 USING (p, e)),
a3 AS (SELECT vec_id, label, p, min(((x1-c1)*(x1-c1) + (x2-c2)*(x2-c2) + (x3-c3)*(x3-c3) + (x4-c4)*(x4-c4)) * 64 + e) AS m FROM parts JOIN b2 USING (p) GROUP BY vec_id, label, p),
coded AS (SELECT vec_id, label, string_agg(printf('%02x', CAST(m % 64 AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM a3 GROUP BY vec_id, label),
sha AS (SELECT sha256(string_agg(c1 || ',' || c2 || ',' || c3 || ',' || c4, ',' ORDER BY p, e)) AS s FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256 FROM coded, sha
"""),
    "op12_filter_audit": """
WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM docs),
said AS (SELECT doc_id, coalesce(max(quality = 1), false) AS good, coalesce(max(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
judged AS (SELECT d.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM words d LEFT JOIN said USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS f, CAST(pow(2, instr('ABCDE', filter_order[step]) - 1) AS INTEGER) AS bit,
  CAST(list_sum(list_transform(range(1, step), lambda k: pow(2, instr('ABCDE', filter_order[k]) - 1))) AS INTEGER) AS before FROM orders, range(1, 6) AS t(step)),
counts AS (SELECT part, mask, good, toxic, count(*) AS n FROM judged GROUP BY ALL),
sums AS (SELECT part, filter_order, step, f,
  CAST(coalesce(sum(n) FILTER (mask & (coalesce(before, 0) | bit) = 0), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & coalesce(before, 0) = 0), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & coalesce(before, 0) <> 0), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(n) FILTER (good AND mask & bit <> 0 AND mask & coalesce(before, 0) = 0), 0) AS BIGINT) AS good_lost,
  CAST(coalesce(sum(n) FILTER (toxic AND mask & bit <> 0 AND mask & coalesce(before, 0) = 0), 0) AS BIGINT) AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM sums
""",
    "op13_substring_dedup": """
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS MATERIALIZED (SELECT r, k, hash(array_to_string(w[k : k + 34], ' ')) AS h, md5(array_to_string(w[k : k + 34], ' ')) AS m FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS k FROM docs WHERE len(w) >= 35)),
twice AS (SELECT h, m FROM windows GROUP BY h, m HAVING count(*) > 1),
edges AS (SELECT r, k, 1 AS d FROM windows JOIN twice USING (h, m) UNION ALL SELECT r, k + 35, -1 FROM windows JOIN twice USING (h, m)),
placed AS (SELECT r, k, w[k] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS k FROM docs)),
steps AS (SELECT r, k, sum(d) AS d FROM edges GROUP BY r, k),
covered AS (SELECT r, k, word, sum(coalesce(d, 0)) OVER (PARTITION BY r ORDER BY k) > 0 AS gone FROM placed LEFT JOIN steps USING (r, k)),
sums AS (SELECT r, count(*) FILTER (gone) AS n, string_agg(word, ' ' ORDER BY k) FILTER (NOT gone) AS kept FROM covered GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM docs LEFT JOIN sums USING (r)
""",
}
