"""Registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from beamloom.llm import byte_bpe, centroids, embedding_dedup, fuzzy_passages, html_extract, jaccard_join, language_id, license_scan, quality_rules, source_mixing, suffix_dedup, token_files
from beamloom.llm.shared import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return source_mixing.mix(docs, keep_text=False).select("doc_id", "source", "lang", "topic", "tokens", "rate", "prob", "kept")


OP1_SQL = f"WITH {source_mixing.mix_sql('documents')}\nSELECT doc_id, source, lang, topic, tokens, rate, prob, kept FROM mixed"


def op2_fuzzy_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_passages.fuzzy_passages(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return byte_bpe.encode_documents(docs, vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = quality_rules.quality_rules(docs, keep_text=False)
    return rows.select("doc_id", *quality_rules.MEASURES, "base_failed", "host_rejected", "kept")


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
lines AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
win AS (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + o) AS n_repeat_words FROM rep, range(0, 5) AS r(o) GROUP BY rid),
m AS (
  SELECT w.rid, doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN lines USING (rid) LEFT JOIN cov USING (rid)),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM b WHERE source IS NOT NULL GROUP BY source),
s AS (SELECT sum(f) / sum(n) AS mu, sum(f * f / n) / sum(n) AS ff, count(*) / sum(n) AS hn FROM h),
v AS (SELECT mu, ff - mu * mu - mu * (1 - mu) * hn AS bt FROM s),
p AS (SELECT mu, CASE WHEN bt > 0 THEN greatest(1.0, least(1e6, mu * (1 - mu) / bt - 1)) ELSE 1e6 END AS k FROM v),
hv AS (SELECT source, (f + mu * k) / (n + k) > 0.5 AS rejected FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  coalesce(rejected, false) AS host_rejected, NOT base_failed AND NOT coalesce(rejected, false) AS kept
FROM b LEFT JOIN hv USING (source)
"""


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")).drop("text_hash")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = token_files.write_token_files(docs, vocabulary("word_bpe_49k.json"), end_id=1)
    return token_files.read_token_files(files, digests=True)


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS ws FROM documents),
sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
    UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 2)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
ov AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT u, v FROM ov JOIN n nu ON nu.doc_id = u JOIN n nv ON nv.doc_id = v WHERE 100 * i >= 90 * (nu.n + nv.n - i)),
reach(s, t) AS (SELECT doc_id, doc_id FROM documents UNION SELECT s, v FROM reach JOIN link ON t = u)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT s, min(t) AS c FROM reach GROUP BY s) c ON c.s = d.doc_id
"""


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_links(table(spark, sf_dir, "embeddings"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.lloyd(table(spark, sf_dir, "embeddings"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_source_mixing": op1_source_mixing,
        "op2_fuzzy_passages": op2_fuzzy_passages,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_quality_rules": op4_quality_rules,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_token_files": op6_token_files,
        "op7_html_extract": op7_html_extract,
        "op8_language_id": op8_language_id,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_embedding_dedup": op10_embedding_dedup,
        "op11_centroid_clusters": op11_centroid_clusters,
        "op12_license_scan": op12_license_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_source_mixing": OP1_SQL,
        "op4_quality_rules": OP4_SQL,
        "op9_jaccard_join": OP9_SQL,
        "op11_centroid_clusters": centroids.lloyd_sql("embeddings"),
        "op12_license_scan": license_scan.scan_sql("documents"),
    }
