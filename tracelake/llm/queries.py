"""The registered corpus queries and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import byte_bpe, decontaminate, filter_audit, jaccard, language, licenses, pii, quality, records, sharding, spelling, token_count, warc
from tracelake.llm.common import Workspace, table

SHARDS = 40


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Workspace(spark, "op2"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = language.from_documents(table(spark, sf_dir, "documents"))
    return language.identify(rows, Workspace(spark, "op3"))


def pages_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = language.from_pages(table(spark, sf_dir, "pages"))
    return language.identify(rows, Workspace(spark, "pages_language"), id_col="page_id")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    workspace = Workspace(spark, "op5")
    read = warc.transactions(warc.write(warc.captures(table(spark, sf_dir, "pages"), workspace), workspace))
    revisit = F.col("response.record_type") == "revisit"
    return read.select(
        F.col("metadata.page_id").alias("page_id"),
        F.when(revisit, F.col("metadata.payload_bytes")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), F.col("response.record_type").alias("record_type"), F.col("metadata.refers_to").alias("refers_to"),
    )


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"), Workspace(spark, "op6"), words=4, percent=85)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Workspace(spark, "op8").path("records")
    manifest = records.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return records.read_digests(spark, manifest)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign_shards(table(spark, sf_dir, "documents"), SHARDS)
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"), Workspace(spark, "op10"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == pii.KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *[count(k) for k in pii.BASE_KINDS], F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"),
        pii.written(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size(F.concat("base", "added")).cast("long").alias("n_spans"),
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), Workspace(spark, "op11"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), Workspace(spark, "op12"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Workspace(spark, "op13"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_decontamination": op2_decontamination,
    "op3_language_id": op3_language_id,
    "op4_token_counts": op4_token_counts,
    "op5_warc": op5_warc,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_bpe": op7_bpe,
    "op8_token_records": op8_token_records,
    "op9_sharding": op9_sharding,
    "op10_pii": op10_pii,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_license_scan": op12_license_scan,
    "op13_filter_audit": op13_filter_audit,
    "pages_language_id": pages_language_id,
}
SQL: dict[str, str] = {
    "op6_ngram_jaccard": r"""
WITH RECURSIVE words_ AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets_ AS (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words_),
entries_ AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets_),
links_ AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM entries_ a JOIN entries_ b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach_(a, b) AS (SELECT doc_id, doc_id FROM sets_ UNION SELECT r.a, l.b FROM reach_ r JOIN links_ l ON r.b = l.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets_ JOIN (SELECT a, min(b) AS component_id FROM reach_ GROUP BY 1) ON a = doc_id""",
    "op5_warc": """
WITH pages_ AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
firsts AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS h, min(page_id) OVER (PARTITION BY body) AS first_id FROM pages_)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(h, CAST(10 * (i // 8) + 1 AS INT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM firsts""",
    "op13_filter_audit": r"""
WITH texts_ AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
words_ AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first_id FROM texts_),
failed_ AS (
  SELECT doc_id, part, concat(CASE WHEN len(w) < 200 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END,
    CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 'C' ELSE '' END,
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END, CASE WHEN doc_id > first_id THEN 'E' ELSE '' END) AS failed FROM words_),
told_ AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
classes_ AS (
  SELECT part, failed, count(*) AS n, coalesce(sum(good), 0) AS n_good, coalesce(sum(bad), 0) AS n_toxic FROM failed_ LEFT JOIN told_ ON failed_.doc_id = told_.doc_id GROUP BY part, failed),
letters_ AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders_ AS (
  SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order FROM letters_ a, letters_ b, letters_ c, letters_ d, letters_ e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
steps_ AS (SELECT filter_order, CAST(s AS INTEGER) AS step, substr(filter_order, s, 1) AS f, substr(filter_order, 1, s - 1) AS before_ FROM orders_, range(1, 6) r(s)),
judged_ AS (
  SELECT part, filter_order, step, f, n, n_good, n_toxic, failed = f AS alone, contains(failed, f) AS fails,
    len(translate(failed, before_, '')) < len(failed) AS gone FROM classes_, steps_),
counts_ AS (
  SELECT part, filter_order, step, f, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails AND NOT gone THEN n_good ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT gone THEN n_toxic ELSE 0 END) AS toxic_lost
  FROM judged_ GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM counts_""",
}
