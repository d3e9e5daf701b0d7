"""The registered queries of this subpackage, each over its whole table, and the SQL that some of them have."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import conversations, crosstokens, decontamination, exactdedup, jpeg, mainhtml, ordinal, packing, simhash, substrings, token_transducer, urlfilter, warc
from foliant.llm.common import read_table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_token_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_transducer.count_tokens(read_table(spark, sf_dir, "documents"), BYTE_BPE, limit=512)


def op10_fixed_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeated passages take, and a digest of the rest."""
    cleaned = substrings.remove_repeats(read_table(spark, sf_dir, "documents"), window=13)
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_dial_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by the stated rule, with its faults, the cheapest repair and a digest of the result."""
    return conversations.repair(conversations.damaged(read_table(spark, sf_dir, "conversations")))


def op12_extendible_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its equal texts that stays."""
    return exactdedup.exact_copies(read_table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH texts AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
), best AS (
  SELECT text_sha256, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM texts GROUP BY text_sha256
)
SELECT t.doc_id, b.keep_id, b.group_size, t.doc_id = b.keep_id AS kept, t.text_sha256 FROM texts t JOIN best b USING (text_sha256)
"""


def op13_array_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between two tokenizers' tokens in every document."""
    return crosstokens.align(read_table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_BPE)


def op2_revisit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit of the archive made of the pages, with the response it stands for."""
    found = warc.resolve_revisits(warc.captures_of(read_table(spark, sf_dir, "pages")))
    return found.withColumn("headers", F.array_join(F.transform("headers", lambda h: F.concat(h["key"], F.lit(": "), h["value"])), "; "))


OP2_SQL = """
WITH url_parts AS (
  SELECT page_id, url, coalesce(html, '') AS html, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS raw_host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1) AS rest, 1704067200 + page_id * 60 AS sec FROM pages
), page AS (
  SELECT *, CASE WHEN scheme <> '' THEN scheme || '://' || CASE WHEN scheme = 'http' THEN regexp_replace(raw_host, ':80$', '')
            WHEN scheme = 'https' THEN regexp_replace(raw_host, ':443$', '') ELSE raw_host END || CASE WHEN starts_with(rest, '/') THEN rest ELSE '/' || rest END END AS canonical_url,
         CASE WHEN contains(url, '?') THEN NULL ELSE '"' || md5(html) || '"' END AS tag FROM url_parts
), revisits AS (
  SELECT page_id * 3 AS record_id, canonical_url, sec - 3600 AS captured, tag AS etag, 't' || sec AS lm, 60 AS age FROM page
  UNION ALL
  SELECT page_id * 3 + 2, canonical_url, sec + 30 * 86400, CASE WHEN contains(url, '#') THEN '"other"' ELSE tag END, 't' || sec, 180 FROM page
), based AS (
  SELECT r.record_id, r.captured, any_value(r.canonical_url) AS canonical_url, any_value(r.etag) AS etag, any_value(r.lm) AS lm, any_value(r.age) AS age, max(p.page_id) AS base
  FROM revisits r LEFT JOIN page p ON p.canonical_url = r.canonical_url AND p.sec < r.captured GROUP BY r.record_id, r.captured
), judged AS (
  SELECT b.*, p.tag, p.sec, p.html, CASE WHEN base IS NULL THEN 'orphan'
      WHEN etag IS NOT NULL AND tag IS NOT NULL THEN CASE WHEN etag = tag THEN 'resolved' ELSE 'mismatch' END
      WHEN lm = 't' || p.sec THEN 'resolved' ELSE 'mismatch' END AS outcome
  FROM based b LEFT JOIN page p ON p.page_id = b.base
)
SELECT record_id, canonical_url, captured, base * 3 + 1 AS response_id, outcome, CASE WHEN base IS NOT NULL THEN md5(html) END AS payload_digest,
       CASE outcome WHEN 'orphan' THEN NULL
         WHEN 'resolved' THEN 'cache-control: max-age=' || age || '; content-length: ' || length(html) || '; content-type: text/html; date: t' || captured
         ELSE 'cache-control: max-age=120; content-length: ' || length(html) || '; content-type: text/html; date: t' || sec END AS headers
FROM judged
"""


def op3_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return mainhtml.extract(read_table(spark, sf_dir, "pages"))


def op5_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expected grade and tail probabilities of every document."""
    return ordinal.grade_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), sample=12_000)


def op4_baseline_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a picture and read back."""
    return jpeg.read_back(jpeg.store(read_table(spark, sf_dir, "documents")))


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op9_shift_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the rules."""
    return urlfilter.judge_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


OP9_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut
), split AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM parts
), rules(verdict, rule, rule_host, rule_path) AS (
  VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'),
         ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')
), best AS (
  SELECT s.page_id, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
  FROM split s JOIN rules r ON (s.host = r.rule_host OR ends_with(s.host, '.' || r.rule_host)) AND starts_with(s.path, r.rule_path)
  GROUP BY s.page_id
)
SELECT s.page_id, s.host, s.path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM split s LEFT JOIN best b USING (page_id)
"""


def op6_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the sequences."""
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), WORD_BPE, capacity=2048)


def op7_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of every document the benchmark holds."""
    found = decontamination.find_benchmark(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), window=10)
    return decontamination.contamination_report(found)


def op8_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and component of every document."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"), size=4, budget=4)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every opN_ query by name."""
    return {name: f for name, f in sorted(globals().items()) if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    return {"op12_extendible_hash": OP12_SQL, "op2_revisit_join": OP2_SQL, "op9_shift_and": OP9_SQL}
