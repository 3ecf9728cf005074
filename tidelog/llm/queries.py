"""Queries ``opN_<name>`` over the whole tables, with production parameters, and their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat_quotes, decontam, html_extract, langid, license_scan, lz_fingerprint, mixing, simhash, substring, token_count


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_count.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")).select("doc_id", "source", "mix_block", "mix_slot", "mix_pos")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents")).drop("detections")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op4_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.fingerprint(_table(spark, sf_dir, "documents"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_counts(_table(spark, sf_dir, "documents"))


def op10_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_quotes.link_quotes(_table(spark, sf_dir, "conversations"))


_ALNUM = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2_SQL = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, w[i:i + least(13, len(w)) - 1] AS s
      FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) u(i) WHERE len(w) > 0),
k AS (SELECT DISTINCT n FROM g),
p AS (SELECT doc_id, n, i, w[i:i + n - 1] AS s FROM d, k, unnest(range(1, len(w) - n + 2)) u(i) WHERE len(w) >= n),
m AS (SELECT p.doc_id, p.i, p.n, g.item_id FROM p JOIN g ON p.n = g.n AND p.s = g.s),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM m), unnest(range(i, i + n)) u(j) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
      FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, w[i:i + 12] AS s FROM d, unnest(range(1, len(w) - 11)) u(i)),
f AS (SELECT s, min(doc_id) AS first FROM p GROUP BY s),
g AS (SELECT doc_id, list(DISTINCT j) AS gone FROM (SELECT p.doc_id, p.i FROM p JOIN f USING (s) WHERE p.doc_id > f.first), unnest(range(i, i + 13)) u(j) GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(w[i], ' ' ORDER BY i) AS kept FROM (SELECT d.doc_id, d.w, g.gone, unnest(range(1, len(w) + 1)) AS i FROM d LEFT JOIN g USING (doc_id))
      WHERE gone IS NULL OR NOT list_contains(gone, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)
"""

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_decontaminate": op2_decontaminate,
    "op3_token_counts": op3_token_counts,
    "op4_lz_fingerprint": op4_lz_fingerprint,
    "op5_html_extract": op5_html_extract,
    "op6_mix_sources": op6_mix_sources,
    "op7_license_scan": op7_license_scan,
    "op8_simhash": op8_simhash,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_chat_quotes": op10_chat_quotes,
}
ORACLES = {"op2_decontaminate": OP2_SQL, "op9_substring_dedup": OP9_SQL}
