"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm import fingerprints, jaccard_join, mixing, outliers, packing, quality, secrets, sharding, token_codes, urls
from folioloom.llm.common import table


def tokenizer_path(name: str) -> str:
    """Of a public tokenizer's file; a parameter of the operators."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def token_codes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codes.token_index(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def urls_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.verdicts(table(spark, sf_dir, "pages"))


def jaccard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"))


def outliers_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judged(table(spark, sf_dir, "documents"))


def sharding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"))


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def fingerprints_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def secrets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_codes": token_codes_query,
    "op2_mixing": mixing_query,
    "op3_quality": quality_query,
    "op4_urls": urls_query,
    "op5_jaccard": jaccard_query,
    "op6_outliers": outliers_query,
    "op7_sharding": sharding_query,
    "op8_packing": packing_query,
    "op9_fingerprints": fingerprints_query,
    "op10_secrets": secrets_query,
}


def _sharding_sql() -> str:
    slots = sharding.lookup_table(sharding.shard_names(64))
    slot = f"(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {sharding.SLOTS})"
    return f"SELECT doc_id, slot, CAST(({slots})[slot + 1] AS INTEGER) AS shard FROM (SELECT doc_id, {slot} AS slot FROM documents)"


#: All pairs that share a shingle, then what links reach: quadratic in a group of copies, so for small tables only.
JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w] ELSE list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
met AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM met JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (SELECT x, y FROM ways UNION SELECT reached.x, ways.y FROM reached JOIN ways ON reached.y = ways.x)
SELECT documents.doc_id, CAST(coalesce(sizes.n, 0) AS BIGINT) AS n_shingles, CAST(least(documents.doc_id, coalesce(r.low, documents.doc_id)) AS BIGINT) AS component_id
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT x, min(y) AS low FROM reached GROUP BY x) r ON r.x = documents.doc_id
"""

SQL = {"op5_jaccard": JACCARD_SQL, "op7_sharding": _sharding_sql()}
