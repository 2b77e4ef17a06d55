"""A training corpus from raw documents, in five stages.

Low-quality documents go, one document of each group of near copies stays,
secrets are masked, sources are mixed to target weights, and the mix is packed
into sequences. Each stage is written as Parquet and reread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioloom.llm import jaccard_join, mixing, packing, quality, secrets
from folioloom.llm.common import table, written
from folioloom.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Workers also hold what earlier stages left, so the cache and what is encoded at once are kept small here.
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), cache=100_000, characters=1_000_000)


STAGES = [
    ("quality_classifier", quality_stage),
    ("ngram_jaccard_join", copies_stage),
    ("secret_scans", secrets_stage),
    ("mixing_to_weights", mixing_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: SQL can express neither the classifier nor the packing.
ORACLE_SQL = None
