"""Files by path: type, status and page ranges."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.functions import text as T


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content, doc_type) of all files at path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).withColumn("doc_type", T.file_type(F.col("path")))


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; only a local master may fall back to a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="folioloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/") + "/folioloom"


def scanned(rows: DataFrame, name: str, *parts: str) -> DataFrame:
    """rows, written once to the shared folder and read again, so that no file is parsed for each use; parts divides them into folders that filters skip."""
    path = f"{work_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.partitionBy(*parts).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def status(found: DataFrame) -> DataFrame:
    """(file_path, success, output, error) of rows (path, doc_type[, error])."""
    error = F.when(F.col("doc_type") == "unknown", F.concat(F.lit("unsupported file type: "), F.col("path")))
    error = F.coalesce(F.col("error"), error) if "error" in found.columns else error
    ok = error.isNull()
    return found.select(F.col("path").alias("file_path"), ok.alias("success"), F.when(ok, F.regexp_replace("path", r"\.[^./]+$", ".txt")).alias("output"), error.alias("error"))


def tally(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if("success").alias("n_success"), F.count_if(~F.col("success")).alias("n_failed"))


def page_ranges(documents: DataFrame, workers: int) -> DataFrame:
    """(doc_id, first_page, last_page), counted from 1: contiguous shares of n_pages."""
    n = F.col("n_pages")
    size = F.ceil(n / F.least(F.lit(workers), F.greatest(n, F.lit(1))))
    starts = documents.where("n_pages > 0").select("doc_id", "n_pages", size.alias("size")).withColumn("first_page", F.explode(F.expr("sequence(1, n_pages, size)")))
    return starts.select("doc_id", "first_page", F.least(F.col("first_page") + F.col("size") - 1, F.col("n_pages")).alias("last_page"))
