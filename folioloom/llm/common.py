"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, everywhere in this package.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Taken from ``spark.checkpoint.dir``. Only a local master, where the
    driver is the executor, may fall back to a temporary folder.
    """
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


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back.

    Cuts the lineage: a lost executor costs at most the tasks it ran since.
    ``dropped`` deletes the table again.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folioloom_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and that no plan still to run reads."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._folioloom_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, lengthened until no column of df has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def tidy(f):
    """f, a function of record batches, that hands memory it has freed back to the system when its task ends.

    Workers are used again by later stages, and what they keep counts with the executor.
    """

    @functools.wraps(f)
    def run(batches):
        try:
            yield from f(batches)
        finally:
            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return run


def joinable(small: DataFrame, most: int = 100_000) -> DataFrame:
    """small with a broadcast hint if it has at most so many rows, which are counted.

    Beyond that it is left to the planner, which then shuffles and splits skew.
    """
    return F.broadcast(small) if small.limit(most + 1).count() <= most else small


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
