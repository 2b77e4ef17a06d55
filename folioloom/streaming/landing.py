"""Documents as they arrive in a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioloom.functions import text as T

FILE = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str, files_each_time: int = 1000) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", str(files_each_time)).load(path).withColumn("doc_type", T.file_type(F.col("path")))


def convert_arriving(stream: DataFrame, convert: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Each batch of files is converted and written to a folder of its own, so a batch that is run again replaces itself."""

    def batch(df: DataFrame, number: int) -> None:
        convert(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
