"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.llm.common import written


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """Rows (id, component) for every id in links (a, b); component is the least id reachable.

    Links are symmetric; repeated ones, loops and nulls are allowed and do
    nothing. Each round's edges are written to the shared folder; nothing is
    collected but a count and a checksum.
    """
    larger, smaller = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges = written(links.where("a is not null and b is not null and a <> b").select(larger, smaller).distinct(), name)
    state = None
    while True:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(lowest.select("u", F.col("m").alias("v")))
        edges = written(small.where("u <> v").distinct(), name)
        seen = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    found = edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    return found.unionAll(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
