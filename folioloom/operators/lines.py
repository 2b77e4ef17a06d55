"""Documents as lines: numbering, cleaning, page-number routing and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.functions import text as T


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, text): lines numbered from 0; one trailing empty line goes."""
    parts = F.split("text", "\n", -1)
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return docs.select("doc_id", F.posexplode(kept).alias("line_no", "text"))


def route_page_numbers(rows: DataFrame) -> DataFrame:
    """rows with is_page: a text line that looks like a page number and lies at the page's foot. Needs is_image, is_table, bottom, page_height."""
    body = ~F.coalesce("is_image", F.lit(False)) & ~F.coalesce("is_table", F.lit(False))
    return rows.withColumn("is_page", body & T.is_page_number(F.col("text")) & T.in_bottom_region(F.col("bottom"), F.col("page_height")))


def line_counts(rows: DataFrame) -> DataFrame:
    """Per document: lines, empty lines, page-number-like lines."""
    empty = T.strip(F.col("text")) == ""
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(empty).alias("n_empty"), F.count_if(T.is_page_number(F.col("text"))).alias("n_page_like"))


def char_stats(rows: DataFrame) -> DataFrame:
    """Per document, blanks and tabs left out: all characters, Han, ASCII letters, digits, others."""
    t = F.translate("text", " \t", "")
    count = lambda keep: F.sum(F.length(F.regexp_replace(t, keep, ""))).cast("long")
    out = rows.groupBy("doc_id").agg(
        F.sum(F.length(t)).cast("long").alias("n_chars"), count(r"[^\x{4e00}-\x{9fff}]").alias("n_han"), count("[^A-Za-z]").alias("n_letters"), count(r"(?U)\D").alias("n_digits")
    )
    return out.withColumn("n_other", F.expr("n_chars - n_han - n_letters - n_digits"))


def element_counts(rows: DataFrame) -> DataFrame:
    """Per document: text, image, table and page-number rows."""
    return rows.groupBy("doc_id").agg(*(F.count_if(F.col("type") == k).alias(f"n_{k}") for k in ("text", "image", "table", "page_number")))
