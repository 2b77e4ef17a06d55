"""Whole conversions, composed of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.functions import text as T
from folioloom.operators import images, layout, lines, numbering
from folioloom.sinks import rewrite
from folioloom.sources import docx, files, pdf


def convert_layout(words: DataFrame, tables: DataFrame, pictures: DataFrame, chars: DataFrame, pages: DataFrame) -> DataFrame:
    """Lines of page layouts: words clustered and cleaned, table text left out, fonts found, everything numbered in reading order, page numbers marked.

    Words are rows, or a row a page with its words as layout.cluster_pages wants
    them, which are not dealt. Lines are made at this call.
    """
    clustered = layout.cluster_pages(words) if "words" in words.columns else layout.cluster_words(words)
    # Written before Python cleans them: else each line waits for it with all words of its page beside it.
    found = files.scanned(clustered, "clustered").withColumn("text", T.normalize(F.col("text"))).where("text <> ''")
    # Written once: fonts are found in two steps, and words need not be clustered for each.
    kept = files.scanned(layout.outside_tables(found, tables), "lines")
    kept = kept.join(layout.line_fonts(kept, chars), ["doc_id", "page_index", "line"], "left")
    box = ["x0", "top", "x1", "bottom"]
    none = F.lit(None).cast("array<struct<name:string,size:double>>")
    parts = kept.select("doc_id", "page_index", F.lit("text").alias("type"), F.col("top").alias("y"), F.col("x0").alias("x"), F.col("line").alias("src_idx"), "text", *box, "fonts")
    for df, kind, idx in ((pictures, "image", "img_idx"), (layout.valid_tables(tables), "table", "table_idx")):
        parts = parts.unionByName(df.select("doc_id", "page_index", F.lit(kind).alias("type"), F.col("top").alias("y"), F.col("x0").alias("x"), F.col(idx).alias("src_idx"), F.lit(None).cast("string").alias("text"), *box, none.alias("fonts")))
    rows = layout.as_lines(layout.number_elements(parts)).join(pages.select("doc_id", "page_index", F.col("width").alias("page_width"), F.col("height").alias("page_height")), ["doc_id", "page_index"], "left")
    return lines.route_page_numbers(rows)


def convert_pdf(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, tables: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Lines of all PDF files at path, and the status of every file there.

    Pages first to last, counted from 1. Tables are those that rules draw,
    unless others are given, as convert_layout wants them. Every file is
    parsed once, at this call.
    """
    found = files.files(spark, path)
    rows = files.scanned(pdf.layout(found), "layout", "kind")
    errors = rows.where("kind = 'error'").select("path", "error")
    shown = layout.page_range(rows, first, last)
    if tables is None:
        tables = pdf.tables(shown)
    chars = pdf.chars(shown)
    out = convert_layout(pdf.words(chars), tables, pdf.images(shown), chars, pdf.pages(shown))
    return out, files.status(found.select("path", "doc_type").join(errors, "path", "left"))


def list_prefixes(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc_id, ord, prefix) of the numbered paragraphs of scanned documents; lists count on through table cells."""
    nums, levels, over, styles = docx.numbering_tables(parts)
    held = numbering.effective_levels(nums, levels, over)
    paragraphs = rows.where("kind = 'p'").select(F.col("path").alias("doc_id"), "ord", F.col("style").alias("style_id"), "num_id", "ilvl")
    return numbering.prefixes(numbering.numbered_paragraphs(paragraphs, styles, held), held)


def file_prefixes(found: DataFrame) -> DataFrame:
    """What list_prefixes has, of files of which nothing else is wanted: each is read once, and only its numbered paragraphs are dealt."""
    return numbering.prefixes(docx.numbered(found))


def rewrite_docx(spark: SparkSession, path: str, bookmarks: bool = True, static_numbers: bool = True) -> DataFrame:
    """(path, content, error) of all documents at path, with a bookmark at each element that yields content, and list numbers as text."""
    found = files.files(spark, path)
    rows, parts = files.scanned(docx.body(found), "body"), files.scanned(docx.parts(found), "parts", "part")
    numbers = list_prefixes(rows, parts) if static_numbers else None
    items = docx.items(rows, images.without_stamps(docx.images(rows, parts)), list_prefixes(rows, parts)) if bookmarks else None
    return rewrite.rewrite(found, items, numbers)


def convert_docx(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Items of all documents at path, and the status of every file there; lists count on through table cells. Every file is parsed at this call."""
    found = files.files(spark, path)
    rows, parts = files.scanned(docx.body(found), "body"), files.scanned(docx.parts(found), "parts", "part")
    kept = images.without_stamps(docx.images(rows, parts))
    items = docx.items(rows, kept, list_prefixes(rows, parts))
    errors = rows.where("kind = 'error'").select("path", "error").unionByName(parts.where("part = 'error'").select("path", F.col("a").alias("error")))
    errors = errors.groupBy("path").agg(F.min("error").alias("error"))
    return items, files.status(found.select("path", "doc_type").join(errors, "path", "left"))
