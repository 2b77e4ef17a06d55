"""One document, or several at once, converted and written to folders."""

from __future__ import annotations

import asyncio
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioloom.plans import convert
from folioloom.operators import images, layout
from folioloom.sinks import render
from folioloom.sources import docx, files, pdf


def detect_file_type(path: str) -> str:
    return {".pdf": "pdf", ".docx": "docx"}.get(PurePosixPath(path).suffix.lower(), "unknown")


def _preflight(spark: SparkSession, path: str) -> str:
    """The file's type; raises where it is missing or of a type that cannot be read."""
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as e:
        raise FileNotFoundError(path) from e
    kind = detect_file_type(path)
    if kind == "unknown":
        raise ValueError(f"unsupported file type: {path}")
    return kind


def item_lines(items: DataFrame) -> DataFrame:
    """(doc_id, line_index, value, element_index): items but page numbers, in order."""
    order = Window.partitionBy("doc_id").orderBy("element_index", "item_pos")
    kept = items.where("type <> 'page_number'")
    return kept.select("doc_id", (F.row_number().over(order) - 1).alias("line_index"), F.col("content").alias("value"), "element_index")


def _named(rows: DataFrame, mark: str, found: DataFrame, own: str) -> DataFrame:
    """found (path, page_index, own, ...) with doc_id and the number that the lines in rows, which mark tells, give each."""
    lines = rows.where(mark).select("doc_id", "page_index", F.col("src_idx").alias(own), "number", "line_index")
    return found.withColumnsRenamed({"path": "doc_id"}).join(lines, ["doc_id", "page_index", own])


def pdf_images(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, name, content) of the images that rows, the lines of found PDF files, hold places for; what cannot be decoded is left out."""
    name = F.format_string("page_%d_%d%s", F.col("page_index") + 1, "number", "suffix")
    return _named(rows, "is_image", pdf.pictures(found), "img_idx").where("blob is not null").select("doc_id", name.alias("name"), F.col("blob").alias("content"))


def docx_images(found: DataFrame) -> DataFrame:
    """(doc_id, name, content) of the images of documents, under the names of their places; stamps are left out."""
    kept = images.without_stamps(docx.images(docx.body(found), docx.parts(found)))
    name = F.format_string("image_%d_%d%s", "element_index", "run_index", F.coalesce(F.nullif("suffix", F.lit("")), F.lit(".png")))
    return kept.select(F.col("path").alias("doc_id"), name.alias("name"), F.col("blob").alias("content"))


def _write(spark: SparkSession, kind: str, path: str, out: str, first: int | None, last: int | None, with_images: bool = True, with_tables: bool = True) -> dict[str, int]:
    """text, metadata (or index), pages, tables and images below out, and how many rows each has; raises RuntimeError where the file cannot be read."""
    found = files.files(spark, path)
    rows, status = convert.convert_pdf(spark, path, first, last) if kind == "pdf" else convert.convert_docx(spark, path)
    failed = status.where("not success").select("error").first()
    if failed:
        raise RuntimeError(f"{path}: {failed['error']}")
    if kind == "pdf":
        body = rows.where("not is_page")
        parts = {"text": render.text_lines(body), "metadata": render.metadata(body), "pages": render.page_lines(rows)}
        if with_tables:
            drawn = _named(rows, "is_table", pdf.tables(pdf.layout(found)), "table_idx")
            parts["tables"] = drawn.select("doc_id", "line_index", render.table_json(F.col("cells")).alias("value"))
        pictures = pdf_images(rows, found)
    else:
        lines = item_lines(rows)
        order = Window.partitionBy("doc_id").orderBy("element_index", "item_pos")
        numbers = rows.where("type = 'page_number'").select("doc_id", (F.row_number().over(order) - 1).alias("line_index"), F.col("content").alias("value"))
        index = lines.select("doc_id", "line_index", F.col("element_index").cast("string").alias("value"))
        parts = {"text": lines.select("doc_id", "line_index", "value"), "index": index, "pages": numbers}
        pictures = docx_images(found)
    for name, part in parts.items():
        render.write_files(part, f"{out}/{name}")
    if with_images:
        parts["images"] = pictures
        pictures.write.mode("overwrite").parquet(f"{out}/images")
    return {name: part.count() for name, part in parts.items()}


def convert_document(spark: SparkSession, path: str, out: str, first: int | None = None, last: int | None = None, with_images: bool = True, with_tables: bool = True) -> dict[str, int]:
    """Converts the file at path into folders below out; first and last bound the pages of a PDF file. Returns the rows of each.

    Images are a Parquet table of names and contents; tables are JSON, of PDF
    files. Either is left out on demand; placeholders in the text stay.

    Raises FileNotFoundError, ValueError for other types, and RuntimeError for
    a file that cannot be read. For many files use plans.convert on a folder.
    """
    return _write(spark, _preflight(spark, path), path, out, first, last, with_images, with_tables)


def rewrite_document(spark: SparkSession, path: str, out: str, bookmarks: bool = True, static_numbers: bool = True) -> None:
    """Writes the document at path to the new file out, with bookmarks and list numbers as text. Raises as convert_document does."""
    if _preflight(spark, path) != "docx":
        raise ValueError(f"not a word-processing document: {path}")
    made = convert.rewrite_docx(spark, path, bookmarks, static_numbers).first()
    if made["error"]:
        raise RuntimeError(f"{path}: {made['error']}")
    with open(out, "xb") as f:
        f.write(made["content"])


async def aconvert_document(spark: SparkSession, path: str, out: str, first: int | None = None, last: int | None = None) -> dict:
    """The same, awaitable: file_path, success, output, error and counts. What can be told beforehand is raised."""
    kind = _preflight(spark, path)
    try:
        counts = await asyncio.to_thread(_write, spark, kind, path, out, first, last)
    except Exception as e:  # noqa: BLE001  reported to the caller
        return {"file_path": path, "success": False, "output": None, "error": str(e), "counts": None}
    return {"file_path": path, "success": True, "output": out, "error": None, "counts": counts}
