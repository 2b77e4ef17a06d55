"""Lines rendered as the text files of a conversion; Parquet is the canonical form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioloom.functions import text as T


def _number(c: Column) -> Column:
    return F.format_string("%.2f", F.coalesce(c, F.lit(0.0)).cast("double"))


def coordinates(rows: DataFrame) -> DataFrame:
    """(doc_id, line_index, value): x0,top,x1,bottom with two decimals, zeros for no box."""
    return rows.select("doc_id", "line_index", F.concat_ws(",", *(_number(F.col(c)) for c in ("x0", "top", "x1", "bottom"))).alias("value"))


def metadata(rows: DataFrame) -> DataFrame:
    """(doc_id, line_index, value): page|width,height|type|box|font,size;... with missing parts empty."""
    size = lambda c: F.coalesce(F.round(c, 2).cast("string"), F.lit(""))
    kind = F.when(F.col("is_image"), "image").when(F.col("is_table"), "table").otherwise("text")
    box = F.when(F.col("x0").isNotNull(), F.concat_ws(",", *(size(F.col(c)) for c in ("x0", "top", "x1", "bottom")))).otherwise("")
    page = F.when(F.col("page_width").isNotNull(), F.concat_ws(",", size(F.col("page_width")), size(F.col("page_height")))).otherwise("")
    fonts = F.array_join(F.transform(F.coalesce("fonts", F.array().cast("array<struct<name:string,size:double>>")), lambda f: F.concat_ws(",", f["name"], f["size"].cast("string"))), ";")
    return rows.select("doc_id", "line_index", F.concat_ws("|", F.coalesce(F.col("page_index") + 1, F.lit(0)).cast("string"), page, kind, box, fonts).alias("value"))


def text_lines(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "line_index", T.clean_line(F.col("text")).alias("value"))


def page_lines(rows: DataFrame) -> DataFrame:
    """(doc_id, line_index, value): the page itself and the captured number."""
    return rows.where("is_page").select("doc_id", "line_index", F.concat_ws("|", (F.col("page_index") + 1).cast("string"), F.col("text")).alias("value"))


def table_json(cells: Column) -> Column:
    return F.when(F.size(cells) > 0, F.to_json(F.struct(cells.alias("data"), F.size(cells).alias("rows"), F.size(F.get(cells, F.lit(0))).alias("cols"))))


def contents_text(entries: DataFrame) -> DataFrame:
    """(doc_id, ord, part, value): entries indented by level, with their pages."""
    indent = F.repeat(F.lit("  "), F.greatest(F.coalesce("level", F.lit(1)) - 1, F.lit(0)))
    return entries.select("doc_id", "ord", "part", F.concat(indent, "text", F.when(F.col("page").isNotNull(), F.concat(F.lit(" ... "), "page")).otherwise("")).alias("value"))


def contents_json(entries: DataFrame) -> DataFrame:
    listed = entries.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "part", "level", "text", "page"))).alias("e"))
    return listed.select("doc_id", F.to_json(F.transform("e", lambda v: F.struct(v["level"].alias("level"), v["text"].alias("text"), v["page"].alias("page"))), {"ignoreNullFields": "false"}).alias("value"))


def bookmarks(items: DataFrame) -> DataFrame:
    """(doc_id, bookmark_id, name): one for each element that yields content, numbered from 1."""
    from pyspark.sql import Window

    own = items.select("doc_id", "element_index").distinct()
    return own.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("element_index")).alias("bookmark_id"), F.concat(F.lit("index_"), F.col("element_index")).alias("name"))


def write_files(rendered: DataFrame, path: str, *order: str) -> None:
    """Text files, one folder a document, lines in order; Spark's commit makes each write all or nothing."""
    rows = rendered.repartition("doc_id").sortWithinPartitions("doc_id", *(order or ("line_index",)))
    rows.select("doc_id", "value").write.partitionBy("doc_id").mode("overwrite").text(path)
