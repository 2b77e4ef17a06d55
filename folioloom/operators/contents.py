"""Tables of contents in lines of text, and in paragraphs of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioloom.functions import text as T
from folioloom.operators import typed_contents

KEYWORD = "目录"


def runs_of_items(rows: DataFrame, least: int = 2) -> DataFrame:
    """(doc_id, start_line, end_line) of runs of at least so many lines that end in a page number: gaps and islands."""
    items = rows.where(T.is_contents_item(F.col("text")))
    order = Window.partitionBy("doc_id").orderBy("line_no")
    runs = items.withColumn("run", F.col("line_no") - F.row_number().over(order)).groupBy("doc_id", "run")
    found = runs.agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.count("*").alias("n"))
    return found.where(F.col("n") >= least).select("doc_id", "start_line", "end_line")


def keyword_region(rows: DataFrame, pattern: str | None = None) -> DataFrame:
    """(doc_id, start_line, end_line) from the contents keyword to the line before its first heading comes again."""
    t, title = T.strip(F.col("text")), T.contents_title(F.col("text"))
    named = t.contains(KEYWORD) & (t.endswith(KEYWORD) | (F.length(t) <= 50))
    marked = rows.select("doc_id", "line_no", title.alias("title"), named.alias("named")).withColumn("opens", T.is_heading(F.col("title"), pattern))
    # Only headings and counts of a document are brought together, not its text.
    heads = F.collect_list(F.when(F.col("opens"), F.struct("line_no", "title")))
    one = marked.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.when(F.col("named"), F.col("line_no"))).alias("anchor"), heads.alias("heads"))
    one = one.where(F.col("anchor") < F.least(F.col("n"), F.greatest(F.lit(100), F.floor(F.col("n") * 0.2))))
    one = one.withColumn("first", F.array_min(F.filter("heads", lambda h: h["line_no"] > F.col("anchor")))).where("first is not null")
    number = T.ordinal_value(F.col("first.title"))
    share = F.floor(F.col("n") * F.when(number == 1, 0.5).otherwise(0.3))
    one = one.withColumn("end", F.when(number.isNull(), F.col("n")).otherwise(F.least(F.col("n"), F.greatest(F.col("first.line_no") + 1, share))))
    again = F.filter("heads", lambda h: (h["line_no"] > F.col("first.line_no")) & (h["line_no"] < F.col("end")) & (h["title"] == F.col("first.title")))
    found = one.select("doc_id", F.col("anchor").alias("start_line"), (F.array_min(F.transform(again, lambda h: h["line_no"])) - 1).alias("end_line"))
    return found.where("end_line is not null")


def regions(rows: DataFrame, pattern: str | None = None, least: int = 2) -> DataFrame:
    """Keyword regions, else runs of items, of each document."""
    first = keyword_region(rows, pattern)
    other = runs_of_items(rows, least).join(first.select("doc_id"), "doc_id", "left_anti")
    return first.select("doc_id", "start_line", "end_line").unionByName(other)


def region_texts(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, start_line, end_line, text): the lines of each region, blank ones left out, right ends stripped."""
    inside = rows.join(found, "doc_id").where("line_no between start_line and end_line").where(T.strip(F.col("text")) != "")
    line = F.regexp_replace("text", r"(?U)\s+\z", "")
    grouped = inside.groupBy("doc_id", "start_line", "end_line").agg(F.array_sort(F.collect_list(F.struct("line_no", line.alias("line")))).alias("x"))
    return grouped.select("doc_id", "start_line", "end_line", F.array_join(F.transform("x", lambda v: v["line"]), "\n").alias("text"))


def field_entries(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, ord, level, text, page) between a contents field's start and the next field end.

    paragraphs: doc_id, ord, style, texts (array of runs' texts), field_begin,
    field_end (booleans), instruction (string). A running state over windows.
    """
    upto = Window.partitionBy("doc_id").orderBy("ord")
    near = F.max(F.col("field_begin").cast("int")).over(upto.rowsBetween(-2, 0)) == 1
    p = paragraphs.withColumn("starts", F.coalesce(F.col("instruction").contains("TOC"), F.lit(False)) & near)
    p = p.withColumn("opened", F.min(F.when(F.col("starts"), F.col("ord"))).over(Window.partitionBy("doc_id"))).where("ord >= opened")
    same = F.col("starts") & F.col("field_begin") & (F.col("ord") == F.col("opened"))
    p = p.withColumn("closed", F.min(F.when(F.col("field_end") & ~same, F.col("ord"))).over(Window.partitionBy("doc_id")))
    p = p.where((F.col("closed").isNull() | (F.col("ord") < F.col("closed"))) & ~same)
    level = F.regexp_extract("style", r"^TOC(\d+)$", 1)
    p = p.withColumn("level", F.last(F.when(level != "", level.cast("int")), ignorenulls=True).over(upto))
    return _entries(p)


def style_entries(paragraphs: DataFrame) -> DataFrame:
    """Entries of paragraphs whose style is named for a contents level."""
    level = F.regexp_extract(F.replace(F.upper("style"), F.lit(" "), F.lit("")), r"^TOC(\d+)$", 1)
    return _entries(paragraphs.where(F.upper("style").startswith("TOC")).withColumn("level", F.when(level != "", level.cast("int"))))


def _entries(p: DataFrame) -> DataFrame:
    many = F.size("texts") > 1
    text = F.when(many, F.array_join(F.slice("texts", F.lit(1), F.size("texts") - 1), "")).otherwise(F.get("texts", F.lit(0)))
    page = F.when(many, T.strip(F.element_at("texts", -1)))
    return p.where(F.size("texts") > 0).select("doc_id", "ord", "level", T.strip(text).alias("text"), page.alias("page"))


def entries(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, ord, part, level, text, page): field entries, else styled ones, else typed ones, of each document; part counts those of one paragraph."""
    single = lambda found: found.withColumn("part", F.lit(0))
    out = single(field_entries(paragraphs))
    out = out.unionByName(single(style_entries(paragraphs)).join(out.select("doc_id").distinct(), "doc_id", "left_anti"))
    done = out.select("doc_id").distinct()
    return out.unionByName(typed_contents.entries(paragraphs.join(done, "doc_id", "left_anti"))).select("doc_id", "ord", "part", "level", "text", "page")
