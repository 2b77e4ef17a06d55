"""Page layout: words to lines, lines against tables, fonts, reading order and numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioloom.sources import files

#: Distance to a line's baseline that a word may have; the new word's share in the baseline.
REACH, SHARE = 4.0, 0.2
#: Height of the bands in which characters meet lines.
BAND = 16.0

#: What a page's words have.
WORD = ("x0", "ord", "text", "top", "x1", "bottom")


def cluster_words(words: DataFrame, reach: float = REACH) -> DataFrame:
    """(doc_id, page_index, line, text, x0, top, x1, bottom) from (doc_id, page_index, ord, text, x0, top, x1, bottom)."""
    pages = words.groupBy("doc_id", "page_index").agg(F.collect_list(F.struct(*WORD)).alias("words"))
    return cluster_pages(pages, reach)


def cluster_pages(pages: DataFrame, reach: float = REACH) -> DataFrame:
    """The same from (doc_id, page_index, words), a row a page with its words in any order: nothing is dealt.

    Words by height join the last line if its running baseline is within
    reach, else start the next: the baseline moves, so this is a fold over
    a page's words, which never outgrow a page. It keeps the baseline and where
    lines start; the lines are then cut out of the page's words.
    """
    word = lambda v: F.struct(((v["top"] + v["bottom"]) / 2).alias("y"), *(v[c].alias(c) for c in WORD))
    pages = pages.select("doc_id", "page_index", F.array_sort(F.transform("words", word)).alias("words"))
    start = F.struct(F.lit(None).cast("double").alias("b"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("starts"))

    def step(s, w):
        near = F.coalesce(F.abs(w["y"] - s["b"]) <= reach, F.lit(False))
        b = F.when(near, s["b"] * (1 - SHARE) + w["y"] * SHARE).otherwise(w["y"])
        return F.struct(b.alias("b"), (s["i"] + 1).alias("i"), F.when(near, s["starts"]).otherwise(F.concat(s["starts"], F.array(s["i"]))).alias("starts"))

    pages = pages.withColumn("starts", F.aggregate("words", start, step, lambda s: s["starts"]))
    pages = pages.select("doc_id", "page_index", "words", F.posexplode("starts").alias("line", "first"), F.concat("starts", F.array(F.size("words"))).alias("starts"))
    rows = pages.select("doc_id", "page_index", "line", F.slice("words", F.col("first") + 1, F.get("starts", F.col("line") + 1) - F.col("first")).alias("w"))
    text = F.transform(F.array_sort(F.transform("w", lambda v: F.struct(v["x0"], v["ord"], v["text"].alias("text")))), lambda v: v["text"])
    each = lambda c: F.transform("w", lambda v: v[c])
    return rows.select("doc_id", "page_index", "line", F.array_join(text, " ").alias("text"), F.array_min(each("x0")).alias("x0"), F.array_min(each("top")).alias("top"), F.array_max(each("x1")).alias("x1"), F.array_max(each("bottom")).alias("bottom"))


def outside_tables(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """rows whose box overlaps no table box of their page: equal keys with a residual condition, no cross join."""
    t = tables.select("doc_id", "page_index", *(F.col(c).alias("t_" + c) for c in ("x0", "top", "x1", "bottom")))
    meets = F.expr("x0 < t_x1 and x1 > t_x0 and top < t_bottom and bottom > t_top")
    same = (rows["doc_id"] == t["doc_id"]) & (rows["page_index"] == t["page_index"])
    return rows.join(t, same & meets, "left_anti")


def line_fonts(rows: DataFrame, chars: DataFrame) -> DataFrame:
    """(doc_id, page_index, line, fonts): the different fonts of the characters that overlap a line, in order of appearance.

    A range join made an equality join by bands about as high as a line. The
    whole part of a character's top must lie between those of the line's ends.
    Characters of one font, size and height meet lines as one row, which tells
    their first. Only where that one misses a line that the others may meet are
    all characters of the page looked at; the lines these are go to the shared
    folder, so that their number decides how they are joined.
    """
    band = lambda c: F.floor(F.col(c) / BAND)
    page = ["doc_id", "page_index"]
    lines = rows.select(*page, "line", *(F.col(c).alias("l_" + c) for c in ("x0", "top", "x1", "bottom")))
    probes = lines.select("*", F.explode(F.sequence(band("l_top"), band("l_bottom"))).alias("band"))
    high = F.expr("top < l_bottom and bottom > l_top and bucket between cast(l_top as int) and cast(l_bottom as int)")
    beside = F.expr("x0 < l_x1 and x1 > l_x0")
    c = chars.where("fontname <> '' and size <> 0").select(*page, "ord", F.col("fontname").alias("name"), F.round("size", 2).alias("size"), "x0", "x1", "top", "bottom", F.col("top").cast("int").alias("bucket"), band("top").alias("band"))
    first = lambda x: F.min_by(x, "ord").alias(x)
    drawn = c.groupBy(*page, "band", "bucket", "name", "size", "top", "bottom").agg(F.min("ord").alias("ord"), first("x0"), first("x1"), F.min("x0").alias("least"), F.max("x1").alias("most"))
    found = probes.join(drawn, [*page, "band"]).where(high & F.expr("least < l_x1 and most > l_x0"))
    found = files.scanned(found.select(*page, "line", "l_x0", "l_top", "l_x1", "l_bottom", "name", "size", "bucket", "band", "top", "bottom", "ord", F.coalesce(beside, F.lit(False)).alias("sure")), "met", "sure")
    left = found.where("not sure").drop("ord", "sure")
    missed = left.join(c, [*page, "band", "bucket", "name", "size", "top", "bottom"]).where(beside)
    kept = [*page, "line", "name", "size", "bucket", "ord"]
    met = found.where("sure").select(*kept).unionByName(missed.select(*kept))
    fonts = met.groupBy("doc_id", "page_index", "line", "name", "size").agg(F.min(F.struct("bucket", "ord")).alias("first"))
    listed = fonts.groupBy("doc_id", "page_index", "line").agg(F.array_sort(F.collect_list(F.struct("first", "name", "size"))).alias("f"))
    return listed.select("doc_id", "page_index", "line", F.transform("f", lambda v: F.struct(v["name"].alias("name"), v["size"].alias("size"))).alias("fonts"))


def number_elements(elements: DataFrame) -> DataFrame:
    """elements (doc_id, page_index, type, y, x, src_idx) with line_index over the document and number within page and type."""
    rank = F.when(F.col("type") == "text", 0).when(F.col("type") == "image", 1).otherwise(2)
    order = ["y", "x", "rank", "src_idx"]
    e = elements.withColumn("rank", rank)
    e = e.withColumn("line_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_index", *order)) - 1)
    own = F.row_number().over(Window.partitionBy("doc_id", "page_index", "type").orderBy(*order))
    return e.withColumn("number", F.when(F.col("type") != "text", own)).drop("rank")


def as_lines(elements: DataFrame) -> DataFrame:
    """Elements as lines: images and tables become placeholders with paths."""
    page = F.col("page_index") + 1
    image, table = F.col("type") == "image", F.col("type") == "table"
    mark = F.concat(F.lit("{{"), F.col("type"), F.format_string("_%d_%d", page, F.col("number")), F.lit("}}"))
    out = elements.withColumn("is_image", image).withColumn("is_table", table).withColumn("text", F.when(image | table, mark).otherwise(F.col("text")))
    return out.withColumn("image_path", F.when(image, F.format_string("images/page_%d_%d.png", page, F.col("number")))).withColumn("table_path", F.when(table, F.format_string("tables/page_%d_%d.json", page, F.col("number"))))


def page_range(rows: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Pages first to last, counted from 1; open ends allowed. Reaches the scan as a pushed filter."""
    if first is not None:
        rows = rows.where(F.col("page_index") >= max(1, first) - 1)
    return rows if last is None else rows.where(F.col("page_index") <= last - 1)


def valid_tables(tables: DataFrame) -> DataFrame:
    return tables.where(F.size("cells") > 0)


def clamp(box: list, width, height, margin: float = 5.0) -> list:
    """A box widened by margin within its page, as columns x0, top, x1, bottom."""
    x0, top, x1, bottom = box
    return [F.greatest(x0 - margin, F.lit(0.0)), F.greatest(top - margin, F.lit(0.0)), F.least(x1 + margin, width), F.least(bottom + margin, height)]
