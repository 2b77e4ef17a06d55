"""Automatic list numbers as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioloom.functions import text as T

ATTRIBUTES = ("start", "num_fmt", "lvl_text", "lvl_jc")
#: Levels that a list has in the document format.
LEVELS = 9


def effective_levels(nums: DataFrame, abstract_levels: DataFrame, overrides: DataFrame) -> DataFrame:
    """(doc_id, num_id, ilvl, attributes): a number's abstract levels, each attribute overridden where given."""
    base = nums.join(abstract_levels, ["doc_id", "abstract_id"]).select("doc_id", "num_id", "ilvl", *ATTRIBUTES)
    over = overrides.select("doc_id", "num_id", "ilvl", *(F.col(a).alias("o_" + a) for a in ATTRIBUTES))
    both = base.join(over, ["doc_id", "num_id", "ilvl"], "left")
    return both.select("doc_id", "num_id", "ilvl", *(F.coalesce("o_" + a, a).alias(a) for a in ATTRIBUTES))


def numbered_paragraphs(paragraphs: DataFrame, style_numbering: DataFrame, levels: DataFrame) -> DataFrame:
    """paragraphs (doc_id, ord, style_id, num_id, ilvl) with the numbering that holds: their own, else their style's; number 0 is none."""
    s = style_numbering.select("doc_id", "style_id", F.col("num_id").alias("s_num"), F.coalesce("ilvl", F.lit("0")).alias("s_lvl"))
    p = paragraphs.join(s, ["doc_id", "style_id"], "left")
    own = F.col("num_id").isNotNull() & F.col("ilvl").isNotNull()
    p = p.withColumn("use_num", F.when(own, F.col("num_id")).otherwise(F.col("s_num"))).withColumn("use_lvl", F.when(own, F.col("ilvl")).otherwise(F.col("s_lvl"))).drop("s_num", "s_lvl")
    p = p.withColumn("use_num", F.when(F.col("use_num") != "0", F.col("use_num")))
    held = levels.select(F.col("doc_id"), F.col("num_id").alias("use_num"), F.col("ilvl").alias("use_lvl"), *ATTRIBUTES)
    return p.join(held, ["doc_id", "use_num", "use_lvl"], "left")


def with_numbers(rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Numbered paragraphs with values: the counters of levels 0 to their own.

    A level counts from its start and starts anew after a shallower paragraph
    of the same list: its number is the start of the first paragraph since then
    and how many followed, so running sums over one window tell all levels.
    Levels that have not come yet show 1.
    """
    upto = Window.partitionBy("doc_id", "use_num").orderBy("ord")
    level, start = F.col("use_lvl").cast("int"), F.coalesce(F.expr("try_cast(start as int)"), F.lit(1))
    ks = range(levels)
    out = rows.where("use_num is not null").withColumn("_level", level).withColumn("_start", start)
    out = out.select("*", *(F.count_if(F.col("_level") == k).over(upto).alias(f"_n{k}") for k in ks))
    # How many came before the last shallower paragraph.
    out = out.select("*", *(F.coalesce(F.last(F.when(F.col("_level") < k, F.col(f"_n{k}")), ignorenulls=True).over(upto), F.lit(0)).alias(f"_b{k}") for k in ks))
    first = lambda k: (F.col("_level") == k) & (F.col(f"_n{k}") == F.col(f"_b{k}") + 1)
    out = out.select("*", *(F.last(F.when(first(k), F.col("_start")), ignorenulls=True).over(upto).alias(f"_s{k}") for k in ks))
    value = [F.when(F.col(f"_n{k}") > F.col(f"_b{k}"), F.col(f"_s{k}") + F.col(f"_n{k}") - F.col(f"_b{k}") - 1).otherwise(1).cast("int") for k in ks]
    return out.select(*rows.columns, F.slice(F.array(*value), F.lit(1), F.col("_level") + 1).alias("values"))


def running_numbers(rows: DataFrame) -> DataFrame:
    """(doc_id, ord, values) of numbered paragraphs."""
    return with_numbers(rows).select("doc_id", F.col("ord").cast("long").alias("ord"), "values")


def prefixes(rows: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """(doc_id, ord, prefix): each level text with its placeholders filled, each in its own level's format; a trailing blank follows. Without levels, rows have the formats as a map, forms."""
    counted = with_numbers(rows).where(F.col("lvl_text").contains("%"))
    if levels is not None:
        form = F.struct(F.col("ilvl").cast("int"), F.coalesce("num_fmt", F.lit("decimal")))
        forms = levels.where("ilvl is not null").groupBy("doc_id", F.col("num_id").alias("use_num")).agg(F.map_from_entries(F.collect_set(form)).alias("forms"))
        counted = counted.join(forms, ["doc_id", "use_num"], "left")
    pieces = F.regexp_extract_all("lvl_text", F.lit(r"(%\d|[^%]+|%)"), F.lit(1))
    place = lambda x: F.substring(x, 2, 1).cast("int") - 1
    shown = lambda k: T.format_number(F.get("values", k), F.coalesce(F.try_element_at("forms", k), F.lit("decimal")))
    filled = F.transform(pieces, lambda x: F.when(x.rlike(r"^%\d$"), F.when(place(x).between(0, F.size("values") - 1), shown(place(x))).otherwise("")).otherwise(x))
    return counted.select("doc_id", F.col("ord").cast("long").alias("ord"), F.concat(F.array_join(filled, ""), F.lit(" ")).alias("prefix"))


def has_numbering(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.coalesce(F.bool_or(F.col("use_num").isNotNull()), F.lit(False)).alias("has_numbering"))
