"""Mixing sources to target weights by weighted sampling without replacement.

Every document draws an exponential key scaled by its quality weight, the
smallest first (Efraimidis and Spirakis); it is hashed from the document, so
reruns agree. A source's budget is met by complete epochs first; the rest of it
goes to documents in key order, by prefix sums of their sizes. Prefix sums run
over 256 bins of the keys, then over 256 bins of the bin in which the budget
ends, and so on; only the rows of the last bin are ordered one by one, so no
task sees a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioloom.llm.common import free_name, joinable, n_words, written

#: Weights of the sources, by code point, null last, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Levels of 256 bins each.
LEVELS = 3
#: The least quality weight; it scales positions, so that no bin holds over 2^-20 of a source by its keys.
LEAST = 0.1


def quality_weight(text: Column, words: Column) -> Column:
    """From LEAST for texts full of marks to 1."""
    marks = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return F.coalesce(F.greatest(F.lit(LEAST), 1 - 2.0 * marks / F.greatest(words, F.lit(1))), F.lit(LEAST))


def key_position(text: Column, doc_id: Column, weight: Column, seed: int) -> Column:
    """1 - exp(-LEAST * key), in [0, 1), of the exponential key of a document: in the keys' order.

    Evenly spread for the least weight, so large keys do not crowd below 1.
    """
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, text), 11)
    uniform = (bits.cast("double") + 0.5) / float(1 << 53)
    return F.least(1 - F.pow(uniform, LEAST / weight), F.lit(1 - 2.0**-53))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """From rows (source, source_size): target, by weight, of share times all sizes.

    No target is above ``most`` times its source's size; what is over goes to
    the other sources by weight until none is above. Solved at once: in the
    order of cap / weight the capped sources come first.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    all_rows = Window.partitionBy()
    rows = sizes.withColumn("weight", w).withColumn("cap", most * F.col("source_size")).withColumn("wanted", share * F.sum("source_size").over(all_rows))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("level", (F.col("wanted") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    rows = rows.withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    level = F.first(F.when(~F.col("capped"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(F.col("capped") | level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("weight")))
    return rows.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 17, partial: bool = True) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken, source, weight.

    taken is in words, repeats counted. The document at which a source's budget
    ends gives its first words only (partial), or else is taken whole if that
    brings the source nearer its target. Null texts have no words and take
    none; null sources are a source; documents without words change nothing.
    Rows that are alike in all columns are documents of their own. An empty
    table gives no rows.
    """
    words = n_words(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.col("source").cast("string").alias("source"), words.alias("size"))
    rows = rows.withColumn("weight", quality_weight(F.col("text"), F.col("size")))
    rows = rows.withColumn("at", key_position(F.coalesce("text", F.lit("")), F.col("doc_id"), F.col("weight"), seed))
    rows = rows.withColumn("bin", F.floor(F.col("at") * float(256**LEVELS)).cast("long"))
    rows = written(rows.select("doc_id", "source", "size", "weight", "at", "bin"), "mix")

    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = source_targets(sizes, weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = goals.withColumn("epochs", epochs)
    budget = F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + F.lit(0.5)).cast("long")
    goals = written(goals.withColumn("budget", F.greatest(budget, F.lit(0))), "goals")

    # The bin in which the budget ends (end) and what is left of the budget before it (left).
    found = goals.select("source", F.col("budget").alias("left"), F.lit(0).cast("long").alias("end"))
    for level in range(LEVELS):
        wide = 256 ** (LEVELS - 1 - level)
        inside = rows.join(joinable(found.withColumnRenamed("source", "s")), F.expr(f"s <=> source and bin div {wide * 256} = end"))
        sums = inside.groupBy("source", F.expr(f"bin div {wide}").alias("b")).agg(F.sum("size").alias("sum"), F.first("left").alias("left"))
        order = Window.partitionBy("source").orderBy("b")
        sums = sums.withColumn("upto", F.sum("sum").over(order)).where(F.col("upto") > F.col("left"))
        first = sums.groupBy("source").agg(F.min_by(F.struct("b", (F.col("left") - F.col("upto") + F.col("sum")).alias("left")), "b").alias("x"))
        found = written(first.select("source", F.col("x.left").alias("left"), F.col("x.b").alias("end")), "ends")
    goals = goals.join(found.withColumnRenamed("source", "s"), F.expr("s <=> source"), "left").select("source", "source_size", "target", "epochs", "budget", "left", "end")
    goals = written(goals, "goals")
    every = rows.join(joinable(goals.withColumnRenamed("source", "s")), F.expr("s <=> source")).drop("s")
    # Without an end the budget covers the whole source: that happens to sources without words alone.
    sure = every.where("end is null or bin <> end").withColumn("extra", F.when(F.col("bin") < F.col("end"), F.col("size")).otherwise(0))
    order = Window.partitionBy("source").orderBy("at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = every.where("bin = end").withColumn("room", F.col("left") - F.coalesce(F.sum("size").over(order), F.lit(0)))
    if partial:
        extra = F.greatest(F.lit(0), F.least("size", "room"))
    else:
        extra = F.when((F.col("room") > 0) & (2 * F.col("room") >= F.col("size")), F.col("size")).otherwise(0)
    edge = edge.withColumn("extra", extra).drop("room")
    taken = (F.col("epochs") * F.col("size") + F.col("extra")).cast("long")
    return sure.unionByName(edge).select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source", "weight", F.col("at").alias("position"))


def mixed(docs: DataFrame, seed: int = 17, **options) -> DataFrame:
    """The mix itself: rows of docs, whole documents, each as often as it is taken.

    Texts are not shuffled: what each source takes is told by its epochs and
    the key of the last document of the fractional one. Documents without
    words are not in the mix. Of rows with the same doc_id and text as the last
    one taken, as many are in the fractional epoch as mix() takes, the first by
    their other columns. Columns of docs may have any names; an empty table gives
    no rows.
    """
    plan = mix(docs, seed=seed, partial=False, **options)
    key = F.struct("position", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "size")
    more = F.col("taken") > F.col("epochs") * F.col("size")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    keyed = plan.withColumn("epochs", whole).select("source", "epochs", key.alias("key"), more.alias("more"))
    cuts = written(keyed.groupBy("source", "epochs").agg(F.max(F.when(F.col("more"), F.col("key"))).alias("last")), "cuts")
    # Copies of the last document may be taken in part: how many of how many.
    edge = keyed.withColumnsRenamed({"source": "s", "epochs": "e"}).join(joinable(cuts), F.expr("s <=> source and key = last"))
    edge = edge.groupBy("source").agg(F.count("*").alias("copies"), F.count_if("more").alias("chosen")).withColumnRenamed("source", "s")
    cuts = cuts.join(edge, F.expr("s <=> source"), "left").select("source", F.struct("epochs", "last", "copies", "chosen").alias("cut"))
    cuts = written(cuts, "cuts")

    one, cut = free_name(docs, "one"), free_name(docs, "cut")
    text, doc = F.coalesce("text", F.lit("")), F.col("doc_id").cast("long")
    words = n_words(F.col("text"))
    own = F.struct(key_position(text, doc, quality_weight(F.col("text"), words), seed).alias("position"), F.coalesce(doc, F.lit(-(1 << 63))).alias("doc_id"), words.alias("size"))
    told = cuts.select(F.col("source").alias(free_name(docs, "told")), F.col("cut").alias(cut))
    rows = docs.where(words > 0).withColumn(one, own).join(joinable(told), F.col(told.columns[0]).eqNullSafe(F.col("source").cast("string")))
    partly = F.col(f"`{cut}`.chosen") < F.col(f"`{cut}`.copies")
    sure = (F.col(one) < F.col(f"`{cut}`.last")) | (F.col(one) == F.col(f"`{cut}`.last")) & ~partly
    times = F.col(f"`{cut}`.epochs") + F.coalesce(sure.cast("int"), F.lit(0))
    nth = free_name(docs, "nth")
    at_cut = F.coalesce((F.col(one) == F.col(f"`{cut}`.last")) & partly, F.lit(False))
    main = rows.withColumn(nth, times).select(*docs.columns, nth)
    extra = rows.where(at_cut).withColumn(nth, F.row_number().over(Window.partitionBy(F.col("source").cast("string")).orderBy(*[c for c in docs.columns if docs.schema[c].dataType.typeName() not in ("map", "variant")])))
    extra = extra.where(F.col(nth) <= F.col(f"`{cut}`.chosen")).withColumn(nth, F.lit(1)).select(*docs.columns, nth)
    rows = main.where(F.col(nth) > 0).unionByName(extra)
    return rows.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(nth)))).select(docs.columns)
