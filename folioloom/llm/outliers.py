"""Quality rules and robust multivariate outliers.

Fixed rules come first. Then each document's statistics, transformed to be
near-normal, form a vector, and every group of a language and a source gets a
minimum-covariance-determinant estimate. From several starts (medians with
absolute deviations, all documents, two quarters of them chosen by a hash),
concentration steps take the share h of documents nearest by Mahalanobis
distance and re-estimate centre and covariance from them, which lowers the
determinant; the start with the least determinant goes on until it falls no
more. Every covariance has a fixed least variance added, for statistics that
hardly vary. Documents far beyond the cutoff are rejected.

All of it is DataFrame expressions: covariances are grouped sums, factors are
Cholesky columns and a distance is one forward substitution. Quantiles are exact
ranks over bins of fixed width, so they do not depend on partitions.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioloom.llm.common import SPACE, joinable, written

SYMBOLS = "#*$%&|<>"
#: Documents in a window that a group needs for an estimate of its own.
LEAST = 50
#: Share of a group in the concentrated subset; steps from every start; least fall of the determinant's logarithm that counts.
H, STEPS, FALL = 0.75, 2, 1e-3
#: Bins a unit of a statistic, and of the logarithm of 1 + a squared distance.
FINE, FAR = 1024, 4096
#: Bins of a wide one.
WIDE = 256
#: Mean of the squares of a standard normal vector's entry within the h nearest, five dimensions.
SHRUNK = 0.634
#: Squared distance beyond which a document is rejected: about the 1 - 1e-11 quantile of five squares.
CUTOFF = 60.0
#: Names of the entries, their transformed statistics, and least standard deviations.
ENTRIES = {
    "words": ("ln(1 + n_words)", 0.7),
    "length": ("ln(1 + word_chars / greatest(n_words, 1))", 0.15),
    "symbols": ("ln(1 + 50 * n_symbols / greatest(n_words, 1))", 0.35),
    "lines": ("ln(1 + n_dup_lines)", 0.35),
    "repeats": ("sqrt(n_repeat_words / greatest(n_words, 1))", 0.12),
}


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in keep with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; null texts have none."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*keep, text.alias("_t"))
    words = F.filter(F.split("_t", SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    symbols = F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))
    rows = rows.select(*keep, symbols.cast("long").alias("n_symbols"), lines.alias("_lines"), words.alias("_words"))
    chars = F.length(F.array_join("_words", ""))
    hashes = F.transform("_words", lambda w: F.xxhash64(w))
    rows = rows.select(*keep, "n_symbols", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), F.size("_words").cast("long").alias("n_words"), chars.cast("long").alias("word_chars"), hashes.alias("_h"))
    base = [*keep, "n_symbols", "n_dup_lines", "n_words", "word_chars"]

    def joined(name: str, step: int) -> Column:
        """Hashes of twice as long windows."""
        n = F.greatest(F.size(name) - step, F.lit(0))
        return F.zip_with(F.slice(name, F.lit(1), n), F.slice(name, F.lit(1 + step), n), lambda a, b: F.xxhash64(a, b))

    for step in (1, 2, 4):
        rows = rows.select(*base, F.when(F.size("_h") > step, joined("_h", step)).otherwise(F.array().cast("array<bigint>")).alias("_h"))
    twice = F.size(F.array_distinct("_h")) < F.size("_h")
    placed = F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    rows = rows.select(*base, F.when(twice, placed).alias("_z"))
    same = lambda x, y: F.coalesce(F.get("_z", y)["h"] == x["h"], F.lit(False))
    spots = F.sort_array(F.transform(F.filter("_z", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))
    rows = rows.select(*base, F.when(F.col("_z").isNotNull(), spots).alias("_p"))
    n = F.size("_p") - 1
    steps = F.zip_with(F.slice("_p", F.lit(1), n), F.slice("_p", F.lit(2), n), lambda a, b: F.least(F.lit(8), b - a).cast("long"))
    covered = F.aggregate(steps, F.lit(8).cast("long"), lambda s, x: s + x)
    rows = rows.select(*base, F.when(F.col("_p").isNotNull(), covered).otherwise(0).cast("long").alias("n_repeat_words"))
    failed = F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")
    return rows.withColumn("base_failed", failed)


def _factored(moments: DataFrame, shrunk: float) -> DataFrame:
    """From group, start, m_i and c_i_j (covariances) to group, start, m_i, the Cholesky columns l_i_j and the determinant's logarithm."""
    names, floors = list(ENTRIES), [f for _, f in ENTRIES.values()]
    rows = moments
    for i, a in enumerate(names):
        for j, b in enumerate(names[: i + 1]):
            done = sum((F.col(f"l_{a}_{names[k]}") * F.col(f"l_{b}_{names[k]}") for k in range(j)), F.lit(0.0))
            held = F.col(f"c_{a}_{b}") / shrunk
            if i == j:
                rows = rows.withColumn(f"l_{a}_{b}", F.sqrt(F.greatest(held + floors[i] ** 2 - done, F.lit(floors[i] ** 2))))
            else:
                rows = rows.withColumn(f"l_{a}_{b}", (held - done) / F.col(f"l_{b}_{b}"))
    size = sum((2 * F.ln(F.col(f"l_{a}_{a}")) for a in names), F.lit(0.0))
    return rows.select("group", "start", *(f"m_{a}" for a in names), *(f"l_{a}_{b}" for i, a in enumerate(names) for b in names[: i + 1]), size.alias("size"))


def _distance() -> Column:
    """Squared Mahalanobis distance, by forward substitution."""
    names, solved, total = list(ENTRIES), [], F.lit(0.0)
    for i, a in enumerate(names):
        rest = F.col(f"x_{a}") - F.col(f"m_{a}")
        for k in range(i):
            rest = rest - F.col(f"l_{a}_{names[k]}") * solved[k]
        solved.append(rest / F.col(f"l_{a}_{a}"))
        total = total + solved[i] * solved[i]
    return total


def _with_distance(rows: DataFrame, estimates: DataFrame, keep: list[str], how: str = "inner") -> DataFrame:
    return rows.join(joinable(estimates), "group", how).select(*keep, _distance().alias("distance"))


def _ranked(rows: DataFrame, keys: list[str], share: float) -> DataFrame:
    """From rows (keys, bin): the first bin up to which a key has the share of its rows, or more.

    Sums run over wide bins first, then over the bins of the one in which the
    share is reached, so that no task orders all bins of a key.
    """
    bins = written(rows.groupBy(*keys, "bin").agg(F.count("*").alias("n")), "bins").withColumn("wide", F.floor(F.col("bin") / WIDE))
    own = Window.partitionBy(*keys)
    wide = bins.groupBy(*keys, "wide").agg(F.sum("n").alias("n"))
    wide = wide.withColumn("before", F.sum("n").over(own.orderBy("wide")) - F.col("n")).withColumn("need", share * F.sum("n").over(own) - F.col("before"))
    reached = wide.where("n >= need").groupBy(*keys).agg(F.min_by(F.struct("wide", "need"), "wide").alias("w")).select(*keys, "w.*")
    inside = bins.join(joinable(written(reached, "reached")), [*keys, "wide"]).withColumn("upto", F.sum("n").over(own.orderBy("bin")))
    return inside.where("upto >= need").groupBy(*keys).agg(F.min("bin").alias("bin"))


def _moments(rows: DataFrame) -> DataFrame:
    names = list(ENTRIES)
    means = [F.avg(f"x_{a}").alias(f"m_{a}") for a in names]
    pairs = [F.covar_pop(f"x_{a}", f"x_{b}").alias(f"c_{a}_{b}") for i, a in enumerate(names) for b in names[: i + 1]]
    return rows.groupBy("group", "start").agg(*means, *pairs)


def _starts(rows: DataFrame) -> DataFrame:
    """Estimates of each group from rows (group, x_...), four starts each."""
    names = list(ENTRIES)

    def middle(values: DataFrame) -> DataFrame:
        found = _ranked(values.withColumn("bin", F.floor(F.col("x") * FINE)), ["group", "name"], 0.5)
        return written(found.select("group", "name", ((F.col("bin") + 0.5) / FINE).alias("m")), "middle")

    values = rows.select("group", F.explode(F.array(*(F.struct(F.lit(a).alias("name"), F.col(f"x_{a}").alias("x")) for a in names))).alias("v")).select("group", "v.*")
    medians = middle(values)
    off = middle(values.join(joinable(medians), ["group", "name"]).select("group", "name", F.abs(F.col("x") - F.col("m")).alias("x")))
    robust = medians.join(off.withColumnRenamed("m", "s"), ["group", "name"]).groupBy("group").pivot("name", names).agg(F.first("m").alias("m"), F.first("s").alias("s"))
    apart = [F.pow(1.4826 * F.col(f"{a}_s"), 2).alias(f"c_{a}_{b}") if a == b else F.lit(0.0).alias(f"c_{a}_{b}") for i, a in enumerate(names) for b in names[: i + 1]]
    robust = robust.select("group", F.lit(0).alias("start"), *(F.col(f"{a}_m").alias(f"m_{a}") for a in names), *apart)
    quarter = F.pmod(F.xxhash64(*(f"x_{a}" for a in names)), F.lit(4))
    some = rows.withColumn("start", F.explode(F.array(F.lit(1), F.when(quarter < 2, (quarter + 2).cast("int"))))).where("start is not null")
    return written(_factored(robust.unionByName(_moments(some)), 1.0), "starts")


def estimates(rows: DataFrame, h: float = H, steps: int = STEPS, fall: float = FALL) -> DataFrame:
    """Minimum-covariance-determinant estimates of each group from rows (group, x_...)."""
    own = ["group", "start", *(f"x_{a}" for a in ENTRIES)]

    def concentrated(found: DataFrame) -> DataFrame:
        far = _with_distance(rows, found, own).withColumn("bin", F.floor(F.ln(1 + F.col("distance")) * FAR))
        cuts = written(_ranked(far, ["group", "start"], h).withColumnRenamed("bin", "cut"), "cuts")
        near = far.join(joinable(cuts), ["group", "start"]).where("bin <= cut")
        return written(_factored(_moments(near), SHRUNK), "estimate")

    found = _starts(rows)
    for _ in range(steps):
        found = concentrated(found)
    best = Window.partitionBy("group").orderBy("size", "start")
    found = written(found.withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth"), "estimate")
    # A group goes on while its determinant falls; as each fall is by a least amount, all end.
    done, going = [], found
    while going.limit(1).count():
        after = concentrated(going)
        fell = going.select("group", F.col("size").alias("before")).join(after, "group").where(F.col("size") < F.col("before") - fall).drop("before")
        fell = written(fell, "estimate")
        done.append(going.join(joinable(fell.select("group")), "group", "left_anti"))
        going = fell
    return written(functools.reduce(DataFrame.unionByName, done, found.limit(0)), "estimates")


def judged(docs: DataFrame, cutoff: float = CUTOFF, least: int = LEAST) -> DataFrame:
    """A row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance.

    Estimates come from documents that pass the base rules, all of them. Groups
    with fewer than ``least`` such documents are pooled by language, and then
    altogether; a pool that is still too small rejects nothing. Null lang and
    source are values like others. Null texts have no words; repeated rows
    count each; other columns are ignored; an empty table gives no rows. A long
    text takes a few arrays of its words' hashes in one task. Sums of squares
    depend on the order of rows in their last digits, so a distance at the very
    cutoff could fall on either side of it in a rerun.
    """
    rows = statistics(docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), "text"), ["doc_id", "lang", "source"])
    rows = written(rows, "statistics")
    good = rows.where("not base_failed")
    by_source = good.groupBy("lang", "source").agg(F.count("*").alias("n"))
    by_source = by_source.withColumn("own", F.col("n") >= least)
    by_lang = by_source.where("not own").groupBy(F.col("lang").alias("pool")).agg((F.sum("n") >= least).alias("pooled"))
    named = by_source.join(by_lang, F.expr("not own and pool <=> lang"), "left")
    group = F.when(F.col("own"), F.to_json(F.struct("lang", "source"))).when(F.col("pooled"), F.to_json(F.struct("lang"))).otherwise("rest")
    named = written(named.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), group.alias("group")), "groups")
    vectors = [F.expr(x).alias(f"x_{a}") for a, (x, _) in ENTRIES.items()]
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    placed = rows.join(joinable(named), F.expr("_l <=> lang and _s <=> source"), "left").select(*base, F.coalesce("group", F.lit("rest")).alias("group"), *vectors)
    learnt = placed.where("not base_failed")
    found = estimates(learnt)
    small = written(learnt.where("group = 'rest'").groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") < least).select("group"), "small")
    found = found.join(F.broadcast(small.limit(1)), "group", "left_anti")
    out = _with_distance(placed, found, base, "left")
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    return out.select(*base, kept.alias("kept"), "distance")
