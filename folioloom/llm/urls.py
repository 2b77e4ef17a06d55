"""URL filters: rules, and gradient-boosted trees for what no rule covers.

Rules label the urls that they cover. On a bounded sample of the distinct ones, trees are
boosted on lexical features: lengths, depth, digit ratio, entropy, parameter
counts and statistics of host suffixes, which are taken from all labelled urls.
What a url is trained on excludes what a fold of rows that it is in tells of its suffix, and each
is trained on once more as if its suffix were unknown, so that the trees also
learn to judge without it. Both labels weigh the same, so no evidence is a
probability of a half, which does not block. The trees become one SQL expression,
which judges every other url inside Spark's generated code.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioloom.llm.common import joinable, written

#: Rules as (verdict, host/path); a rule fits its host and all subdomains.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Distinct labelled urls that the trees are fitted on, at most; boosting parameters.
SAMPLE, TREES, DEPTH, RATE, CUTS, LEAST = 20_000, 24, 3, 0.3, 24, 20
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digits", "entropy", "parameters", "hyphens", "suffix_rate", "suffix_share")
#: Folds of labelled urls; labels that a suffix has besides its own, half of them blocked.
FOLDS, SMOOTH = 5, 10
#: Probability of "block" above which a url is blocked.
THRESHOLD = 0.5


def host(url: Column) -> Column:
    """What stands between the first :// and /, ?, # or the end, A-Z lower-cased; empty without ://."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """From the host's end to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://[^/?#]*([^?#]*)", 1)


def rule(host_column: Column, path_column: Column, rules=RULES) -> Column:
    """Struct of the longest rule that fits (the first of equally long ones) and its verdict; null without one."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, text in reversed(sorted(rules, key=lambda r: -len(r[1]))):
        name, slash, rest = text.partition("/")
        fits = ((host_column == name) | host_column.endswith("." + name)) & path_column.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def lexical(url: Column, host_column: Column, path_column: Column) -> dict[str, Column]:
    n = F.greatest(F.length(url), F.lit(1))
    count = lambda c, marks: F.length(c) - F.length(F.translate(c, marks, ""))
    shares = F.transform(F.array_distinct(F.split(url, "")), lambda c: F.when(c == "", 0.0).otherwise((F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n))
    entropy = F.aggregate(shares, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.ln(p)).otherwise(0.0))
    return {
        "length": F.length(url), "host_length": F.length(host_column), "path_length": F.length(path_column), "depth": count(path_column, "/"), "labels": count(host_column, ".") + 1,
        "digits": count(url, "0123456789") / n, "entropy": F.round(entropy, 9), "parameters": count(url, "=&"), "hyphens": count(host_column, "-_"),
    }


def boost(x: np.ndarray, y: np.ndarray, times: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> tuple[float, list]:
    """Logistic boosting of regression trees on rows x with labels y, each counting ``times``.

    A tree is a number, or (feature, threshold, below or equal, above).
    """
    prior = (times @ y + 1) / (times.sum() + 2)
    start = math.log(prior / (1 - prior))
    held = [np.unique(c) for c in x.T] if len(x) else []
    held = [v if len(v) <= CUTS else np.unique(np.quantile(c, np.linspace(0, 1, CUTS + 1), method="lower")) for v, c in zip(held, x.T)]
    cuts = [(v[:-1] + v[1:]) / 2 for v in held]  # midway, so that unseen values go to the nearer side
    binned = np.stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, x.T)], 1) if len(x) else x.astype(int)
    score, model = np.full(len(x), start), []

    def grow(rows, left):
        g, h = grad[rows].sum(), hess[rows].sum()
        best, chosen = 1e-9, None
        if left and times[rows].sum() >= 2 * LEAST:
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                gs, hs, ns = (np.bincount(binned[rows, f], v[rows], len(c) + 1).cumsum()[:-1] for v in (grad, hess, times))
                ok = (ns >= LEAST) & (times[rows].sum() - ns >= LEAST)
                gain = np.where(ok, gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1), 0)
                k = int(np.argmax(gain))
                if gain[k] > best:
                    best, chosen = gain[k], (f, k)
        if chosen is None:
            value = float(rate * g / (h + 1))
            score[rows] += value
            return value
        f, k = chosen
        low = binned[rows, f] <= k
        return FEATURES[f], float(cuts[f][k]), grow(rows[low], left - 1), grow(rows[~low], left - 1)

    for _ in range(trees if len(x) and 0 < times @ y < times.sum() else 0):
        p = 1 / (1 + np.exp(-score))
        grad, hess = times * (y - p), times * p * (1 - p)
        model.append(grow(np.arange(len(x)), depth))
    return start, model


def tree_expression(tree) -> str:
    if isinstance(tree, float):
        return f"{tree!r}D"
    name, cut, low, high = tree
    return f"CASE WHEN {name} <= {cut!r}D THEN {tree_expression(low)} ELSE {tree_expression(high)} END"


def verdicts(pages: DataFrame, rules=RULES, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """A row per page: page_id, host, path, rule, verdict, block_probability.

    Null urls count as empty; without :// host and path are empty. Without
    urls that rules cover, the model's probability is a half everywhere and
    urls without a rule are allowed. Repeated rows are judged each; a url's
    copies count in training as often as they come. Other columns are ignored;
    an empty table gives no rows.
    """
    spark = pages.sparkSession
    url = F.coalesce(F.col("url"), F.lit(""))
    rows = pages.select("page_id", url.alias("url"), host(url).alias("host"), path(url).alias("path"))
    rows = rows.withColumn("found", rule(F.col("host"), F.col("path"), rules))
    features = lexical(F.col("url"), F.col("host"), F.col("path"))
    rows = rows.select("page_id", "url", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("ruled"), F.substring_index("host", ".", -2).alias("suffix"), *(c.cast("double").alias(k) for k, c in features.items()), F.xxhash64("url").alias("_order"), F.pmod(F.xxhash64("page_id"), F.lit(FOLDS)).alias("fold"))
    rows = written(rows, "urls")
    # A url's copies have the same features, so it stands once and counts as often as it comes.
    distinct = rows.where("ruled is not null").groupBy("url").agg(F.count("*").alias("times"), F.min("fold").alias("fold"), *(F.first(c).alias(c) for c in ("_order", "ruled", "suffix", *features)))
    labelled = distinct.orderBy("_order", "url").limit(sample).withColumn("y", (F.col("ruled") == "block").cast("double"))
    labelled = written(labelled, "labelled")  # sample rows at most
    counts = rows.where("ruled is not null").groupBy("suffix", "fold").agg(F.count("*").alias("n"), F.count_if(F.col("ruled") == "block").alias("blocked"))
    counts = written(counts, "suffixes")
    ruled = float(counts.agg(F.sum("n")).first()[0] or 1)
    whole = counts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"))

    def with_suffix(df: DataFrame, statistics: DataFrame, on: list[str]) -> DataFrame:
        rate = (F.coalesce("blocked", F.lit(0)) + SMOOTH / 2) / (F.coalesce("n", F.lit(0)) + SMOOTH)
        joined = df.join(joinable(statistics), on, "left").withColumn("suffix_rate", rate)
        return joined.withColumn("suffix_share", F.coalesce("n", F.lit(0)) / F.lit(ruled)).drop("n", "blocked")

    others = whole.withColumnsRenamed({"n": "all", "blocked": "all_blocked"}).join(counts, "suffix")
    others = others.select("suffix", "fold", (F.col("all") - F.col("n")).alias("n"), (F.col("all_blocked") - F.col("blocked")).alias("blocked"))
    seen = with_suffix(labelled, others, ["suffix", "fold"])
    unseen = seen.withColumn("suffix_rate", F.lit(0.5)).withColumn("suffix_share", F.lit(0.0))
    alike = seen.unionByName(unseen).groupBy(*FEATURES, "y").agg(F.sum("times").alias("times")).collect()  # 2 * sample rows at most
    alike.sort(key=tuple)
    held = np.array([tuple(r) for r in alike], float).reshape(-1, len(FEATURES) + 2)
    for k in (0, 1):  # both labels weigh as much
        own = held[:, -2] == k
        held[own, -1] *= held[:, -1].sum() / 2 / max(held[own, -1].sum(), 1) if 0 < own.sum() < len(own) else 1
    start, trees = boost(held[:, : len(FEATURES)], held[:, -2], held[:, -1])
    total = " + ".join([f"{start!r}D", *map(tree_expression, trees)])
    probability = 1 / (1 + F.exp(-F.expr(total)))
    out = with_suffix(rows, whole, ["suffix"]).withColumn("block_probability", probability)
    judged = F.coalesce("ruled", F.when(F.col("block_probability") > threshold, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", judged.alias("verdict"), "block_probability")
