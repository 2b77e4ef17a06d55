"""Exact n-gram Jaccard join with prefix filters under several token orders.

A document's set holds its distinct five-word shingles, hashed to 64 bits. Two
sets with a Jaccard similarity of at least t share tokens in their prefixes
under every global order of the tokens: with o = the least overlap, prefixes
of p(x) and p(y) tokens share at least min(p(x) - n(x) + o, p(y) - n(y) + o). Orders
used here put frequent tokens last (by a counting sketch over all documents) and
rank the others by unlike hashes. Prefixes under the first order are posted and
meet on their tokens. A pair that shares enough of them meets the prefixes under
the other orders, whose tokens are cut to 16 bits (sets of which share no fewer),
and only pairs that share enough under every order fetch their whole sets.

Equal sets are one class and take part once. Members of a posting list are
first tested against the list's least member; the components found so far are
then merged, and only pairs across components remain, taken from the members
outside a list's largest component. Of the lists that hold such members each
member keeps its shortest ones, as many as any partner must share with it: a
prefix filter once more, with lists as tokens, which drops the long lists of
common passages and of near copies. Parities of the tokens in 256 classes,
which bound how far two sets differ, tell most of the others apart. A group of near copies thus costs a few
tests a member, not all its pairs, and no link between components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioloom.llm.common import dropped, free_name, joinable, tidy, written
from folioloom.llm.components import components
from folioloom.llm.shingles import mix, shingle_sets
from folioloom.llm.wordcache import slices

#: log2 of the counters of the frequency sketch, and the parts it is summed in.
COUNTERS, PARTS = 22, 64
#: log2 of the bits of the filter of documents whose sets are needed, and the documents up to which it is used.
FILTER_BITS, FILTERED = 25, 1 << 22
#: Members of a posting list that one key of a join takes, about.
SALTED = 512


def _texts(batch):
    names, texts = batch.column("doc_id"), [t or "" for t in batch.column("text").to_pylist()]
    for a, b in slices(len(texts), [len(t) for t in texts], 1_000_000):
        yield names.slice(a, b - a), texts[a:b]


def _levels(docs: DataFrame, words: int) -> np.ndarray:
    """A frequency level for each counter, from the shingles of all documents: 0 for usual ones.

    Each task counts into a table of fixed size (saturating at 255 for a
    task; it only orders tokens, so this cannot change a result).
    """

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts = np.zeros(1 << COUNTERS, np.uint32)
        for batch in batches:
            for _, texts in _texts(batch):
                sets = shingle_sets(texts, words)
                if sets:
                    np.add.at(counts, (np.concatenate(sets) >> np.uint64(64 - COUNTERS)).astype(np.int64), np.uint32(1))
        table = np.minimum(counts, 255).astype(np.uint8).reshape(PARTS, -1)
        for k in range(PARTS):
            if table[k].any():
                yield pa.record_batch({"part": pa.array([k], pa.int32()), "counts": pa.array([table[k].tobytes()], pa.binary())})

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(x, np.uint8).astype(np.uint32)
        for k, x in sums.items():
            yield pa.record_batch({"part": pa.array([k], pa.int32()), "counts": pa.array([x.tobytes()], pa.binary())})

    parts = docs.select("doc_id", "text").mapInArrow(tidy(count), "part int, counts binary").repartition(PARTS, "part").mapInArrow(tidy(add), "part int, counts binary")
    table = np.zeros((PARTS, (1 << COUNTERS) // PARTS), np.uint32)
    for row in parts.collect():  # PARTS rows of a fixed size
        table[row["part"]] = np.frombuffer(row["counts"], np.uint32)
    counts = table.ravel()
    mean = counts.mean()
    usual = mean + 8 * mean**0.5 + 8
    return np.where(counts <= usual, 0, 1 + np.log2(np.maximum(counts, 1) / usual)).clip(0, 30).astype(np.uint8)


def order_keys(tokens: np.ndarray, levels: np.ndarray) -> list[np.ndarray]:
    """Sort keys of tokens under three global orders: by level, then by three unlike rankings."""
    level = levels[(tokens >> np.uint64(64 - COUNTERS)).astype(np.int64)].astype(np.uint64) << np.uint64(59)
    return [level | mix(tokens ^ np.uint64(salt)) >> np.uint64(5) for salt in (0, 0x2545F4914F6CDD1D, 0x5851F42D4C957F2D)]


def prefix_size(n: int, percent: int) -> int:
    """A tenth of the set beyond the least prefix, so that linked sets share many tokens of theirs, not just one."""
    return min(n, n - -(-percent * n // 100) + 1 + n // 10)


def least_overlap(n: int, m: int, percent: int) -> int:
    return -(-percent * (n + m) // (100 + percent))


def least_shared(n: int, m: int, percent: int) -> int:
    """Tokens that the prefixes of two linked sets share under any order, at least."""
    o = least_overlap(n, m, percent)
    return max(1, min(prefix_size(n, percent) - n + o, prefix_size(m, percent) - m + o))


def cut_prefixes(tokens: np.ndarray, keys: list[np.ndarray], percent: int) -> bytes:
    """The prefixes under the given orders, tokens cut to 16 bits, ascending."""
    p = prefix_size(len(tokens), percent)
    return b"".join(np.sort((tokens[np.argpartition(k, p - 1)[:p]] & np.uint64(0xFFFF)).astype(np.uint16)).tobytes() for k in keys) if p else b""


def shared(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two ascending arrays as multisets."""
    a, ka = np.unique(x, return_counts=True)
    b, kb = np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    return int(np.minimum(ka[i], kb[j]).sum())


def passes(x: np.ndarray, n: int, y: np.ndarray, m: int, percent: int) -> bool:
    """Whether sets of n and m tokens with these cut prefixes share enough under every one of their orders."""
    if percent * max(n, m) > 100 * min(n, m):
        return False
    need, p, q = least_shared(n, m, percent), prefix_size(n, percent), prefix_size(m, percent)
    return all(shared(x[k * p : (k + 1) * p], y[k * q : (k + 1) * q]) >= need for k in range(len(x) // p))


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """The exact test of two sets."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _sets_of(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """Rows (doc_id, tokens) of the documents with these ids, or a few more.

    Up to FILTERED ids pass as a filter of fixed size, so that no text is
    shuffled; beyond that they are joined.
    """
    spark = docs.sparkSession
    ids = written(ids.distinct(), "needed")
    docs, held = docs.where("doc_id is not null"), None
    if ids.count() <= FILTERED:
        spot = F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS))
        bits = ids.select(spot.alias("spot")).select(F.expr("int(spot div 32)").alias("word"), F.expr("shiftleft(1L, int(spot % 32))").alias("bit"))
        found = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # as many rows as the filter has words, at most
        table = np.zeros((1 << FILTER_BITS) // 32, np.uint32)
        table[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
        held = spark.sparkContext.broadcast(table)
    else:
        docs = docs.join(ids, F.col("doc_id") == F.col("id"), "left_semi")

    def emit_sets(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if held is not None:
                spots = batch.column("spot").to_numpy()
                batch = batch.filter(pa.array((held.value[spots // 32] >> (spots % 32).astype(np.uint32) & 1).astype(bool)))
            for names, texts in _texts(batch):
                yield pa.record_batch({"doc_id": names, "tokens": pa.array([x.tobytes() for x in shingle_sets(texts, words)], pa.binary())})

    spots = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS)).alias("spot"))
    return spots.mapInArrow(tidy(emit_sets), "doc_id long, tokens binary")


def _both(pairs: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """pairs (a, b) with the columns of a's row, named x_..., and of b's, named y_...; rows have a column id."""
    x = rows.select(F.col("id").alias("a"), *(F.col(c).alias("x_" + c) for c in columns))
    y = rows.select(F.col("id").alias("b"), *(F.col(c).alias("y_" + c) for c in columns))
    return pairs.join(y, "b").join(x, "a")


def _verified(pairs: DataFrame, docs: DataFrame, others: DataFrame, words: int, percent: int) -> DataFrame:
    """Those pairs (a, b) that link; others has rows (id, n, cut)."""

    def emit_candidates(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x, y = batch.column("x_cut"), batch.column("y_cut")
            n, m = batch.column("x_n").to_pylist(), batch.column("y_n").to_pylist()
            good = [passes(np.frombuffer(x[i].as_buffer(), np.uint16), n[i], np.frombuffer(y[i].as_buffer(), np.uint16), m[i], percent) for i in range(batch.num_rows)]
            yield pa.record_batch({k: batch.column(k) for k in "ab"}).filter(pa.array(good, pa.bool_()))

    def emit_links(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x, y = batch.column("x_tokens"), batch.column("y_tokens")
            good = [linked(np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64), percent) for i in range(batch.num_rows)]
            yield pa.record_batch({k: batch.column(k) for k in "ab"}).filter(pa.array(good, pa.bool_()))

    met = _both(pairs, others, ["n", "cut"]).select("a", "b", "x_n", "y_n", "x_cut", "y_cut")
    candidates = written(met.mapInArrow(tidy(emit_candidates), "a long, b long"), "candidates")
    sets = written(_sets_of(docs, candidates.select(F.explode(F.array("a", "b")).alias("id")), words), "sets")
    full = _both(candidates, sets.withColumnRenamed("doc_id", "id"), ["tokens"]).select("a", "b", "x_tokens", "y_tokens")
    links = written(full.mapInArrow(tidy(emit_links), "a long, b long"), "links")
    dropped(sets, candidates)
    return links


def jaccard_classes(docs: DataFrame, percent: int = 75, words: int = 5) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id.

    Documents whose shingle sets have a Jaccard similarity of percent / 100 or
    more are linked; component_id is the least doc_id reachable by links. Null
    or wordless texts have no shingles and no links. Rows that repeat a doc_id
    are one node of the link graph. Null ids get a component only from a class
    that has an id too. Other columns are ignored; an empty table gives no rows.
    Long texts are hashed in parts; a set takes 8 bytes a word in one task. A
    posting list, of all different sets that have a token in their prefix, is
    made in one task, which takes 24 bytes a member; frequent tokens come last,
    so a long one is of sets that are hardly more than a common passage.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    levels = spark.sparkContext.broadcast(_levels(docs, words))

    def emit_prefixes(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for names, texts in _texts(batch):
                sets, prefixes, cuts, prints, signs = shingle_sets(texts, words), [], [], [], []
                for x in sets:
                    prints.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                    signs.append(np.packbits(np.bincount((x & np.uint64(255)).astype(np.int64), minlength=256) & 1).view(np.int64))
                    p, keys = prefix_size(len(x), percent), order_keys(x, levels.value)
                    cuts.append(cut_prefixes(x, keys[1:], percent))
                    prefixes.append(x[np.argpartition(keys[0], p - 1)[:p]].tobytes() if p else b"")
                yield pa.record_batch({"doc_id": names, "n": pa.array([len(x) for x in sets], pa.int64()), "print": pa.array(prints, pa.binary()), "prefix": pa.array(prefixes, pa.binary()), "cut": pa.array(cuts, pa.binary())} | {f"s{k}": pa.array([v[k] for v in signs], pa.int64()) for k in range(4)})

    marked = written(docs.mapInArrow(tidy(emit_prefixes), "doc_id long, n long, print binary, prefix binary, cut binary, s0 long, s1 long, s2 long, s3 long"), "prefixes")
    kept = marked.where("n > 0 and doc_id is not null")
    classes = kept.groupBy("print").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    others = kept.select(F.col("doc_id").alias("id"), "n", "cut")

    def emit_postings(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            prefixes = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("prefix")]
            if prefixes:
                sizes = [len(x) for x in prefixes]
                yield pa.record_batch({"token": pa.array(np.concatenate(prefixes)), "rep": pa.array(np.repeat(batch.column("rep").to_numpy(), sizes)), "n": pa.array(np.repeat(batch.column("n").to_numpy(), sizes).astype(np.int32))})

    def emit_lists(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: set[int] = set()

        def lists(token, rep, n):
            """Rows (list, length, leader, leader_n, rep, n) of the tokens that several sets post."""
            cut = np.concatenate(([True], (token[1:] != token[:-1]) | (percent * n[1:].astype(np.int64) > 100 * n[:-1].astype(np.int64))))
            starts = np.flatnonzero(cut)
            sizes = np.diff(np.append(starts, len(token)))
            many = sizes > 1
            starts, sizes = starts[many], sizes[many]
            if not len(starts):
                return None
            keep = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
            rep, n = rep[keep], n[keep]
            at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            # members are distinct, so a sum of their hashes names a list
            name = mix(np.add.reduceat(mix(rep.astype(np.uint64) ^ np.uint64(0x2545F4914F6CDD1D)), at) + sizes.astype(np.uint64)).astype(np.int64)
            leader = np.minimum.reduceat(rep, at)
            leader_n = np.maximum.reduceat(np.where(rep == np.repeat(leader, sizes), n, 0), at)
            return pa.record_batch({k: pa.array(v) for k, v in (("list", np.repeat(name, sizes)), ("length", np.repeat(sizes, sizes)), ("leader", np.repeat(leader, sizes)), ("leader_n", np.repeat(leader_n, sizes)), ("rep", rep), ("n", n))})

        left = None
        for batch in batches:
            now = [batch.column(k).to_numpy() for k in ("token", "rep", "n")]
            if left is not None:
                now = [np.concatenate(x) for x in zip(left, now)]
            last = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            left = [x[last:] for x in now]
            if last and (rows := lists(*(x[:last] for x in now))) is not None:
                yield rows
        if left is not None and len(left[0]) and (rows := lists(*left)) is not None:
            yield rows

    postings = classes.select("rep", "n", "prefix").mapInArrow(tidy(emit_postings), "token long, rep long, n int")
    sorted_postings = postings.repartition("token").sortWithinPartitions("token", "n", "rep")
    lists = sorted_postings.mapInArrow(tidy(emit_lists), "list long, length long, leader long, leader_n int, rep long, n int")
    # Tokens with the same members make one list that counts as often.
    lists = written(lists.groupBy("list", "rep", "length", "n", "leader", "leader_n").agg(F.count("*").cast("int").alias("times")), "lists")

    def least_shared_sql(n: str, m: str) -> str:
        """least_shared() in SQL."""
        o = f"cast(ceil({percent} * cast({n} + {m} as long) / {100 + percent}) as long)"
        p = f"(least(0, 1 + {{0}} div 10 - cast(ceil({percent} * cast({{0}} as long) / 100) as long)) + {o})"
        return f"greatest(1, least({p.format(n)}, {p.format(m)}))"

    def shared_enough(n: str, m: str, shared: str):
        return F.expr(f"{percent} * greatest({n}, {m}) <= 100 * least({n}, {m}) and {shared} >= {least_shared_sql(n, m)}")

    stars = lists.where("rep <> leader").groupBy(F.col("leader").alias("a"), F.col("rep").alias("b")).agg(F.sum("times").alias("shared"), F.first("leader_n").alias("an"), F.first("n").alias("bn"))
    stars = written(stars.where(shared_enough("an", "bn", "shared")).select("a", "b"), "stars")
    links = _verified(stars, docs, others, words, percent)
    first = written(components(links), "first")

    member = lists.join(first.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    member = written(member, "members")
    # A long list is dealt over several keys wherever it is joined.
    keys = f"cast(length div {SALTED} as int)"
    member = member.withColumn("salt", F.expr(f"cast(pmod(xxhash64(rep), 1 + {keys}) as int)"))
    spread = member.groupBy("list", "component").agg(F.count("*").alias("k"), F.min("n").alias("low"), F.max("n").alias("high"), F.first("length").alias("length"))
    live = spread.groupBy("list").agg(F.count("*").alias("parts"), F.first("length").alias("length"), F.min("low").alias("low"), F.max("high").alias("high"), F.max_by("component", F.struct("k", "component")).alias("main")).where("parts > 1")
    live = live.withColumn("salt", F.explode(F.expr(f"sequence(0, {keys})"))).drop("parts", "length")
    alive = member.join(live, ["list", "salt"]).select("list", "salt", "times", "rep", "n", "component", "main", "length", "low", "high")
    # Least that a member shares with any partner in its lists: it is least at either end of the partners' sizes.
    alive = alive.withColumn("low", F.expr(f"greatest(low, cast(ceil({percent} * n / 100) as int))")).withColumn("high", F.expr(f"least(high, cast(floor(100 * n / {percent}) as int))"))
    need = F.expr(f"greatest(1, least({least_shared_sql('n', 'low')}, {least_shared_sql('n', 'high')}) - 2)")  # 2: rounding between the ends
    own = Window.partitionBy("rep", "n")
    before = own.orderBy("length", "list").rowsBetween(Window.unboundedPreceding, -1)
    alive = alive.withColumn("need", F.min(need).over(own)).withColumn("all", F.sum("times").over(own)).withColumn("before", F.coalesce(F.sum("times").over(before), F.lit(0)))
    probes = alive.where("before <= `all` - need")
    last = F.max(F.struct("length", "list")).over(own).alias("last")
    probes = probes.select("list", "salt", "length", "times", "rep", "n", "component", "main", "all", (F.col("all") - F.sum("times").over(own)).alias("dropped"), last)
    signs = marked.where("n > 0 and doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("rep"), F.first("n").cast("int").alias("n"), *(F.first(f"s{k}").alias(f"s{k}") for k in range(4)))
    probes = written(probes.join(signs.drop("print"), ["rep", "n"]), "probes")
    carried = ("rep", "n", "component", "all", "dropped", "last", "s0", "s1", "s2", "s3")
    x = probes.where("component <> main").select("list", "salt", "times", *(F.col(c).alias("x_" + c) for c in carried))
    y = probes.withColumn("salt", F.explode(F.expr(f"sequence(0, {keys})"))).select("list", "salt", *(F.col(c).alias("y_" + c) for c in carried), (F.col("component") == F.col("main")).alias("y_main"))
    possible = f"{percent} * greatest(x_n, y_n) <= 100 * least(x_n, y_n) and least(x_all, y_all) >= {least_shared_sql('x_n', 'y_n')}"
    # Parities that differ are no more than the tokens that only one of two sets has.
    differ = " + ".join(f"bit_count(x_s{k} ^ y_s{k})" for k in range(4))
    possible += f" and {differ} <= x_n + y_n - 2 * cast(ceil({percent} * cast(x_n + y_n as long) / {100 + percent}) as long)"
    met = x.join(y, ["list", "salt"]).where(f"x_component <> y_component and (y_main or x_rep < y_rep) and {possible}")
    met = met.groupBy(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b")).agg(F.max(F.expr("if(x_last <= y_last, x_dropped, y_dropped)")).alias("beyond"), F.sum("times").alias("met"), F.first("x_n").alias("an"), F.first("y_n").alias("bn"))
    rest = met.where(shared_enough("an", "bn", "(met + beyond)")).select("a", "b").join(stars, ["a", "b"], "left_anti")
    rest = written(rest, "rest")
    if rest.limit(1).count():
        links = _verified(rest, docs, others, words, percent)
        first = written(components(first.select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(links.select("a", "b"))), "second")

    found = classes.select("print", "rep").join(first.select(F.col("id").alias("rep"), "component"), "rep", "left").select("print", F.coalesce("component", "rep").alias("component"))
    rows = marked.select("doc_id", "n", F.when(F.col("n") > 0, F.col("print")).alias("print"))
    out = rows.join(found, "print", "left")
    least = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), least.alias("component_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each component, and all rows without words.

    Each row is a node of its own. The row with the least doc_id stays; rows
    whose doc_id is null or repeated come after all others, in the order of the
    table. Columns of docs may have any names; an empty table gives no rows.
    """
    name = free_name(docs, "node")
    doc = F.col("doc_id").cast("long")
    unclear = written(docs.groupBy(doc.alias("id")).count().where("count > 1 or id is null").select("id"), "unclear")
    if not unclear.limit(1).count():
        found = jaccard_classes(docs.select("doc_id", "text"), **options).where("doc_id = component_id")
        return docs.join(found.select(F.col("doc_id").alias(name)), doc == F.col(name), "left_semi")
    low, high = docs.agg(F.min(doc), F.max(doc)).first()
    place = F.monotonically_increasing_id()
    node = place if high is None else place + F.lit(high + 1) if high < 1 << 62 else F.lit(low - 1) - place
    renamed = unclear.select(F.col("id").alias(name))
    own = written(docs.join(joinable(renamed), doc.eqNullSafe(F.col(name)), "left_semi").withColumn(name, node), "unclear-rows")
    clear = docs.join(joinable(renamed), doc.eqNullSafe(F.col(name)), "left_anti").withColumn(name, doc)
    every = clear.unionByName(own)
    found = jaccard_classes(every.select(F.col(name).alias("doc_id"), "text"), **options).where("doc_id = component_id")
    return every.join(found.select(F.col("doc_id").alias(name)), name, "left_semi").select(docs.columns)
