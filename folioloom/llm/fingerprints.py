"""Order-independent document fingerprints by a homomorphic multiset hash.

A text is a multiset of paragraphs: its lines that hold a word, without white
space at their ends. A paragraph is hashed to a wide vector of eight 64-bit words,
and the fingerprint is the sum of these vectors modulo 2^64: adding or deleting a
paragraph adds or subtracts its vector, the order of paragraphs does not matter,
and equal multisets have equal fingerprints.

A second part estimates likeness. Paragraphs are cut into chunks of a few words at
places that the words themselves choose, so that an edit changes the chunks about
it only; each chunk is hashed to 128 signs, and these are summed modulo 2^32, which
no text is long enough to reach. The cosine of two such sums estimates the cosine
of the two multisets of chunks, however often a chunk occurs.

Not made for adversaries: whoever chooses the texts can find collisions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.llm.shingles import BYTES, mix, powers
from folioloom.llm.wordcache import spread

#: 64-bit words of a paragraph's vector; signs of a chunk's.
WIDE, LANES = 8, 128
#: A chunk ends between two words whose hash has so many zero bits at its end, or after so many words.
BITS, LONGEST = 2, 16
#: White space that separates words and that paragraphs lose at their ends.
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes cut into chunks at once; a longer text is taken in parts, each of which ends a chunk.
PART = 1_000_000
#: Rows of a range of documents, about, and the most ranges; beyond those ranges grow, and tasks stream them.
RANGE, MOST_RANGES = 4096, 16_384


class Prints(NamedTuple):
    """Fingerprints, a row each: sums of paragraphs modulo 2^64, and of chunks modulo 2^32."""

    wide: np.ndarray
    lanes: np.ndarray

    def row(self, i: int) -> Prints:
        return Prints(self.wide[i : i + 1], self.lanes[i : i + 1])

    def named(self) -> list[str]:
        """Lowercase hex of all words, big-endian."""
        return [w.astype(">u8").tobytes().hex() + v.astype(">u4").tobytes().hex() for w, v in zip(self.wide, self.lanes)]


def paragraphs(text: bytes) -> list[bytes]:
    return [p for line in text.split(b"\n") if (p := line.strip(WHITE))]


def _parts(text: bytes) -> Iterator[bytes]:
    start = 0
    while len(text) - start > PART:
        cut = text.rfind(b"\n", start, start + PART) + 1 or text.rfind(b" ", start, start + PART) + 1
        if cut <= start:  # no place to cut so soon: the next one, or the end
            cut = min((p + 1 for p in (text.find(m, start + PART) for m in (b"\n", b" ")) if p >= 0), default=len(text))
        yield text[start:cut]
        start = cut
    yield text[start:]


def chunk_hashes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the chunks of all parts, and each one's part."""
    data = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
    inside = ~np.isin(data, np.frombuffer(WHITE, np.uint8))
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = powers(len(data) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTES[data] * up[: len(data)])))
    words = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    line = np.searchsorted(np.flatnonzero(data == 10), starts)
    pairs = mix(words[:-1] * np.uint64(3) + words[1:])
    last = np.append((line[1:] != line[:-1]) | (pairs & np.uint64((1 << BITS) - 1) == 0), True)
    stops = np.flatnonzero(last) + 1
    firsts = np.concatenate(([0], stops[:-1]))
    times = -(-(stops - firsts) // LONGEST)
    nth = spread(np.zeros(len(times), np.int64), times)[0]
    firsts = np.repeat(firsts, times) + LONGEST * nth
    stops = np.minimum(np.repeat(stops, times), firsts + LONGEST)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)])))
    found = mix((total[stops] - total[firsts]) * down[firsts] + (stops - firsts).astype(np.uint64))
    begins = np.cumsum([0] + [len(p) + 1 for p in parts[:-1]])
    return found, np.searchsorted(begins, starts[firsts], "right") - 1


def signs(chunks: np.ndarray) -> np.ndarray:
    """LANES bits of each chunk."""
    words = np.stack([mix(chunks ^ np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))) for k in range(1, LANES // 64 + 1)], 1)
    return np.unpackbits(words.astype("<u8").view(np.uint8), axis=1)


def prints(texts: list[str]) -> Prints:
    """The fingerprint of each text."""
    n = len(texts)
    wide, lanes = np.zeros((n, WIDE), np.uint64), np.zeros((n, LANES), np.int64)
    held: list[bytes] = []
    owners: list[int] = []
    size = 0

    def settle():
        if not held:
            return
        chunks, part = chunk_hashes(held)
        owner = np.array(owners)[part]
        for a in range(0, len(chunks), 50_000):
            own = owner[a : a + 50_000]
            at = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            ones = np.add.reduceat(signs(chunks[a : a + 50_000]), at, axis=0, dtype=np.int64)
            lanes[own[at]] += 2 * ones - np.diff(np.append(at, len(own)))[:, None]

    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass")
        found = b"".join([hashlib.blake2b(p, digest_size=8 * WIDE).digest() for p in paragraphs(raw)])
        if found:
            wide[i] = np.frombuffer(found, "<u8").reshape(-1, WIDE).sum(0, dtype=np.uint64)
        for part in _parts(raw):
            if size + len(part) > PART:
                settle()
                held, owners, size = [], [], 0
            held.append(part)
            owners.append(i)
            size += len(part) + 1
    settle()
    return Prints(wide, lanes.astype(np.uint32))


def fingerprint(text: str) -> Prints:
    return prints([text])


def combine(one: Prints, other: Prints, sign: int = 1) -> Prints:
    """Of the unions of multisets, row by row (sign 1), or of their differences (sign -1).

    The second part is exact too if the texts are joined at a line's end.
    """
    if sign < 0:
        return Prints(one.wide - other.wide, one.lanes - other.lanes)
    return Prints(one.wide + other.wide, one.lanes + other.lanes)


def likeness(one: Prints, other: Prints) -> np.ndarray:
    """Row by row, from 0 to 1; 1 for equal fingerprints, also of empty texts."""
    a, b = (x.lanes.view(np.int32).astype(np.float64) for x in (one, other))
    norm = np.sqrt((a * a).sum(1) * (b * b).sum(1))
    value = np.divide((a * b).sum(1), norm, out=np.zeros(len(a)), where=norm > 0).clip(0, 1)
    return np.where((one.wide == other.wide).all(1), 1.0, value)


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by as many characters from the start of following."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def fingerprints(docs: DataFrame, rows: int = RANGE, most: int = MOST_RANGES) -> DataFrame:
    """A row per document, against the next by ascending doc_id (after the last: the first).

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint
    (hex), near_edited, near_next. Null texts count as empty. Rows that repeat
    a doc_id follow each other by text; null ids come first. One document alone
    is its own next; an empty table gives no rows. Other columns are ignored.
    Very long texts are cut into chunks in parts, so a task holds a few such
    texts and their copies, no multiple for each character.

    Documents are dealt into ranges of ids whose bounds are ids that occur, so
    the row after a range's end is known beforehand and is sent along with it.
    The bounds, ``most`` at most, are all that reaches the driver.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    total, low = docs.agg(F.count("*"), F.min(F.coalesce("doc_id", F.lit(-(1 << 63))))).first()
    n = min(max(1, total // rows), most)
    marks = []
    if n > 1:
        shares = ",".join(str(k / n) for k in range(1, n))
        marks = docs.agg(F.expr(f"percentile_approx(doc_id, array({shares}), {max(10_000, 20 * n)})")).first()[0] or []
    bounds = sorted(set(marks) - {low})
    last = len(bounds)  # ranges 0 to last; range k ends before bounds[k]
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(np.array(bounds, np.int64))

    def follow(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def rows_of(ids, own, nexts):
            first, changed = prints([*own, nexts[-1]]), [edited(a, b) for a, b in zip(own, nexts)]
            second, after = prints(changed), Prints(*(x[1:] for x in first))
            first = Prints(*(x[:-1] for x in first))
            return pa.record_batch({
                "doc_id": pa.array(ids, pa.int64()), "n_chars": pa.array([len(t) for t in own], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
                "fingerprint": pa.array(first.named()), "edited_fingerprint": pa.array(second.named()),
                "near_edited": pa.array(likeness(first, second)), "near_next": pa.array(likeness(first, after)),
            })

        held_ids: list = []
        held_texts: list[str] = []
        current = None
        ended = True
        for batch in batches:
            for bucket, extra, name, text in zip(*(batch.column(k).to_pylist() for k in ("bucket", "extra", "doc_id", "text"))):
                if bucket != current:
                    current, ended, held_ids, held_texts = bucket, False, [], []
                if ended:  # further rows of the id sent along
                    continue
                if extra:
                    if held_texts:
                        yield rows_of(held_ids, held_texts, [*held_texts[1:], text])
                    held_ids, held_texts, ended = [], [], True
                    continue
                if len(held_texts) > 1 and sum(map(len, held_texts[-200:])) * (len(held_texts) / len(held_texts[-200:])) > 2_000_000 or len(held_texts) > 2000:
                    yield rows_of(held_ids[:-1], held_texts[:-1], held_texts[1:])
                    held_ids, held_texts = held_ids[-1:], held_texts[-1:]
                held_ids.append(name)
                held_texts.append(text)

    def deal(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bounds = sent.value
        for batch in batches:
            keys = batch.column("key").to_numpy()
            bucket = np.searchsorted(bounds, keys, "right").astype(np.int64)
            copies = [(bucket, np.zeros(len(keys), bool), np.arange(len(keys)))]
            if len(bounds):
                also = np.flatnonzero(np.isin(keys, bounds))
                copies.append((bucket[also] - 1, np.ones(len(also), bool), also))
            first = np.flatnonzero(keys == low)
            copies.append((np.full(len(first), last), np.ones(len(first), bool), first))
            for b, e, rows in copies:
                part = batch.take(pa.array(rows, pa.int64()))
                yield pa.record_batch({"bucket": pa.array(b, pa.int64()), "extra": pa.array(e), "doc_id": part.column("doc_id"), "text": part.column("text")})

    dealt = docs.withColumn("key", key).mapInArrow(deal, "bucket long, extra boolean, doc_id long, text string")
    ordered = dealt.repartitionById(last + 1, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "extra", "doc_id", "text")
    return ordered.mapInArrow(follow, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
