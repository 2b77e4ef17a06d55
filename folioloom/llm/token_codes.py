"""Token ids in directly addressable codes.

An id is cut into chunks of eight bits. Level 0 holds the lowest chunk of every
id; level k holds chunk k of those ids that have one. A continuation bitmap per
level tells which ids go on, and a rank directory (ones before each block of
512 bits) leads to their place in the next level. Any token is read by touching
one byte and one bitmap block per level; no block is decoded.

Files: Parquet as the container, one row a segment (whole documents, about a
million tokens; a longer document alone), the codes in one uncompressed binary column, so that Spark's
writers commit them and a lost executor costs only its own tasks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioloom.llm.common import joinable, written
from folioloom.llm.wordcache import Encoder, slices

MAGIC, BLOCK = b"DAC1", 512
#: Tokens of a segment, about; a longer document has a segment of its own.
SEGMENT = 1 << 20
SEGMENTS = "shard int, segment int, n_tokens long, doc_ids array<long>, ends array<long>, codes binary"


def pack_codes(ids: np.ndarray) -> bytes:
    """The codes of unsigned 32-bit ids, as bytes."""
    levels, rest = [], np.ascontiguousarray(ids, "<u4")
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(rest) // BLOCK) * BLOCK // 8, np.uint8)
        padded[: len(bits)] = bits
        ones = np.bitwise_count(padded.reshape(-1, BLOCK // 8)).sum(1, dtype=np.uint32)
        ranks = np.concatenate([np.zeros(1, "<u4"), np.cumsum(ones, dtype="<u4")]).astype("<u4")
        levels.append((rest.astype(np.uint8), padded, ranks))
        if not more.any():
            break
        rest = rest[more] >> 8
    head = [MAGIC, struct.pack("<I", len(levels))]
    head += [struct.pack("<QQQ", len(c), len(b), len(r)) for c, b, r in levels]
    return b"".join([*head, *(x.tobytes() for level in levels for x in level)])


class Codes:
    """Reads packed codes in place."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("these are no codes")
        (n,) = struct.unpack_from("<I", data, 4)
        sizes = [struct.unpack_from("<QQQ", data, 8 + 24 * i) for i in range(n)]
        at, self.levels = 8 + 24 * n, []
        for c, b, r in sizes:
            self.levels.append((np.frombuffer(data, np.uint8, c, at), np.frombuffer(data, np.uint8, b, at + c), np.frombuffer(data, "<u4", r, at + c + b)))
            at += c + b + 4 * r

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        """Id i, from one byte and one bitmap block a level."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * k
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            start = i // BLOCK * (BLOCK // 8)
            before = int(np.bitwise_count(bits[start : i >> 3]).sum()) + int(bits[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
            i = int(ranks[i // BLOCK]) + before
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop, by one rank a level."""
        out = np.zeros(max(0, stop - start), "<u4")
        where = slice(None)
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            out[where] |= chunks[start:stop].astype("<u4") << np.uint32(8 * k)
            on = np.unpackbits(bits[start >> 3 : -(-stop // 8)], bitorder="little")[start & 7 :][: stop - start].astype(bool)
            if not on.any():
                break
            where = np.flatnonzero(on) if isinstance(where, slice) else where[on]
            block = start // BLOCK
            first = int(ranks[block]) + int(np.unpackbits(bits[block * (BLOCK // 8) : -(-start // 8)], bitorder="little")[: start - block * BLOCK].sum())
            start, stop = first, first + int(on.sum())
        return out


def token_segments(docs: DataFrame, tokenizer: str, kind: str = "word", end_id: int = 1, segment: int = SEGMENT) -> DataFrame:
    """Segments of all documents in ascending doc_id order (null first; ties by the text's first 64 characters, then by its hash).

    Null texts count as empty; each document ends in ``end_id``. A special
    token's marker in a text is that token, as the library has it. Very long
    texts are encoded in parts. Rows that repeat a doc_id are documents of their
    own. Other columns are ignored. An empty table gives no segment.
    """

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        encoder, shard, k = Encoder.of(tokenizer, kind), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        names: list = []
        ends: list[np.ndarray] = []
        size = 0

        def flush():
            nonlocal size, k
            row = pa.record_batch({
                "shard": pa.array([shard], pa.int32()), "segment": pa.array([k], pa.int32()), "n_tokens": pa.array([size], pa.int64()),
                "doc_ids": pa.array([[x for n in names for x in n]], pa.list_(pa.int64())), "ends": pa.array([np.concatenate(ends)], pa.list_(pa.int64())),
                "codes": pa.array([pack_codes(np.concatenate(ids))], pa.binary()),
            })
            ids.clear(), names.clear(), ends.clear()
            size, k = 0, k + 1
            return row

        for batch in batches:
            texts, found = batch.column("text"), batch.column("doc_id").to_pylist()
            for a, b in slices(len(found), pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
                got, stops = encoder.encode(texts.slice(a, b - a))
                got = np.insert(got.astype("<u4"), stops[1:], end_id)
                stops = stops + np.arange(len(stops))
                first = 0
                while first < b - a:  # as many whole documents as the segment still takes, or one
                    last = int(np.searchsorted(stops, stops[first] + segment - size, "right")) - 1
                    if last <= first:
                        if size:
                            yield flush()
                            continue
                        last = first + 1
                    ids.append(got[stops[first] : stops[last]])
                    names.append(found[a + first : a + last])
                    ends.append(size + stops[first + 1 : last + 1] - stops[first])
                    size, first = int(ends[-1][-1]), last
        if names:
            yield flush()

    order = ("doc_id", "_start", "_hash")
    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.substring("text", 1, 64).alias("_start"), F.xxhash64("text").alias("_hash"))
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(encode, SEGMENTS)


def write_tokens(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes the segments to the shared folder; returns them as read back."""
    return written(token_segments(docs, tokenizer, **options), "tokens", compression="uncompressed")


def read_documents(segments: DataFrame) -> DataFrame:
    """A row per document of the segments: doc_id, start, n_tokens, ids_crc32, shard, segment."""

    def decode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                x = batch.slice(row, 1)
                names, ends = x.column("doc_ids")[0].as_py(), x.column("ends")[0].as_py()
                codes, starts = Codes(x.column("codes")[0].as_py()), [0, *ends[:-1]]
                ids = codes.slice(0, len(codes))
                n = len(names)
                yield pa.record_batch({
                    "shard": pa.array([x.column("shard")[0].as_py()] * n, pa.int32()), "segment": pa.array([x.column("segment")[0].as_py()] * n, pa.int32()),
                    "doc_id": pa.array(names, pa.int64()), "inner": pa.array(starts, pa.int64()), "n_tokens": pa.array([b - a for a, b in zip(starts, ends)], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)], pa.int64()),
                })

    # Two prefix sums: over shards (as many as write tasks), then over the segments of each.
    sums = segments.select("shard", "segment", "n_tokens")
    shards = sums.groupBy("shard").agg(F.sum("n_tokens").alias("all"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("segment_start", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(shards, "shard")
    starts = starts.select("shard", "segment", (F.col("shard_start") + F.col("segment_start")).alias("base"))
    rows = segments.mapInArrow(decode, "shard int, segment int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return rows.join(joinable(starts), ["shard", "segment"]).select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", "shard", "segment")


def token_index(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Encodes, writes and reads back all documents; see read_documents."""
    return read_documents(write_tokens(docs, tokenizer, **options))


def read_tokens(segments: DataFrame, wanted: DataFrame) -> DataFrame:
    """Single tokens, in place: from rows (doc_id, position) to doc_id, position, token_id.

    Position counts from 0 in the document, its end id last. Rows asked for
    twice come once; ids or positions that do not exist are left out; a doc_id
    that several rows have gives a token for each. A segment is asked for no
    more positions than it has tokens.
    """
    spans = segments.select("shard", "segment", F.posexplode("doc_ids").alias("i", "doc_id"), "ends")
    spans = spans.select("shard", "segment", "doc_id", F.when(F.col("i") > 0, F.get("ends", F.col("i") - 1)).otherwise(0).alias("first"), F.get("ends", "i").alias("stop"))
    asked = wanted.select(F.col("doc_id").cast("long"), F.col("position").cast("long")).where("position >= 0").distinct()
    asked = asked.join(spans, "doc_id").where("first + position < stop").select("shard", "segment", F.struct("doc_id", "position", (F.col("first") + F.col("position")).alias("at")).alias("one"))
    asked = asked.groupBy("shard", "segment").agg(F.collect_list("one").alias("asked"))

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                codes, rows = Codes(batch.column("codes")[i].as_py()), batch.column("asked")[i].as_py()
                yield pa.record_batch({k: pa.array([r[k] for r in rows], pa.int64()) for k in ("doc_id", "position")} | {"token_id": pa.array([codes[r["at"]] for r in rows], pa.int64())})

    return segments.select("shard", "segment", "codes").join(asked, ["shard", "segment"]).mapInArrow(read, "doc_id long, position long, token_id long")
