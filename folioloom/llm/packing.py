"""Best-fit packing with swap-based local search.

Documents become pieces of at most ``capacity`` tokens. Pieces are dealt by a
hash into blocks of about ``block`` pieces, and each block is packed by
best-fit decreasing; then a local search moves pieces, or exchanges one for one
or two for one, between underfull bins wherever that increases the sum of
squared fills, until bins empty. A block wastes about one bin of thousands.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.llm.common import tidy, written
from folioloom.llm.wordcache import CACHE, CHARACTERS, Encoder, slices

#: Pieces of a block, on average.
BLOCK = 16_384
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, slot long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, kind: str = "byte", end_id: int = 0, cache: int = CACHE, characters: int = CHARACTERS) -> DataFrame:
    """Pieces of all documents; a document over capacity is cut so that only its first piece is short.

    Null texts count as empty (one piece, the end id). Rows that repeat a
    doc_id are documents of their own. A special token's marker in a text is that
    token, as the library has it. part and slot name a row for good once the
    pieces are written. A smaller cache of word pieces, and fewer characters
    encoded at once (longer texts are encoded in parts), take less memory and
    more time.
    """

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        encoder, part, slot = Encoder.of(tokenizer, kind, cache), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts, names = batch.column("text"), batch.column("doc_id").to_pylist()
            rows = []
            for a, b in slices(len(names), pc.fill_null(pc.binary_length(texts), 0).to_pylist(), characters):
                got, stops = encoder.encode(texts.slice(a, b - a), characters)
                ids = memoryview(np.insert(got.astype("<u4"), stops[1:], end_id)).cast("B")
                stops = (stops + np.arange(len(stops))).tolist()
                for name, low, high in zip(names[a:b], stops, stops[1:]):
                    n, start = high - low, 0
                    for k, stop in enumerate(range(n % capacity or capacity, n + 1, capacity)):
                        rows.append((name, k, start, stop - start, zlib.crc32(ids[4 * (low + start) : 4 * (low + stop)]), part, slot))
                        start, slot = stop, slot + 1
            cols = list(zip(*rows)) if rows else [()] * 7
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "slot"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(cut), PIECES)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each to the fullest bin that still holds it."""
    bins: list[list[int]] = []
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: there is a bin with room r
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            k = open_by_room[room].pop()
            if not open_by_room[room]:
                mask ^= 1 << room
            bins[k].append(i)
        else:
            room, k = capacity, len(bins)
            bins.append([i])
        if room > n:
            open_by_room[room - n].append(k)
            mask |= 1 << room - n
    return bins


class Underfull:
    """Bins that still have room, by what they would take: a load for what they give back.

    A bin of a room takes a load if the load is over what it gives back (nothing,
    one item or two), by the room at most. ``cover`` counts, for each load, the
    ways to take it, so that a search without success looks at one number.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        #: For nothing, one and two items back: of each load given back, the bins by room, and a bit for each such room.
        self.bins: list[dict[int, dict[int, dict[int, None]]]] = [{}, {}, {}]
        self.rooms: list[dict[int, int]] = [{}, {}, {}]
        self.cover = np.zeros((3, 2 * capacity + 1), np.int32)

    def _each(self, items: dict[int, list[int]]):
        yield 0, (0,)
        yield 1, items
        yield 2, two_of(items)

    def add(self, k: int, items: dict[int, list[int]], room: int) -> None:
        for back, loads in self._each(items):
            bins, rooms, cover = self.bins[back], self.rooms[back], self.cover[back]
            for n in loads:
                bins.setdefault(n, {}).setdefault(room, {})[k] = None
                rooms[n] = rooms.get(n, 0) | 1 << room
                cover[n + 1 : n + room + 1] += 1

    def remove(self, k: int, items: dict[int, list[int]], room: int) -> None:
        for back, loads in self._each(items):
            bins, rooms, cover = self.bins[back], self.rooms[back], self.cover[back]
            for n in loads:
                cover[n + 1 : n + room + 1] -= 1
                del bins[n][room][k]
                if not bins[n][room]:
                    del bins[n][room]
                    rooms[n] ^= 1 << room
                    if not rooms[n]:
                        del rooms[n], bins[n]

    def find(self, back: int, load: int) -> tuple[int, int]:
        """The least load given back, and the bin of least room that takes load for it; there is one."""
        for n in sorted(self.rooms[back]):
            if n < load and (fits := self.rooms[back][n] >> load - n):
                return n, next(iter(self.bins[back][n][load - n + (fits & -fits).bit_length() - 1]))
        raise LookupError(load)


def two_of(items: dict[int, list[int]]) -> dict[int, tuple[int, int]]:
    """Two lengths of each sum that two items have."""
    lengths = sorted(items)
    return {a + b: (a, b) for i, a in enumerate(lengths) for b in lengths[i:] if a < b or len(items[a]) > 1}


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Empties bins, the emptiest first, by moves and exchanges that raise the sum of squared fills.

    Each step takes from an underfull bin and fills a fuller one: an item moves,
    one is exchanged for one or two smaller ones together, or two for one. The sum
    rises strictly, so the search ends: when no step is left in all the underfull
    bins, or when there are no more bins than the least number.
    """
    least = -(-sum(lengths) // capacity)
    held: list[dict[int, list[int]]] = []
    fill = [sum(lengths[i] for i in b) for b in bins]
    for b in bins:
        held.append({})
        for i in b:
            held[-1].setdefault(lengths[i], []).append(i)
    left = sum(1 for f in fill if f)

    def shift(source: int, target: int, loads: tuple[int, ...]) -> None:
        for n in loads:
            held[target].setdefault(n, []).append(held[source][n].pop())
            if not held[source][n]:
                del held[source][n]
            fill[source], fill[target] = fill[source] - n, fill[target] + n

    def step(a: int, index: Underfull) -> tuple[int, tuple[int, ...], tuple[int, ...]] | None:
        """A bin that takes from a, what it takes, and what it gives back."""
        ones = sorted(held[a], reverse=True)
        for back in (0, 1, 2):
            for n in ones:
                if index.cover[back][n]:
                    given, b = index.find(back, n)
                    return b, (n,), ((), (given,), two_of(held[b]).get(given, ()))[back]
        twos = two_of(held[a])
        sums = np.fromiter(twos, np.int64, len(twos))
        fit = sums[index.cover[1][sums] > 0]
        if not len(fit):
            return None
        given, b = index.find(1, int(fit.max()))
        return b, twos[int(fit.max())], (given,)

    changed = True
    while changed and left > least:
        changed, index = False, Underfull(capacity)
        queue = [(f, k) for k, f in enumerate(fill) if 0 < f < capacity]
        for f, k in queue:
            index.add(k, held[k], capacity - f)
        heapq.heapify(queue)
        alike: dict[int, None] = {}  # bins without a step, as full as the last one tried: they may still take
        while queue and left > least:
            f, a = heapq.heappop(queue)
            if fill[a] != f:
                if fill[a] < capacity:
                    heapq.heappush(queue, (fill[a], a))
                continue
            if alike and fill[next(iter(alike))] < f:
                for k in alike:
                    index.remove(k, held[k], capacity - fill[k])
                alike = {}
            index.remove(a, held[a], capacity - f)  # what is left is at least as full
            while held[a] and (found := step(a, index)):
                b, out, back = found
                index.remove(b, held[b], capacity - fill[b])
                shift(a, b, out)
                shift(b, a, back)
                tried = alike.pop(b, 0) is None
                if fill[b] < capacity:
                    index.add(b, held[b], capacity - fill[b])
                    if tried:
                        heapq.heappush(queue, (fill[b], b))
                changed = True
            left -= not held[a]
            if fill[a] == f:
                index.add(a, held[a], capacity - f)
                alike[a] = None
    return [[i for own in h.values() for i in own] for h in held if h]


def pack_block(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin number and offset of each item."""
    where, offset = [0] * len(lengths), [0] * len(lengths)
    for k, items in enumerate(local_search(best_fit(lengths, capacity), lengths, capacity)):
        at = 0
        for i in items:
            where[i], offset[i] = k, at
            at += lengths[i]
    return where, offset


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, block: int = BLOCK, **options) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    An empty table gives no rows. Pieces are written first, so a lost executor
    or a rerun task cannot deal them differently.
    """
    pieces = written(token_pieces(docs, tokenizer, capacity, **options), "pieces")
    blocks = max(1, round(pieces.count() / block))

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["part", "slot"], ignore_index=True)
        where, rows["offset"] = pack_block(rows["length"].tolist(), capacity)
        rows["sequence_id"] = rows["block"].astype("int64") * (1 << 32) + np.array(where, "int64")
        return rows[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("part", "slot"), F.lit(blocks)))
    return dealt.groupBy("block").applyInPandas(packed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
