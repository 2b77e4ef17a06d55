"""Hashed word shingles of whole texts, computed for a batch at once."""

from __future__ import annotations

import numpy as np

#: A-Z to lower case; all white space to blanks.
FOLD = bytes(32 if b in (32, 9, 10, 11, 12, 13) else b + 32 if 65 <= b <= 90 else b for b in range(256))
BASE = 0x9E3779B97F4A7C15
#: Bytes of a text hashed at once.
PART = 2_000_000
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        m = max(n, 1 << 20)
        _powers[:] = []
        for r in (BASE | 1, pow(BASE | 1, -1, 1 << 64)):
            p = np.full(m, r & _MASK, np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p, dtype=np.uint64))
    return _powers[0][:n], _powers[1][:n]


def _parts(text: bytes, k: int) -> list[bytes]:
    """Parts of a long text of at least k words each, the next starting k - 1 words before the last one's end."""
    data = np.frombuffer(text.translate(FOLD), np.uint8) != 32
    starts = np.flatnonzero(data & np.concatenate(([True], ~data[:-1])))
    out, first = [], 0
    while True:
        stop = max(int(np.searchsorted(starts, starts[first] + PART)) if len(starts) else 0, first + k)
        if stop + k > len(starts):
            return [*out, text[starts[first] :] if len(starts) else text]
        out.append(text[starts[first] : starts[stop]])
        first = stop - k + 1


def shingle_hashes(texts: list[str], k: int = 5) -> list[np.ndarray]:
    """Per text the 64-bit hashes of its k-word shingles, in order, repeats included.

    Fewer than k words make one shingle; no word makes none. Long texts are
    hashed in parts, which share the words that shingles need.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    if max(map(len, raw), default=0) > PART + 1000:
        long = {i: np.concatenate([_hashes([p], k)[0] for p in _parts(r, k)]) for i, r in enumerate(raw) if len(r) > PART + 1000}
        short = iter(_hashes([r for i, r in enumerate(raw) if i not in long], k))
        return [long[i] if i in long else next(short) for i in range(len(raw))]
    return _hashes(raw, k)


def _hashes(raw: list[bytes], k: int) -> list[np.ndarray]:
    bounds = np.cumsum([0] + [len(r) + 1 for r in raw])
    data = np.frombuffer((b" ".join(raw) + b" ").translate(FOLD), np.uint8)
    inside = data != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * up[: len(data)], out=total[1:])
    words = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, bounds)
    out = []
    n = max(0, len(words) - k + 1)
    run = np.zeros(n, np.uint64)
    for j in range(k):
        run = run * np.uint64(BASE) + words[j : j + n]
    run = mix(run)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= k:
            out.append(run[a : b - k + 1])
        elif b > a:
            value = np.array([b - a], np.uint64)
            for j in range(a, b):
                value = value * np.uint64(BASE) + words[j]
            out.append(mix(value + np.uint64(b - a)))
        else:
            out.append(run[:0])
    return out


def shingle_sets(texts: list[str], k: int = 5) -> list[np.ndarray]:
    """Per text its distinct shingles, ascending."""
    out = []
    for x in shingle_hashes(texts, k):
        x = np.sort(x)
        out.append(x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) > 1 else x)
    return out
