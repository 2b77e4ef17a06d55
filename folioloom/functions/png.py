"""Images of the PNG format by the standard library, and the row differences that PDF streams share with it."""

from __future__ import annotations

import struct
import zlib

import numpy as np

# Fixed values of the format: its first bytes, and the samples of a pixel by colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _row(form: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A row of bytes from its differences to the byte before, above, to their mean, or to the likest of three."""
    match form:
        case 0:
            return row
        case 2:
            return row + above
        case 1:
            out = np.zeros(-(-len(row) // step) * step, np.uint8)
            out[: len(row)] = row
            return np.cumsum(out.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)[: len(row)]
        case 3:
            got = bytearray(row.tobytes())
            over = above.tolist()
            for k in range(len(got)):
                got[k] = (got[k] + ((got[k - step] if k >= step else 0) + over[k]) // 2) & 255
        case 4:
            got = bytearray(row.tobytes())
            over = above.tolist()
            for k in range(len(got)):
                left, corner = (got[k - step], over[k - step]) if k >= step else (0, 0)
                up = over[k]
                to_left, to_up, to_corner = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
                got[k] = (got[k] + (left if to_left <= to_up and to_left <= to_corner else up if to_up <= to_corner else corner)) & 255
        case _:
            raise ValueError(f"unknown row form {form}")
    return np.frombuffer(got, np.uint8)


def rows_of_bytes(data: bytes, size: int, step: int) -> bytes:
    """Rows of size bytes, each after a byte that tells its form; a last row may be shorter."""
    out, above = [], np.zeros(size, np.uint8)
    for at in range(0, len(data), size + 1):
        row = np.frombuffer(data, np.uint8, min(size, len(data) - at - 1), at + 1)
        made = _row(data[at], row, above[: len(row)], step)
        out.append(made.tobytes())
        above = np.concatenate([made, np.zeros(size - len(made), np.uint8)])
    return b"".join(out)


def samples(rows: bytes, width: int, height: int, per_pixel: int, bits: int) -> np.ndarray:
    """(height, width, samples of a pixel) of packed rows; of 16 bits the upper 8."""
    size = (width * per_pixel * bits + 7) // 8
    grid = np.frombuffer(rows, np.uint8, size * height).reshape(height, size)
    if bits == 16:
        grid = grid[:, ::2]
    elif bits < 8:
        grid = np.unpackbits(grid, axis=1)[:, : width * per_pixel * bits].reshape(height, -1, bits)
        grid = grid @ (1 << np.arange(bits - 1, -1, -1)).astype(np.uint8)
    return grid[:, : width * per_pixel].reshape(height, width, per_pixel)


def pixels(blob: bytes) -> np.ndarray:
    """(height, width, 3) of an image that is not interlaced; raises ValueError for others. Transparency is left out."""
    if not blob.startswith(SIGNATURE):
        raise ValueError("this is no PNG image")
    at, parts = len(SIGNATURE), {}
    while at + 8 <= len(blob):
        size, kind = struct.unpack_from(">I4s", blob, at)
        parts[kind] = parts.get(kind, b"") + blob[at + 8 : at + 8 + size]
        at += size + 12
    width, height, bits, colour, _, _, interlaced = struct.unpack(">IIBBBBB", parts[b"IHDR"])
    if interlaced or colour not in SAMPLES:
        raise ValueError("an interlaced image, or one of unknown colours")
    n = SAMPLES[colour]
    rows = rows_of_bytes(zlib.decompress(parts[b"IDAT"]), (width * n * bits + 7) // 8, max(1, n * bits // 8))
    got = samples(rows, width, height, n, bits)
    if colour == 3:
        return np.frombuffer(parts[b"PLTE"], np.uint8).reshape(-1, 3)[got[:, :, 0]]
    if bits < 8:
        got = (got * (255 // ((1 << bits) - 1))).astype(np.uint8)
    return got[:, :, :3] if n >= 3 else np.repeat(got[:, :, :1], 3, axis=2)


def image(grid: np.ndarray) -> bytes:
    """A PNG image of 8-bit samples (height, width, 1 or 3)."""
    height, width, n = grid.shape
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.concatenate([np.zeros((height, 1), np.uint8), grid.reshape(height, width * n)], axis=1)
    head = struct.pack(">IIBBBBB", width, height, 8, 0 if n == 1 else 2, 0, 0, 0)
    return SIGNATURE + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows.tobytes())) + part(b"IEND", b"")
