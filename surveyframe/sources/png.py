"""PNG images as arrays, and their downscaling: what page images need before they are sent on.

Read are images of 8 bits a channel, grey, coloured or by palette, with or without alpha, not interlaced; others raise a ValueError.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np

_MAGIC = b"\x89PNG\r\n\x1a\n"
#: Channels by colour type: grey, colour, palette, grey and alpha, colour and alpha.
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Lobes of the windowed sinc.
LOBES = 3


def read_png(data: bytes) -> np.ndarray:
    """Height, width, channels; a palette's colours take its numbers' place."""
    if data[:8] != _MAGIC:
        raise ValueError("not a PNG image")
    at, packed, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in _CHANNELS or head[6]:
        raise ValueError("only images of 8 bits a channel, not interlaced")
    width, height, _, colour, *_ = head
    n = _CHANNELS[colour]
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * n)
    pixels = _unfiltered(rows[:, 0], rows[:, 1:].reshape(height, width, n))
    return palette[pixels[..., 0]] if colour == 3 else pixels


def _unfiltered(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undoes the filters. Rows as they are, or as differences from the left or from above, are summed up by whole runs; only
    those from the first to the last that look at more than one neighbour are made by diagonals."""
    if not len(rows):
        return rows
    out = np.zeros((len(rows) + 1, *rows.shape[1:]), np.uint8)  # behind a row of zeros
    mixed = np.flatnonzero((kinds == 3) | (kinds == 4))
    first, last = (mixed[0], mixed[-1] + 1) if len(mixed) else (len(rows), len(rows))
    runs = [0, *(np.flatnonzero(kinds[1:] != kinds[:-1]) + 1).tolist(), len(rows)]
    for start, end in zip(runs, runs[1:], strict=False):
        if start == first:
            out[first + 1 : last + 1] = _by_diagonals(kinds[first:last], rows[first:last], out[first])
        if first <= start < last:
            continue
        part, kind = rows[start:end], kinds[start]
        if kind == 1:
            part = np.cumsum(part, axis=1, dtype=np.uint8)
        elif kind == 2:
            part = np.cumsum(part, axis=0, dtype=np.uint8) + out[start]
        out[start + 1 : end + 1] = part
    return out[1:]


def _by_diagonals(kinds: np.ndarray, rows: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Below the row ``top``. A pixel needs those left of, above and above left of it, so all pixels of a diagonal are made at once."""
    height, width, n = rows.shape
    out = np.zeros((height + 1, width + 1, n), np.int16)
    out[0, 1:] = top
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        x = d - y
        left, above, corner, kind = out[y + 1, x], out[y, x + 1], out[y, x], kinds[y][:, None]
        guess = left + above - corner
        a, b, c = abs(guess - left), abs(guess - above), abs(guess - corner)
        nearest = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
        out[y + 1, x + 1] = rows[y, x] + np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, above, (left + above) // 2, nearest], 0) & 0xFF
    return out[1:, 1:].astype(np.uint8)


def write_png(pixels: np.ndarray) -> bytes:
    """Each row as its difference from the row above."""
    height, width, n = pixels.shape
    colour = {1: 0, 3: 2, 2: 4, 4: 6}[n]
    flat = pixels.reshape(height, width * n)
    rows = np.empty((height, 1 + width * n), np.uint8)
    rows[:, 0] = 2
    rows[:1, 1:] = flat[:1]
    rows[1:, 1:] = flat[1:] - flat[:-1]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return _MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


@lru_cache(maxsize=16)
def _weights(n: int, m: int) -> np.ndarray:
    """m x n: how much each of n pixels adds to each of m. The sinc is as much wider as pixels become fewer."""
    scale = n / m
    centre = (np.arange(m)[:, None] + 0.5) * scale
    x = (np.arange(n)[None, :] + 0.5 - centre) / max(scale, 1.0)
    w = np.where(abs(x) < LOBES, np.sinc(x) * np.sinc(x / LOBES), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resized(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """By a windowed sinc, across, then down."""
    across = np.clip(np.rint(np.einsum("yxc,wx->ywc", pixels.astype(np.float64), _weights(pixels.shape[1], width), optimize=True)), 0, 255)
    return np.clip(np.rint(np.einsum("ywc,hy->hwc", across, _weights(pixels.shape[0], height), optimize=True)), 0, 255).astype(np.uint8)


def fitted(data: bytes, max_side: int = 2000) -> bytes:
    """The image, downscaled if a side is longer than ``max_side``; sides are cut to whole pixels, one at least."""
    if data[:8] == _MAGIC and max(struct.unpack_from(">II", data, 16)) <= max_side:
        return data
    pixels = read_png(data)
    height, width, _ = pixels.shape
    ratio = max_side / max(width, height)
    return write_png(resized(pixels, max(1, int(width * ratio)), max(1, int(height * ratio)))) if ratio < 1 else data
