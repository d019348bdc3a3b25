from __future__ import annotations

import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pytest

from surveyframe import queries
from surveyframe.sources import extract, png

DATA = "/root/testdata/sf0.001"


def filtered(pixels, kinds):
    """A PNG image whose rows are filtered by these kinds, pixel by pixel."""
    height, width, n = pixels.shape
    at = lambda y, x, c: int(pixels[y, x, c]) if y >= 0 and x >= 0 else 0
    out = bytearray()
    for y in range(height):
        out.append(kinds[y])
        for x in range(width):
            for c in range(n):
                a, b, d = at(y, x - 1, c), at(y - 1, x, c), at(y - 1, x - 1, c)
                p = a + b - d
                nearest = min((abs(p - v), i, v) for i, v in enumerate((a, b, d)))[2]
                out.append((at(y, x, c) - [0, a, b, (a + b) // 2, nearest][kinds[y]]) % 256)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 2: 4, 4: 6}[n], 0, 0, 0)
    packed = zlib.compress(bytes(out))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", packed[:5]) + chunk(b"tEXt", b"x") + chunk(b"IDAT", packed[5:]) + chunk(b"IEND", b"")


def lanczos(row, m):
    """One row of numbers to m, by the definition."""
    n, out = len(row), []
    scale = n / m
    for i in range(m):
        total = weight = 0.0
        for j, v in enumerate(row):
            x = (j + 0.5 - (i + 0.5) * scale) / max(scale, 1)
            w = 0.0 if abs(x) >= 3 else 1.0 if x == 0 else 3 * math.sin(math.pi * x) * math.sin(math.pi * x / 3) / (math.pi * x) ** 2
            total, weight = total + w * v, weight + w
        out.append(min(255, max(0, round(total / weight))))
    return out


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_filters_and_round_trip(channels):
    rnd = np.random.default_rng(channels)
    pixels = rnd.integers(0, 256, (9, 7, channels), dtype=np.uint8)
    assert (png.read_png(filtered(pixels, [0, 1, 2, 3, 4, 4, 3, 2, 1])) == pixels).all()
    assert (png.read_png(png.write_png(pixels)) == pixels).all()
    for bad in (b"", b"text", filtered(pixels, [0] * 9).replace(b"\x08", b"\x10", 1)):
        with pytest.raises((ValueError, struct.error)):
            png.read_png(bad)


@pytest.mark.parametrize("kinds", [[2] * 6 + [1, 1, 0, 0, 2], [1, 2, 4, 0, 2, 2, 3, 1, 2, 2, 0], [0, 2, 2, 4, 4], [3], [1]])
def test_runs_of_filters(kinds):
    pixels = np.random.default_rng(7).integers(0, 256, (len(kinds), 5, 3), dtype=np.uint8)
    assert (png.read_png(filtered(pixels, kinds)) == pixels).all()


def test_simple_filters_need_no_diagonals(monkeypatch):
    monkeypatch.setattr(png, "_by_diagonals", None)
    pixels = np.random.default_rng(8).integers(0, 256, (40, 9, 1), dtype=np.uint8)
    assert (png.read_png(png.write_png(pixels)) == pixels).all() and (png.read_png(filtered(pixels, [0, 1, 2, 2] * 10)) == pixels).all()


def test_resampling():
    rnd = random.Random(1)
    row = [rnd.randrange(256) for _ in range(40)]
    found = png.resized(np.array(row, np.uint8).reshape(1, 40, 1), 13, 1)[0, :, 0].tolist()
    assert max(abs(a - b) for a, b in zip(found, lanczos(row, 13), strict=True)) <= 1
    column = png.resized(np.array(row, np.uint8).reshape(40, 1, 1), 1, 13)[:, 0, 0].tolist()
    assert column == found and (png.resized(np.full((30, 50, 3), 77, np.uint8), 20, 12) == 77).all()


def test_sides(spark):
    wide, small = png.write_png(np.zeros((10, 33, 3), np.uint8)), png.write_png(np.zeros((3, 4, 1), np.uint8))
    assert png.read_png(png.fitted(wide, 20)).shape == (6, 20, 3) and png.fitted(small, 4) is small
    assert png.read_png(png.fitted(png.write_png(np.zeros((1, 300, 1), np.uint8)), 10)).shape == (1, 10, 1)
    df = spark.createDataFrame([(1, wide), (2, small), (3, None), (4, b"no image")], "id int, png binary")
    found = {r.id: r.png for r in extract.fit_images(df, 20).collect()}
    assert png.read_png(found[1]).shape == (6, 20, 3) and found[2] == small and found[3] is None and found[4] == b"no image"


def test_query(spark):
    rows = {r.doc_id: r for r in queries.page_images(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs[::40]:
        data = list((d.text or " ").encode() or b" ")
        data += [32] * (-len(data) % 256)
        height = len(data) // 256
        lines = [data[i * 256 : i * 256 + 256] for i in range(height)]
        ratio = min(1.0, 64 / max(256, height))
        w, h = max(1, int(256 * ratio)), max(1, int(height * ratio))
        across = [lanczos(x, w) for x in lines]
        down = [lanczos([x[i] for x in across], h) for i in range(w)]
        r = rows[d.doc_id]
        assert (r.width, r.height) == (w, h)
        assert r.pixels_sha256 == hashlib.sha256(bytes(down[i][j] for j in range(h) for i in range(w))).hexdigest()
