"""Sizes from headers, JPEG's lossy half, and scorers that a caller brings."""

from __future__ import annotations

import struct

import numpy as np
import pytest

from framesift.functions import jpeg, pixels
from framesift.sources import files, headers


def marker(kind: int, payload: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(payload) + 2) + payload


def chunk(kind: bytes, payload: bytes) -> bytes:
    return kind + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)


def riff(*chunks: bytes) -> bytes:
    body = b"WEBP" + b"".join(chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def tiff(order: str, w: int, h: int, form: int, gap: int) -> bytes:
    entry = lambda tag, value: struct.pack(f"{order}HHI", tag, form, 1) + (struct.pack(f"{order}HH", value, 0) if form == 3 else struct.pack(f"{order}I", value))
    entries = [entry(254, 0), entry(256, w), entry(257, h), entry(258, 8)]
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(f"{order}I", 8 + gap)
    return head + b"\0" * gap + struct.pack(f"{order}H", len(entries)) + b"".join(entries) + struct.pack(f"{order}I", 0)


FRAME = lambda kind: marker(kind, struct.pack(">BHHB", 8, 300, 451, 3) + bytes(9))
BODY = b"\x55" * 300_000
IMAGES = {
    "a.png": (b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 70_000, 3) + BODY, ("png", 70_000, 3)),
    "base.jpg": (b"\xff\xd8" + marker(0xE0, b"JFIF\0" + bytes(9)) + FRAME(0xC0) + BODY, ("jpeg", 451, 300)),
    # a thumbnail with a frame header of its own, fill bytes, tables, a progressive frame
    "sub/exif.JPEG": (b"\xff\xd8" + marker(0xE1, b"Exif\0\0" + FRAME(0xC0) + bytes(60_000)) + b"\xff\xff" + marker(0xC4, bytes(20)) + marker(0xDB, bytes(65)) + FRAME(0xC2) + BODY, ("jpeg", 451, 300)),
    "lossy.webp": (riff(chunk(b"VP8 ", b"\x30\x01\x00\x9d\x01\x2a" + struct.pack("<HH", 640 | 1 << 14, 480) + BODY)), ("webp", 640, 480)),
    "lossless.webp": (riff(chunk(b"VP8L", b"\x2f" + struct.pack("<I", 99 | 199 << 14) + BODY)), ("webp", 100, 200)),
    "big.webp": (riff(chunk(b"VP8X", bytes(4) + (69_999).to_bytes(3, "little") + (9).to_bytes(3, "little")), chunk(b"ICCP", BODY)), ("webp", 70_000, 10)),
    "little.tif": (tiff("<", 33, 44, 3, 250_000), ("tiff", 33, 44)),
    "big.tiff": (tiff(">", 100_000, 2, 4, 10) + BODY, ("tiff", 100_000, 2)),
    "w.bmp": (b"BM" + bytes(12) + struct.pack("<Iii", 40, 31, -17) + BODY, ("bmp", 31, 17)),
    "old.bmp": (b"BM" + bytes(12) + struct.pack("<IHH", 12, 7, 8) + BODY, ("bmp", 7, 8)),
    "named wrong.png": (b"BM" + bytes(12) + struct.pack("<Iii", 40, 5, 6), ("bmp", 5, 6)),
}
BROKEN = {"empty.png": b"", "short.jpg": b"\xff\xd8" + marker(0xE0, bytes(9))[:-4], "none.jpg": b"\xff\xd8" + marker(0xDA, bytes(8)), "text.png": b"no image at all", "still.webp": riff(chunk(b"ALPH", bytes(8))), "cut.tif": b"II*\0" + struct.pack("<I", 5000)}


def test_sizes_from_headers(spark, tmp_path):
    for name, (content, _) in IMAGES.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    for name, content in BROKEN.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "notes.txt").write_text("no image")
    rows = {r.rel: r for r in headers.image_headers(spark, str(tmp_path), files=3).collect()}
    assert set(rows) == {*IMAGES, *BROKEN}
    for name, (content, want) in IMAGES.items():
        got = rows[name]
        assert (got.kind, got.w, got.h, got.error) == (*want, None), name
        assert got.size == len(content) and got.path == str(tmp_path / name)
        # a few ranges, however large the file is
        assert 0 < got.bytes_read <= 4 * headers.RANGE, name
    for name in BROKEN:
        assert rows[name].error and rows[name].w is None, name
    assert headers.image_headers(spark, str(tmp_path / "nowhere")).count() == 0
    assert headers.image_headers(spark, str(tmp_path), files=3).rdd.getNumPartitions() == -(-len(rows) // 3)


def by_the_definition(block: np.ndarray, quality: int) -> np.ndarray:
    """One block of luma, coefficient by coefficient."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    out = np.zeros((8, 8))
    root = lambda k: 1 / np.sqrt(2) if k == 0 else 1.0
    wave = lambda x, u: np.cos((2 * x + 1) * u * np.pi / 16)
    for u in range(8):
        for v in range(8):
            total = sum((block[x, y] - 128) * wave(x, u) * wave(y, v) for x in range(8) for y in range(8))
            step = min(255, max(1, (jpeg.LUMA[8 * u + v] * scale + 50) // 100))
            q = round(root(u) * root(v) * total / 4 / step, jpeg.DIGITS)
            out[u, v] = np.sign(q) * np.floor(abs(q) + 0.5) * step
    back = np.array([[sum(root(u) * root(v) * out[u, v] * wave(x, u) * wave(y, v) for u in range(8) for v in range(8)) / 4 + 128 for y in range(8)] for x in range(8)])
    return np.clip(np.floor(np.round(back, jpeg.DIGITS) + 0.5), 0, 255)


@pytest.mark.parametrize("quality", [20, 75, 95])
def test_blocks_by_the_definition(quality):
    rng = np.random.default_rng(quality)
    for block in (rng.integers(0, 256, (8, 8)), np.full((8, 8), 77), np.add.outer(np.arange(8), np.arange(8)) * 16):
        assert np.array_equal(jpeg.recompressed(block.astype(np.uint8)[:, :, None], quality)[:, :, 0], by_the_definition(block, quality))


def test_table_of_a_quality():
    # worked by hand: at 75 the scale is 50, so 16 -> (800 + 50) // 100 = 8, 11 -> 6, 99 -> 50
    assert jpeg.table(jpeg.LUMA, 75)[0, :2].tolist() == [8, 6] and jpeg.table(jpeg.CHROMA, 75)[7, 7] == 50
    assert jpeg.table(jpeg.LUMA, 100).max() == 1 and jpeg.table(jpeg.LUMA, 1).max() == 255


def test_artifact_score():
    rng = np.random.default_rng(5)
    ramp = np.add.outer(np.arange(50), np.arange(67)) * 2 % 256
    smooth = np.repeat(ramp[:, :, None], 3, axis=2).astype(np.uint8)
    noisy = rng.integers(0, 256, (50, 67, 3)).astype(np.uint8)
    flat = np.full((21, 9, 3), 200, np.uint8)
    assert jpeg.recompressed(noisy).shape == noisy.shape and np.abs(jpeg.recompressed(flat).astype(int) - 200).max() <= 1
    assert jpeg.artifact_score(flat) == pytest.approx(0, abs=0.01)
    scores = [jpeg.artifact_score(noisy, q) for q in (95, 75, 30, 5)]
    assert scores == sorted(scores) and jpeg.artifact_score(smooth) < scores[1]
    # what went through JPEG once loses less the second time
    assert jpeg.artifact_score(jpeg.recompressed(noisy)) < scores[1]
    assert jpeg.artifact_score(noisy[:1, :1]) >= 0


def test_scorers_of_a_caller(spark, tmp_path, make_png):
    rng = np.random.default_rng(1)
    (tmp_path / "a.png").write_bytes(make_png(rng.integers(0, 255, (20, 30, 3)).tolist()))
    (tmp_path / "flat.png").write_bytes(make_png(np.full((16, 16, 3), 9).tolist()))
    (tmp_path / "bad.png").write_bytes(b"none")

    def picky(picture) -> float:
        if picture.bgr.max() < 10:
            raise RuntimeError("too dark")
        return float(picture.gray.max())

    more = {"jpeg": pixels.NAMED["jpeg"], "picky": picky, "odd": lambda p: float("nan")}
    rows = {r.path.rpartition("/")[2]: r for r in pixels.image_metrics(files.decoded(spark, str(tmp_path)), more).collect()}
    assert rows["a.png"].picky > 100 and rows["a.png"].jpeg > 0 and rows["a.png"].odd is None and rows["a.png"].error is None
    assert rows["flat.png"].picky is None and rows["flat.png"].blur == 0 and rows["flat.png"].error is None
    assert rows["bad.png"].error and rows["bad.png"].jpeg is None
    with pytest.raises(ValueError):
        pixels.image_metrics(files.decoded(spark, str(tmp_path)), {"blur": picky})
