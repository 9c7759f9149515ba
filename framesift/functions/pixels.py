"""Metrics on pixels, with NumPy inside Arrow batches.

Images come as rows of BGR bytes, as Spark's image reader gives them. The definitions are those of the usual
libraries (reflected borders, population statistics); results agree with them in meaning, not to the last bit.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator, Mapping
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def pixels(data: bytes, h: int, w: int, channels: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(h, w, channels)


def gray(image: np.ndarray) -> np.ndarray:
    """Luma of BGR pixels, rounded to bytes."""
    if image.shape[2] == 1:
        return image[:, :, 0].astype(float)
    return np.rint(image[:, :, :3].astype(float) @ [0.114, 0.587, 0.299])


def _padded(a: np.ndarray, n: int) -> np.ndarray:
    """Mirrored without the edge pixel; an image of one pixel a side repeats it."""
    for axis in (0, 1):
        widths = [(0, 0), (0, 0)]
        widths[axis] = (n, n)
        a = np.pad(a, widths, mode="reflect" if a.shape[axis] > n else "edge")
    return a


def laplacian(a: np.ndarray) -> np.ndarray:
    p = _padded(a, 1)
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * a


def blur(a: np.ndarray, size: int, sigma: float = 0.0) -> np.ndarray:
    """Gaussian blur; without sigma the size sets it."""
    sigma = sigma or 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    x = np.arange(size) - size // 2
    kernel = np.exp(-(x**2) / (2 * sigma**2))
    kernel /= kernel.sum()
    p = _padded(a, size // 2)
    rows = sum(k * p[i : i + a.shape[0], :] for i, k in enumerate(kernel))
    return sum(k * rows[:, i : i + a.shape[1]] for i, k in enumerate(kernel))


def blur_score(a: np.ndarray) -> float:
    """Variance of the Laplacian: higher is sharper."""
    return float(laplacian(a).var())


def noise_score(a: np.ndarray) -> float:
    return float((a - blur(a, 5)).std())


def ssim(a: np.ndarray, b: np.ndarray, span: float = 255.0, size: int = 7) -> float:
    """Mean structural similarity over uniform windows, with sample covariances."""
    size = min(size, *a.shape)
    size -= 1 - size % 2
    n = size * size

    def mean(x: np.ndarray) -> np.ndarray:
        s = np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        return (s[size:, size:] - s[:-size, size:] - s[size:, :-size] + s[:-size, :-size]) / n

    ma, mb = mean(a), mean(b)
    unbiased = n / (n - 1) if n > 1 else 1.0
    va, vb, cov = unbiased * (mean(a * a) - ma * ma), unbiased * (mean(b * b) - mb * mb), unbiased * (mean(a * b) - ma * mb)
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    return float((((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))).mean())


def high_frequency(a: np.ndarray, cutoff: float = 0.25) -> float:
    """Mean magnitude of the spectrum without its middle."""
    spectrum = np.abs(np.fft.fftshift(np.fft.fft2(a)))
    h, w = a.shape
    dh, dw = int(h * cutoff), int(w * cutoff)
    spectrum[h // 2 - dh : h // 2 + dh, w // 2 - dw : w // 2 + dw] = 0
    return float(spectrum.mean())


def hf_loss(original: np.ndarray, rebuilt: np.ndarray, cutoff: float = 0.25) -> float:
    """Share of high frequencies that a reconstruction loses."""
    before = high_frequency(original, cutoff)
    return 0.0 if before < 1e-6 else max(0.0, (before - high_frequency(rebuilt, cutoff)) / before)


def resized(a: np.ndarray, h: int, w: int, lobes: int = 3) -> np.ndarray:
    """Lanczos resampling, one axis after the other."""

    def weights(n_in: int, n_out: int) -> np.ndarray:
        scale = max(1.0, n_in / n_out)
        centre = (np.arange(n_out) + 0.5) * n_in / n_out
        x = (np.arange(n_in)[None, :] + 0.5 - centre[:, None]) / scale
        k = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
        return k / k.sum(axis=1, keepdims=True)

    return np.clip(np.rint(weights(a.shape[0], h) @ a @ weights(a.shape[1], w).T), 0, 255)


def upscaled_size(h: int, w: int, target: int) -> tuple[int, int]:
    scale = target / min(h, w)
    return int(h * scale), int(w * scale)


def hallucination(original: np.ndarray, upscaled: np.ndarray) -> float:
    """Likeness of the blurred original and its upscaled version."""
    return ssim(blur(resized(original, *upscaled.shape), 21), blur(upscaled, 21))


def perceptual_hash(a: np.ndarray, side: int = 8) -> int:
    """64 bits: low frequencies of a small copy, against their median."""
    n = side * 4
    k = np.arange(n)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))
    low = (basis @ resized(a, n, n) @ basis.T)[:side, :side]
    bits = (low > np.median(low)).ravel()
    return int(np.packbits(bits).view(">i8")[0])


def lightness(image: np.ndarray) -> np.ndarray:
    """L of CIE LAB, 0 to 100."""
    c = image[:, :, 2::-1].astype(float) / 255
    linear = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    y = linear @ [0.2126729, 0.7151522, 0.0721750]
    return np.where(y > 0.008856, 116 * np.cbrt(y) - 16, 903.3 * y)


def difference_views(original: np.ndarray, rebuilt: np.ndarray, gain: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """Soft and hard views of where two images differ: errors inside the mask are amplified, others shown faintly."""
    error = np.abs(original.astype(float) - rebuilt.astype(float)).mean(axis=2)
    smooth = blur(error, 5)
    mask = smooth > otsu(smooth)
    return np.clip(np.where(mask, gain * error, 0.25 * error), 0, 255).astype(np.uint8), mask.astype(np.uint8) * 255


def otsu(a: np.ndarray) -> float:
    """The byte threshold that parts values best; mean plus deviation where all are alike."""
    counts = np.bincount(np.clip(np.rint(a), 0, 255).astype(int).ravel(), minlength=256).astype(float)
    total, levels = counts.sum(), np.arange(256)
    below, moment = counts.cumsum(), (counts * levels).cumsum()
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (moment[-1] * below / total - moment) ** 2 / (below * (total - below))
    between = np.nan_to_num(between)
    return float(between.argmax()) if between.max() > 0 else float(a.mean() + a.std())


class Picture:
    """An image that its scorers share: each form of it is made once, when the first scorer asks for it."""

    def __init__(self, data: bytes, h: int, w: int, channels: int) -> None:
        self.bgr = pixels(data, h, w, channels)

    @cached_property
    def gray(self) -> np.ndarray:
        return gray(self.bgr)


Scoring = Callable[[Picture], float]


def _jpeg(picture: Picture) -> float:
    from framesift.functions.jpeg import artifact_score

    return artifact_score(picture.bgr)


#: Scorers that every image gets, and those that a caller may name; all are numbers.
BASIC: dict[str, Scoring] = {"min_side": lambda p: min(p.bgr.shape[:2]), "blur": lambda p: blur_score(p.gray), "noise": lambda p: noise_score(p.gray)}
NAMED: dict[str, Scoring] = {"jpeg": _jpeg}


def image_metrics(images: DataFrame, more: Mapping[str, Scoring] | None = None) -> DataFrame:
    """path, min_side, blur, noise, phash, a column for each of more, and error, of each of (path, w, h, channels, data).

    All scorers of an image work on one decoded copy. A row that can't be read, or that a basic scorer fails on, has an error and no
    values; where one of more fails, or gives no number, its value is null and the row's others stay. Names of more are
    names of columns; they replace none of the basic ones.
    """
    extra = dict(more or {})
    if clash := extra.keys() & {"path", "phash", "error", *BASIC}:
        raise ValueError(f"scorers named {sorted(clash)} are there already")
    names = ["path", *BASIC, "phash", *extra, "error"]
    types = [pa.string(), pa.int64(), *[pa.float64()] * (len(BASIC) - 1), pa.int64(), *[pa.float64()] * len(extra), pa.string()]
    kinds = ["string", "long", *["double"] * (len(BASIC) - 1), "long", *["double"] * len(extra), "string"]

    def optional(score: Scoring, picture: Picture) -> float | None:
        try:
            value = float(score(picture))
        except Exception:  # an optional scorer that fails gives no value
            return None
        return None if np.isnan(value) else value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, w, h, channels, data in zip(*(batch.column(c).to_pylist() for c in ("path", "w", "h", "channels", "data")), strict=True):
                try:
                    picture = Picture(data, h, w, channels)
                    basic = [score(picture) for score in BASIC.values()]
                    rows.append((path, *basic, perceptual_hash(picture.gray), *(optional(score, picture) for score in extra.values()), None))
                except Exception as e:  # a broken image is a row with an error, not a failed job
                    rows.append((path, *[None] * (len(names) - 2), str(e)[:200]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    schema = ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True))
    return images.select("path", "w", "h", "channels", "data").mapInArrow(run, schema)


def reconstruction_loss(pairs: DataFrame, cutoff: float = 0.25) -> DataFrame:
    """path, hf_loss, ssim, error of (path, w, h, channels, data, rebuilt); failures have an error and no score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, w, h, channels, data, rebuilt in zip(*(batch.column(c).to_pylist() for c in ("path", "w", "h", "channels", "data", "rebuilt")), strict=True):
                try:
                    a, b = pixels(data, h, w, channels), pixels(rebuilt, h, w, channels)
                    rows.append((path, hf_loss(lightness(a), lightness(b), cutoff), ssim(gray(a), gray(b)), None))
                except Exception as e:  # as above
                    rows.append((path, None, None, str(e)[:200]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.string(), pa.float64(), pa.float64(), pa.string()])], names=["path", "hf_loss", "ssim", "error"])

    return pairs.select("path", "w", "h", "channels", "data", "rebuilt").mapInArrow(run, "path string, hf_loss double, ssim double, error string")


def png_bytes(image: np.ndarray) -> bytes:
    """BGR or gray pixels as a PNG file."""
    rgb = image[:, :, 2::-1] if image.shape[2] >= 3 else np.repeat(image[:, :, :1], 3, axis=2)
    h, w = rgb.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(rgb, np.uint8).reshape(h, w * 3)], axis=1)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows.tobytes())) + part(b"IEND", b"")


def resampled(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """All channels of an image, by Lanczos."""
    return np.stack([resized(image[:, :, c].astype(float), h, w) for c in range(image.shape[2])], axis=2).astype(np.uint8)


def region_crops(regions: DataFrame) -> DataFrame:
    """rel, content (PNG), error of regions (crop, left, top, right, bottom, w, h, channels, data); bounds as crop_bounds gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                try:
                    cut = pixels(r["data"], r["h"], r["w"], r["channels"])[r["top"] : r["bottom"], r["left"] : r["right"]]
                    rows.append((f"{r['crop']}.png", png_bytes(cut), None))
                except Exception as e:  # as above
                    rows.append((f"{r['crop']}.png", None, str(e)[:200]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.binary(), pa.string()))], names=["rel", "content", "error"])

    return regions.select("crop", "left", "top", "right", "bottom", "w", "h", "channels", "data").mapInArrow(run, "rel string, content binary, error string")


#: Strength of denoising, and the sides of its patches and of the window that they are looked for in.
DENOISE, PATCH, WINDOW = 3.0, 7, 21


def denoised(image: np.ndarray, strength: float = DENOISE, patch: int = PATCH, window: int = WINDOW) -> np.ndarray:
    """Non-local means: each pixel becomes the mean of those around it, weighted by how like their patches are, over all channels.

    For each shift within the window the squared differences of the image and its shifted copy are summed over patches by an
    integral image, so a shift costs what the image is, whatever the patch. Borders are mirrored.
    """
    h, w, channels = image.shape
    reach, half = window // 2, patch // 2
    wide = np.stack([_padded(image[:, :, c].astype(float), reach + half) for c in range(channels)], axis=2)
    base = wide[reach : reach + h + 2 * half, reach : reach + w + 2 * half]
    total, weight = np.zeros((h, w, channels)), np.zeros((h, w, 1))
    scale = strength * strength * channels * patch * patch
    for dy in range(window):
        for dx in range(window):
            moved = wide[dy : dy + h + 2 * half, dx : dx + w + 2 * half]
            squares = ((base - moved) ** 2).sum(axis=2)
            sums = np.pad(squares.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
            apart = sums[patch:, patch:] - sums[:-patch, patch:] - sums[patch:, :-patch] + sums[:-patch, :-patch]
            alike = np.exp(-np.maximum(apart, 0.0) / scale)[:, :, None]
            total += alike * moved[half : half + h, half : half + w]
            weight += alike
    return np.clip(np.rint(total / weight), 0, 255).astype(np.uint8)


def upscaled(images: DataFrame, target: int) -> DataFrame:
    """path, content (PNG), ssim, error of images (path, divisor, w, h, channels, data), brought by Lanczos to a short side of target.

    A JPEG is denoised first. An image with a divisor is shrunk by it, so that what compression left goes, and brought to its own short side
    at least. ssim is its likeness to the original.
    """
    jpeg = re.compile(r"\.jpe?g$", re.IGNORECASE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                try:
                    before = image = pixels(r["data"], r["h"], r["w"], r["channels"])
                    if jpeg.search(r["path"]):
                        image = denoised(image)
                    if r["divisor"]:
                        image = resampled(image, max(1, r["h"] // r["divisor"]), max(1, r["w"] // r["divisor"]))
                    after = resampled(image, *upscaled_size(r["h"], r["w"], max(target, min(r["h"], r["w"])) if r["divisor"] else target))
                    rows.append((r["path"], png_bytes(after), hallucination(gray(before), gray(after)), None))
                except Exception as e:  # as above
                    rows.append((r["path"], None, None, str(e)[:200]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.binary(), pa.float64(), pa.string()))], names=["path", "content", "ssim", "error"])

    return images.select("path", "divisor", "w", "h", "channels", "data").mapInArrow(run, "path string, content binary, ssim double, error string")
