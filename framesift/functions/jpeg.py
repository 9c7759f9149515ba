"""The lossy half of JPEG in NumPy: colour transform, halved chroma, 8 x 8 cosine transform, quantisation, and back.

Entropy coding loses nothing, so an image that went through here is what a baseline encoder and decoder make of it, but
for the integer arithmetic that such libraries use (differences of a level or two).
"""

from __future__ import annotations

import numpy as np

from framesift.functions import pixels

# The standard's quantisation tables for luma and chroma, and the quality at which artefacts are measured.
LUMA = [
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
]
CHROMA = [
    17, 18, 24, 47, 99, 99, 99, 99,
    18, 21, 26, 66, 99, 99, 99, 99,
    24, 26, 56, 99, 99, 99, 99, 99,
    47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
]
QUALITY = 75
#: Red, green and blue in luma and the two colour differences.
TO_YCC = np.array([[0.299, 0.587, 0.114], [-0.168735892, -0.331264108, 0.5], [0.5, -0.418687589, -0.081312411]])
TO_RGB = np.linalg.inv(TO_YCC)
#: Digits that quotients are rounded to before halves go away from zero, so that the order of sums doesn't decide.
DIGITS = 6


def basis() -> np.ndarray:
    """The orthonormal cosine transform of 8 values, a row for each frequency."""
    k = np.arange(8)
    c = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) / 2
    c[0] /= np.sqrt(2)
    return c


BASIS = basis()


def table(base: list[int], quality: int) -> np.ndarray:
    """A quantisation table scaled to a quality of 1 to 100."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(base).reshape(8, 8) * scale + 50) // 100, 1, 255)


def quantised(block: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Coefficients of blocks (..., 8, 8) of samples, in steps; halves away from zero."""
    q = np.round(BASIS @ (block - 128.0) @ BASIS.T / steps, DIGITS)
    return np.sign(q) * np.floor(np.abs(q) + 0.5)


def rebuilt(coefficients: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Samples of quantised blocks."""
    back = BASIS.T @ (coefficients * steps) @ BASIS + 128.0
    return np.clip(np.floor(np.round(back, DIGITS) + 0.5), 0, 255)


def _plane(a: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """A plane of samples through quantisation and back; it is filled up to whole blocks by its last row and column."""
    h, w = a.shape
    full = np.pad(a, ((0, -h % 8), (0, -w % 8)), mode="edge")
    blocks = full.reshape(full.shape[0] // 8, 8, full.shape[1] // 8, 8).swapaxes(1, 2)
    return rebuilt(quantised(blocks, steps), steps).swapaxes(1, 2).reshape(full.shape)[:h, :w]


def _halved(a: np.ndarray) -> np.ndarray:
    """Means of two by two samples; an odd last row or column is repeated."""
    full = np.pad(a, ((0, a.shape[0] % 2), (0, a.shape[1] % 2)), mode="edge")
    return np.floor(full.reshape(full.shape[0] // 2, 2, full.shape[1] // 2, 2).mean(axis=(1, 3)) + 0.5)


def _doubled(a: np.ndarray, axis: int) -> np.ndarray:
    """Twice the samples along an axis: three parts of the sample and one of the nearer neighbour."""
    before = np.concatenate([np.take(a, [0], axis), np.take(a, range(a.shape[axis] - 1), axis)], axis)
    after = np.concatenate([np.take(a, range(1, a.shape[axis]), axis), np.take(a, [-1], axis)], axis)
    return np.stack([0.75 * a + 0.25 * before, 0.75 * a + 0.25 * after], axis + 1).reshape([n * 2 if i == axis else n for i, n in enumerate(a.shape)])


def recompressed(image: np.ndarray, quality: int = QUALITY) -> np.ndarray:
    """An image of BGR or gray bytes after one round of JPEG."""
    h, w = image.shape[:2]
    if image.shape[2] < 3:
        return _plane(image[:, :, 0].astype(float), table(LUMA, quality)).astype(np.uint8)[:, :, None]
    ycc = image[:, :, 2::-1].astype(float) @ TO_YCC.T + [0, 128, 128]
    ycc = np.clip(np.floor(ycc + 0.5), 0, 255)
    luma = _plane(ycc[:, :, 0], table(LUMA, quality))
    chroma = [_doubled(_doubled(_plane(_halved(ycc[:, :, k]), table(CHROMA, quality)), 0), 1)[:h, :w] for k in (1, 2)]
    rgb = (np.stack([luma, *chroma], axis=2) - [0, 128, 128]) @ TO_RGB.T
    return np.clip(np.floor(rgb + 0.5), 0, 255).astype(np.uint8)[:, :, ::-1]


def artifact_score(image: np.ndarray, quality: int = QUALITY) -> float:
    """1 less the likeness of an image and its recompressed copy, mean of the channels: what one more round of JPEG takes from it."""
    after = recompressed(image, quality)
    channels = range(after.shape[2])
    return 1.0 - float(np.mean([pixels.ssim(image[:, :, k].astype(float), after[:, :, k].astype(float)) for k in channels]))
