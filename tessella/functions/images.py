"""Dense features of images: histograms of colour, orientation, texture and hue over a spatial pyramid.

Pixels become one whole number each (for orientations, with a weight); a cell's feature is the share of each number in
it. The pyramid has 1, 4 and 16 cells inside a margin of PAD pixels. An image without room for a cell has zeros there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PAD = 3
#: splits by axis and weight of each level
LEVELS = ((1, 0.25), (2, 0.25), (4, 0.5))
SIZES = {"rgb": 512, "hog": 9, "lbp": 256, "hsv": 65}


def _grey(rgb: np.ndarray, step: int = 3) -> np.ndarray:
    return rgb.astype(np.int64).sum(axis=2) // step


def rgb_bins(rgb: np.ndarray) -> tuple[np.ndarray, None]:
    """The three high bits of each channel, red highest."""
    high = rgb.astype(np.int64) >> 5
    return high @ np.array([64, 8, 1]), None


def hog_bins(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nine orientations of the grey gradient and its size; border pixels have size 0."""
    grey, bins, size = _grey(rgb), np.zeros(rgb.shape[:2], np.int64), np.zeros(rgb.shape[:2])
    if min(grey.shape) >= 3:
        dx = (grey[1:-1, 2:] - grey[1:-1, :-2]).astype(np.float32)
        dy = (grey[2:, 1:-1] - grey[:-2, 1:-1]).astype(np.float32)
        size[1:-1, 1:-1] = np.hypot(dx, dy)
        with np.errstate(divide="ignore", invalid="ignore"):
            # a drop over the full range counts as upright
            angle = np.arctan((dy / np.where(dx == -255, np.float32(1e-3), dx)).astype(np.float64))
        place = SIZES["hog"] * (0.5 + np.nan_to_num(angle, nan=-np.pi / 2) / np.pi)
        bins[1:-1, 1:-1] = np.clip(place.astype(np.int64), 0, SIZES["hog"] - 1)
    return bins, size


def lbp_bins(rgb: np.ndarray) -> tuple[np.ndarray, None]:
    """Which of the eight neighbours are brighter, at steps of four grey levels; row by row, the first is the high bit."""
    grey, bins = _grey(rgb, 12), np.zeros(rgb.shape[:2], np.int64)
    h, w = grey.shape
    if min(h, w) >= 3:
        near = [(y, x) for y in range(3) for x in range(3) if (y, x) != (1, 1)]
        bits = [(grey[y : h - 2 + y, x : w - 2 + x] > grey[1:-1, 1:-1]).astype(np.int64) for y, x in near]
        bins[1:-1, 1:-1] = sum(b << 7 - i for i, b in enumerate(bits))
    return bins, None


def hsv_bins(rgb: np.ndarray) -> tuple[np.ndarray, None]:
    """Sixteen hues by four saturations, and 0 for what is darker than a quarter."""
    v = rgb.astype(np.float32)
    top, low = v.max(axis=2), v.min(axis=2)
    spread = np.where(top > low, top - low, 1)
    red, green, blue = ((top - v[..., i]) / spread for i in range(3))
    hue = np.where(v[..., 0] == top, blue - green, np.where(v[..., 1] == top, 2 + red - blue, 4 + green - red)) / 6
    hue = np.where(top > low, hue % 1, 0)
    saturation = np.where(top > 0, (top - low) / np.maximum(top, 1), 0)
    rounded = lambda x: np.floor(x + 0.5).astype(np.int64)
    return np.where(top / 255 > 0.25, 1 + 16 * rounded(3 * saturation) + rounded(15 * hue), 0), None


BINS = {"rgb": rgb_bins, "hog": hog_bins, "lbp": lbp_bins, "hsv": hsv_bins}


def pyramid(bins: np.ndarray, weights: np.ndarray | None, size: int) -> np.ndarray:
    """The shares of each bin by cell, levels in order and cells column by column."""
    h, w = bins.shape
    out = []
    for splits, scale in LEVELS:
        dx, dy = (max(0, n - 2 * PAD) // splits for n in (w, h))
        for i in range(splits):
            for j in range(splits):
                at = np.s_[PAD + j * dy : PAD + (j + 1) * dy, PAD + i * dx : PAD + (i + 1) * dx]
                found = np.bincount(bins[at].ravel(), None if weights is None else weights[at].ravel(), size)
                out.append(scale * found / found.sum() if found.sum() > 0 else np.zeros(size))
    return np.concatenate(out)


def features(rgb: np.ndarray) -> dict[str, np.ndarray]:
    """All dense features of one image (height x width x 3, red first)."""
    return {name: pyramid(*of(rgb), SIZES[name]) for name, of in BINS.items()}


def with_features(images: DataFrame) -> DataFrame:
    """``origin`` and the dense columns ``d:rgb``, ``d:hog``, ``d:lbp`` and ``d:hsv`` of what ``sources.scans.decoded_images``
    gives; grey images count as equal in all channels, transparency is left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = row["image"]
                pixels = np.frombuffer(at["data"], np.uint8).reshape(at["height"], at["width"], at["nChannels"])
                rgb = np.repeat(pixels, 3, axis=2) if at["nChannels"] == 1 else pixels[:, :, 2::-1]  # stored blue first
                found = features(rgb)
                columns = [pa.array([at["origin"]]), *(pa.array([found[k].tolist()], pa.list_(pa.float64())) for k in SIZES)]
                yield pa.RecordBatch.from_arrays(columns, ["origin", *(f"d:{k}" for k in SIZES)])

    return images.select("image").mapInArrow(work, "origin string, " + ", ".join(f"`d:{k}` array<double>" for k in SIZES))
