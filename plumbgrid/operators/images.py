"""Images as packed rows (rows, cols, rgb: binary, three bytes a pixel): resampling, matching to an anchor, derived maps, fields.

One row is an image of bounded size, so rows go through Arrow one batch after the other, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Half-widths of the filters, and the luma weights of a byte image in 65536ths.
LANCZOS, BICUBIC = 3.0, 2.0
LUMA = (19595, 38470, 7471)


def _filter(x: np.ndarray, support: float) -> np.ndarray:
    x = np.abs(x)
    if support == LANCZOS:
        return np.where(x < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    near, far = 1.5 * x**3 - 2.5 * x**2 + 1, -0.5 * (x**3 - 5 * x**2 + 8 * x - 4)
    return np.where(x < 1, near, np.where(x < 2, far, 0.0))


def _weights(size: int, n: int, support: float) -> np.ndarray:
    """n x size: what each place takes of each sample; the filter widens when the image shrinks."""
    scale = size / n
    wide = max(scale, 1.0)
    center = (np.arange(n)[:, None] + 0.5) * scale
    at = np.arange(size)[None, :]
    first, last = np.maximum(0, (center - support * wide + 0.5).astype(int)), np.minimum(size, (center + support * wide + 0.5).astype(int))
    w = np.where((at >= first) & (at < last), _filter((at + 0.5 - center) / wide, support), 0.0)
    return w / w.sum(1, keepdims=True)


def resized(image: np.ndarray, rows: int, cols: int, support: float = LANCZOS) -> np.ndarray:
    """A byte image of another size: columns, then rows, rounded to bytes after each."""
    out = image.astype(np.float64)
    for axis, n in ((1, cols), (0, rows)):
        if out.shape[axis] != n:
            out = np.moveaxis(np.tensordot(_weights(out.shape[axis], n, support), out, (1, axis)), 0, axis)
            out = np.clip(np.floor(out + 0.5), 0, 255)
    return out.astype(np.uint8)


def luma(rgb: np.ndarray) -> np.ndarray:
    return ((rgb.astype(np.int64) @ np.array(LUMA) + 0x8000) >> 16).astype(np.uint8)


def mip_stdev(rgb: np.ndarray, sizes: tuple[int, ...] = (256, 128, 64, 32)) -> dict[int, float]:
    """How much the luma varies at each size that the image is not smaller than."""
    return {s: float(luma(resized(rgb, s, s)).astype(np.float32).std()) for s in sizes if s <= min(rgb.shape[:2])}


def lab(rgb: np.ndarray) -> np.ndarray:
    """Luminance and two channel differences; an approximation."""
    x = rgb.astype(np.float32) / np.float32(255)
    return np.stack([x @ np.array([0.2126, 0.7152, 0.0722], np.float32) * 100, (x[..., 0] - x[..., 1]) * 50, (x[..., 1] - x[..., 2]) * 50], -1)


def rgb_of(values: np.ndarray) -> np.ndarray:
    light, a, b = values[..., 0] / 100, values[..., 1] / 50, values[..., 2] / 50
    return (np.clip(np.stack([light + a * 0.5, light - a * 0.5 + b * 0.25, light - b * 0.5], -1), 0, 1) * 255).astype(np.uint8)


def matched_light(values: np.ndarray, anchor: np.ndarray, bins: int = 256) -> np.ndarray:
    """Luminances (0 to 100) moved so that their distribution is the anchor's, bin by bin."""

    def shares(v):
        total = np.cumsum(np.histogram(v, bins, (0.0, 100.0))[0]).astype(np.float64)
        return total / max(total[-1], 1)

    to = np.interp(shares(values), shares(anchor), np.linspace(0, 100, bins))
    return to[np.clip((values / 100 * (bins - 1)).astype(int), 0, bins - 1)].astype(np.float32)


def matched_spread(values: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Values with the anchor's mean and deviation."""
    return (values - values.mean()) * ((anchor.std() + 1e-6) / (values.std() + 1e-6)) + anchor.mean()


def distance(a: np.ndarray, b: np.ndarray, bins: int = 32) -> float:
    """The mean distance of the channels' distribution functions."""
    gaps = []
    for ch in range(3):
        x, y = (np.cumsum(np.histogram(v[..., ch].astype(np.float32) / np.float32(255), bins, (0.0, 1.0))[0] / max(v[..., ch].size, 1)) for v in (a, b))
        gaps.append(np.abs(x - y).mean())
    return float(np.mean(gaps))


def roughness(rgb: np.ndarray, level: float, contrast: float, snow: bool = False) -> np.ndarray:
    """A byte map around a level from luminance and saturation; on snow bright is rougher."""
    x = rgb.astype(np.float64)
    light = x @ np.array([0.2126, 0.7152, 0.0722]) / 255
    colour = (x.max(-1) - x.min(-1)) / 255
    light, colour = light - light.mean(), colour - colour.mean()
    detail = light * contrast + colour * contrast * 0.5
    return (np.clip(level + (colour * contrast - detail if snow else detail), 0, 1) * 255).astype(np.uint8)


# fields without seams, from numpy's generators


def tileable_noise(size: int, grid: int, seed: int) -> np.ndarray:
    """Random bytes on a grid, enlarged around the edges; mean 0 and deviation 1."""
    low = np.random.default_rng(seed).random((grid, grid), dtype=np.float32)
    wide = np.clip(np.tile(low, (3, 3)) * np.float32(255), 0, 255).astype(np.uint8)
    up = resized(wide, size * 3, size * 3, BICUBIC)[size : 2 * size, size : 2 * size].astype(np.float32) / np.float32(255)
    return (up - up.mean()) / max(float(up.std()), 1e-5)


def tileable_fbm(size: int, seed: int, grids: tuple[int, ...] = (3, 5, 9, 17), gain: float = 0.55) -> np.ndarray:
    weights = [gain**k for k in range(len(grids))]
    return sum(w * tileable_noise(size, g, seed + 7919 * k) for k, (w, g) in enumerate(zip(weights, grids, strict=True))) / max(sum(weights), 1e-5)


def wave_field(size: int, seed: int, terms: int = 5) -> np.ndarray:
    """The mean of sines with whole wave numbers (1 to 4, 0 to 3) and random phases."""
    rng, turn = np.random.default_rng(seed), np.linspace(0, 2 * np.pi, size, endpoint=False, dtype=np.float32)
    total = np.zeros((size, size), np.float32)
    for _ in range(terms):
        across, down, phase = int(rng.integers(1, 5)), int(rng.integers(0, 4)), float(rng.random()) * 2 * np.pi
        total += np.sin(turn[None, :] * across + turn[:, None] * down + phase).astype(np.float32)
    return total / max(terms, 1)


def matched_mean(source: np.ndarray, field: np.ndarray, strength: float = 0.72) -> np.ndarray:
    """A field (0 to 1) moved towards the source's mean colour."""
    own, target = field.mean((0, 1), keepdims=True), source.astype(np.float64).mean((0, 1), keepdims=True) / 255
    return np.clip(field * (1 - strength) + field * (target / np.maximum(own, 1e-4)) * strength, 0, 1)


# over tables


def _image(row) -> np.ndarray:
    return np.frombuffer(row.rgb, np.uint8).reshape(row.rows, row.cols, 3)


def _each(images: DataFrame, columns: str, make) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [make(row) for row in pdf.itertuples(index=False)]
            yield pd.DataFrame([x for rows in found for x in rows], columns=[c.split()[0] for c in columns.split(", ")])

    return images.mapInPandas(run, columns)


def mip_stdevs(images: DataFrame, sizes: tuple[int, ...] = (256, 128, 64, 32)) -> DataFrame:
    """AGG18: (img, size, stdev)."""
    return _each(images.select("img", "rows", "cols", "rgb"), "img long, size int, stdev double", lambda row: [(row.img, s, v) for s, v in mip_stdev(_image(row), sizes).items()])


def mean_colors(images: DataFrame) -> DataFrame:
    """AGG31: (img, red, green, blue): each image as one pixel."""
    return _each(images.select("img", "rows", "cols", "rgb"), "img long, red int, green int, blue int", lambda row: [(row.img, *resized(_image(row), 1, 1)[0, 0].tolist())])


def roughness_maps(images: DataFrame, level: float, contrast: float, snow: bool = False) -> DataFrame:
    """FN25: (img, rows, cols, rough: binary)."""
    return _each(images.select("img", "rows", "cols", "rgb"), "img long, rows int, cols int, rough binary", lambda row: [(row.img, row.rows, row.cols, roughness(_image(row), level, contrast, snow).tobytes())])


def locked_to_anchor(images: DataFrame, family: str, anchor: str) -> DataFrame:
    """FN22, UDF12: (family, img, before, after, rgb): images (family, img, rows, cols, rgb, and a true column for the family's anchor) with the anchor's distribution of luminance and spread of colour, and their distances from it; the anchor stays as it is."""
    own = images.where(F.col(anchor)).select(family, F.struct("rows", "cols", "rgb").alias("__a"))
    rows = images.join(own, family).select(F.col(family).alias("family"), "img", "rows", "cols", "rgb", F.col(anchor).alias("is_anchor"), F.col("__a.rows").alias("arows"), F.col("__a.cols").alias("acols"), F.col("__a.rgb").alias("argb"))

    def make(row):
        image, to = _image(row), np.frombuffer(row.argb, np.uint8).reshape(row.arows, row.acols, 3)
        if row.is_anchor:
            return [(row.family, row.img, 0.0, 0.0, row.rgb)]
        a, b = lab(image), lab(to)
        locked = rgb_of(np.stack([matched_light(a[..., 0], b[..., 0]), *(matched_spread(a[..., k], b[..., k]) for k in (1, 2))], -1))
        return [(row.family, row.img, distance(to, image), distance(to, locked), locked.tobytes())]

    return _each(rows, "family long, img long, before double, after double, rgb binary", make).withColumnRenamed("family", family)


def packed(pixels: DataFrame, img: str = "img") -> DataFrame:
    """Images (img, rows, cols, rgb) of pixels (img, r, c, red, green, blue)."""
    cells = F.array_sort(F.collect_list(F.struct("r", "c", "red", "green", "blue")))
    byte = lambda v: F.lpad(F.hex(v), 2, "0")
    text = F.array_join(F.transform(cells, lambda s: F.concat(byte(s["red"]), byte(s["green"]), byte(s["blue"]))), "")
    return pixels.groupBy(img).agg((F.max("r") + 1).cast("int").alias("rows"), (F.max("c") + 1).cast("int").alias("cols"), F.unhex(text).alias("rgb"))
