"""Rasters in long form (page, r, c, h): stencils by windows; whole-page kernels by Arrow grouped maps.

The page is the unit of parallelism: stencils partition by page, kernels get one page each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import fbm


def grid(spark, n: int, pages: DataFrame | None = None, extent: float | None = None) -> DataFrame:
    """n x n samples (r, c), of each of `pages` (page_x, page_z) if given; with `extent` also their places x, z."""
    cells = spark.range(n * n).select(F.expr(f"CAST(id div {n} AS INT)").alias("r"), (F.col("id") % n).cast("int").alias("c"))
    if pages is None:
        return cells
    rows = pages.select("*", F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))).alias("k"))
    rows = rows.withColumns({"r": F.expr(f"CAST(k div {n} AS INT)"), "c": (F.col("k") % n).cast("int")}).drop("k")
    step = (extent or n - 1) / max(n - 1, 1)
    return rows.withColumns({"x": F.col("page_x") + F.col("c") * step, "z": F.col("page_z") + F.col("r") * step})


def noise_pages(pages: DataFrame, n: int, extent: float, seed: int = 0, **settings) -> DataFrame:
    return grid(pages.sparkSession, n, pages, extent).withColumn("h", fbm(F.col("x"), F.col("z"), seed=seed, **settings))


def gradient(df: DataFrame, page: list[str], cell: float = 1.0) -> DataFrame:
    """Adds gx, gy: central differences, one-sided at the edges."""
    for name, along, across in (("gx", "c", "r"), ("gy", "r", "c")):
        w = Window.partitionBy(*page, across).orderBy(along)
        lo, hi, h = F.lag("h").over(w), F.lead("h").over(w), F.col("h")
        step = F.when(lo.isNull() & hi.isNull(), F.lit(0.0)).when(lo.isNull(), hi - h).when(hi.isNull(), h - lo).otherwise((hi - lo) / 2.0)
        df = df.withColumn(name, step / cell)
    return df


def slope_aspect(df: DataFrame, page: list[str], cell: float = 1.0) -> DataFrame:
    gx, gy = F.col("gx"), F.col("gy")
    out = gradient(df, page, cell)
    return out.withColumns({"slope_deg": F.degrees(F.atan(F.sqrt(gx * gx + gy * gy))), "aspect_deg": F.pmod(F.degrees(F.atan2(-gx, gy)), F.lit(360.0))})


def hillshade(df: DataFrame, page: list[str], azimuth: float = 315.0, altitude: float = 45.0, scale: float = 2.0) -> DataFrame:
    az, alt = np.radians(azimuth), np.radians(altitude)
    sx, sy, sz = (float(v) for v in (np.cos(alt) * np.sin(az), np.cos(alt) * np.cos(az), np.sin(alt)))
    gx, gy = F.col("gx") * scale, F.col("gy") * scale
    light = (gx * -sx + gy * -sy + sz) / F.sqrt(gx * gx + gy * gy + 1.0)
    return gradient(df, page).withColumn("shade", F.floor(F.least(F.greatest(light, F.lit(0.0)), F.lit(1.0)) * 255.0).cast("int"))


def halve(df: DataFrame, page: list[str], rows: int, cols: int) -> DataFrame:
    """The next mip level: means of 2 x 2 cells; an odd last row or column is dropped."""
    inner = df.where((F.col("r") < rows // 2 * 2) & (F.col("c") < cols // 2 * 2))
    return inner.groupBy(*page, F.expr("CAST(r div 2 AS INT)").alias("r"), F.expr("CAST(c div 2 AS INT)").alias("c")).agg(F.avg("h").alias("h"))


def pyramid(df: DataFrame, page: list[str], rows: int, cols: int) -> DataFrame:
    """All levels, halved until a side is under 8; level 0 is the input."""
    level, k = df.select(*page, "r", "c", "h"), 0
    out = level.withColumn("mip", F.lit(0))
    while min(rows, cols) // 2 >= 8:
        level, rows, cols, k = halve(level, page, rows, cols), rows // 2, cols // 2, k + 1
        out = out.unionByName(level.withColumn("mip", F.lit(k)))
    return out


def bilinear(heights: Column, rows: int, cols: int, u: Column, v: Column) -> Column:
    """Sample of a packed raster (row-major array) at u, v in [0, 1]; no join."""
    fx, fy = (F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)) * (n - 1) for t, n in ((u, cols), (v, rows)))
    x0, y0 = F.floor(fx), F.floor(fy)
    x1, y1 = F.least(x0 + 1, F.lit(cols - 1)), F.least(y0 + 1, F.lit(rows - 1))
    at = lambda y, x: F.get(heights, (y * cols + x).cast("int"))
    mix = lambda a, b, t: a + (b - a) * t
    return mix(mix(at(y0, x0), at(y0, x1), fx - x0), mix(at(y1, x0), at(y1, x1), fx - x0), fy - y0)


# whole-page kernels; a direction is (axis, sign)
_SIDES = ((1, -1), (1, 1), (0, -1), (0, 1))


def _beyond(a: np.ndarray, axis: int, sign: int, edge: float = np.nan) -> np.ndarray:
    """At each cell the value of its neighbour; `edge` outside of the page."""
    out = np.full_like(a, edge)
    take, put = [slice(None)] * 2, [slice(None)] * 2
    take[axis], put[axis] = (slice(1, None), slice(None, -1)) if sign > 0 else (slice(None, -1), slice(1, None))
    out[tuple(put)] = a[tuple(take)]
    return out


def _given(flows: list[np.ndarray]) -> np.ndarray:
    """What cells get of what their neighbours send towards them."""
    return sum(_beyond(f, axis, -sign, 0.0) for f, (axis, sign) in zip(flows, _SIDES, strict=True))


def thermal(h: np.ndarray, talus: float, rate: float) -> np.ndarray:
    """What stands steeper than the talus slides to the lower neighbours; keeps the sum."""
    flows = [rate * np.fmax(0, h - _beyond(h, a, s) - talus) for a, s in _SIDES]
    flows = [np.nan_to_num(f) for f in flows]
    return h - sum(flows) + _given(flows)


#: The parameters of erosion with their defaults; `gravity` and `seed` are accepted and change nothing.
EROSION = {
    "iterations": 50, "rain_rate": 0.012, "evaporation": 0.015, "sediment_capacity": 0.10, "dissolve_rate": 0.30, "deposit_rate": 0.30,
    "min_slope": 0.005, "gravity": 9.81, "thermal_iterations": 50, "talus_angle_deg": 30.0, "talus_rate": 0.25, "seed": 42,
}


def erode(h: np.ndarray, **settings) -> dict[str, np.ndarray]:
    """Rain, flow to lower neighbours, dissolving and depositing, with a slide every few steps; only slides without iterations.

    The settings are those of EROSION; others raise TypeError. `thermal_iterations` sets the cadence, iterations //
    thermal_iterations, not an exact count.
    """
    if unknown := settings.keys() - EROSION.keys():
        raise TypeError(f"no erosion settings: {sorted(unknown)}")
    p = EROSION | settings
    iterations, thermal_iterations, talus_rate = p["iterations"], p["thermal_iterations"], p["talus_rate"]
    h = h.astype(np.float32)
    water, sediment, drainage = (np.zeros_like(h) for _ in range(3))
    flows = [np.zeros_like(h)] * 4
    talus = float(np.tan(np.radians(p["talus_angle_deg"])))
    every = max(1, iterations // thermal_iterations) if thermal_iterations else 0
    for step in range(iterations):
        water += np.float32(p["rain_rate"])
        level = h + water
        flows = [np.nan_to_num(np.fmax(0, level - _beyond(level, a, s))) for a, s in _SIDES]
        wanted = sum(flows)
        share = np.where(wanted > 1e-8, np.minimum(1, water / np.maximum(wanted, 1e-8)), 1).astype(np.float32)
        flows = [f * share for f in flows]
        out = sum(flows)
        water += _given(flows) - out
        drainage += out
        speed = np.hypot(flows[1] - flows[0], flows[3] - flows[2])
        gy, gx = np.gradient(h)
        gap = p["sediment_capacity"] * np.maximum(np.hypot(gx, gy), p["min_slope"]) * speed - sediment
        moved = np.where(gap > 0, p["dissolve_rate"], p["deposit_rate"]) * gap
        h, sediment = h - moved.astype(np.float32), sediment + moved.astype(np.float32)
        water *= np.float32(1 - p["evaporation"])
        if every and step % every == 0:
            h = thermal(h, talus, talus_rate)
    if not iterations:
        for _ in range(thermal_iterations):
            h = thermal(h, talus, talus_rate)
    vx, vy = flows[1] - flows[0], flows[3] - flows[2]
    rows, cols = np.indices(h.shape)
    to = np.clip(rows + np.sign(vy), 0, h.shape[0] - 1).astype(int) * h.shape[1] + np.clip(cols + np.sign(vx), 0, h.shape[1] - 1).astype(int)
    own = rows * h.shape[1] + cols
    inflow = 1 + np.bincount(to[to != own], minlength=h.size).reshape(h.shape)
    return {"eroded": h, "drainage": drainage, "vx": vx, "vy": vy, "flow_accum": inflow.astype(np.float32)}


#: The eight directions (row, column) in the order that breaks ties, from east, clockwise.
_EIGHT = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))


def drainage(h: np.ndarray) -> np.ndarray:
    """How much runs through each cell if all of it takes the steepest way down; log scale, 0 to 1."""
    rows, cols = h.shape
    padded = np.pad(h.astype(np.float64), 1, constant_values=np.inf)
    drops = np.stack([(h - padded[1 + i : 1 + i + rows, 1 + j : 1 + j + cols]) / np.hypot(i, j) for i, j in _EIGHT])
    way = drops.argmax(0)
    step = np.array([i * cols + j for i, j in _EIGHT])
    target = np.where(drops.max(0) > 0, np.arange(h.size).reshape(h.shape) + step[way], -1).ravel()
    amount = np.ones(h.size)
    for k in np.argsort(-h.ravel(), kind="stable"):
        if target[k] >= 0:
            amount[target[k]] += amount[k]
    return normalized(np.log1p(amount).reshape(h.shape))


def normalized(a: np.ndarray) -> np.ndarray:
    lo, hi = a.min(), a.max()
    return (a - lo) / (hi - lo) if hi - lo > 1e-6 else np.zeros_like(a)


def blurred(h: np.ndarray, sigma: float, mode: str = "symmetric") -> np.ndarray:
    """Gaussian, cut at four sigma; symmetric or wrapped edges."""
    reach = max(1, int(4 * sigma + 0.5))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    for axis in (0, 1):
        wide = np.pad(h, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], mode=mode)
        h = np.apply_along_axis(np.convolve, axis, wide, kernel, "valid")
    return h


def ridges(h: np.ndarray, sigma: float = 2.0) -> np.ndarray:
    """Where the smoothed surface bends down, 0 to 1."""
    smooth = np.pad(blurred(h, max(sigma, 0.001)), 1, mode="symmetric")
    bend = 4 * smooth[1:-1, 1:-1] - smooth[:-2, 1:-1] - smooth[2:, 1:-1] - smooth[1:-1, :-2] - smooth[1:-1, 2:]
    return normalized(np.clip(bend, 0, None))


#: The modes of a terrain feature.
MODES = ("dem_height", "ridge_emphasis", "drainage_accumulation", "slope_deg", "aspect_deg")


def feature(h: np.ndarray, mode: str, sigma: float = 2.0) -> np.ndarray:
    """A feature of a raster, computed from its heights; ValueError for other modes."""
    if mode == "dem_height":
        return h.astype(np.float64)
    if mode == "ridge_emphasis":
        return ridges(h.astype(np.float64), sigma)
    if mode == "drainage_accumulation":
        return drainage(h)
    if mode not in MODES:
        raise ValueError(f"unknown feature mode {mode!r}")
    gy, gx = np.gradient(h.astype(np.float64))
    return np.degrees(np.arctan(np.hypot(gx, gy))) if mode == "slope_deg" else np.mod(np.degrees(np.arctan2(-gx, gy)), 360.0)


def resampled(h: np.ndarray, n: int) -> np.ndarray:
    """Bilinear samples at n x n evenly spaced places from corner to corner."""
    y, x = (np.linspace(0, size - 1, n) for size in h.shape)
    rows, cols = (np.minimum(np.floor(t).astype(int), max(size - 2, 0)) for t, size in ((y, h.shape[0]), (x, h.shape[1])))
    wide = np.pad(h.astype(np.float64), ((0, 1), (0, 1)), mode="edge")
    v, u = (y - rows)[:, None], (x - cols)[None, :]
    corner = lambda i, j: wide[np.ix_(rows + i, cols + j)]
    return (corner(0, 0) * (1 - u) + corner(0, 1) * u) * (1 - v) + (corner(1, 0) * (1 - u) + corner(1, 1) * u) * v


def features(df: DataFrame, page: list[str], n: int, modes: tuple[str, ...] = MODES, sigma: float = 2.0) -> DataFrame:
    """(page, mode, r, c, v): every page's raster (r, c, h) resampled to n x n, then its features; ValueError for unknown modes or n < 1."""
    if n < 1 or set(modes) - set(MODES):
        raise ValueError(f"n is {n}, modes are {modes}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["r", "c"])
        h = resampled(pdf.h.to_numpy(np.float64).reshape(int(pdf.r.max()) + 1, int(pdf.c.max()) + 1), n)
        r, c = np.indices((n, n))
        parts = [pd.DataFrame({**{k: pdf[k].iloc[0] for k in page}, "mode": mode, "r": r.ravel(), "c": c.ravel(), "v": feature(h, mode, sigma).ravel()}) for mode in modes]
        return pd.concat(parts)

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.select(*page, "r", "c", "h").groupBy(*page).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in page) + ", mode string, r int, c int, v double")


def half_shift(df: DataFrame, rows: int, cols: int) -> DataFrame:
    """A raster moved by half its size around its edges; what was its border meets in the middle."""
    return df.withColumns({"r": (F.col("r") + (rows - rows // 2)) % rows, "c": (F.col("c") + (cols - cols // 2)) % cols})


def value_range(df: DataFrame, page: list[str], value: str = "h", nodata: float | None = None, floor: float = -9000.0) -> DataFrame:
    """(page, lo, hi) of the values above `floor` that are not `nodata`; pages without any have no row."""
    valid = (F.col(value) > floor) & (F.lit(True) if nodata is None else F.col(value) != nodata)
    return df.where(valid).groupBy(*page).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))


def normalized_by(df: DataFrame, page: list[str], value: str = "h", least: float = 1e-6) -> DataFrame:
    """Adds v, the value from 0 to 1 within its page; 0 where a page's range is `least` or less."""
    bounds = df.groupBy(*page).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    rows = df.join(bounds, page)
    span = F.col("__hi") - F.col("__lo")
    return rows.withColumn("v", F.when(span > least, (F.col(value) - F.col("__lo")) / span).otherwise(F.lit(0.0))).drop("__lo", "__hi")


def delta_stats(df: DataFrame, page: list[str], before: str, after: str, over: float = 0.5) -> DataFrame:
    """(page, cells, mean_delta, max_delta, changed): how far two rasters of the same cells differ; changed counts cells over `over`."""
    d = F.abs(F.col(after) - F.col(before))
    return df.groupBy(*page).agg(F.count("*").alias("cells"), F.avg(d).alias("mean_delta"), F.max(d).alias("max_delta"), F.count_if(d > over).alias("changed"))


def seam_score(df: DataFrame, page: list[str], rows: int, cols: int, values: list[str], combine: str = "max") -> DataFrame:
    """(page, seam): mean squared difference of opposite edges, over all `values`; the greater of the two pairs, or their mean."""
    parts = []
    for axis, across, last in (("r", "c", rows - 1), ("c", "r", cols - 1)):
        edge = df.where(F.col(axis).isin(0, last)).groupBy(*page, across)
        at = lambda v, place: F.max(F.when(F.col(axis) == place, F.col(v)))  # noqa: E731, B023
        square = sum((F.pow(at(v, 0) - at(v, last), F.lit(2.0)) for v in values[1:]), F.pow(at(values[0], 0) - at(values[0], last), F.lit(2.0)))
        parts.append(edge.agg((square / len(values)).alias("d")).groupBy(*page).agg(F.avg("d").alias("mse")))
    both = parts[0].unionByName(parts[1]).groupBy(*page)
    return both.agg((F.max("mse") if combine == "max" else F.avg("mse")).alias("seam"))


def per_page(df: DataFrame, page: list[str], kernel, columns: list[str]) -> DataFrame:
    """Run a kernel (2-D array to a dict of 2-D arrays) on each page's h."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["r", "c"])
        shape = (int(pdf.r.max()) + 1, int(pdf.c.max()) + 1)
        found = kernel(pdf.h.to_numpy(np.float32).reshape(shape))
        return pdf[[*page, "r", "c"]].assign(**{k: found[k].ravel().astype(float) for k in columns})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in [*page, "r", "c"]), *(f"{c} double" for c in columns)])
    return df.select(*page, "r", "c", "h").groupBy(*page).applyInPandas(run, schema)
