"""Column functions of surfaces: sine hashes, blends of taps, approximate Lab, elevation features, grey maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import unit

#: The direction and the factor of the sine hash.
ALONG, ACROSS, FACTOR = 127.1, 311.7, 43758.5453123


def sine_hash(x: Column, z: Column) -> Column:
    """In [0, 1): the fraction of a scaled sine."""
    wave = F.sin(x * ALONG + z * ACROSS) * FACTOR
    return wave - F.floor(wave)


def surface_noise(x: Column, z: Column, frequency: float) -> Column:
    """Sine hashes of the lattice around a place, mixed smoothly."""
    px, pz = x * frequency, z * frequency
    i, j = F.floor(px), F.floor(pz)
    ease = lambda t: t * t * (F.lit(3.0) - t * 2.0)
    u, v = ease(px - i), ease(pz - j)
    near = lerp(sine_hash(i, j), sine_hash(i + 1, j), u)
    return lerp(near, lerp(sine_hash(i, j + 1), sine_hash(i + 1, j + 1), u), v)


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def contrast_blend(values: list[Column], weights: list[Column]) -> Column:
    """Weighted taps whose spread around their mean is kept."""
    mean = sum(values[1:], values[0]) / len(values)
    spread = F.sqrt(sum([w * w for w in weights[1:]], weights[0] * weights[0]))
    moved = sum([w * (v - mean) for v, w in zip(values[1:], weights[1:], strict=True)], weights[0] * (values[0] - mean))
    return mean + moved / F.greatest(spread, F.lit(1e-4))


def noise_blend(values: list[Column], noises: list[Column]) -> Column:
    """Taps weighed by the square of their noise; none weighs nothing."""
    weights = [n * n + 0.05 for n in noises]
    return sum([v * w for v, w in zip(values[1:], weights[1:], strict=True)], values[0] * weights[0]) / sum(weights[1:], weights[0])


def noise_layer(noise: Column, count: int) -> Column:
    """Which of `count` layers a noise value in [0, 1) picks."""
    return F.least(F.greatest(F.floor(noise * count + 0.001), F.lit(0)), F.lit(count - 1)).cast("int")


def cover_blend(value0: Column, alpha0: Column, value1: Column, alpha1: Column) -> Column:
    """Two taps weighed by what they cover."""
    w0, w1 = alpha0 + 0.05, alpha1 + 0.05
    return (value0 * w0 + value1 * w1) / (w0 + w1)


def rgb_to_lab(r: Column, g: Column, b: Column) -> Column:
    """Struct of l, a, b from bytes: luminance and two channel differences, not the CIE space."""
    r, g, b = (c / 255.0 for c in (r, g, b))
    return F.struct(((r * 0.2126 + g * 0.7152 + b * 0.0722) * 100).alias("l"), ((r - g) * 50).alias("a"), ((g - b) * 50).alias("b"))


def lab_to_rgb(lab: Column) -> Column:
    """Struct of r, g, b bytes, rounded down; an approximate inverse."""
    light, a, b = lab["l"] / 100.0, lab["a"] / 50.0, lab["b"] / 50.0
    channels = {"r": light + a * 0.5, "g": light - a * 0.5 + b * 0.25, "b": light - b * 0.5}
    return F.struct(*[F.floor(unit(v) * 255).cast("int").alias(k) for k, v in channels.items()])


def elevation_feature(h: Column, feature: Column, mode: str, strength: float, amplitude: float = 1.0, middle: float | Column = 0.0, inside: Column | None = None, fade: float = 256.0) -> Column:
    """Height with a raster feature on it.

    `dem_height` moves h towards the feature less `middle`, fading to nothing at the raster's border (`inside`: distance
    to it, negative outside); `ridge_emphasis` adds; every other mode adds around 0.5.
    """
    if mode == "dem_height":
        return lerp(h, feature - middle, F.lit(strength) * (F.lit(1.0) if inside is None else unit(inside / fade)))
    return h + (feature if mode == "ridge_emphasis" else feature - 0.5) * amplitude * strength


def grey(h: Column, lo: float = -100.0, hi: float = 100.0) -> Column:
    """Byte of a height in a fixed range, rounded down."""
    return F.floor(unit((h - lo) / (hi - lo)) * 255.0).cast("int")


def parent_snap(x: Column, cell: float) -> Column:
    """The nearest sample of the grid twice as coarse; halves go up."""
    return F.floor(x / (2 * cell) + 0.5) * (2 * cell)


def inverse_erf(x: Column) -> Column:
    """Winitzki's approximation on (-1, 1), within 2e-3."""
    k = 0.147
    tail = F.log(F.lit(1.0) - x * x + 1e-12)
    term = tail / 2.0 + 2.0 / (3.141592653589793 * k)
    return F.signum(x) * F.sqrt(F.sqrt(term * term - tail / k) - term)


def mip_choice(hint: Column, cells: list[float]) -> Column:
    """The coarsest level of rising cell sizes that is no coarser than the hint, or level 0; null for hints of zero or less."""
    fits = [F.when(hint >= size, F.lit(level)) for level, size in enumerate(cells)]
    return F.when(hint > 0, F.coalesce(F.greatest(*fits) if len(fits) > 1 else fits[0], F.lit(0)))


def failed_checks(passed: dict[str, Column]) -> Column:
    """`fail: a,b` of the checks that are false; empty if none is. A null check did not run."""
    names = F.concat_ws(",", *[F.when(~ok, F.lit(name)) for name, ok in passed.items()])
    return F.when(names == "", "").otherwise(F.concat(F.lit("fail: "), names))
