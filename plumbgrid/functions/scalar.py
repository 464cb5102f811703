"""Column functions: hashes, noise, bands, hex weights, versions, canonical JSON, log lines."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf

MASK = 0xFFFFFFFF


def _u32(c: Column) -> Column:
    return c.bitwiseAND(F.lit(MASK))


def _times(c: Column, k: int) -> Column:
    """Product modulo 2**32 of a number below 2**32; in halves, so that no step leaves 63 bits."""
    high = (c * (k >> 16)).bitwiseAND(F.lit(0xFFFF))
    return _u32(F.shiftleft(high, 16) + c * (k & 0xFFFF))


def wang_hash(x: Column) -> Column:
    """Wang's hash of a number below 2**32."""
    x = x.bitwiseXOR(F.lit(61)).bitwiseXOR(F.shiftright(x, 16))
    x = _times(x, 9)
    x = x.bitwiseXOR(F.shiftright(x, 4))
    x = _times(x, 0x27D4EB2D)
    return x.bitwiseXOR(F.shiftright(x, 15))


def region_hash(seed: Column, salt: Column, rx: Column, rz: Column) -> Column:
    """Avalanche of a seed, a salt and a region's coordinates."""
    x = _u32(seed)
    for part, k in ((salt, 2654435761), (rx, 2246822507), (rz, 3266489909)):  # fixed values
        x = x.bitwiseXOR(_times(_u32(part), k))
    return wang_hash(x)


def region_variant(seed: Column, salt: Column, rx: Column, rz: Column, count: Column) -> Column:
    return F.when(count <= 1, F.lit(0).cast("bigint")).otherwise(region_hash(seed, salt, rx, rz) % F.greatest(count, F.lit(1)))


def smoothstep(edge0, edge1, x: Column) -> Column:
    a, b = (F.lit(e) if not isinstance(e, Column) else e for e in (edge0, edge1))
    t = F.least(F.greatest((x - a) / F.when(b == a, F.lit(1.0)).otherwise(b - a), F.lit(0.0)), F.lit(1.0))
    return F.when(b == a, (x >= a).cast("double")).otherwise(t * t * (F.lit(3.0) - t * 2.0))


def band_weight(elev: Column, slope: Column, lo_e: Column, hi_e: Column, band_e: Column, lo_s: Column, hi_s: Column, band_s: Column) -> Column:
    """How well a rule's elevation and slope bands hold a place: 1 inside, soft edges outside."""

    def axis(v: Column, lo: Column, hi: Column, band: Column) -> Column:
        width = F.greatest(band, F.lit(1e-3))
        return smoothstep(lo - width, lo, v) * (F.lit(1.0) - smoothstep(hi, hi + width, v))

    return axis(elev, lo_e, hi_e, band_e) * axis(slope, lo_s, hi_s, band_s)


def morph_factor(dx: Column, dz: Column, half: float, band: float = 0.16) -> Column:
    far, start = F.greatest(F.abs(dx), F.abs(dz)), half * (1 - band)
    ramp = (far - start) / (half - start) if half > start else F.lit(1.0)
    return F.when(far <= start, F.lit(0.0)).when(far >= half, F.lit(1.0)).otherwise(ramp)


def edge_mix(d: Column, blend: float) -> Column:
    return F.lit(0.0) if blend <= 0.001 else F.least(F.greatest(F.lit(1.0) - d / blend, F.lit(0.0)), F.lit(1.0)) * 0.5


def hex_weights(u: Column, v: Column) -> Column:
    """Barycentric weights of a place in the triangle lattice: struct of w0, w1, w2."""
    k = 1.15470054
    sx, sy = u * k - v * (k * 0.5), v * k
    fx, fy = sx - F.floor(sx), sy - F.floor(sy)
    lower = fx + fy < 1
    pick = lambda a, b: F.when(lower, a).otherwise(b)
    return F.struct(pick(1 - fx - fy, 1 - fy).alias("w0"), pick(fx, 1 - fx).alias("w1"), pick(fy, fx + fy - 1).alias("w2"))


def unit(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))


def composite_score(seam: Column, periodic: Column, rich: Column) -> Column:
    return unit(1 - seam / 0.02) * 0.4 + unit(1 - (periodic - 6) / 19.0) * 0.4 + unit(rich) * 0.2


def semver(text: Column) -> Column:
    """struct of major, minor, patch; zeros where one of the first three parts is no number. What follows a hyphen is dropped."""
    parts = F.transform(F.slice(F.split(text, r"\."), 1, 3), lambda p: F.split(p, "-")[0])
    fine = (F.size(parts) == 3) & F.forall(parts, lambda p: p.rlike("^[0-9]+$"))
    number = lambda i: F.when(fine, F.get(parts, F.lit(i)).cast("bigint")).otherwise(F.lit(0))
    return F.struct(number(0).alias("major"), number(1).alias("minor"), number(2).alias("patch"))


def compatible(a: Column, b: Column) -> Column:
    """The same major version; before 1.0 the same minor version too."""
    return (a["major"] == b["major"]) & ((a["major"] > 0) | (a["minor"] == b["minor"]))


def content_hash(**fields: Column) -> Column:
    """sha256 of flat fields (integers, booleans, ASCII strings) as JSON with sorted keys and no spaces; `canonical_hash` takes any."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def canonical(value) -> str:
    """JSON with sorted keys at every level, no spaces, ASCII only."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=str)


def _plain(value):
    """Rows, arrays and maps of a batch as dicts and lists."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple):  # a map comes as pairs where Arrow can't tell
        return [_plain(v) for v in value]
    return value


def canonical_hash(value: Column) -> Column:
    """sha256 of a column of any type as canonical JSON: nested keys sorted, floats and non-ASCII text as Python's json writes them."""

    @arrow_udf("string")
    def run(v: pa.Array) -> pa.Array:
        return pa.array([hashlib.sha256(canonical(_plain(x)).encode()).hexdigest() for x in v.to_pylist(maps_as_pydicts="strict")], pa.string())

    return run(value)


def content_key(fixed: dict, x: Column, z: Column) -> Column:
    """sha256 of canonical JSON: fixed fields and a place."""

    @arrow_udf("string")
    def run(xs: pa.Array, zs: pa.Array) -> pa.Array:
        found = [canonical(fixed | {"world_origin_x": a, "world_origin_z": b}) for a, b in zip(xs.to_pylist(), zs.to_pylist(), strict=True)]
        return pa.array([hashlib.sha256(t.encode()).hexdigest() for t in found], pa.string())

    return run(x.cast("double"), z.cast("double"))


def migration_path(a: Column, b: Column) -> Column:
    """The versions to go through: none if they are equal, else the target alone."""
    return F.when(a == b, F.array().cast("array<string>")).otherwise(F.array(b))


def page_origin(v: Column, extent: float) -> Column:
    """Where the page of a coordinate begins."""
    return F.floor(v / extent) * extent


def snap(v: Column, size: float) -> Column:
    """The nearest multiple of a cell; halves go away from zero."""
    return F.round(v / size) * size


def world_to_uv(v: Column, lo: float, hi: float) -> Column:
    """A coordinate from 0 to 1 within bounds; 0 where they are the same."""
    return unit((v - lo) / (hi - lo)) if hi != lo else F.lit(0.0)


def height01(h: Column, amplitude: float) -> Column:
    return h / amplitude * 0.5 + 0.5


def height_of(v: Column, scale: float, offset: float = 0.0) -> Column:
    """The height that a stored value from 0 to 1 stands for."""
    return (v - 0.5) * 2.0 * scale + offset


def haze(distance: Column, near: float, far: float) -> Column:
    return smoothstep(near, far, distance)


def triplanar_weights(x: Column, y: Column, z: Column, sharpness: float) -> Column:
    """struct of x, y, z: powers of a normal's parts, over their sum."""
    parts = [F.pow(F.abs(v), F.lit(sharpness)) for v in (x, y, z)]
    total = F.greatest(parts[0] + parts[1] + parts[2], F.lit(1e-4))
    return F.struct(*[(p / total).alias(k) for p, k in zip(parts, "xyz", strict=True)])


def is_stale(stamp: Column, expected: Column) -> Column:
    """A missing stamp is stale; a blank one never is fresh."""
    found = F.coalesce(stamp, F.lit(""))
    return (found == "") | (found != expected)


def page_key(ring: Column, x: Column, z: Column) -> Column:
    """ring:x:z, coordinates cut to integers."""
    return F.concat_ws(":", ring.cast("string"), x.cast("bigint").cast("string"), z.cast("bigint").cast("string"))


def resolved(path: Column, world: str, engine: str, mount: str = "addons/engine/") -> Column:
    """A res:// path on disk: the mounted engine, the engine's worlds, or the world itself; other paths as they are."""
    rest = F.regexp_replace(path, "^res://", "")
    inside = F.when(rest.startswith(mount), F.concat(F.lit(engine + "/"), F.substring(rest, len(mount) + 1, 1 << 20)))
    inside = inside.when(rest.startswith("worlds/"), F.concat(F.lit(engine + "/"), rest)).otherwise(F.concat(F.lit(world + "/"), rest))
    return F.when(path.startswith("res://"), inside).otherwise(path)


def duration_ms(started: Column, ended: Column, now: Column) -> Column:
    """0 for what has not started; what has not ended lasts until now."""
    return F.when(F.coalesce(started, F.lit(0)) <= 0, F.lit(0).cast("bigint")).otherwise(F.when(F.coalesce(ended, F.lit(0)) > 0, ended).otherwise(now) - started)


def log_line(kind: str, level: Column, system: Column, ms: Column, message: Column, fields: dict[str, Column] | None = None) -> Column:
    """One line: human (padded, with k=v fields), json (the fields beside the others) or compact."""
    pairs = [F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in (fields or {}).items()]
    if kind == "human":
        return F.concat_ws(" ", F.format_string("[%s] [%s] [%6d] %s", F.rpad(level, 5, " "), F.rpad(F.substring(system, 1, 15), 15, " "), ms, message), *pairs)
    if kind == "json":
        return F.to_json(F.struct(level.alias("level"), system.alias("system"), ms.alias("ts_ms"), message.alias("msg"), *[v.alias(k) for k, v in (fields or {}).items()]))
    return F.concat_ws(" ", level, system, message, *pairs)


#: Levels in their order.
LEVELS = ("DEBUG", "INFO", "WARN", "ERROR")


def should_log(level: Column, system: Column, least: str, verbose: list[str]) -> Column:
    """At or over the least level; DEBUG also for systems that are verbose."""
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), level)
    return (rank >= LEVELS.index(least) + 1) | ((level == "DEBUG") & system.isin(*verbose))


def to_stderr(level: Column) -> Column:
    return level.isin("WARN", "ERROR")


# noise on arrays, for Arrow UDFs


def np_hash(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint32)
    x = x ^ np.uint32(61) ^ (x >> np.uint32(16))
    x = x * np.uint32(9)
    x ^= x >> np.uint32(4)
    x = x * np.uint32(0x27D4EB2D)
    return x ^ (x >> np.uint32(15))


def np_lattice(cx: np.ndarray, cy: np.ndarray, seed: int) -> np.ndarray:
    own = np_hash(np.array([seed & MASK], np.uint32))
    mixed = np_hash(cx.astype(np.int64).astype(np.uint32) ^ np_hash(cy.astype(np.int64).astype(np.uint32) ^ own))
    return (mixed & np.uint32(0xFFFFFF)) / 16777216.0


def np_fbm(x: np.ndarray, y: np.ndarray, octaves: int = 6, frequency: float = 1 / 512, lacunarity: float = 2.0, gain: float = 0.5, seed: int = 0) -> np.ndarray:
    """Sum of octaves of value noise, over the sum of their amplitudes; in double precision."""
    total, amp, weight = np.zeros(len(x)), 1.0, 0.0
    for octave in range(octaves):
        sub, u, v = (seed + octave * 1013) & MASK, x * frequency, y * frequency
        i, j = np.floor(u), np.floor(v)
        s, t = (f * f * (3 - 2 * f) for f in (u - i, v - j))
        corner = [np_lattice(i + di, j + dj, sub) for dj in (0, 1) for di in (0, 1)]
        near, far = (lo + (hi - lo) * s for lo, hi in (corner[:2], corner[2:]))
        total += amp * (2 * (near + (far - near) * t) - 1)
        weight, amp, frequency = weight + amp, amp * gain, frequency * lacunarity
    return total / weight


def fbm(x: Column, y: Column, amplitude: float = 50.0, **settings) -> Column:
    """Fractal noise as an Arrow UDF: its expression tree would be thousands of nodes, slower than the transfer."""

    @pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series(amplitude * np_fbm(a.to_numpy(float), b.to_numpy(float), **settings))

    return run(x, y)


def lattice(cx: Column, cy: Column, seed: int) -> Column:
    """Lattice hash in [0, 1)."""
    own = int(np_hash(np.array([seed & MASK], np.uint32))[0])
    inner = wang_hash(_u32(cy).bitwiseXOR(F.lit(own)))
    return wang_hash(_u32(cx).bitwiseXOR(inner)).bitwiseAND(F.lit(0xFFFFFF)) / F.lit(16777216.0)
