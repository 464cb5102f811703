"""Kernel chains on pages: a generator, then post-processes, as DataFrame transforms.

A kernel is {"type": ..., "params": {...}} or {"type": "chain", "stages": [kernels]}. Pages are rows (page_x, page_z).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import canonical, content_key, fbm
from ..functions.surface import elevation_feature
from ..lineage import cut_lineage
from . import raster

PAGE = ["page_x", "page_z"]
CAPABILITIES = ["height", "slope", "aspect"]
_SOURCES: dict[str, dict] = {}


def register_source(name: str, heights: DataFrame, n: int, x0: float, z0: float, size: float) -> None:
    """A square raster (r, c, h) of n x n samples by name; the last one registered under a name counts."""
    _SOURCES[name] = {"heights": heights.select("r", "c", "h"), "n": n, "x0": x0, "z0": z0, "size": size}


def _packed(found: dict, mode: str, sigma: float) -> DataFrame:
    """One row: the source's feature as an array, the middle of its heights, and the hash of what it was made from."""
    cells = F.array_sort(F.collect_list(F.struct("r", "c", "h")))
    heights = found["heights"].groupBy().agg(F.transform(cells, lambda s: s["h"]).alias("__raster"), ((F.min("h") + F.max("h")) / 2).alias("__middle"))
    if mode == "dem_height":
        return heights
    made = raster.features(found["heights"].withColumn("page", F.lit(0)), ["page"], found["n"], (mode,), sigma)
    cells = F.array_sort(F.collect_list(F.struct("r", "c", "v")))
    return made.groupBy().agg(F.transform(cells, lambda s: s["v"]).alias("__raster")).withColumn("__middle", F.lit(0.0))


def clear_sources() -> None:
    _SOURCES.clear()


#: The settings of a noise stage.
NOISE = ("octaves", "frequency", "lacunarity", "gain", "amplitude")
FEATURE = ("source", "mode", "strength", "ridge_smooth_sigma_cells", "seed")


def known(params: dict, names) -> dict:
    """The settings that a stage knows; catalogs may hold others."""
    return {k: params[k] for k in names if k in params}


def _noise(params: dict, n: int, extent: float, seed: int, base: dict):
    return lambda pages: raster.noise_pages(pages, n, extent, seed=seed, **known(params, NOISE))


def _erosion(params: dict, n: int, extent: float, seed: int, base: dict):
    settings = known(params, raster.EROSION)

    def run(df: DataFrame) -> DataFrame:
        out = raster.per_page(df, PAGE, lambda h: raster.erode(h, **settings), ["eroded"]).withColumnRenamed("eroded", "h")
        step = extent / max(n - 1, 1)
        return out.withColumns({"x": F.col("page_x") + F.col("c") * step, "z": F.col("page_z") + F.col("r") * step})

    return run


def _feature(params: dict, n: int, extent: float, seed: int, base: dict):
    """A feature of a registered source, computed from its heights and blended in by the base noise's amplitude; unknown sources leave the pages as they are."""
    settings = {"mode": "ridge_emphasis", "strength": 0.7, "ridge_smooth_sigma_cells": 2.0} | known(params, FEATURE)
    found, mode, strength = _SOURCES.get(settings.get("source", "")), settings["mode"], min(max(settings["strength"], 0.0), 1.0)

    def run(df: DataFrame) -> DataFrame:
        if found is None:
            return df
        u, v = (F.col("x") - found["x0"]) / found["size"], (F.col("z") - found["z0"]) / found["size"]
        inside = F.least(u, 1 - u, v, 1 - v) * found["size"]
        rows = df.crossJoin(F.broadcast(_packed(found, mode, settings["ridge_smooth_sigma_cells"])))  # one row, a raster of registered size
        at = raster.bilinear(F.col("__raster"), found["n"], found["n"], u, v)
        blended = elevation_feature(F.col("h"), at, mode, strength, base.get("amplitude", 50.0), F.col("__middle"), inside)
        return rows.withColumn("h", blended).drop("__raster", "__middle")

    return run


GENERATORS: dict[str, Callable] = {"noise_stack": _noise}
POST: dict[str, Callable] = {"erosion": _erosion, "dem_feature": _feature}


def stages_of(kernel: dict) -> list[dict]:
    """A kernel as its list of stages: one generator first, post-processes after it. ValueError otherwise."""
    if not isinstance(kernel, dict):
        raise ValueError(f"a kernel is a dict, not {type(kernel).__name__}")
    stages = kernel.get("stages") if kernel.get("type") == "chain" else [kernel]
    if not isinstance(stages, list) or not stages:
        raise ValueError("a chain needs stages")
    for place, stage in enumerate(stages):
        kind = stage.get("type", "")
        if kind not in GENERATORS and kind not in POST:
            raise ValueError(f"unknown stage type: {kind!r}")
        if (kind in GENERATORS) != (place == 0):
            raise ValueError("a chain has one generator, and it comes first")
    return stages


def run_chain(pages: DataFrame, kernel: dict, n: int, extent: float, seed: int = 0) -> DataFrame:
    """(page_x, page_z, r, c, x, z, h) of each page, every stage applied in order."""
    stages, makers = stages_of(kernel), GENERATORS | POST
    base = stages[0].get("params") or {}
    steps = [makers[s["type"]](s.get("params") or {}, n, extent, seed, base) for s in stages]
    return reduce(DataFrame.transform, steps, pages.select(*PAGE).distinct())


def source_hash(name: str) -> str:
    """sha256 of a registered raster's place and heights, empty for names that are not registered."""
    if (found := _SOURCES.get(name)) is None:
        return ""
    cells = F.array_sort(F.collect_list(F.struct("r", "c", "h")))
    text = found["heights"].groupBy().agg(F.sha2(F.to_json(cells), 256).alias("h")).first().h
    return hashlib.sha256(f"{found['n']}:{found['x0']}:{found['z0']}:{found['size']}:{text}".encode()).hexdigest()


def catalog_hash(catalog: list[dict]) -> str:
    return hashlib.sha256(canonical({"biomes": catalog}).encode()).hexdigest()


def page_keys(pages: DataFrame, catalog: list[dict], biome: int, n: int, extent: float, seed: int) -> DataFrame:
    """(page_x, page_z, key): the sha256 of all that a page is made from, the registered rasters of its stages included."""
    stages = stages_of(catalog[biome]["kernel"])
    sources = {s: source_hash(s) for s in sorted({(x.get("params") or {}).get("source", "") for x in stages if x["type"] == "dem_feature"})}
    fixed = {"kind": "page", "catalog_hash": catalog_hash(catalog), "biome": catalog[biome].get("name", biome), "extent_m": float(extent), "grid_n": n, "seed": seed, "sources": sources}
    return pages.select(*PAGE).distinct().withColumn("key", content_key(fixed, F.col("page_x"), F.col("page_z")))


def bake(pages: DataFrame, catalog: list[dict], biome: int, n: int, extent: float, seed: int = 0, store: str | None = None) -> DataFrame:
    """(page_x, page_z, r, c, h) of one biome's chain. IndexError for a biome out of range.

    With `store`, a folder, pages are kept there by their key, with what they were made from as metadata: those that
    it holds are read and not computed, the others are computed once, in one job, and added. A page that a lost task
    wrote twice, or two runs added at the same time, has equal rows, of which one is read.
    """
    if not 0 <= biome < len(catalog):
        raise IndexError(f"biome {biome} of {len(catalog)}")
    kernel = catalog[biome]["kernel"]
    if store is None:
        return run_chain(pages, kernel, n, extent, seed).select(*PAGE, "r", "c", "h")
    spark, keys = pages.sparkSession, page_keys(pages, catalog, biome, n, extent, seed)
    kept = _stored(spark, store)
    missing = keys.join(kept.select("key"), "key", "left_anti")
    made = run_chain(missing, kernel, n, extent, seed).groupBy(*PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "c", "h"))), lambda s: s["h"]).alias("heights"))
    about = {"catalog_hash": catalog_hash(catalog), "biome": str(catalog[biome].get("name", biome)), "extent_m": str(float(extent)), "grid_n": str(n), "seed": str(seed), "stages": ",".join(s["type"] for s in stages_of(kernel))}
    made = made.join(missing, PAGE).withColumn("metadata", F.create_map(*[F.lit(x) for kv in about.items() for x in kv]))
    made.select("key", F.lit(n).alias("cols"), "heights", "metadata").write.mode("append").parquet(store)
    found = keys.join(_stored(spark, store).dropDuplicates(["key"]), "key").select(*PAGE, F.posexplode("heights").alias("k", "h"))
    return found.select(*PAGE, F.expr(f"CAST(k div {n} AS INT)").alias("r"), (F.col("k") % n).cast("int").alias("c"), "h")


def _stored(spark: SparkSession, store: str) -> DataFrame:
    schema = "key string, cols int, heights array<double>, metadata map<string,string>"
    place = spark._jvm.org.apache.hadoop.fs.Path(store)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(schema).parquet(store) if there else spark.createDataFrame([], schema)


def point_heights(points: DataFrame, catalog: list[dict], seed: int = 0) -> DataFrame:
    """points (id, x, z) with h: the unweighted mean over the biomes of their generators alone."""
    bases = [known(stages_of(b["kernel"])[0].get("params") or {}, NOISE) for b in catalog]
    total = sum((fbm(F.col("x"), F.col("z"), seed=seed, **p) for p in bases[1:]), fbm(F.col("x"), F.col("z"), seed=seed, **bases[0]))
    return points.withColumn("h", total / len(bases))


def request_errors(grid_n: Column, extent: Column, caps: Column, tier: Column) -> Column:
    """What is wrong with a page request, as an array of codes; empty if nothing is. Nulls count as wrong."""
    rules = {
        "grid_n": grid_n > 0, "extent": extent > 0, "caps_empty": F.size(caps) > 0,
        "caps_unknown": F.forall(caps, lambda c: c.isin(CAPABILITIES)), "tier": F.length(tier) > 0,
    }
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules.items()]))


def generate_pages(requests: DataFrame, kernel: dict, n: int, extent: float, seed: int = 0) -> DataFrame:
    """One row a request (id, page_x, page_z, grid_n, extent, caps, tier): its errors as data, or its page.

    Returns id, errors, heights (row-major array, null unless asked for), cells, complete. Requests for other grids than
    n x n over `extent` get the error `shape`. Pages that several requests name are computed once.
    """
    found = requests.withColumn("errors", request_errors(F.col("grid_n"), F.col("extent"), F.col("caps"), F.col("tier")))
    shape = F.coalesce((F.col("grid_n") == n) & (F.col("extent") == extent), F.lit(False))
    found = found.withColumn("errors", F.when((F.size("errors") == 0) & ~shape, F.array(F.lit("shape"))).otherwise(F.col("errors")))
    cells = run_chain(found.where("size(errors) = 0"), kernel, n, extent, seed)
    packed = cells.groupBy(*PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "c", "h"))), lambda s: s["h"]).alias("page"))
    rows = found.join(packed, PAGE, "left").withColumn("page", F.when(F.size("errors") == 0, F.col("page")))
    heights = F.when(F.array_contains("caps", "height"), F.col("page"))
    # height is the only field kept with the page; slope and aspect follow from it
    return rows.select("id", "errors", heights.alias("heights"), F.coalesce(F.size("page"), F.lit(0)).alias("cells"), ((F.size("errors") == 0) & F.col("page").isNotNull()).alias("complete"))


def run_checks(spark: SparkSession, checks: dict[str, Callable[[SparkSession], DataFrame]]) -> DataFrame:
    """Issues (severity, code) of all registered checks. A check that fails, when planned or when run, becomes the issue `<name>.check_crashed`, and the others stand."""
    found = [spark.createDataFrame([], "severity string, code string")]
    for name, check in checks.items():
        try:
            found.append(cut_lineage(check(spark).select("severity", "code"), "check"))
        except Exception:  # noqa: BLE001 - the report names it
            found.append(spark.createDataFrame([("error", f"{name}.check_crashed")], "severity string, code string"))
    return reduce(DataFrame.unionByName, found)


def rebase(tiles: DataFrame, old: tuple[int, int], new: tuple[int, int], side: int) -> DataFrame:
    """Tiles (tx, tz) of a window at `old` keyed for one at `new`; those outside of it go."""
    moved = tiles.withColumns({"tx": F.col("tx") + (old[0] - new[0]), "tz": F.col("tz") + (old[1] - new[1])})
    return moved.where(F.col("tx").between(0, side - 1) & F.col("tz").between(0, side - 1))


def fill_nearest(tiles: DataFrame, side: int) -> DataFrame:
    """(ring, tx, tz, tile): each slot of side x side windows, its own tile or the nearest; ties go to the least tile.

    A ring has at most side * side resident tiles, so that a ring's pairs are bounded by the window.
    """
    slots = tiles.select("ring").distinct().withColumn("sx", F.explode(F.sequence(F.lit(0), F.lit(side - 1)))).withColumn("sz", F.explode(F.sequence(F.lit(0), F.lit(side - 1))))
    d2 = (F.col("tx") - F.col("sx")) * (F.col("tx") - F.col("sx")) + (F.col("tz") - F.col("sz")) * (F.col("tz") - F.col("sz"))
    nearest = slots.join(tiles, "ring").groupBy("ring", "sx", "sz").agg(F.min_by("tile", F.struct(d2, F.col("tile"))).alias("tile"))
    return nearest.select("ring", F.col("sx").alias("tx"), F.col("sz").alias("tz"), "tile")
