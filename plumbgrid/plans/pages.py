"""Queries of kernel chains, page windows and surface functions, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..functions import surface
from ..lineage import shared_path
from ..operators import chain, quality, spatial, store
from ..session import table
from .queries import query
from .relations import relation

CHAIN = {"type": "chain", "stages": [{"type": "noise_stack", "params": {"frequency": 1 / 48}}, {"type": "erosion", "params": {"iterations": 10, "thermal_iterations": 5}}, {"type": "dem_feature", "params": {"source": "dome", "strength": 0.5}}]}
CATALOG = [{"name": "alpine", "kernel": CHAIN}, {"name": "flat", "kernel": {"type": "noise_stack", "params": {"frequency": 1 / 96, "amplitude": 10.0}}}]


def _pages(spark, sf_dir):
    return relation(spark, sf_dir, "cameras").selectExpr("frame * 64e0 AS page_x", "0e0 AS page_z")


@query()
def chain_page(spark, sf_dir):
    """UDF02 to UDF05, UDF07, UDF10, AGG24's input: noise, erosion and a registered raster, through a store of pages."""
    chain.register_source("dome", relation(spark, sf_dir, "grid"), 32, 0.0, -256.0, 1024.0)
    return chain.bake(_pages(spark, sf_dir), CATALOG, 0, 16, 64.0, 7, shared_path(spark, "pages")).withColumn("h", F.round("h", 4))


@query()
def point_heights(spark, sf_dir):
    """UDF06."""
    return chain.point_heights(relation(spark, sf_dir, "points").select("id", "x", "z"), CATALOG, 7).select("id", F.round("h", 4).alias("h"))


@query("SELECT id, CASE WHEN size = 0 THEN 'grid_n' WHEN size = 1 THEN 'extent' WHEN size = 2 THEN 'caps_unknown' WHEN id % 3 = 0 THEN 'shape' ELSE '' END AS errors, CASE WHEN size < 3 OR id % 3 = 0 THEN 0 ELSE 64 END AS cells, NOT (size < 3 OR id % 3 = 0) AS complete FROM (SELECT p_partkey AS id, p_size % 5 AS size FROM {part}) t")
def page_requests(spark, sf_dir):
    """UDF11, VAL01, PRJ07: errors as data beside pages."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_size % 5 AS size").selectExpr(
        "id", "(id % 7) * 32e0 AS page_x", "0e0 AS page_z", "CASE WHEN size = 0 THEN 0 WHEN id % 3 = 0 AND size > 2 THEN 16 ELSE 8 END AS grid_n",
        "CASE WHEN size = 1 THEN -1e0 ELSE 32e0 END AS extent", "IF(size = 2, array('height', 'colour'), array('height')) AS caps", "'high' AS tier",
    )
    out = chain.generate_pages(rows, CATALOG[1]["kernel"], 8, 32.0, 7)
    return out.select("id", F.array_join("errors", ",").alias("errors"), "cells", "complete")


@query("SELECT 'error' AS severity, 'c.check_crashed' AS code UNION ALL SELECT 'warning' AS severity, 'b.large' AS code FROM {part} WHERE p_size > 48 UNION ALL SELECT 'error' AS severity, 'a.name' AS code FROM {nation} WHERE n_regionkey = 1")
def check_registry(spark, sf_dir):
    """UDF01, SET04: three checks, the third of which fails."""
    return chain.run_checks(
        spark,
        {
            "a": lambda s: table(s, sf_dir, "nation").where("n_regionkey = 1").selectExpr("'error' AS severity", "'a.name' AS code"),
            "b": lambda s: table(s, sf_dir, "part").where("p_size > 48").selectExpr("'warning' AS severity", "'b.large' AS code"),
            "c": lambda s: table(s, sf_dir, "nation").select("no_such_column"),
        },
    )


def _tiles(spark, sf_dir):
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS tile", "s_nationkey AS ring", "CAST(s_suppkey % 8 AS INT) AS tx", "CAST(s_suppkey * 5 % 8 AS INT) AS tz")


_TILES = "(SELECT s_suppkey AS tile, s_nationkey AS ring, CAST(s_suppkey % 8 AS INT) AS tx, CAST(s_suppkey * 5 % 8 AS INT) AS tz FROM {supplier})"


@query(f"SELECT tile, ring, tx - 2 AS tx, tz + 1 AS tz FROM {_TILES} t WHERE tx - 2 BETWEEN 0 AND 7 AND tz + 1 BETWEEN 0 AND 7")
def ring_rebase(spark, sf_dir):
    """WIN13."""
    return chain.rebase(_tiles(spark, sf_dir), (0, 0), (2, -1), 8)


@query(f"SELECT ring, sx AS tx, sz AS tz, tile FROM (SELECT t.ring AS ring, sx, sz, tile, row_number() OVER (PARTITION BY t.ring, sx, sz ORDER BY (tx - sx) * (tx - sx) + (tz - sz) * (tz - sz), tile) AS n FROM {_TILES} t, (SELECT CAST(range AS INT) AS sx FROM range(8)) a, (SELECT CAST(range AS INT) AS sz FROM range(8)) b) q WHERE n = 1")
def nearest_resident(spark, sf_dir):
    """WIN14."""
    return chain.fill_nearest(_tiles(spark, sf_dir), 8)


@query("SELECT frame, sha256(string_agg(CAST(px AS VARCHAR) || ':' || CAST(pz AS VARCHAR), ',' ORDER BY px, pz)) AS signature, CAST(count(*) AS BIGINT) AS pages FROM (SELECT frame, px, unnest(range(CAST(floor((z - 100e0) / 64e0) AS BIGINT), CAST(floor((z + 100e0 - 0.001e0) / 64e0) AS BIGINT) + 1)) AS pz FROM (SELECT frame, z, unnest(range(CAST(floor((x - 100e0) / 64e0) AS BIGINT), CAST(floor((x + 100e0 - 0.001e0) / 64e0) AS BIGINT) + 1)) AS px FROM cameras) a) b GROUP BY frame")
def page_signature(spark, sf_dir):
    """SET06, SET01, AGG30: the pages of a frame, of bounded number, as one hash."""
    pages = spatial.page_cover(relation(spark, sf_dir, "cameras"), 200.0, 64.0).selectExpr("frame", "CAST(page_x / 64 AS BIGINT) AS px", "CAST(page_z / 64 AS BIGINT) AS pz")
    names = F.transform(F.array_sort(F.collect_list(F.struct("px", "pz"))), lambda p: F.concat_ws(":", p["px"], p["pz"]))
    return pages.groupBy("frame").agg(F.sha2(F.array_join(names, ","), 256).alias("signature"), F.count("*").alias("pages"))


# surface functions


def _hash(x: str, z: str) -> str:
    wave = f"(sin(({x}) * 127.1e0 + ({z}) * 311.7e0) * 43758.5453123e0)"
    return f"({wave} - floor({wave}))"


def _mix(a: str, b: str, t: str) -> str:
    return f"({a} + ({b} - {a}) * {t})"


_EASE = "(({0}) * ({0}) * (3e0 - ({0}) * 2e0))"
_NOISE = _mix(_mix(_hash("i", "j"), _hash("i + 1", "j"), "u"), _mix(_hash("i", "j + 1"), _hash("i + 1", "j + 1"), "u"), "v")


@query(f"SELECT id, round({_hash('i', 'j')}, 5) AS hash, round({_NOISE}, 5) AS noise, CAST(least(greatest(floor({_NOISE} * 4 + 0.001e0), 0), 3) AS INT) AS layer FROM (SELECT id, floor(x * 0.1e0) AS i, floor(z * 0.1e0) AS j, {_EASE.format('x * 0.1e0 - floor(x * 0.1e0)')} AS u, {_EASE.format('z * 0.1e0 - floor(z * 0.1e0)')} AS v FROM points) p")
def surface_noise(spark, sf_dir):
    """FN07, FN13's layers."""
    rows = relation(spark, sf_dir, "points")
    x, z = F.col("x"), F.col("z")
    noise = surface.surface_noise(x, z, 0.1)
    own = surface.sine_hash(F.floor(x * 0.1), F.floor(z * 0.1))
    return rows.select("id", F.round(own, 5).alias("hash"), F.round(noise, 5).alias("noise"), surface.noise_layer(noise, 4).alias("layer"))


@query(
    "SELECT id, round(m + (0.2e0 * (x - m) + 0.3e0 * (z - m) + 0.5e0 * (x * 0.5e0 - m)) / sqrt(0.04e0 + 0.09e0 + 0.25e0), 6) AS contrast, "
    "round((x * (0.01e0 + 0.05e0) + z * (0.25e0 + 0.05e0)) / (0.01e0 + 0.05e0 + 0.25e0 + 0.05e0), 6) AS weighed, round((x * 0.35e0 + z * 0.85e0) / 1.2e0, 6) AS cover, "
    "round(x + (z - 5e0 - x) * (0.5e0 * least(greatest((50e0 - abs(x)) / 25e0, 0e0), 1e0)), 6) AS dem, round(x + z * 2e0 * 0.5e0, 6) AS ridge, round(x + (z - 0.5e0) * 2e0 * 0.5e0, 6) AS other FROM (SELECT id, x, z, (x + z + x * 0.5e0) / 3e0 AS m FROM points) p"
)
def tap_blends(spark, sf_dir):
    """FN12 to FN14, FN18."""
    x, z, f = F.col("x"), F.col("z"), lambda v: F.lit(float(v))
    columns = {
        "contrast": surface.contrast_blend([x, z, x * 0.5], [f(0.2), f(0.3), f(0.5)]), "weighed": surface.noise_blend([x, z], [f(0.1), f(0.5)]), "cover": surface.cover_blend(x, f(0.3), z, f(0.8)),
        "dem": surface.elevation_feature(x, z, "dem_height", 0.5, middle=5.0, inside=50 - F.abs(x), fade=25.0), "ridge": surface.elevation_feature(x, z, "ridge_emphasis", 0.5, 2.0), "other": surface.elevation_feature(x, z, "slope_deg", 0.5, 2.0),
    }
    return relation(spark, sf_dir, "points").select("id", *[F.round(c, 6).alias(k) for k, c in columns.items()])


_LAB = "SELECT id, (r * 0.2126e0 + g * 0.7152e0 + b * 0.0722e0) * 100 AS l, (r - g) * 50 AS a, (g - b) * 50 AS bb FROM (SELECT p_partkey AS id, p_partkey % 256 / 255e0 AS r, p_size * 5 % 256 / 255e0 AS g, p_partkey * 7 % 256 / 255e0 AS b FROM {part}) t"


@query(f"SELECT id, round(l, 4) AS l, round(a, 4) AS a, round(bb, 4) AS b, CAST(floor(least(greatest(l / 100e0 + a / 50e0 * 0.5e0, 0e0), 1e0) * 255) AS INT) AS red, CAST(floor(least(greatest(l / 100e0 - bb / 50e0 * 0.5e0, 0e0), 1e0) * 255) AS INT) AS blue FROM ({_LAB}) q")
def color_lab(spark, sf_dir):
    """FN21, the fallback form."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), surface.rgb_to_lab(F.col("p_partkey") % 256, F.col("p_size") * 5 % 256, F.col("p_partkey") * 7 % 256).alias("lab"))
    back = surface.lab_to_rgb(F.col("lab"))
    return rows.select("id", *[F.round(F.col(f"lab.{k}"), 4).alias(k) for k in "lab"], back["r"].alias("red"), back["b"].alias("blue"))


_T = "ln(1e0 - e * e + 1e-12)"
_K = f"({_T} / 2e0 + 2e0 / (3.141592653589793e0 * 0.147e0))"


@query(f"SELECT id, CAST(floor(least(greatest((x + 100e0) / 200e0, 0e0), 1e0) * 255e0) AS INT) AS grey, floor(x / 8e0 + 0.5e0) * 8e0 AS snapped, round(sign(e) * sqrt(sqrt({_K} * {_K} - {_T} / 0.147e0) - {_K}), 5) AS erfinv, CASE WHEN x <= 0 THEN -1 WHEN x >= 16 THEN 2 WHEN x >= 8 THEN 1 ELSE 0 END AS mip, CASE WHEN x > 0 AND z > 0 THEN '' ELSE 'fail: ' || concat_ws(',', CASE WHEN x <= 0 THEN 'edge' END, CASE WHEN z <= 0 THEN 'junc' END) END AS failed FROM (SELECT id, x, z, least(greatest(x / 100e0, -0.9e0), 0.9e0) AS e FROM points) p")
def surface_maps(spark, sf_dir):
    """FN24, FN37, FN39, FN43, SRT12."""
    x, z = F.col("x"), F.col("z")
    e = F.least(F.greatest(x / 100.0, F.lit(-0.9)), F.lit(0.9))
    return relation(spark, sf_dir, "points").select(
        "id", surface.grey(x).alias("grey"), surface.parent_snap(x, 4.0).alias("snapped"), F.round(surface.inverse_erf(e), 5).alias("erfinv"),
        F.coalesce(surface.mip_choice(x, [4.0, 8.0, 16.0]), F.lit(-1)).alias("mip"), surface.failed_checks({"edge": x > 0, "junc": z > 0}).alias("failed"),
    )


# names, jobs, images and caches


@query("SELECT key, CAST(key % 4 AS VARCHAR) || ':' || CAST(size_bytes AS VARCHAR) || ':' || CAST(CAST(trunc(last_access) AS BIGINT) AS VARCHAR) AS page_key, NOT (key % 5 > 0) AS stale, CASE WHEN key % 2 = 0 THEN CASE WHEN key % 4 = 0 THEN '/engine/worlds/a.json' ELSE '/world/maps/a.json' END ELSE '/abs/a.json' END AS path, CASE WHEN key % 3 = 0 THEN 0 ELSE size_bytes - key % 3 END AS duration_ms FROM artifacts")
def key_and_stamp(spark, sf_dir):
    """FN34, FN36, FN40, FN44."""
    key, size = F.col("key"), F.col("size_bytes")
    path = F.when(key % 4 == 0, "res://worlds/a.json").when(key % 2 == 0, "res://maps/a.json").otherwise("/abs/a.json")
    return relation(spark, sf_dir, "artifacts").select(
        "key", fn.page_key(key % 4, size, F.col("last_access")).alias("page_key"), fn.is_stale(F.when(key % 5 > 0, "v1"), F.lit("v1")).alias("stale"),
        fn.resolved(path, "/world", "/engine").alias("path"), fn.duration_ms(key % 3, F.lit(0), size).alias("duration_ms"),
    )


@query("SELECT CASE passed WHEN 3 THEN 'A' WHEN 2 THEN 'B' WHEN 1 THEN 'C' ELSE 'D' END AS grade, round(cover, 6) AS cover, round(border, 6) AS border, round(hard, 6) AS hard FROM (SELECT cover, border, hard, CASE WHEN cover BETWEEN 0.15e0 AND 0.75e0 THEN 1 ELSE 0 END + CASE WHEN border < 0.05e0 THEN 1 ELSE 0 END + CASE WHEN hard > 0.65e0 THEN 1 ELSE 0 END AS passed FROM (SELECT avg(CASE WHEN alpha > 0 THEN 1e0 ELSE 0e0 END) AS cover, avg(CASE WHEN r IN (0, 31) OR c IN (0, 31) THEN CASE WHEN alpha > 0 THEN 1e0 ELSE 0e0 END END) AS border, avg(CASE WHEN alpha IN (0, 255) THEN 1e0 ELSE 0e0 END) AS hard FROM (SELECT r, c, CASE WHEN h < 60 THEN 0 WHEN h < 90 THEN 255 ELSE 128 END AS alpha FROM grid) a) b) d")
def subject_grade(spark, sf_dir):
    """AGG21."""
    alpha = F.when(F.col("h") < 60, 0).when(F.col("h") < 90, 255).otherwise(128)
    out = quality.subject_grade(relation(spark, sf_dir, "grid").withColumns({"img": F.lit(0), "alpha": alpha}), ["img"], 32, 32)
    return out.select("grade", *[F.round(c, 6).alias(c) for c in ("cover", "border", "hard")])


@query("SELECT CAST(sum(4 * size_bytes) AS BIGINT) AS bytes, CAST(sum(CASE WHEN key % 4 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS in_flight, CAST(sum(CASE WHEN key % 4 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS cached FROM artifacts")
def cache_stats(spark, sf_dir):
    """AGG32, AGG33."""
    status = F.when(F.col("key") % 4 == 0, "in_flight").when(F.col("key") % 4 == 1, "cached")
    return store.cache_stats(relation(spark, sf_dir, "artifacts").withColumn("status", status), "size_bytes", "status")
