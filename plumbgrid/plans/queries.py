"""One query for each operator, over relations derived from the given tables, and its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..functions import surface
from ..operators import jobs as job_ops
from ..operators import materials, quality, raster, rules, spatial, store
from ..operators import weights as rules_weights
from ..session import table
from .relations import duck_sql, relation

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = duck_sql(oracle)
        return f

    return add


# spatial


@query("SELECT q.id AS qid, p.id AS id, round((p.x-q.x)*(p.x-q.x)+(p.z-q.z)*(p.z-q.z), 6) AS d2 FROM points p JOIN points q ON q.id % 20 = 0 AND (p.x-q.x)*(p.x-q.x)+(p.z-q.z)*(p.z-q.z) <= 25e0")
def spatial_radius(spark, sf_dir):
    """JOIN01, PRJ01, PRJ02."""
    points = relation(spark, sf_dir, "points")
    probes = points.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("x").alias("qx"), F.col("z").alias("qz"), F.lit(5.0).alias("radius"))
    return spatial.radius_join(points, probes, 10.0).withColumn("d2", F.round("d2", 6))


@query("SELECT q.id AS rid, p.id AS id FROM points p JOIN points q ON q.id % 20 = 0 AND p.x BETWEEN q.x AND q.x + 12e0 AND p.z BETWEEN q.z - 3e0 AND q.z + 4e0")
def spatial_rect(spark, sf_dir):
    """JOIN02, PRJ03."""
    points = relation(spark, sf_dir, "points")
    rects = points.where("id % 20 = 0").selectExpr("id AS rid", "x AS x0", "z - 3e0 AS z0", "x + 12e0 AS x1", "z + 4e0 AS z1")
    return spatial.rect_join(points, rects, 10.0)


@query("SELECT qid, id, round(d2, 6) AS d2, CAST(rank AS INT) AS rank FROM (SELECT q.id AS qid, p.id AS id, (p.x-q.x)*(p.x-q.x)+(p.z-q.z)*(p.z-q.z) AS d2, row_number() OVER (PARTITION BY q.id ORDER BY (p.x-q.x)*(p.x-q.x)+(p.z-q.z)*(p.z-q.z), p.id) AS rank FROM points p JOIN points q ON q.id % 20 = 0) t WHERE rank <= 3")
def spatial_knn(spark, sf_dir):
    """JOIN03, SRT01."""
    points = relation(spark, sf_dir, "points")
    probes = points.where("id % 20 = 0").selectExpr("id AS qid", "x AS qx", "z AS qz")
    return spatial.nearest_join(points, probes, 3, 5.0).withColumn("d2", F.round("d2", 6))


@query("SELECT count(*) AS buckets, max(n) AS max_load, CAST(sum(n) AS BIGINT) AS size FROM (SELECT floor(x/10e0) AS a, floor(z/10e0) AS b, count(*) AS n FROM points GROUP BY 1, 2) t")
def cell_stats(spark, sf_dir):
    """AGG01."""
    return spatial.cell_stats(relation(spark, sf_dir, "points"), 10.0)


@query("SELECT id, x, z FROM points WHERE id % 10 <> 3 AND id % 10 <> 4 UNION ALL SELECT id, x + 1e0, z FROM points WHERE id % 10 = 3")
def index_changes(spark, sf_dir):
    """UDF08: rows 3 of 10 move, rows 4 of 10 go."""
    points = relation(spark, sf_dir, "points")
    moved = spatial.upsert(points, points.where("id % 10 = 3").withColumn("x", F.col("x") + 1))
    return spatial.remove(moved, points.where("id % 10 = 4"))



@query("SELECT id, CAST(floor(x / 32e0) * 32e0 AS DOUBLE) AS page_x, CAST(floor(z / 32e0) * 32e0 AS DOUBLE) AS page_z, round(x / 4e0) * 4e0 AS snap_x, least(greatest((x + 50e0) / 100e0, 0e0), 1e0) AS u, x / 100e0 * 0.5e0 + 0.5e0 AS height01, floor(x / 8e0 + 0.5e0) * 8e0 AS parent_x FROM points")
def page_keys(spark, sf_dir):
    """PRJ04 to PRJ06, PRJ15, FN39."""
    x, z = F.col("x"), F.col("z")
    columns = {"page_x": fn.page_origin(x, 32.0), "page_z": fn.page_origin(z, 32.0), "snap_x": fn.snap(x, 4.0), "u": fn.world_to_uv(x, -50.0, 50.0), "height01": fn.height01(x, 100.0), "parent_x": surface.parent_snap(x, 4.0)}
    return relation(spark, sf_dir, "points").select("id", *[c.alias(k) for k, c in columns.items()])



@query("SELECT frame, 0 AS ring, CAST(px * 64e0 AS DOUBLE) AS page_x, CAST(pz * 64e0 AS DOUBLE) AS page_z FROM (SELECT frame, px, z, unnest(range(CAST(floor((z - 100e0) / 64e0) AS BIGINT), CAST(floor((z + 100e0 - 0.001e0) / 64e0) AS BIGINT) + 1)) AS pz FROM (SELECT frame, z, unnest(range(CAST(floor((x - 100e0) / 64e0) AS BIGINT), CAST(floor((x + 100e0 - 0.001e0) / 64e0) AS BIGINT) + 1)) AS px FROM cameras) a) b")
def page_cover(spark, sf_dir):
    """JOIN06, SRC01's windows."""
    return spatial.page_cover(relation(spark, sf_dir, "cameras"), 200.0, 64.0)


@query("SELECT k, 'load' AS action FROM (SELECT DISTINCT id % 200 AS k FROM usage WHERE system = 'click' AND id % 200 < 150) r WHERE k % 3 <> 0 AND k % 7 <> 0 UNION ALL SELECT k, 'evict' AS action FROM (SELECT DISTINCT id % 200 AS k FROM usage WHERE system = 'view') p WHERE k NOT IN (SELECT id % 200 FROM usage WHERE system = 'click' AND id % 200 < 150)")
def residency_diff(spark, sf_dir):
    """JOIN05, SET02, SET03."""
    rows = relation(spark, sf_dir, "usage").selectExpr("id % 200 AS k", "system")
    keys = rows.select("k").distinct()
    return spatial.residency_diff(rows.where("system = 'click' AND k < 150").select("k"), rows.where("system = 'view'").select("k"), keys.where("k % 3 = 0"), keys.where("k % 7 = 0"), ["k"])


# hashes, noise, scalars

_WANG = "WITH a AS (SELECT id, xor(xor(id, 61), id >> 16) AS x FROM n), b AS (SELECT id, (x * 9) & 4294967295 AS x FROM a), c AS (SELECT id, xor(x, x >> 4) AS x FROM b), d AS (SELECT id, (x * 668265261) & 4294967295 AS x FROM c) SELECT id, xor(x, x >> 15) AS hash FROM d"


@query(_WANG.replace("WITH a", "WITH n AS (SELECT p_partkey * 99991 % 4294967296 AS id FROM {part}), a"))
def lattice_hash(spark, sf_dir):
    """FN01."""
    keys = table(spark, sf_dir, "part").select((F.col("p_partkey") * 99991 % 4294967296).alias("id"))
    return keys.select("id", fn.wang_hash(F.col("id")).alias("hash"))


_HUGE = "CAST(({} * CAST({} AS HUGEINT)) % 4294967296 AS BIGINT)"


@query(
    "WITH s AS (SELECT p_partkey AS id, (p_partkey % 64 - 32 + 4294967296) % 4294967296 AS rx, p_partkey % 50 AS rz FROM {part}), "
    "a AS (SELECT id, xor(xor(xor(CAST(9 AS BIGINT), " + _HUGE.format(3, 2654435761) + "), " + _HUGE.format("rx", 2246822507) + "), " + _HUGE.format("rz", 3266489909) + ") AS x FROM s), "
    "b AS (SELECT id, xor(xor(x, 61), x >> 16) AS x FROM a), c AS (SELECT id, (x * 9) & 4294967295 AS x FROM b), d AS (SELECT id, xor(x, x >> 4) AS x FROM c), e AS (SELECT id, (x * 668265261) & 4294967295 AS x FROM d), "
    "f AS (SELECT id, xor(x, x >> 15) AS x FROM e) SELECT id, x AS hash, x % 5 AS variant FROM f"
)
def region_variant(spark, sf_dir):
    """FN08, FN09."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 64 - 32).alias("rx"), (F.col("p_partkey") % 50).alias("rz"))
    args = (F.lit(9).cast("bigint"), F.lit(3).cast("bigint"), F.col("rx"), F.col("rz"))
    return rows.select("id", fn.region_hash(*args).alias("hash"), fn.region_variant(*args, F.lit(5)).alias("variant"))


def _step(lo: str, hi: str, v: str) -> str:
    t = f"least(greatest(({v} - ({lo})) / (({hi}) - ({lo})), 0e0), 1e0)"
    return f"({t} * {t} * (3e0 - 2e0 * {t}))"


def _axis(v: str, k: str) -> str:
    band = f"greatest(band_{k}, 0.001e0)"
    return f"{_step(f'lo_{k} - {band}', f'lo_{k}', v)} * (1e0 - {_step(f'hi_{k}', f'hi_{k} + {band}', v)})"


_WEIGHT = f"SELECT id, biome, {_axis('elev', 'e')} * ({_axis('slope', 's')}) AS w FROM places CROSS JOIN bands"
_SHARE = f"WITH raw AS ({_WEIGHT}), t AS (SELECT id, sum(w) AS total, count(*) AS n FROM raw GROUP BY id) SELECT raw.id AS id, biome, CASE WHEN total <= 1e-9 THEN 1e0 / n ELSE w / total END AS w FROM raw JOIN t ON raw.id = t.id"


def _weights(spark, sf_dir):
    rows = relation(spark, sf_dir, "places").crossJoin(F.broadcast(relation(spark, sf_dir, "bands")))  # a fixed list of rules
    return rows.withColumn("raw", fn.band_weight(*[F.col(c) for c in ("elev", "slope", "lo_e", "hi_e", "band_e", "lo_s", "hi_s", "band_s")]))


@query(f"SELECT id, biome, round(w, 6) AS w FROM ({_WEIGHT}) t")
def band_weight(spark, sf_dir):
    """FN05, FN06."""
    return _weights(spark, sf_dir).select("id", "biome", F.round("raw", 6).alias("w"))


@query(_SHARE.replace("SELECT raw.id AS id, biome, CASE", "SELECT raw.id AS id, biome, round(CASE").replace("total END AS w", "total END, 6) AS w"))
def biome_weights(spark, sf_dir):
    """AGG08."""
    return rules_weights.shares(_weights(spark, sf_dir), ["id"], "raw").select("id", "biome", F.round("w", 6).alias("w"))


@query(_SHARE.replace(") SELECT raw.id", "), share AS (SELECT raw.id", 1) + ") SELECT id, round(sum(w * CASE biome WHEN 'alpine' THEN 0.9e0 WHEN 'forest' THEN 0.4e0 ELSE 0.7e0 END) / sum(w), 6) AS value FROM share WHERE w > 0.001e0 GROUP BY id")
def slot_blend(spark, sf_dir):
    """AGG09: a weighted mean over the rules that count."""
    value = F.when(F.col("biome") == "alpine", 0.9).when(F.col("biome") == "forest", 0.4).otherwise(0.7)
    rows = rules_weights.shares(_weights(spark, sf_dir), ["id"], "raw").withColumn("value", value)
    return rules_weights.weighted_mean(rows, ["id"], "w", "value").select("id", F.round("value", 6).alias("value"))


_FX = "(x * 1.15470054e0 - z * (1.15470054e0 * 0.5e0))"
_FY = "(z * 1.15470054e0)"


@query(f"SELECT id, round(CASE WHEN fx + fy < 1 THEN 1 - fx - fy ELSE 1 - fy END, 6) AS w0, round(CASE WHEN fx + fy < 1 THEN fx ELSE 1 - fx END, 6) AS w1, round(CASE WHEN fx + fy < 1 THEN fy ELSE fx + fy - 1 END, 6) AS w2, round(CASE WHEN d <= 16.8e0 THEN 0e0 WHEN d >= 20e0 THEN 1e0 ELSE (d - 16.8e0) / (20e0 - 16.8e0) END, 6) AS morph, round(least(greatest(1e0 - abs(x) / 8e0, 0e0), 1e0) * 0.5e0, 6) AS edge FROM (SELECT id, x, {_FX} - floor({_FX}) AS fx, {_FY} - floor({_FY}) AS fy, greatest(abs(x), abs(z)) AS d FROM points) t")
def surface_scalars(spark, sf_dir):
    """FN10, FN11, FN16."""
    x, z = F.col("x"), F.col("z")
    w = fn.hex_weights(x, z)
    return relation(spark, sf_dir, "points").select("id", *[F.round(w[k], 6).alias(k) for k in ("w0", "w1", "w2")], F.round(fn.morph_factor(x, z, 20.0), 6).alias("morph"), F.round(fn.edge_mix(F.abs(x), 8.0), 6).alias("edge"))



@query(f"SELECT id, round({_step('10e0', '40e0', 'sqrt(x * x + z * z)')}, 6) AS haze, round(pow(abs(x), 4e0) / greatest(pow(abs(x), 4e0) + pow(abs(z), 4e0) + 1e0, 0.0001e0), 6) AS wx, round(x + (z - x) * 0.25e0, 6) AS lerp FROM points")
def haze_triplanar(spark, sf_dir):
    """FN15, FN17, FN19."""
    x, z = F.col("x"), F.col("z")
    columns = {"haze": fn.haze(F.sqrt(x * x + z * z), 10.0, 40.0), "wx": fn.triplanar_weights(x, F.lit(1.0), z, 4.0)["x"], "lerp": surface.lerp(x, z, F.lit(0.25))}
    return relation(spark, sf_dir, "points").select("id", *[F.round(c, 6).alias(k) for k, c in columns.items()])


_PART = "CASE WHEN regexp_matches(version, '^[0-9]+(-[^.]*)?\\.[0-9]+(-[^.]*)?\\.[0-9]+(-[^.]*)?(\\..*)?$') THEN CAST(regexp_extract(split_part(version, '.', {0}), '^[0-9]+') AS BIGINT) ELSE 0 END"


@query("SELECT id, version, major, minor, patch, major = 1 AS compatible, NOT (major = 1 AND minor = 2 AND patch = 3) AS needs_migration FROM (SELECT id, version, " + ", ".join(f"{_PART.format(k + 1)} AS {n}" for k, n in enumerate(("major", "minor", "patch"))).replace("{", "{{").replace("}", "}}") + " FROM versions) t")
def semver(spark, sf_dir):
    """FN28 to FN30, against 1.2.3."""
    rows = relation(spark, sf_dir, "versions").withColumn("v", fn.semver(F.col("version")))
    own = fn.semver(F.lit("1.2.3"))
    return rows.select("id", "version", "v.major", "v.minor", "v.patch", fn.compatible(F.col("v"), own).alias("compatible"), (F.col("v") != own).alias("needs_migration"))


@query("SELECT p_partkey AS id, sha256('{{\"a\":' || p_partkey || ',\"b\":\"' || p_brand || '\",\"c\":true}}') AS hash, 'objects/' || substr(sha256('{{\"a\":' || p_partkey || ',\"b\":\"' || p_brand || '\",\"c\":true}}'), 1, 2) AS folder FROM {part}")
def content_hash(spark, sf_dir):
    """FN31, FN33, FN35."""
    h = fn.content_hash(c=F.lit(True), a=F.col("p_partkey"), b=F.col("p_brand"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), h.alias("hash"), F.concat(F.lit("objects/"), F.substring(h, 1, 2)).alias("folder"))


@query("SELECT event_id AS id, '[' || rpad(CASE event_type WHEN 'click' THEN 'WARN' ELSE 'INFO' END, 5, ' ') || '] [' || rpad(substr(event_type || '_subsystem_name', 1, 15), 15, ' ') || '] [' || lpad(CAST(event_id % 100000 AS VARCHAR), 6, ' ') || '] value' AS human, CASE event_type WHEN 'click' THEN 'WARN' ELSE 'INFO' END || ' ' || event_type || '_subsystem_name value' AS compact FROM {events} WHERE event_type = 'click' OR event_type = 'view'")
def log_format(spark, sf_dir):
    """FN41, SNK06, PRJ10."""
    level = F.when(F.col("event_type") == "click", "WARN").otherwise("INFO")
    args = (level, F.concat("event_type", F.lit("_subsystem_name")), F.col("event_id") % 100000, F.lit("value"))
    rows = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view"))
    return rows.select(F.col("event_id").alias("id"), fn.log_line("human", *args).alias("human"), fn.log_line("compact", *args).alias("compact"))


# rasters

_GRAD = "SELECT r, c, h, CASE WHEN xl IS NULL THEN xh - h WHEN xh IS NULL THEN h - xl ELSE (xh - xl) / 2e0 END AS gx, CASE WHEN yl IS NULL THEN yh - h WHEN yh IS NULL THEN h - yl ELSE (yh - yl) / 2e0 END AS gy FROM (SELECT r, c, h, lag(h) OVER (PARTITION BY r ORDER BY c) AS xl, lead(h) OVER (PARTITION BY r ORDER BY c) AS xh, lag(h) OVER (PARTITION BY c ORDER BY r) AS yl, lead(h) OVER (PARTITION BY c ORDER BY r) AS yh FROM grid) t"


def _grid(spark, sf_dir):
    return relation(spark, sf_dir, "grid").withColumn("page", F.lit(0))


@query(f"SELECT r, c, round(degrees(atan(sqrt(gx*gx+gy*gy))), 4) AS slope_deg, round(CASE WHEN degrees(atan2(-gx, gy)) < 0 THEN degrees(atan2(-gx, gy)) + 360e0 ELSE degrees(atan2(-gx, gy)) END, 4) AS aspect_deg, round(degrees(atan(sqrt(gx*gx+gy*gy) / 4e0)), 4) AS metric_deg FROM ({_GRAD}) g")
def slope_aspect(spark, sf_dir):
    """WIN01 to WIN04."""
    out = raster.slope_aspect(_grid(spark, sf_dir), ["page"])
    metric = F.degrees(F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")) / 4.0))
    return out.select("r", "c", F.round("slope_deg", 4).alias("slope_deg"), F.round("aspect_deg", 4).alias("aspect_deg"), F.round(metric, 4).alias("metric_deg"))


@query(f"SELECT r, c, CAST(floor(least(greatest((-0.5e0 * -2e0 * gx + -0.5e0 * 2e0 * gy + sqrt(0.5e0)) / sqrt(4e0*gx*gx+4e0*gy*gy+1e0), 0e0), 1e0) * 255e0 + 1e-9) AS INT) AS shade FROM ({_GRAD}) g".replace("-0.5e0 * -2e0 * gx + -0.5e0 * 2e0 * gy", "gx - gy"))
def hillshade(spark, sf_dir):
    """WIN12 (sun at 315, 45 degrees)."""
    return raster.hillshade(_grid(spark, sf_dir), ["page"]).select("r", "c", "shade")


@query("WITH a AS (SELECT r // 2 AS r, c // 2 AS c, avg(h) AS h FROM grid GROUP BY 1, 2), b AS (SELECT r // 2 AS r, c // 2 AS c, avg(h) AS h FROM a GROUP BY 1, 2) SELECT 0 AS mip, r, c, h FROM grid UNION ALL SELECT 1, r, c, h FROM a UNION ALL SELECT 2, r, c, h FROM b")
def mip_pyramid(spark, sf_dir):
    """AGG25."""
    return raster.pyramid(_grid(spark, sf_dir), ["page"], 32, 32).select("mip", "r", "c", "h")


@query("WITH s AS (SELECT id, least(greatest((x + 50e0) / 100e0, 0e0), 1e0) * 31e0 AS fx, least(greatest((z + 50e0) / 100e0, 0e0), 1e0) * 31e0 AS fy FROM points), k AS (SELECT id, fx, fy, CAST(floor(fx) AS INT) AS x0, CAST(floor(fy) AS INT) AS y0, CAST(least(floor(fx) + 1, 31) AS INT) AS x1, CAST(least(floor(fy) + 1, 31) AS INT) AS y1 FROM s) SELECT id, round((a.h + (b.h - a.h) * (fx - x0)) + ((c.h + (d.h - c.h) * (fx - x0)) - (a.h + (b.h - a.h) * (fx - x0))) * (fy - y0), 6) AS h FROM k JOIN grid a ON a.r = y0 AND a.c = x0 JOIN grid b ON b.r = y0 AND b.c = x1 JOIN grid c ON c.r = y1 AND c.c = x0 JOIN grid d ON d.r = y1 AND d.c = x1")
def bilinear_sample(spark, sf_dir):
    """JOIN12, FN38: a packed page of fixed size is broadcast."""
    packed = relation(spark, sf_dir, "grid").groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "c", "h"))), lambda s: s["h"]).alias("heights"))
    rows = relation(spark, sf_dir, "points").crossJoin(F.broadcast(packed))
    return rows.select("id", F.round(raster.bilinear(F.col("heights"), 32, 32, (F.col("x") + 50) / 100, (F.col("z") + 50) / 100), 6).alias("h"))



@query("SELECT count(*) AS cells, min(h) AS lo, max(h) AS hi, round(avg(abs(h - 48e0)), 6) AS mean_delta, max(abs(h - 48e0)) AS max_delta, CAST(sum(CASE WHEN abs(h - 48e0) > 0.5e0 THEN 1 ELSE 0 END) AS BIGINT) AS changed FROM grid WHERE h > -9000")
def raster_stats(spark, sf_dir):
    """AGG24, AGG26: how far the grid is from a level, and its range."""
    rows = _grid(spark, sf_dir).withColumn("level", F.lit(48.0))
    both = raster.delta_stats(rows, ["page"], "level", "h").join(raster.value_range(rows, ["page"]), "page")
    return both.select("cells", "lo", "hi", F.round("mean_delta", 6).alias("mean_delta"), "max_delta", "changed")


@query("SELECT r, c, round((h - lo) / (hi - lo), 6) AS v, (r + 16) % 32 AS shifted_r, (c + 16) % 32 AS shifted_c FROM grid CROSS JOIN (SELECT min(h) AS lo, max(h) AS hi FROM grid) m")
def raster_normalized(spark, sf_dir):
    """WIN11, AGG29."""
    rows = raster.normalized_by(_grid(spark, sf_dir), ["page"]).withColumns({"shifted_r": F.col("r"), "shifted_c": F.col("c")})
    moved = raster.half_shift(_grid(spark, sf_dir).select("r", "c", F.col("r").alias("own_r"), F.col("c").alias("own_c")), 32, 32)
    moved = moved.select(F.col("own_r").alias("r"), F.col("own_c").alias("c"), F.col("r").alias("shifted_r"), F.col("c").alias("shifted_c"))
    return rows.select("r", "c", F.round("v", 6).alias("v")).join(moved, ["r", "c"])


@query("SELECT round(greatest((SELECT avg((a.h - b.h) * (a.h - b.h)) FROM grid a JOIN grid b ON a.c = b.c AND a.r = 0 AND b.r = 31), (SELECT avg((a.h - b.h) * (a.h - b.h)) FROM grid a JOIN grid b ON a.r = b.r AND a.c = 0 AND b.c = 31)), 6) AS seam")
def seam_score(spark, sf_dir):
    """AGG22."""
    return raster.seam_score(_grid(spark, sf_dir), ["page"], 32, 32, ["h"]).select(F.round("seam", 6).alias("seam"))



def _kernel(name, kernel, columns, doc):
    def run(spark, sf_dir):
        pages = relation(spark, sf_dir, "cameras").select("frame").withColumnRenamed("frame", "page")
        rows = raster.noise_pages(pages.withColumns({"page_x": F.col("page") * 64.0, "page_z": F.lit(0.0)}), 32, 64.0, seed=7, frequency=1 / 48).drop("page_x", "page_z", "x", "z")
        return raster.per_page(rows, ["page"], kernel, columns)

    run.__doc__ = doc
    QUERIES[name] = run


_kernel("erosion_page", raster.erode, ["eroded", "drainage", "vx", "vy", "flow_accum"], "WIN07 to WIN09, AGG27.")
_kernel("thermal_page", lambda h: raster.erode(h, iterations=0), ["eroded"], "WIN08 alone, 50 slides.")
_kernel("ridge_page", lambda h: {"ridge": raster.ridges(h.astype(float))}, ["ridge"], "WIN05, AGG29.")
_kernel("drainage_page", lambda h: {"drainage": raster.drainage(h)}, ["drainage"], "WIN06, AGG28.")
_kernel("wrapped_blur", lambda h: {"blur": raster.blurred(h.astype(float), 2.0, "wrap")}, ["blur"], "WIN10.")


# store, usage, streams in batch form


@query("WITH RECURSIVE d AS (SELECT s.key AS start, deps.key AS key FROM (SELECT key FROM artifacts WHERE key % 20 = 0) s JOIN deps ON deps.depends_on = s.key UNION SELECT d.start, deps.key FROM d JOIN deps ON deps.depends_on = d.key) SELECT start, key FROM d")
def dep_closure(spark, sf_dir):
    """GRF01, GRF02."""
    starts = relation(spark, sf_dir, "artifacts").where("key % 20 = 0").selectExpr("key AS start", "key")
    return store.dependents(relation(spark, sf_dir, "deps"), starts)


@query("WITH RECURSIVE d AS (SELECT CAST(3 AS BIGINT) AS key UNION SELECT deps.key FROM d JOIN deps ON deps.depends_on = d.key) SELECT key, size_bytes, last_access FROM artifacts WHERE key NOT IN (SELECT key FROM d)")
def invalidate(spark, sf_dir):
    """GRF03 to GRF05: what is left when key 3 and its dependents go."""
    one = spark.createDataFrame([(3, 3)], "start long, key long")
    gone = store.dependents(relation(spark, sf_dir, "deps"), one).select("key").union(one.select("key"))
    return spatial.remove(relation(spark, sf_dir, "artifacts").withColumnRenamed("key", "id"), gone.withColumnRenamed("key", "id")).select(F.col("id").alias("key"), "size_bytes", "last_access")


@query("SELECT key, size_bytes, freed_before FROM (SELECT key, size_bytes, CAST(coalesce(sum(size_bytes) OVER (ORDER BY last_access, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS freed_before, (SELECT sum(size_bytes) FROM artifacts) AS total FROM artifacts) t WHERE freed_before < total - 2000000")
def lru_evict(spark, sf_dir):
    """SRT05, SRT07."""
    return store.keep_newest(relation(spark, sf_dir, "artifacts"), 2_000_000).select("key", "size_bytes", "freed_before")



@query("SELECT CAST(sum(size_bytes) AS BIGINT) AS bytes, CAST(floor(sum(size_bytes) / 1048576) AS BIGINT) AS mb, count(*) AS n FROM artifacts")
def store_size(spark, sf_dir):
    """AGG05."""
    return store.store_size(relation(spark, sf_dir, "artifacts"))


@query("SELECT key, last_access FROM artifacts WHERE last_access < 930e0")
def age_evict(spark, sf_dir):
    """SRT08."""
    return store.unreferenced(relation(spark, sf_dir, "artifacts"), 960.0, 30.0).select("key", "last_access")


@query("SELECT key FROM (SELECT key, row_number() OVER (ORDER BY last_access DESC, key DESC) AS n FROM artifacts) t WHERE n > 100")
def lru_count(spark, sf_dir):
    """SRT06."""
    return store.keep_recent(relation(spark, sf_dir, "artifacts"), 100).select("key")



@query("SELECT key, CAST(sum(value) AS BIGINT) AS total FROM usage GROUP BY key")
def usage_totals(spark, sf_dir):
    """AGG02, PRJ11."""
    return store.usage_totals(relation(spark, sf_dir, "usage"))


@query("SELECT b.key AS key, CAST(budget - coalesce(total, 0) AS BIGINT) AS headroom, budget - coalesce(total, 0) < 0 AS over FROM budgets b LEFT JOIN (SELECT key, sum(value) AS total FROM usage GROUP BY key) u ON u.key = b.key")
def headroom(spark, sf_dir):
    """AGG03."""
    return store.headroom(relation(spark, sf_dir, "usage"), relation(spark, sf_dir, "budgets"))


@query("SELECT system, key, value FROM (SELECT system, key, value, row_number() OVER (PARTITION BY system, key ORDER BY ts DESC, id DESC) AS n FROM usage) t WHERE n = 1")
def latest_usage(spark, sf_dir):
    """STR03 in batch form."""
    return store.latest_usage(relation(spark, sf_dir, "usage"))



@query("SELECT system, total FROM (SELECT system, CAST(sum(value) AS BIGINT) AS total FROM usage WHERE key = 'draw_calls' GROUP BY system) t ORDER BY total DESC, system LIMIT 3")
def top_publishers(spark, sf_dir):
    """SRT02."""
    return store.top_publishers(relation(spark, sf_dir, "usage"), "draw_calls", 3)


@query("SELECT id, source FROM changes ORDER BY id DESC LIMIT 100")
def recent_changes(spark, sf_dir):
    """SRT09."""
    return store.recent(relation(spark, sf_dir, "changes"), 100).select("id", "source")


@query("SELECT id, system, value FROM usage WHERE ts >= TIMESTAMP '2024-01-28 00:00:00'")
def history(spark, sf_dir):
    """SRT10."""
    return store.since(relation(spark, sf_dir, "usage"), F.lit("2024-01-28 00:00:00").cast("timestamp")).select("id", "system", "value")


@query("SELECT system, key, count(*) AS n, CAST(sum(value) AS BIGINT) AS bytes, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS large FROM usage GROUP BY system, key")
def owner_counts(spark, sf_dir):
    """AGG04."""
    return store.owner_totals(relation(spark, sf_dir, "usage"), ["system", "key"], "value", 50)


@query("SELECT key, CAST(sum(CASE WHEN id % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) AS open FROM usage GROUP BY key HAVING sum(CASE WHEN id % 2 = 0 THEN 1 ELSE -1 END) > 0")
def leaks(spark, sf_dir):
    """STR10 in batch form: even readings register, odd ones unregister."""
    return store.leaks(relation(spark, sf_dir, "usage").withColumn("delta", F.when(F.col("id") % 2 == 0, 1).otherwise(-1)), "key", "delta")



@query("SELECT c.id AS id, s.sub_id AS sub_id FROM changes c JOIN subscriptions s ON (s.names = '' OR list_contains(string_split(s.names, ','), c.source)) AND (s.sx0 IS NULL OR (c.x0 < s.sx1 AND c.x1 > s.sx0 AND c.z0 < s.sz1 AND c.z1 > s.sz0))")
def change_match(spark, sf_dir):
    """JOIN07, JOIN08, PRJ08."""
    subs = relation(spark, sf_dir, "subscriptions").withColumn("sources", F.filter(F.split("names", ","), lambda s: s != ""))
    return store.matched_changes(relation(spark, sf_dir, "changes"), subs)



@query("SELECT a.key AS key FROM artifacts a WHERE NOT EXISTS (SELECT 1 FROM deps d JOIN artifacts j ON j.key = d.depends_on WHERE d.key = a.key AND j.size_bytes % 3000 <> 0)")
def job_ready(spark, sf_dir):
    """JOIN14, on jobs whose status and dependencies derive from the artifacts."""
    jobs = relation(spark, sf_dir, "artifacts").select(F.col("key").alias("id"), F.when(F.col("size_bytes") % 3000 == 0, "completed").otherwise("queued").alias("status"))
    return job_ops.ready(jobs, relation(spark, sf_dir, "deps").withColumnRenamed("key", "id")).select(F.col("id").alias("key"))


@query("SELECT key FROM artifacts ORDER BY size_bytes, last_access, key LIMIT 1")
def next_job(spark, sf_dir):
    """SRT11."""
    jobs = relation(spark, sf_dir, "artifacts").select(F.col("key").alias("id"), F.col("size_bytes").alias("priority"), F.col("last_access").alias("seq"))
    return job_ops.next_jobs(jobs).select(F.col("id").alias("key"))


@query("SELECT size_bytes % 5000 AS priority, count(*) AS n FROM artifacts GROUP BY size_bytes % 5000")
def queue_depth(spark, sf_dir):
    """AGG11."""
    return job_ops.queue_depth(relation(spark, sf_dir, "artifacts").select((F.col("size_bytes") % 5000).alias("priority")))


@query("SELECT a.id AS id, coalesce(g.h, 0e0) AS h FROM points a LEFT JOIN grid g ON g.r = floor(a.x) AND g.c = floor(a.z)")
def page_latest(spark, sf_dir):
    """JOIN13: the cell of the grid that a point lies in, 0 outside."""
    cells = relation(spark, sf_dir, "grid").select(F.col("r").cast("bigint").alias("cell_x"), F.col("c").cast("bigint").alias("cell_z"), "h")
    return spatial.sampled_cells(relation(spark, sf_dir, "points"), cells, 1.0).select("id", "h")


@query("SELECT slot, n, CAST(coalesce(sum(n) OVER (ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM (SELECT slot, count(*) AS n FROM candidates GROUP BY slot) t")
def layer_windows(spark, sf_dir):
    """AGG12, SRC10."""
    return materials.layer_windows(relation(spark, sf_dir, "candidates"), ["slot"], "slot")


@query("SELECT c.id AS id, c.slot AS slot, CASE c.slot WHEN 0 THEN 'alpine' WHEN 1 THEN 'shore' ELSE 'none' END AS biome, coalesce(b.lo_e, -1e4) AS lo_e, coalesce(b.hi_e, 1e4) AS hi_e, coalesce(b.band_s, 1e0) AS band_s FROM candidates c LEFT JOIN bands b ON b.biome = CASE c.slot WHEN 0 THEN 'alpine' WHEN 1 THEN 'shore' END")
def slot_catalog(spark, sf_dir):
    """JOIN04, PRJ12."""
    slots = relation(spark, sf_dir, "candidates").select("id", "slot", F.when(F.col("slot") == 0, "alpine").when(F.col("slot") == 1, "shore").otherwise("none").alias("biome"))
    catalog = relation(spark, sf_dir, "bands").withColumn("place", F.lit(0))
    return materials.slot_bands(slots, catalog, keys=("biome",)).select("id", "slot", "biome", "lo_e", "hi_e", "band_s")


@query("SELECT slot, 'left' AS side FROM (SELECT DISTINCT slot FROM candidates WHERE id % 4 = 0 EXCEPT SELECT DISTINCT slot FROM candidates WHERE grade = 'D') a UNION ALL SELECT slot, 'right' AS side FROM (SELECT DISTINCT slot FROM candidates WHERE grade = 'D' EXCEPT SELECT DISTINCT slot FROM candidates WHERE id % 4 = 0) b")
def key_difference(spark, sf_dir):
    """SET05."""
    rows = relation(spark, sf_dir, "candidates")
    return materials.key_difference(rows.where("id % 4 = 0"), rows.where("grade = 'D'"), ["slot"])



# quality and rules


@query("SELECT slot, coalesce(grade, '-') AS grade, count(*) AS n FROM candidates GROUP BY slot, coalesce(grade, '-')")
def grade_histogram(spark, sf_dir):
    """AGG06."""
    return materials.grade_histogram(relation(spark, sf_dir, "candidates"), "slot")


@query("SELECT slot, count(*) AS total, CAST(sum(CASE WHEN grade = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS best, CAST(sum(CASE WHEN grade = 'A' THEN 0 ELSE 1 END) AS BIGINT) AS flagged FROM candidates GROUP BY slot")
def review_counts(spark, sf_dir):
    """AGG07: what is not of grade A is flagged, ungraded ones too."""
    return materials.review_counts(relation(spark, sf_dir, "candidates"), "slot")


@query("SELECT id, CASE WHEN seam > 0.019e0 THEN 'failed' WHEN grade = 'A' THEN 'candidate' ELSE 'rejected_auto' END AS status FROM candidates")
def candidate_status(spark, sf_dir):
    """UDF13."""
    return relation(spark, sf_dir, "candidates").select("id", materials.candidate_status(F.col("seam") > 0.019, F.col("grade")).alias("status"))


@query("WITH a AS (SELECT slot, list_sort(list(id)) AS ids FROM candidates WHERE grade = 'A' AND slot % 2 = 0 GROUP BY slot), n AS (SELECT slot, ids, unnest(range(0, least(len(ids), 4))) AS place FROM a) SELECT 's' || slot AS slot, 0 AS place, CAST(id AS VARCHAR) AS id, 's' || slot AS source, 0.5e0 AS weight FROM candidates WHERE grade = 'B' AND slot NOT IN (SELECT slot FROM a) UNION ALL SELECT 's' || slot, CAST(place AS INT), CASE place WHEN 0 THEN 'default' ELSE 'v' || (place - 1) || '_' || ids[place + 1] END, CASE place WHEN 0 THEN 's' || slot ELSE 's' || slot || '_variants/v' || (place - 1) || '_' || ids[place + 1] END, 1e0 FROM n")
def promotions(spark, sf_dir):
    """SNK04, VAL14: each slot's candidates of grade A and a small seam replace its variants."""
    rows = relation(spark, sf_dir, "candidates").select(F.concat(F.lit("s"), "slot").alias("slot"), F.col("id").cast("string").alias("tag"), "id", "grade")
    best = rows.where("grade = 'A'").groupBy("slot").agg(F.array_sort(F.collect_list("id")).alias("ids"))  # a slot's candidates of the highest grade are a list of bounded use
    chosen = best.where(F.regexp_extract("slot", "[0-9]+", 0).cast("int") % 2 == 0).select("slot", F.get("ids", 0).cast("string").alias("base"), F.transform(F.slice("ids", 2, 3), lambda i: i.cast("string")).alias("siblings"))
    manifest = rows.where("grade = 'B'").select("slot", F.lit(0).alias("place"), F.col("tag").alias("id"), F.col("slot").alias("source"), F.lit(0.5).alias("weight"))
    return materials.promoted(manifest, chosen, rows)


_SCORE = "round(least(greatest(1 - seam / 0.02e0, 0e0), 1e0) * 0.4e0 + least(greatest(1 - (periodic - 6) / 19e0, 0e0), 1e0) * 0.4e0 + least(greatest(rich, 0e0), 1e0) * 0.2e0, 4)"


@query(f"SELECT slot, id, composite, CAST(n AS INT) AS place FROM (SELECT slot, id, composite, row_number() OVER (PARTITION BY slot ORDER BY composite DESC, id) AS n FROM (SELECT slot, id, {_SCORE} AS composite FROM candidates) s) t WHERE n <= 3")
def rank_variants(spark, sf_dir):
    """FN20, SRT03, SRT04."""
    rows = relation(spark, sf_dir, "candidates").withColumn("composite", F.round(fn.composite_score(F.col("seam"), F.col("periodic"), F.col("rich")), 4))
    return quality.ranked(rows, ["slot"], "composite", "id", 3).select("slot", "id", "composite", "place")


_HIST = "SELECT img, CAST(least(floor(v * 32e0), 31) AS INT) AS bin, count(*) AS n FROM samples WHERE v >= 0 AND v <= 1 GROUP BY 1, 2"


@query(f"SELECT img, bin, n, round(CAST(sum(n) OVER (PARTITION BY img ORDER BY bin) AS DOUBLE) / sum(n) OVER (PARTITION BY img), 6) AS cdf FROM ({_HIST}) h")
def histogram_cdf(spark, sf_dir):
    """AGG14."""
    out = quality.cdf(quality.histogram(relation(spark, sf_dir, "samples"), "img", "v", 32))
    return out.select("img", "bin", "n", F.round("cdf", 6).alias("cdf"))


@query(f"SELECT img, round(-sum(n / t * log2(n / t)), 6) AS entropy FROM (SELECT img, CAST(n AS DOUBLE) AS n, CAST(sum(n) OVER (PARTITION BY img) AS DOUBLE) AS t FROM ({_HIST}) h) k GROUP BY img")
def entropy(spark, sf_dir):
    """AGG15."""
    return quality.entropy(quality.histogram(relation(spark, sf_dir, "samples"), "img", "v", 32)).withColumn("entropy", F.round("entropy", 6))


@query("SELECT img, CAST(k AS INT) AS k, v FROM (SELECT img, v, row_number() OVER (PARTITION BY img ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY img) AS n FROM samples) s JOIN (SELECT range AS k FROM range(16)) q ON s.i = CAST(round_even((k + 0.5e0) / 16e0 * (n - 1), 0) AS BIGINT)")
def inverse_cdf(spark, sf_dir):
    """AGG17 with 16 quantiles."""
    return quality.inverse_cdf(relation(spark, sf_dir, "samples"), "img", "v", 16)


@query(f"WITH h AS ({_HIST}), g AS (SELECT i.img AS img, b.bin AS bin, coalesce(h.n, 0) AS n FROM (SELECT DISTINCT img FROM h) i CROSS JOIN (SELECT CAST(range AS INT) AS bin FROM range(32)) b LEFT JOIN h ON h.img = i.img AND h.bin = b.bin), c AS (SELECT img, bin, CAST(sum(n) OVER (PARTITION BY img ORDER BY bin) AS DOUBLE) / sum(n) OVER (PARTITION BY img) AS cdf FROM g) SELECT a.img AS img, round(avg(abs(a.cdf - b.cdf)), 6) AS distance FROM c a JOIN c b ON a.bin = b.bin AND b.img = 1 GROUP BY a.img")
def hist_distance(spark, sf_dir):
    """FN23, to image 1."""
    return quality.palette_distance(quality.histogram(relation(spark, sf_dir, "samples"), "img", "v", 32), 1, 32).withColumn("distance", F.round("distance", 6))



@query("SELECT img, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, round(avg(CASE WHEN v > 0.5e0 THEN 1e0 ELSE 0e0 END), 6) AS coverage FROM samples GROUP BY img")
def moments(spark, sf_dir):
    """AGG16."""
    out = quality.moments(relation(spark, sf_dir, "samples"), "img", "v", 0.5)
    return out.select("img", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "coverage")])



@query()
def palette_kmeans(spark, sf_dir):
    """AGG19: five mean colours for each image of 256 pixels, one image a task's group."""
    return quality.palette(relation(spark, sf_dir, "pixels"), "img")


@query()
def periodicity(spark, sf_dir):
    """AGG23 on noise pages."""
    pages = relation(spark, sf_dir, "cameras").selectExpr("frame AS page", "frame * 64e0 AS page_x", "0e0 AS page_z")
    rows = raster.noise_pages(pages, 64, 64.0, seed=3, frequency=1 / 8)
    return raster.per_page(rows.drop("page_x", "page_z", "x", "z"), ["page"], lambda h: {"peak": np.full(h.shape, quality.periodic(h))}, ["peak"]).groupBy("page").agg(F.round(F.first("peak"), 3).alias("peak"))


_NOISE = "SELECT p_partkey AS id, CAST(p_size % 20 AS INT) AS octaves, (p_size % 7) / 100e0 AS frequency, 0.5e0 + p_size % 4 AS lacunarity, (p_size % 6) / 5e0 AS gain, p_size % 9 - 1e0 AS amplitude FROM {part}"
_NOISE_RULES = {"octaves_low": "octaves <= 0", "octaves_high": "octaves > 16", "frequency": "frequency <= 0", "lacunarity": "lacunarity <= 1", "gain": "gain <= 0 OR gain >= 1", "amplitude": "amplitude < 0"}
_NOISE_ISSUES = "(" + " UNION ALL ".join(f"SELECT id, 'error' AS severity, '{code}' AS code FROM ({_NOISE}) n WHERE {cond}" for code, cond in _NOISE_RULES.items()) + ")"


@query(f"SELECT id, severity, code FROM {_NOISE_ISSUES} i")
def rule_issues(spark, sf_dir):
    """VAL02."""
    return rules.config_issues(spark.sql(_NOISE, part=table(spark, sf_dir, "part")), "noise_stack", "id")



@query(f"SELECT severity, count(*) AS n FROM {_NOISE_ISSUES} t GROUP BY severity")
def issue_counts(spark, sf_dir):
    """AGG10."""
    return store.issue_counts(rule_issues(spark, sf_dir))


@query("SELECT d.key AS key, d.depends_on AS depends_on FROM deps d LEFT JOIN (SELECT key FROM artifacts WHERE size_bytes > 5000) a ON a.key = d.depends_on WHERE a.key IS NULL")
def missing_references(spark, sf_dir):
    """JOIN10."""
    return materials.missing_references(relation(spark, sf_dir, "deps"), relation(spark, sf_dir, "artifacts").where("size_bytes > 5000"), "depends_on", "key").select("key", "depends_on")



_LINT = "CASE WHEN regexp_matches(code, '\\bprint\\(') THEN 'print' WHEN regexp_matches(code, '\\bprints\\(') THEN 'prints' END"
_LINT_LINES = "replace(replace(text, 'token = ', 'print('), 'Released', 'prints(')"


@query(f"SELECT file, line, call FROM (SELECT 'd' || doc_id || '.gd' AS file, CAST(n AS INT) AS line, {_LINT} AS call FROM (SELECT doc_id, n, split_part(line, '#', 1) AS code, line FROM (SELECT doc_id, unnest(string_split({_LINT_LINES}, chr(10))) AS line, generate_subscripts(string_split({_LINT_LINES}, chr(10)), 1) AS n FROM {{documents}}) t WHERE NOT contains(line, '# LINT_OK')) q) r WHERE call IS NOT NULL")
def text_lint(spark, sf_dir):
    """FN42, VAL13, SRC15: forbidden calls in lines of texts, in which two frequent phrases stand for calls."""
    text = F.replace(F.replace(F.col("text"), F.lit("token = "), F.lit("print(")), F.lit("Released"), F.lit("prints("))
    lines = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id", F.lit(".gd")).alias("file"), F.posexplode(F.split(text, "\n")).alias("n", "text"))
    return rules.log_lint(lines.select("file", (F.col("n") + 1).alias("line"), "text"))
