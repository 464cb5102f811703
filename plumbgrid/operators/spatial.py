"""Point sets on a grid: radius, rectangle and nearest-neighbour joins, cell statistics, upserts.

Every range join is an equi-join on grid cells with the exact predicate on what is left, so it plans as a hash or
sort-merge join, never as a nested loop over all pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut_lineage


def cell(v: Column, size: float) -> Column:
    """Grid cell of a coordinate; rounds down, so that cells left of zero are as wide as the others."""
    return F.floor(v / F.lit(float(size))).cast("bigint")


def cells_of(df: DataFrame, size: float, x: str = "x", z: str = "z") -> DataFrame:
    return df.withColumns({"cell_x": cell(F.col(x), size), "cell_z": cell(F.col(z), size)})


#: Cells along a side that a rectangle covers at its level, about.
WIDE = 8


def _cover(df: DataFrame, size: float, x0: Column, x1: Column, z0: Column, z1: Column) -> DataFrame:
    """One row for each cell that a row's rectangle touches."""
    rows = df.withColumn("cell_x", F.explode(F.sequence(cell(x0, size), cell(x1, size))))
    return rows.withColumn("cell_z", F.explode(F.sequence(cell(z0, size), cell(z1, size))))


def _level(size: float, x0: Column, x1: Column, z0: Column, z1: Column) -> Column:
    """How often cells must double until a rectangle touches about WIDE along a side."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(x1 - x0, z1 - z0, F.lit(float(size))) / F.lit(float(size * WIDE))))).cast("int")


def _levels(df: DataFrame) -> list[int]:
    """The levels that occur: at most one for each doubling of a rectangle's size."""
    return sorted(r[0] for r in df.select("level").distinct().collect())


def _cells_at(df: DataFrame, size: float, levels: list[int], x: str = "x", z: str = "z") -> DataFrame:
    """One row for each of the levels, with the row's cell of that level."""
    rows = df.withColumn("level", F.explode(F.array(*[F.lit(k) for k in levels])))
    width = F.lit(float(size)) * F.pow(F.lit(2.0), F.col("level"))
    return rows.withColumns({"cell_x": F.floor(F.col(x) / width).cast("bigint"), "cell_z": F.floor(F.col(z) / width).cast("bigint")})


def _covers_at(df: DataFrame, size: float, bounds: tuple[Column, Column, Column, Column]) -> DataFrame:
    """One row for each cell of its own level that a row's rectangle touches."""
    width = F.lit(float(size)) * F.pow(F.lit(2.0), F.col("level"))
    x0, x1, z0, z1 = (F.floor(v / width).cast("bigint") for v in bounds)
    return df.withColumn("cell_x", F.explode(F.sequence(x0, x1))).withColumn("cell_z", F.explode(F.sequence(z0, z1)))


def radius_join(points: DataFrame, queries: DataFrame, size: float) -> DataFrame:
    """points (id, x, z) within radius of queries (qid, qx, qz, radius), the border included; negative radii match nothing.

    A query is covered by cells of a level that suits its radius, so that it becomes about WIDE * WIDE rows however
    large it is; points have a cell for each level that occurs.
    """
    r = F.col("radius")
    bounds = (F.col("qx") - r, F.col("qx") + r, F.col("qz") - r, F.col("qz") + r)
    probes = queries.where("radius >= 0").withColumn("level", _level(size, *bounds))
    levels = _levels(probes) or [0]
    dx, dz = F.col("x") - F.col("qx"), F.col("z") - F.col("qz")
    joined = _cells_at(points, size, levels).join(_covers_at(probes, size, bounds), ["level", "cell_x", "cell_z"])
    return joined.where(dx * dx + dz * dz <= r * r).select("qid", "id", (dx * dx + dz * dz).alias("d2"))


def rect_join(points: DataFrame, rects: DataFrame, size: float, closed: bool = True) -> DataFrame:
    """points in rects (rid, x0, z0, x1, z1); closed on all sides, or half-open at the far edges."""
    bounds = (F.col("x0"), F.col("x1"), F.col("z0"), F.col("z1"))
    probes = rects.where("x0 <= x1 AND z0 <= z1").withColumn("level", _level(size, *bounds))
    levels = _levels(probes) or [0]
    far = (F.col("x") <= F.col("x1")) & (F.col("z") <= F.col("z1")) if closed else (F.col("x") < F.col("x1")) & (F.col("z") < F.col("z1"))
    joined = _cells_at(points, size, levels).join(_covers_at(probes, size, bounds), ["level", "cell_x", "cell_z"])
    return joined.where((F.col("x") >= F.col("x0")) & (F.col("z") >= F.col("z0")) & far).select("rid", "id")


def rect_overlaps(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """Pairs of left (x0, z0, x1, z1) and right (sx0, sz0, sx1, sz1) that overlap strictly, each once, with all columns of both.

    Both are covered by cells; a pair meets at the coarser of its two levels, and of the cells that both touch it
    counts in the one of their common corner.
    """
    lb, rb = [F.col(c) for c in ("x0", "x1", "z0", "z1")], [F.col(c) for c in ("sx0", "sx1", "sz0", "sz1")]
    left = left.where("x0 <= x1 AND z0 <= z1").withColumn("level", _level(size, *lb))
    right = right.where("sx0 <= sx1 AND sz0 <= sz1").withColumn("level", _level(size, *rb))
    levels = sorted({*_levels(left), *_levels(right)}) or [0]

    def at_all(df, own):
        return df.withColumn(own, F.col("level")).withColumn("level", F.explode(F.filter(F.array(*[F.lit(k) for k in levels]), lambda k: k >= F.col(own))))

    a = _covers_at(at_all(left, "__a"), size, tuple(lb))
    b = _covers_at(at_all(right, "__b"), size, tuple(rb))
    joined = a.join(b, ["level", "cell_x", "cell_z"]).where(F.col("level") == F.greatest("__a", "__b"))
    width = F.lit(float(size)) * F.pow(F.lit(2.0), F.col("level"))
    corner = (F.floor(F.greatest("x0", "sx0") / width) == F.col("cell_x")) & (F.floor(F.greatest("z0", "sz0") / width) == F.col("cell_z"))
    strict = (F.col("x0") < F.col("sx1")) & (F.col("x1") > F.col("sx0")) & (F.col("z0") < F.col("sz1")) & (F.col("z1") > F.col("sz0"))
    return joined.where(corner & strict).drop("level", "cell_x", "cell_z", "__a", "__b")


def nearest_join(points: DataFrame, queries: DataFrame, k: int, size: float) -> DataFrame:
    """The k nearest points of each query (qid, qx, qz), exactly: qid, id, d2, rank; ties go to the lesser id.

    Points are counted by cells, and cells by those of each coarser level. Each query takes the finest level at which its
    cell and the eight around it hold k points: those lie within the diagonal of two cells, which is its radius. One
    radius join then finds all candidates, and the points are read twice in all, whatever the distances.
    """
    spark, schema = points.sparkSession, "qid long, id long, d2 double, rank int"
    bounds = points.select("x", "z").union(queries.select("qx", "qz")).agg(F.min("x"), F.max("x"), F.min("z"), F.max("z")).first()
    if k <= 0 or points.isEmpty() or bounds[0] is None:
        return spark.createDataFrame([], schema)
    span = max(bounds[1] - bounds[0], bounds[3] - bounds[2])
    top = max(0, math.ceil(math.log2(max(span, size) / size)) + 1)
    cells = cut_lineage(cells_of(points, size).groupBy("cell_x", "cell_z").agg(F.count("*").alias("n")), "cells")
    wide = F.pow(F.lit(2.0), F.col("level"))  # half as many cells along a side at each level
    every = cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top))))
    every = every.groupBy("level", F.floor(F.col("cell_x") / wide).cast("bigint").alias("cell_x"), F.floor(F.col("cell_z") / wide).cast("bigint").alias("cell_z")).agg(F.sum("n").alias("n"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    probes = _cells_at(queries.select("qid", "qx", "qz"), size, list(range(top + 1)), "qx", "qz").withColumn("a", around)
    probes = probes.select("qid", "level", (F.col("cell_x") + F.col("a.i")).alias("cell_x"), (F.col("cell_z") + F.col("a.j")).alias("cell_z"))
    enough = probes.join(every, ["level", "cell_x", "cell_z"]).groupBy("qid", "level").agg(F.sum("n").alias("n")).where(F.col("n") >= k)
    level = cut_lineage(enough.groupBy("qid").agg(F.min("level").alias("own")), "levels")
    radius = F.lit(2 * math.sqrt(2) * size * (1 + 1e-9)) * F.pow(F.lit(2.0), F.coalesce("own", F.lit(top)))
    found = radius_join(points, queries.join(level, "qid", "left").withColumn("radius", radius), size)
    order = Window.partitionBy("qid").orderBy("d2", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cell_stats(points: DataFrame, size: float) -> DataFrame:
    """buckets, the fullest bucket, and points."""
    per = cells_of(points, size).groupBy("cell_x", "cell_z").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("buckets"), F.coalesce(F.max("n"), F.lit(0)).alias("max_load"), F.coalesce(F.sum("n"), F.lit(0)).alias("size"))


def sampled_cells(points: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """points (id, x, z) with the height h of their cell (cell_x, cell_z, h); 0 where there is none."""
    return cells_of(points, size).join(cells, ["cell_x", "cell_z"], "left").withColumn("h", F.coalesce("h", F.lit(0.0)))


def contains(points: DataFrame, ids: DataFrame) -> DataFrame:
    """ids (id) with whether a point has it."""
    return ids.join(points.select("id").distinct().withColumn("contained", F.lit(True)), "id", "left").withColumn("contained", F.coalesce("contained", F.lit(False)))


def moved(points: DataFrame, changes: DataFrame) -> DataFrame:
    """Points at new places; changes of unknown ids are left out."""
    return upsert(points, changes.join(points.select("id"), "id", "left_semi"))


def upsert(points: DataFrame, changes: DataFrame) -> DataFrame:
    """Insert, or overwrite rows of the same id."""
    return points.join(changes.select("id"), "id", "left_anti").unionByName(changes)


def remove(points: DataFrame, ids: DataFrame) -> DataFrame:
    return points.join(ids.select("id"), "id", "left_anti")


def page_cover(cameras: DataFrame, ring_extent: float, page_extent: float, ring: int = 0) -> DataFrame:
    """Pages (by origin) that the square around each camera (frame, x, z) touches; the far edge is half-open by a millimetre."""
    half = ring_extent / 2
    rows = _cover(cameras, page_extent, F.col("x") - half, F.col("x") + half - 0.001, F.col("z") - half, F.col("z") + half - 0.001)
    return rows.select("frame", F.lit(ring).alias("ring"), (F.col("cell_x") * page_extent).alias("page_x"), (F.col("cell_z") * page_extent).alias("page_z"))


def residency_diff(required: DataFrame, before: DataFrame, cached: DataFrame, in_flight: DataFrame, keys: list[str]) -> DataFrame:
    """Loads: required, not cached nor in flight. Evicts: required before, no longer. Column action tells them apart."""
    loads = required.dropDuplicates(keys).join(cached, keys, "left_anti").join(in_flight, keys, "left_anti")
    evicts = before.dropDuplicates(keys).join(required, keys, "left_anti")
    return loads.select(*keys, F.lit("load").alias("action")).unionByName(evicts.select(*keys, F.lit("evict").alias("action")))
