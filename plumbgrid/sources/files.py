"""Readers of JSON documents, text files and raster arrays as tables."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..lineage import qualified
from . import png

_BAND = "elevation_m ARRAY<DOUBLE>, slope_deg ARRAY<DOUBLE>, band_width_elevation_m DOUBLE, band_width_slope_deg DOUBLE"
CATALOG = f"biomes ARRAY<STRUCT<name STRING, material_kit STRING, kit_dir STRING, auto_rule STRUCT<{_BAND.replace(' ARRAY', ': ARRAY').replace('m DOUBLE', 'm: DOUBLE').replace('g DOUBLE', 'g: DOUBLE')}>, slots ARRAY<STRUCT<name: STRING>>>>"
MANIFEST = "world_seed BIGINT, region_size_m DOUBLE, edge_blend_m DOUBLE, slots ARRAY<STRUCT<biome: STRING, slot: STRING, variants: ARRAY<STRUCT<id: STRING, source: STRING, weight: DOUBLE>>>>"


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """SRC04, SRC18: one row for each biome, with its rule's bands and its kit under either name."""
    rows = spark.read.schema(CATALOG).json(path, multiLine=True).select(F.posexplode("biomes").alias("place", "b"))
    rule = F.col("b.auto_rule")
    bands = [F.get(rule["elevation_m"], 0).alias("lo_e"), F.get(rule["elevation_m"], 1).alias("hi_e"), F.coalesce(rule["band_width_elevation_m"], F.lit(0.0)).alias("band_e")]
    bands += [F.get(rule["slope_deg"], 0).alias("lo_s"), F.get(rule["slope_deg"], 1).alias("hi_s"), F.coalesce(rule["band_width_slope_deg"], F.lit(0.0)).alias("band_s")]
    return rows.select("place", F.col("b.name").alias("biome"), F.coalesce("b.material_kit", "b.kit_dir").alias("kit"), *bands)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """SRC05, SRC10: one row for each variant, in the manifest's order."""
    rows = spark.read.schema(MANIFEST).json(path, multiLine=True)
    rows = rows.select("world_seed", "region_size_m", "edge_blend_m", F.posexplode("slots").alias("place", "s"))
    return rows.select("world_seed", "region_size_m", "edge_blend_m", "place", "s.biome", "s.slot", F.posexplode("s.variants").alias("n", "v")).select("*", "v.id", "v.source", "v.weight").drop("v")


def keyed_json(spark: SparkSession, path: str, value: str = "MAP<STRING,STRING>", strict: bool = False) -> DataFrame:
    """SRC06, SRC07, SRC09, SRC13: a JSON object as (key, value) rows; strict fails on what doesn't parse, whole."""
    rows = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", f"MAP<STRING,{value}>", {"mode": "FAILFAST" if strict else "PERMISSIVE"})
    return rows.select(F.explode(parsed).alias("key", "value"))


def tier(tiers: DataFrame, name: str | None) -> DataFrame:
    """PRJ14: the row of a tier, or of `high` where there is no such."""
    return tiers.where(F.col("key").isin(name or "high", "high")).orderBy(F.col("key") == "high").limit(1)


def lines(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """SRC15: (file, line, text) of all files under a path; lines count from 1."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("n", "text")).select("file", (F.col("n") + 1).alias("line"), "text")


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """SRC14, FN32, AGG34: (file, size_bytes, modified, sha256)."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return rows.select(F.col("path").alias("file"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def rasters(spark: SparkSession, path: str, pattern: str = "*.np[yz]") -> DataFrame:
    """SRC02: (file, rows, cols, heights) of .npy files, and of the first two-dimensional array of .npz files.

    Read by Spark, so from any store it reads; a file that holds no such array fails the read.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for name, content in zip(pdf.path, pdf.content, strict=True):
                data = np.load(io.BytesIO(content), allow_pickle=False)
                array = data if isinstance(data, np.ndarray) else next((data[k] for k in data.files if data[k].ndim == 2), None)
                if array is None or array.ndim != 2:
                    raise ValueError(f"{name}: no two-dimensional array")
                found.append((name, *array.shape, array.astype(np.float32).ravel().tolist()))
            yield pd.DataFrame(found, columns=["file", "rows", "cols", "heights"])

    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return rows.select("path", "content").mapInPandas(decode, "file string, rows int, cols int, heights array<float>")


def unpacked(packed: DataFrame, keys: list[str]) -> DataFrame:
    """A packed raster table in long form (keys, r, c, h)."""
    rows = packed.select(*keys, "cols", F.posexplode("heights").alias("k", "h"))
    return rows.select(*keys, F.expr("CAST(k div cols AS INT)").alias("r"), (F.col("k") % F.col("cols")).cast("int").alias("c"), F.col("h").cast("double").alias("h"))


def write_artifacts(df: DataFrame, path: str, mode: str = "append") -> None:
    """SNK01, SNK08: artifacts by key, in folders by the key's first two digits."""
    df.withColumn("shard", F.substring("key", 1, 2)).write.partitionBy("shard").mode(mode).parquet(path)


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """SNK04: the rows of `new`, and those of `old` whose keys it lacks."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def catalog_text(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC06, SRC08: documents of one JSON object each, whole or not at all: (file, value), null for files that don't parse or lack a named field.

    A reader that keeps its prior state on failure takes the row only where value is not null.
    """
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("value"))
    names = [f.name for f in rows.schema["value"].dataType.fields]
    whole = F.col("value").isNotNull()
    for name in names:
        whole = whole & F.col(f"value.{name}").isNotNull()
    return rows.select("file", F.when(whole, F.col("value")).alias("value"))


MACRO = "world_min_xz ARRAY<DOUBLE>, world_max_xz ARRAY<DOUBLE>, texture STRING"
SLOTS = "slots ARRAY<STRUCT<name: STRING, siblings: ARRAY<STRING>>>"


def macro_albedo(spark: SparkSession, path: str) -> DataFrame:
    """SRC08: (file, x0, z0, x1, z1, texture) of configurations that have all three fields."""
    rows = catalog_text(spark, path, MACRO).where("value IS NOT NULL")
    at = lambda name, k: F.get(F.col(f"value.{name}"), k)
    return rows.select("file", at("world_min_xz", 0).alias("x0"), at("world_min_xz", 1).alias("z0"), at("world_max_xz", 0).alias("x1"), at("world_max_xz", 1).alias("z1"), "value.texture")


def slot_index(spark: SparkSession, path: str, before: DataFrame | None = None) -> DataFrame:
    """SRC06: (file, place, name, siblings); files that don't parse keep their rows of `before`, if there are any."""
    rows = catalog_text(spark, path, SLOTS)
    new = rows.where("value IS NOT NULL").select("file", F.posexplode("value.slots").alias("place", "s")).select("file", "place", "s.name", "s.siblings")
    if before is None:
        return new
    return new.unionByName(before.join(rows.where("value IS NULL").select("file"), "file", "left_semi"))


def candidate_index(spark: SparkSession, path: str) -> DataFrame:
    """SRC13: (file, biome, slot, id, entry) of candidate indexes; files that don't parse give none."""
    schema = "biome STRING, slot STRING, candidates MAP<STRING, STRUCT<prompt: STRING, size: INT, grade: STRING, failed_checks: ARRAY<STRING>, status: STRING, generated_at: STRING>>"
    rows = hidden_text(spark, path).select("file", F.from_json("value", schema).alias("value")).where("value.candidates IS NOT NULL")
    return rows.select("file", "value.biome", "value.slot", F.explode("value.candidates").alias("id", "entry"))


def hidden_text(spark: SparkSession, path: str) -> DataFrame:
    """(file, value) of files whose names Spark's readers skip, as they begin with an underscore: listed by the driver, read in tasks."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    names = [(qualified(spark, f.getPath().toString()),) for f in found or []]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in batches:
            out = []
            for name in pdf.file:
                store, at = fs.FileSystem.from_uri(name)
                with store.open_input_file(at) as f:
                    out.append((name, f.read().decode("utf-8", "replace")))
            yield pd.DataFrame(out, columns=["file", "value"])

    listed = spark.createDataFrame(names, "file string")
    return listed.repartition(max(1, min(len(names), 200))).mapInPandas(run, "file string, value string")


def version(spark: SparkSession, path: str) -> DataFrame:
    """SRC16: (file, version): the value of the first `version="..."` line, 0.0.0 without one."""
    rows = spark.read.text(path, wholetext=True)
    found = F.regexp_extract("value", r'(?m)^\s*version\s*=\s*"([^"]+)"', 1)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.when(found == "", "0.0.0").otherwise(found).alias("version"))


def prompt_matrix(spark: SparkSession, path: str) -> DataFrame:
    """SRC12: (file, path, value) of YAML documents made of nested maps, lists and scalars: the leaves, by their path (keys and places, with dots).

    A plain subset: block maps and lists by indentation, quoted and bare scalars, comments. Files are small.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(f, p, v) for f, text in zip(pdf.file, pdf.value, strict=True) for p, v in yaml_leaves(text)], columns=["file", "path", "value"])

    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return rows.mapInPandas(run, "file string, path string, value string")


def yaml_leaves(text: str) -> Iterator[tuple[str, str]]:
    open_: list[list] = []  # [indent, name or None for a list, place]
    for line in text.split("\n"):
        body = line.split(" #")[0].rstrip()
        if not body.strip() or body.lstrip().startswith("#") or body.strip() == "---":
            continue
        indent, rest = len(body) - len(body.lstrip()), body.lstrip()
        while rest:
            item = rest.startswith("- ") or rest == "-"
            while open_ and (open_[-1][0] > indent or open_[-1][0] == indent and not (item and open_[-1][1] is not None)):
                if item and open_[-1][0] == indent:
                    break
                open_.pop()
            if item:
                if not open_ or open_[-1][1] is not None or open_[-1][0] != indent:
                    open_.append([indent, None, -1])
                open_[-1][2] += 1
                indent, rest = indent + 2, rest[2:].lstrip()
                if not rest:
                    break
                continue
            key, mark, value = rest.partition(":") if not rest.startswith(("'", '"')) else ("", "", "")
            if mark and (not value or value[0] == " "):
                open_.append([indent, key.strip(), 0])
                rest = value.strip()
                if not rest:
                    break
            yield ".".join(str(n if n is not None else at) for _, n, at in open_), rest.strip("'\"")
            break


def dem_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """SRC03: (id, x0, z0, x1, z1, lo, hi, rows, cols, heights) of folders with <id>.json and <id>.png (16 or 8 bits).

    Sidecars with other than four bounds, without extent, or with a range that does not rise, are left out, as are
    those whose raster does not read. A feature's raster, <id>_<mode>.png, has `mode` (null for heights) and its own
    range; those of another shape than the heights are left out.
    """
    schema = "id STRING, crs STRING, source_resolution_m DOUBLE, bounds_world_xz ARRAY<DOUBLE>, elevation_range_m ARRAY<DOUBLE>, features STRUCT<ranges: MAP<STRING, ARRAY<DOUBLE>>>"
    side = spark.read.schema(schema).option("pathGlobFilter", "*.json").json(folder, multiLine=True)
    b, e = F.col("bounds_world_xz"), F.col("elevation_range_m")
    side = side.where((F.size(b) == 4) & (F.size(e) == 2)).where((b[2] > b[0]) & (b[3] > b[1]) & (e[1] > e[0]))
    heights = side.select("id", F.lit(None).cast("string").alias("mode"), b, e[0].alias("lo"), e[1].alias("hi"))
    ranged = side.select("id", b, F.explode("features.ranges").alias("mode", "range")).where("size(range) = 2")
    wanted = heights.unionByName(ranged.select("id", "mode", b, F.get("range", 0).alias("lo"), F.get("range", 1).alias("hi")))
    wanted = wanted.withColumn("file", F.concat_ws("_", "id", "mode"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for file, content in zip(pdf.file, pdf.content, strict=True):
                try:
                    a = png.decode(content)
                except (ValueError, zlib.error, struct.error, TypeError):
                    continue
                a = a if a.ndim == 2 else a[..., 0]
                found.append((file, *a.shape, (a / (65535 if a.dtype == np.uint16 else 255)).ravel().tolist()))
            yield pd.DataFrame(found, columns=["file", "rows", "cols", "values"])

    images = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(folder)
    images = images.select(F.regexp_extract("path", r"([^/]+)\.png$", 1).alias("file"), "content").mapInPandas(run, "file string, rows int, cols int, values array<double>")
    rows = wanted.join(images, "file")
    own = rows.where("mode IS NULL").select("id", F.col("rows").alias("r"), F.col("cols").alias("c"))
    rows = rows.join(own, "id").where((F.col("rows") == F.col("r")) & (F.col("cols") == F.col("c")))
    return rows.select("id", "mode", b[0].alias("x0"), b[1].alias("z0"), b[2].alias("x1"), b[3].alias("z1"), "lo", "hi", "rows", "cols", F.transform("values", lambda v: F.col("lo") + v * (F.col("hi") - F.col("lo"))).alias("heights"))


def quantized(rasters: DataFrame) -> DataFrame:
    """SNK03: (id, mode, lo, hi, png) of packed rasters (id, mode, rows, cols, heights): 16-bit files, rounded down over the raster's own range."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                h = np.asarray(row.heights, np.float64).reshape(row.rows, row.cols)
                lo, hi = float(h.min()), float(h.max())
                out.append((row.id, row.mode, lo, hi, png.encode((np.clip((h - lo) / max(hi - lo, 1e-6), 0, 1) * 65535).astype(np.uint16))))
            yield pd.DataFrame(out, columns=["id", "mode", "lo", "hi", "png"])

    return rasters.select("id", "mode", "rows", "cols", "heights").mapInPandas(run, "id string, mode string, lo double, hi double, png binary")


def page_bytes(heights) -> Column:
    """SNK02: an array of heights as little-endian 32-bit floats."""

    @pandas_udf("binary")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda a: None if a is None else np.asarray(a, "<f4").tobytes())

    return run(heights)


def bytes_page(data) -> Column:
    """SNK02: the heights of such bytes."""

    @pandas_udf("array<float>")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))

    return run(data)


def write_report(df: DataFrame, path: str) -> None:
    """SNK05: rejects, rankings or manifests as JSON lines."""
    df.write.mode("overwrite").json(path)


def hashed(spark: SparkSession, path: str, memo: DataFrame | None = None, pattern: str = "*") -> DataFrame:
    """FN32: (file, modified, size_bytes, sha256); files that the memo knows by path, time and size are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    names = listed.select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"), F.col("length").alias("size_bytes"))
    if memo is None:
        return files(spark, path, pattern).select("file", "modified", "size_bytes", "sha256")
    key = ["file", "modified", "size_bytes"]
    known = names.join(memo.select(*key, "sha256"), key)
    new = [r.file for r in names.join(memo.select(*key), key, "left_anti").select("file").collect()]  # a row a changed file
    if not new:
        return known.select(*key, "sha256")
    read = spark.read.format("binaryFile").load(new).select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
    return known.select(*key, "sha256").unionByName(read)
