"""Material slots, their variants and candidates as tables: layer windows, catalogs, references, promotion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import running

#: Bands of a slot that the catalog does not name, and the most variants of a slot.
WIDE = {"lo_e": -10000.0, "hi_e": 10000.0, "band_e": 1.0, "lo_s": 0.0, "hi_s": 90.0, "band_s": 1.0}
CAP = 8


def layer_windows(variants: DataFrame, slot: list[str], order: str) -> DataFrame:
    """(slot, n, first): how many layers each slot has and how many stand before it, slots in the order of their least `order`."""
    counts = variants.groupBy(*slot).agg(F.count("*").alias("n"), F.min(order).alias("__at"))
    return running(counts, [F.col("__at"), *map(F.col, slot)], F.col("n"), "first").drop("__at")


def windows_match(left: DataFrame, right: DataFrame, slot: list[str]) -> DataFrame:
    """One row, `matches`: whether two lists of windows (slot, first, n) are equal."""
    a, b = (df.select(*slot, "first", "n", F.lit(side).alias("__s")) for df, side in ((left, 1), (right, -1)))
    uneven = a.unionByName(b).groupBy(*slot, "first", "n").agg(F.sum("__s").alias("d")).where("d <> 0")
    return uneven.agg((F.count("*") == 0).alias("matches"))


def slot_bands(slots: DataFrame, catalog: DataFrame, windows: DataFrame | None = None, keys: tuple[str, ...] = ("biome", "slot")) -> DataFrame:
    """Slots with the bands that the catalog gives them, or wide ones; slots whose window is empty go, if windows (keys, n) are given.

    Of several entries under one name the first by `place` counts.
    """
    if windows is not None:
        slots = slots.join(windows.where("n > 0").select(*keys), list(keys), "left_semi")
    first = catalog.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("place"))).where("__n = 1").select(*keys, *WIDE)
    rows = slots.join(first, list(keys), "left")
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in WIDE.items()})


def variant_layers(slots: DataFrame) -> DataFrame:
    """(layers): the variants of all slots, an array each; null arrays hold none."""
    return slots.agg(F.coalesce(F.sum(F.coalesce(F.size("variants"), F.lit(0))), F.lit(0)).alias("layers"))


def tile_layers(tiles: DataFrame, loaded: DataFrame) -> DataFrame:
    """(biome, tile, layer): tiles (biome, place, tile) whose image was loaded, numbered from 0 in their biome's order; a biome's tiles are a list of bounded length."""
    found = tiles.join(loaded.select("biome", "tile"), ["biome", "tile"], "left_semi")
    return found.select("biome", "tile", (F.row_number().over(Window.partitionBy("biome").orderBy("place")) - 1).alias("layer"))


def place_of(names, name):
    """The place of a name in an array, from 0; -1 if it has none."""
    return F.coalesce(F.array_position(names, name), F.lit(0)).cast("int") - 1


def name_at(names, place):
    """The name at a place from 0; empty outside."""
    return F.coalesce(F.when(place >= 0, F.get(names, place)), F.lit(""))


def key_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side): keys that only one of two tables has."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("right")))


def missing_references(refs: DataFrame, known: DataFrame, ref: str, key: str) -> DataFrame:
    """Rows whose reference names nothing known."""
    return refs.join(known.select(F.col(key).alias(ref)).distinct(), ref, "left_anti")


def source_states(variants: DataFrame, files: DataFrame, maps: tuple[str, ...] = ("albedo", "normal", "roughness", "ao")) -> DataFrame:
    """Variants (folder, ...) with `state` by the files (folder, name) of their folder: ready with an albedo, broken with other maps only, else absent."""
    held = files.where(F.col("name").isin(*maps)).groupBy("folder").agg(F.max(F.col("name") == "albedo").alias("__albedo"))
    state = F.when(F.col("__albedo"), "ready").when(~F.col("__albedo"), "broken").otherwise("absent")
    return variants.join(held, "folder", "left").withColumn("state", state).drop("__albedo")


# candidates


def grade_histogram(candidates: DataFrame, slot: str) -> DataFrame:
    return candidates.groupBy(slot, F.coalesce("grade", F.lit("-")).alias("grade")).agg(F.count("*").alias("n"))


def review_counts(candidates: DataFrame, slot: str) -> DataFrame:
    """(slot, total, best, flagged): candidates, those of grade A, and all others."""
    best = F.count_if(F.col("grade") == "A")
    return candidates.groupBy(slot).agg(F.count("*").alias("total"), best.alias("best"), (F.count("*") - best).alias("flagged"))


def candidate_status(failed, grade):
    """Grade A makes a candidate, any other a rejected one; a failed run is neither."""
    return F.when(failed, "failed").when(grade == "A", "candidate").otherwise("rejected_auto")


def graded(candidates: DataFrame, grades: list[str] | None, files: DataFrame | None = None) -> DataFrame:
    """Candidates (folder, grade, ...) of some grades whose image is among the files (folder)."""
    rows = candidates if grades is None else candidates.where(F.col("grade").isin(*grades))
    return rows if files is None else rows.join(files.select("folder").distinct(), "folder", "left_semi")


def promotion_errors(promotions: DataFrame, candidates: DataFrame, cap: int = CAP) -> DataFrame:
    """(slot, code, tag): promotions (slot, base, siblings) with more variants than the cap (`over_cap`, tag null) or that name candidates (slot, tag) which don't exist (`missing`)."""
    over = promotions.where(F.size("siblings") + 1 > cap).select("slot", F.lit("over_cap").alias("code"), F.lit(None).cast("string").alias("tag"))
    tags = promotions.select("slot", F.explode(F.concat(F.array("base"), F.coalesce("siblings", F.array().cast("array<string>")))).alias("tag"))
    gone = tags.join(candidates.select("slot", "tag").distinct(), ["slot", "tag"], "left_anti")
    return over.unionByName(gone.select("slot", F.lit("missing").alias("code"), "tag"))


def promoted(manifest: DataFrame, promotions: DataFrame, candidates: DataFrame, cap: int = CAP) -> DataFrame:
    """The manifest (slot, place, id, source, weight) with the promoted slots replaced whole; ValueError before anything is written if a promotion is wrong.

    A promoted slot has its base first, under `default`, then its siblings as v0_tag, v1_tag, and so on, all of weight 1.
    """
    if wrong := promotion_errors(promotions, candidates, cap).limit(20).collect():
        raise ValueError(f"promotions refused: {[tuple(r) for r in wrong]}")
    tags = F.concat(F.array(F.lit(None).cast("string")), F.coalesce("siblings", F.array().cast("array<string>")))
    rows = promotions.select("slot", F.posexplode(tags).alias("place", "tag"))
    name = F.concat(F.lit("v"), (F.col("place") - 1).cast("string"), F.lit("_"), F.col("tag"))
    new = rows.select(
        "slot", "place",
        F.when(F.col("place") == 0, "default").otherwise(name).alias("id"),
        F.when(F.col("place") == 0, F.col("slot")).otherwise(F.concat("slot", F.lit("_variants/"), name)).alias("source"),
        F.lit(1.0).alias("weight"),
    )
    old = manifest.join(promotions.select("slot").distinct(), "slot", "left_anti").select("slot", "place", "id", "source", "weight")
    return old.unionByName(new)
