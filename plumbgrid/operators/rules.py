"""Rule sets over configurations, catalogs, manifests, files and source lines: what breaks a rule becomes a row.

Settings that are null have their defaults. Every set returns (key columns, severity, code), and more where it says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .raster import EROSION, MODES
from .store import issues

Rules = list[tuple[str, str, Column]]
#: Defaults of a noise stage and of a feature stage.
NOISE = {"octaves": 6, "frequency": 1 / 512, "lacunarity": 2.0, "gain": 0.5, "amplitude": 50.0}
FEATURE = {"source": "", "mode": "ridge_emphasis", "strength": 0.7, "ridge_smooth_sigma_cells": 2.0}
GENERATOR, POST = "noise_stack", ("erosion", "dem_feature")
SLOTS, VARIANTS, LAYERS = 8, 8, 256


def _outside(c: Column, lo: float, hi: float) -> Column:
    return (c < lo) | (c > hi)


def noise_rules(get) -> Rules:
    """VAL02. `get` gives a setting's column, its default filled in."""
    return [
        ("error", "octaves_low", get("octaves") <= 0), ("error", "octaves_high", get("octaves") > 16), ("error", "frequency", get("frequency") <= 0),
        ("error", "lacunarity", get("lacunarity") <= 1), ("error", "gain", (get("gain") <= 0) | (get("gain") >= 1)), ("error", "amplitude", get("amplitude") < 0),
    ]


def erosion_rules(get) -> Rules:
    """VAL03."""
    return [
        ("error", "iterations_low", get("iterations") < 1), ("error", "iterations_high", get("iterations") > 1000), ("error", "rain_rate", get("rain_rate") <= 0),
        ("error", "evaporation", _outside(get("evaporation"), 0, 1)), ("error", "sediment_capacity", get("sediment_capacity") <= 0),
        ("error", "dissolve_rate", _outside(get("dissolve_rate"), 0, 1)), ("error", "deposit_rate", _outside(get("deposit_rate"), 0, 1)),
        ("error", "min_slope", get("min_slope") < 0), ("error", "gravity", get("gravity") <= 0), ("error", "thermal_iterations", get("thermal_iterations") < 0),
        ("error", "talus_angle_deg", _outside(get("talus_angle_deg"), 0, 89)), ("error", "talus_rate", _outside(get("talus_rate"), 0, 1)),
    ]


def feature_rules(get) -> Rules:
    """VAL04."""
    return [
        ("error", "source", get("source") == ""), ("error", "mode", ~get("mode").isin(*MODES)), ("error", "strength", _outside(get("strength"), 0, 1)),
        ("error", "ridge_smooth_sigma_cells", get("ridge_smooth_sigma_cells") <= 0),
    ]


_KINDS = {"noise_stack": (noise_rules, NOISE), "erosion": (erosion_rules, EROSION), "dem_feature": (feature_rules, FEATURE)}


def config_issues(configs: DataFrame, kind: str, key: str) -> DataFrame:
    """VAL02 to VAL04 of configurations with a column for each setting; settings without a column have their default."""
    rules, defaults = _KINDS[kind]
    return issues(configs, rules(lambda name: F.coalesce(F.col(name), F.lit(defaults[name])) if name in configs.columns else F.lit(defaults[name])), key)


def chain_issues(chains: DataFrame, key: str) -> DataFrame:
    """VAL05: (key, stage, severity, code) of chains (key, stages: array<struct<type, params: map<string,string>>>).

    A chain without stages, a first stage that is no generator, a generator behind it, unknown types (each at its
    stage; -1 for the chain), and the bounds of every stage's settings; a setting that is no number has its default.
    """
    empty = chains.where(F.coalesce(F.size("stages"), F.lit(0)) <= 0).select(key, F.lit(-1).alias("stage"), F.lit("error").alias("severity"), F.lit("empty_chain").alias("code"))
    rows = chains.select(key, F.posexplode("stages").alias("stage", "s")).select(key, "stage", F.coalesce("s.type", F.lit("")).alias("type"), "s.params")
    order = issues(
        rows.withColumn("__k", F.struct(key, "stage")),
        [
            ("error", "first_is_no_generator", (F.col("stage") == 0) & (F.col("type") != GENERATOR)),
            ("error", "second_generator", (F.col("stage") > 0) & (F.col("type") == GENERATOR)),
            ("error", "unknown_type", (F.col("stage") > 0) & ~F.col("type").isin(GENERATOR, *POST)),
        ],
        "__k",
    )
    out = empty.unionByName(order.select(F.col(f"__k.{key}").alias(key), "__k.stage", "severity", "code"))
    for kind, (rules, defaults) in _KINDS.items():

        def get(name, defaults=defaults):
            found = F.try_element_at("params", F.lit(name))
            return F.coalesce(found if isinstance(defaults[name], str) else found.try_cast("double"), F.lit(defaults[name]))

        own = issues(rows.where(F.col("type") == kind).withColumn("__k", F.struct(key, "stage")), rules(get), "__k")
        out = out.unionByName(own.select(F.col(f"__k.{key}").alias(key), "__k.stage", "severity", "code"))
    return out


def catalog_issues(catalogs: DataFrame, key: str) -> DataFrame:
    """VAL06 of catalogs (key, biomes: array<struct<name, slots: array<...>>>): (key, place, severity, code), place -1 for the whole."""
    none = catalogs.where(F.coalesce(F.size("biomes"), F.lit(0)) <= 0).select(key, F.lit(-1).alias("place"), F.lit("error").alias("severity"), F.lit("no_biomes").alias("code"))
    rows = catalogs.select(key, F.posexplode("biomes").alias("place", "b")).withColumn("__k", F.struct(key, "place"))
    found = issues(rows, [("error", "name", F.coalesce(F.col("b.name"), F.lit("")) == ""), ("error", "slots", F.coalesce(F.size("b.slots"), F.lit(0)) > SLOTS)], "__k")
    return none.unionByName(found.select(F.col(f"__k.{key}").alias(key), "__k.place", "severity", "code"))


def manifest_issues(manifests: DataFrame, key: str) -> DataFrame:
    """VAL07 of manifests (key, region_size_m, edge_blend_m, max_variants, max_layers, slots: array<struct<biome, slot, variants: array<...>>>): (key, place, severity, code)."""
    region, edge = F.coalesce("region_size_m", F.lit(0.0)), F.coalesce("edge_blend_m", F.lit(0.0))
    most = F.coalesce("max_variants", F.lit(VARIANTS))
    sizes = F.transform(F.coalesce("slots", F.array().cast(manifests.schema["slots"].dataType)), lambda s: F.greatest(F.coalesce(F.size(s["variants"]), F.lit(0)), F.lit(0)))
    layers = F.aggregate(sizes, F.lit(0), lambda a, n: a + n)
    whole = issues(
        manifests,
        [
            ("error", "region_size", region <= 0), ("error", "edge_blend", (region > 0) & (edge >= region / 4)), ("error", "variant_cap", most > VARIANTS),
            ("error", "total_layers", layers > F.coalesce("max_layers", F.lit(LAYERS))),
        ],
        key,
    )
    rows = manifests.select(key, most.alias("__most"), F.posexplode(sizes).alias("place", "n"))
    over = rows.where(F.col("n") > F.col("__most")).select(key, "place", F.lit("error").alias("severity"), F.lit("slot_variants").alias("code"))
    return whole.withColumn("place", F.lit(-1)).select(key, "place", "severity", "code").unionByName(over)


def slot_mask_issues(masks: DataFrame, key: str) -> DataFrame:
    """VAL08 of masks (key, slots: array<struct<name, siblings: array<string>>>): (key, name, severity, code)."""
    none = masks.where(F.coalesce(F.size("slots"), F.lit(0)) <= 0).select(key, F.lit(None).cast("string").alias("name"), F.lit("error").alias("severity"), F.lit("no_slots").alias("code"))
    rows = masks.select(key, F.explode("slots").alias("s")).where(F.coalesce(F.size("s.siblings"), F.lit(0)) <= 0)
    return none.unionByName(rows.select(key, "s.name", F.lit("error").alias("severity"), F.lit("no_siblings").alias("code")))


def detail_issues(arrays: DataFrame, key: str, files: DataFrame | None = None) -> DataFrame:
    """VAL09 of detail arrays (key, tiles: array<string>, blends: map<string,map<string,string>>): (key, slot, tile, severity, code).

    Weights of tiles that are not declared, weights that are no numbers, weights outside of 0 to 1; with `files`
    (key, name), declared tiles without `<tile>_albedo`: a warning if the key has no files at all, else an error.
    """
    weights = arrays.select(key, "tiles", F.explode("blends").alias("slot", "w")).select(key, "tiles", "slot", F.explode("w").alias("tile", "weight"))
    number = F.col("weight").try_cast("double")
    rows = weights.withColumn("__k", F.struct(key, "slot", "tile"))
    found = issues(rows, [("error", "unknown_tile", ~F.array_contains("tiles", F.col("tile"))), ("error", "weight_no_number", number.isNull()), ("error", "weight_range", _outside(number, 0, 1))], "__k")
    out = found.select(F.col(f"__k.{key}").alias(key), "__k.slot", "__k.tile", "severity", "code")
    if files is None:
        return out
    have = files.select(key).distinct().withColumn("__any", F.lit(True))
    tiles = arrays.select(key, F.explode("tiles").alias("tile")).withColumn("name", F.concat("tile", F.lit("_albedo"))).join(files.select(key, "name"), [key, "name"], "left_anti")
    tiles = tiles.join(have, key, "left").withColumn("severity", F.when(F.col("__any"), "error").otherwise("warning"))
    return out.unionByName(tiles.select(key, F.lit(None).cast("string").alias("slot"), "tile", "severity", F.when(F.col("__any"), "tile_missing").otherwise("not_promoted").alias("code")))


def macro_issues(worlds: DataFrame, key: str, files: DataFrame) -> DataFrame:
    """VAL10 of worlds (key, has_config, texture: resolved path or empty): a warning without a configuration, an error where its texture is not among the files (path)."""
    rows = worlds.join(files.select(F.col("path").alias("texture"), F.lit(True).alias("__there")).distinct(), "texture", "left")
    named = F.coalesce("texture", F.lit("")) != ""
    return issues(rows, [("warning", "config_missing", ~F.col("has_config")), ("error", "texture_missing", F.col("has_config") & named & F.col("__there").isNull())], key)


def allowlist_issues(entries: DataFrame, dirs: list[str], names: list[str], key: str = "path") -> DataFrame:
    """VAL11 of a folder's entries (path, name, is_dir): folders that are not allowed are errors, files warnings; names that begin with a dot are left out."""
    seen = entries.where(~F.col("name").startswith("."))
    return issues(seen, [("error", "dir_not_allowed", F.col("is_dir") & ~F.col("name").isin(*dirs)), ("warning", "file_not_allowed", ~F.col("is_dir") & ~F.col("name").isin(*names))], key)


def size_issues(files: DataFrame, folder: str, each_mb: float = 20.0, all_mb: float = 100.0) -> DataFrame:
    """VAL11 of files (folder, size_bytes): folders over a size, and all together (null folder), are errors."""
    per = files.groupBy(folder).agg((F.sum("size_bytes") / 1048576).alias("mb"))
    own = per.where(F.col("mb") > each_mb).select(folder, F.lit("error").alias("severity"), F.lit("folder_size").alias("code"))
    whole = per.agg(F.sum("mb").alias("mb")).where(F.col("mb") > all_mb)
    return own.unionByName(whole.select(F.lit(None).cast(files.schema[folder].dataType).alias(folder), F.lit("error").alias("severity"), F.lit("total_size").alias("code")))


#: Folders of documents with the most lines a file may have, and how grave more is.
LINE_CAPS = [("docs/", 200, "warning", "top_level"), ("docs/state/", 300, "warning", "state"), ("docs/roadmap/", 350, "warning", "roadmap"), ("docs/reference/pitfalls/", 300, "warning", "pitfalls"), ("docs/specs/", 600, "info", "spec")]


def line_issues(files: DataFrame, caps: list[tuple[str, int, str, str]] = LINE_CAPS) -> DataFrame:
    """VAL12 of files (path, lines): those directly in a folder with more lines than its cap."""
    folder = F.regexp_extract("path", "^(.*/)", 1)
    return issues(files, [(severity, code, (folder == place) & F.col("path").endswith(".md") & (F.col("lines") > most)) for place, most, severity, code in caps], "path")


#: Calls that go around the log, in the order in which one is reported; where they may; what allows one.
CALLS = ("print", "push_warning", "push_error", "print_rich", "printt", "prints")
EXEMPT_FILES, EXEMPT_DIRS, ALLOWED = ("Log.gd",), ("addons", "tests", "examples"), "# LINT_OK"


def log_lint(lines: DataFrame, calls: tuple[str, ...] = CALLS) -> DataFrame:
    """FN42, VAL13 of source lines (file, line, text): (file, line, call), the first forbidden call of a line; comments and exempt files are left out."""
    parts = F.split("file", "/")
    seen = lines.where(~F.element_at(parts, -1).isin(*EXEMPT_FILES) & ~F.arrays_overlap(parts, F.array(*map(F.lit, EXEMPT_DIRS))) & ~F.col("text").contains(ALLOWED))
    code = F.split_part("text", F.lit("#"), F.lit(1))
    call = F.coalesce(*[F.when(code.rlike(rf"\b{name}\("), F.lit(name)) for name in calls])
    return seen.select("file", "line", call.alias("call")).where("call IS NOT NULL")
