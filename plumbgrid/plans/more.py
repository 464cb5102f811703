"""Queries of rule sets, manifests, jobs, streams in batch form and images, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..operators import images, jobs, materials, raster, rules, spatial, store, weights
from ..session import table
from ..sources import files
from .queries import query
from .relations import relation


def _sql(spark, sf_dir, name, text):
    return spark.sql(text, **{name: table(spark, sf_dir, name)})


def _union(configs: str, conditions: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT id, '{severity}' AS severity, '{code}' AS code FROM ({configs}) c WHERE {cond}" for code, (severity, cond) in conditions.items())


def _errors(conditions: dict[str, str]) -> dict[str, tuple[str, str]]:
    return {k: ("error", v) for k, v in conditions.items()}


# rule sets

_EROSION = "SELECT p_partkey AS id, CAST(p_size * 40 - 40 AS INT) AS iterations, p_size % 3 / 100e0 AS rain_rate, p_size % 5 / 3e0 AS evaporation, p_size % 6 - 1e0 AS sediment_capacity, p_size % 4 / 2e0 AS dissolve_rate, p_size % 7 / 5e0 AS deposit_rate, p_size % 9 - 1e0 AS min_slope, p_size % 8 * 2e0 AS gravity, CAST(p_size % 10 - 1 AS INT) AS thermal_iterations, p_size * 2e0 - 3e0 AS talus_angle_deg, p_size % 11 / 9e0 AS talus_rate FROM {part}"


@query(_union(_EROSION, _errors({
    "iterations_low": "iterations < 1", "iterations_high": "iterations > 1000", "rain_rate": "rain_rate <= 0", "evaporation": "evaporation < 0 OR evaporation > 1", "sediment_capacity": "sediment_capacity <= 0",
    "dissolve_rate": "dissolve_rate < 0 OR dissolve_rate > 1", "deposit_rate": "deposit_rate < 0 OR deposit_rate > 1", "min_slope": "min_slope < 0", "gravity": "gravity <= 0", "thermal_iterations": "thermal_iterations < 0",
    "talus_angle_deg": "talus_angle_deg < 0 OR talus_angle_deg > 89", "talus_rate": "talus_rate < 0 OR talus_rate > 1",
})))
def erosion_issues(spark, sf_dir):
    """VAL03."""
    return rules.config_issues(_sql(spark, sf_dir, "part", _EROSION), "erosion", "id")


_FEATURE = "SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN '' ELSE 'dome' END AS source, CASE p_size % 3 WHEN 0 THEN 'slope_deg' WHEN 1 THEN 'fog' END AS mode, p_size % 7 / 5e0 AS strength, p_size % 5 - 1e0 AS ridge_smooth_sigma_cells FROM {part}"


@query(_union(_FEATURE, _errors({"source": "source = ''", "mode": "mode = 'fog'", "strength": "strength < 0 OR strength > 1", "ridge_smooth_sigma_cells": "ridge_smooth_sigma_cells <= 0"})))
def feature_issues(spark, sf_dir):
    """VAL04: a null mode is the default one."""
    return rules.config_issues(_sql(spark, sf_dir, "part", _FEATURE), "dem_feature", "id")


@query("WITH c AS (SELECT p_partkey AS id, p_size % 6 AS k, p_size FROM {part}), s AS (SELECT id, 0 AS stage, CASE WHEN k = 1 THEN 'erosion' ELSE 'noise_stack' END AS type, p_size FROM c WHERE k > 0 UNION ALL SELECT id, 1, CASE k WHEN 2 THEN 'noise_stack' WHEN 3 THEN 'fog' ELSE 'erosion' END, p_size FROM c WHERE k > 1) "
       "SELECT id, -1 AS stage, 'error' AS severity, 'empty_chain' AS code FROM c WHERE k = 0 UNION ALL SELECT id, stage, 'error', 'first_is_no_generator' FROM s WHERE stage = 0 AND type <> 'noise_stack' UNION ALL SELECT id, stage, 'error', 'second_generator' FROM s WHERE stage > 0 AND type = 'noise_stack' UNION ALL SELECT id, stage, 'error', 'unknown_type' FROM s WHERE type = 'fog' "
       "UNION ALL SELECT id, stage, 'error', 'octaves_high' FROM s WHERE type = 'noise_stack' AND p_size > 16 UNION ALL SELECT id, stage, 'error', 'iterations_high' FROM s WHERE type = 'erosion' AND p_size * 30 > 1000")  # fmt: skip
def chain_issues(spark, sf_dir):
    """VAL05: order, types and bounds of the stages of chains."""
    size = F.col("p_size")
    k = size % 6
    kind = lambda name: F.struct(name.alias("type"), F.create_map(F.lit("octaves"), size.cast("string"), F.lit("iterations"), (size * 30).cast("string")).alias("params"))
    first = kind(F.when(k == 1, "erosion").otherwise("noise_stack"))
    second = kind(F.when(k == 2, "noise_stack").when(k == 3, "fog").otherwise("erosion"))
    stages = F.when(k > 1, F.array(first, second)).when(k == 1, F.array(first)).otherwise(F.array().cast("array<struct<type:string,params:map<string,string>>>"))
    return rules.chain_issues(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), stages.alias("stages")), "id")


@query("SELECT p_partkey AS id, -1 AS place, 'error' AS severity, 'no_biomes' AS code FROM {part} WHERE p_size % 5 = 0 UNION ALL SELECT p_partkey, 0, 'error', 'name' FROM {part} WHERE p_size % 5 > 0 AND p_size % 3 = 0 UNION ALL SELECT p_partkey, 0, 'error', 'slots' FROM {part} WHERE p_size % 5 > 0 AND p_size % 12 > 8 UNION ALL SELECT p_partkey, 1, 'error', 'name' FROM {part} WHERE p_size % 5 > 0")
def catalog_issues(spark, sf_dir):
    """VAL06."""
    size = F.col("p_size")
    biome = lambda name, n: F.struct(name.alias("name"), F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: i.cast("string")).alias("slots"))
    both = F.array(biome(F.when(size % 3 > 0, "alpine").otherwise(""), size % 12), biome(F.lit(None).cast("string"), F.lit(1)))
    return rules.catalog_issues(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(size % 5 > 0, both).alias("biomes")), "id")


@query("WITH m AS (SELECT p_partkey AS id, p_size % 4 * 100e0 AS region, p_size % 6 * 20e0 AS edge, CAST(p_size % 11 AS INT) AS most, CAST(p_size % 13 AS INT) AS a, CAST(p_size % 17 AS INT) AS b FROM {part}) SELECT id, -1 AS place, 'error' AS severity, 'region_size' AS code FROM m WHERE region <= 0 UNION ALL SELECT id, -1, 'error', 'edge_blend' FROM m WHERE region > 0 AND edge >= region / 4 UNION ALL SELECT id, -1, 'error', 'variant_cap' FROM m WHERE most > 8 UNION ALL SELECT id, -1, 'error', 'total_layers' FROM m WHERE a + b > 20 UNION ALL SELECT id, 0, 'error', 'slot_variants' FROM m WHERE a > most UNION ALL SELECT id, 1, 'error', 'slot_variants' FROM m WHERE b > most")
def manifest_issues(spark, sf_dir):
    """VAL07, AGG13's cap."""
    size = F.col("p_size")
    slot = lambda n: F.struct(F.lit("b").alias("biome"), F.lit("s").alias("slot"), F.array_repeat(F.lit("v"), (size % n).cast("int")).alias("variants"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (size % 4 * 100.0).alias("region_size_m"), (size % 6 * 20.0).alias("edge_blend_m"), (size % 11).cast("int").alias("max_variants"), F.lit(20).alias("max_layers"), F.array(slot(13), slot(17)).alias("slots"))
    return rules.manifest_issues(rows, "id")


@query("SELECT p_partkey AS id, CAST(NULL AS VARCHAR) AS name, 'error' AS severity, 'no_slots' AS code FROM {part} WHERE p_size % 7 = 0 UNION ALL SELECT p_partkey, 'rock', 'error', 'no_siblings' FROM {part} WHERE p_size % 7 > 0 AND p_size % 2 = 0 UNION ALL SELECT p_partkey, 'sand', 'error', 'no_siblings' FROM {part} WHERE p_size % 7 > 0")
def slot_mask_issues(spark, sf_dir):
    """VAL08."""
    size, none = F.col("p_size"), F.array().cast("array<string>")
    slots = F.array(F.struct(F.lit("rock").alias("name"), F.when(size % 2 == 1, F.array(F.lit("a"))).otherwise(none).alias("siblings")), F.struct(F.lit("sand").alias("name"), F.lit(None).cast("array<string>").alias("siblings")))
    return rules.slot_mask_issues(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(size % 7 > 0, slots).alias("slots")), "id")


@query("WITH d AS (SELECT p_partkey AS id, p_size FROM {part}) SELECT id, 'cliff' AS slot, 'moss' AS tile, 'error' AS severity, 'unknown_tile' AS code FROM d UNION ALL SELECT id, 'cliff', 'rock', 'error', 'weight_no_number' FROM d WHERE p_size % 3 = 0 UNION ALL SELECT id, 'cliff', 'rock', 'error', 'weight_range' FROM d WHERE p_size % 3 > 0 AND p_size > 30 UNION ALL SELECT id, NULL, 'rock', 'error', 'tile_missing' FROM d WHERE p_size % 4 = 1 UNION ALL SELECT id, NULL, 'rock', 'warning', 'not_promoted' FROM d WHERE p_size % 4 = 2")
def detail_issues(spark, sf_dir):
    """VAL09."""
    size = F.col("p_size")
    weight = F.when(size % 3 == 0, "heavy").otherwise((size / 30.0).cast("string"))
    blends = F.create_map(F.lit("cliff"), F.create_map(F.lit("rock"), weight, F.lit("moss"), F.lit("0.5")))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array(F.lit("rock")).alias("tiles"), blends.alias("blends"))
    listed = table(spark, sf_dir, "part").where("p_size % 4 <> 2").select(F.col("p_partkey").alias("id"), F.when(size % 4 == 1, "rock_normal").otherwise("rock_albedo").alias("name"))
    return rules.detail_issues(rows, "id", listed)


@query("SELECT p_partkey AS id, 'warning' AS severity, 'config_missing' AS code FROM {part} WHERE p_size % 4 = 0 UNION ALL SELECT p_partkey, 'error', 'texture_missing' FROM {part} WHERE p_size % 4 = 2")
def macro_issues(spark, sf_dir):
    """VAL10."""
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (size % 4 > 0).alias("has_config"), F.when(size % 4 == 1, "").when(size % 4 == 2, "w/gone.png").otherwise("w/there.png").alias("texture"))
    return rules.macro_issues(rows, "id", spark.createDataFrame([("w/there.png",)], "path string"))


@query("SELECT 'p' || p_partkey AS path, CASE WHEN p_size % 2 = 0 THEN 'error' ELSE 'warning' END AS severity, CASE WHEN p_size % 2 = 0 THEN 'dir_not_allowed' ELSE 'file_not_allowed' END AS code FROM {part} WHERE p_brand NOT IN ('Brand#11', 'Brand#12') AND NOT (p_size % 2 = 1 AND p_brand = 'Brand#13') AND p_size % 5 > 0")
def allowlist_issues(spark, sf_dir):
    """VAL11, its lists of names."""
    size = F.col("p_size")
    entries = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("path"), F.when(size % 5 == 0, F.concat(F.lit("."), "p_brand")).otherwise(F.col("p_brand")).alias("name"), (size % 2 == 0).alias("is_dir"))
    return rules.allowlist_issues(entries, ["Brand#11", "Brand#12"], ["Brand#11", "Brand#12", "Brand#13"])


@query("WITH f AS (SELECT p_brand AS folder, sum(p_size * 100000) / 1048576 AS mb FROM {part} GROUP BY p_brand) SELECT folder, 'error' AS severity, 'folder_size' AS code FROM f WHERE mb > 20 UNION ALL SELECT CAST(NULL AS VARCHAR), 'error', 'total_size' FROM (SELECT sum(mb) AS mb FROM f) t WHERE mb > 100")
def size_issues(spark, sf_dir):
    """VAL11, its sizes; AGG34."""
    return rules.size_issues(table(spark, sf_dir, "part").select(F.col("p_brand").alias("folder"), (F.col("p_size") * 100000).alias("size_bytes")), "folder")


@query("WITH f AS (SELECT CASE p_size % 4 WHEN 0 THEN 'docs/' WHEN 1 THEN 'docs/state/' WHEN 2 THEN 'docs/specs/' ELSE 'docs/other/' END || p_partkey || CASE WHEN p_size % 9 = 0 THEN '.txt' ELSE '.md' END AS path, CAST(p_size * 15 AS INT) AS lines, p_size FROM {part}) SELECT path, CASE p_size % 4 WHEN 2 THEN 'info' ELSE 'warning' END AS severity, CASE p_size % 4 WHEN 0 THEN 'top_level' WHEN 1 THEN 'state' ELSE 'spec' END AS code FROM f WHERE p_size % 9 > 0 AND ((p_size % 4 = 0 AND lines > 200) OR (p_size % 4 = 1 AND lines > 300) OR (p_size % 4 = 2 AND lines > 600))")
def line_issues(spark, sf_dir):
    """VAL12."""
    size = F.col("p_size")
    folder = F.when(size % 4 == 0, "docs/").when(size % 4 == 1, "docs/state/").when(size % 4 == 2, "docs/specs/").otherwise("docs/other/")
    return rules.line_issues(table(spark, sf_dir, "part").select(F.concat(folder, F.col("p_partkey").cast("string"), F.when(size % 9 == 0, ".txt").otherwise(".md")).alias("path"), (size * 15).cast("int").alias("lines")))


@query("WITH i AS (SELECT p_size AS s FROM {part} WHERE p_size > 40) SELECT (SELECT count(*) FROM i) AS errors, (SELECT count(*) FROM {nation} WHERE n_regionkey = 1) AS warnings, CAST(0 AS BIGINT) AS infos, false AS passed")
def issue_verdict(spark, sf_dir):
    """AGG10's pass flag."""
    found = table(spark, sf_dir, "part").where("p_size > 40").selectExpr("'error' AS severity").unionByName(table(spark, sf_dir, "nation").where("n_regionkey = 1").selectExpr("'warning' AS severity"))
    return store.verdict(found, strict=True)


# materials and candidates


@query("SELECT slot, 'missing' AS code, CAST(max(id) + 1 AS VARCHAR) AS tag FROM (SELECT 's' || slot AS slot, id FROM candidates) c GROUP BY slot UNION ALL SELECT slot, 'over_cap', NULL FROM (SELECT 's' || slot AS slot, count(*) AS n FROM candidates GROUP BY slot) d WHERE n > 7")
def promotion_errors(spark, sf_dir):
    """VAL14: each slot's own candidates as siblings of one that does not exist."""
    rows = relation(spark, sf_dir, "candidates").select(F.concat(F.lit("s"), "slot").alias("slot"), F.col("id").cast("string").alias("tag"), "id")
    asked = rows.groupBy("slot").agg((F.max("id") + 1).cast("string").alias("base"), F.collect_list("tag").alias("siblings"))
    return materials.promotion_errors(asked, rows)


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 'ready' WHEN id % 3 = 1 THEN 'broken' ELSE 'absent' END AS state FROM candidates")
def source_states(spark, sf_dir):
    """JOIN09."""
    rows = relation(spark, sf_dir, "candidates").select("id", F.concat(F.lit("f"), "id").alias("folder"))
    listed = rows.where("id % 3 = 0").select("folder", F.explode(F.array(F.lit("albedo"), F.lit("normal"))).alias("name")).unionByName(rows.where("id % 3 = 1").select("folder", F.lit("ao").alias("name")))
    return materials.source_states(rows, listed).select("id", "state")


@query("SELECT id, grade FROM candidates WHERE grade IN ('B', 'C') AND id % 4 > 0")
def graded_candidates(spark, sf_dir):
    """PRJ09."""
    rows = relation(spark, sf_dir, "candidates").withColumn("folder", F.col("id"))
    return materials.graded(rows, ["B", "C"], rows.where("id % 4 > 0")).select("id", "grade")


@query("SELECT id, CASE grade WHEN 'A' THEN 0 WHEN 'B' THEN 1 WHEN 'C' THEN 2 ELSE -1 END AS place, CASE slot WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE '' END AS name FROM candidates")
def names_and_places(spark, sf_dir):
    """PRJ13."""
    names = F.array(F.lit("A"), F.lit("B"), F.lit("C"))
    return relation(spark, sf_dir, "candidates").select("id", materials.place_of(names, F.col("grade")).alias("place"), materials.name_at(names, F.col("slot").cast("int")).alias("name"))


@query("WITH w AS (SELECT slot, count(*) AS n FROM candidates GROUP BY slot), v AS (SELECT slot, count(*) AS n FROM candidates WHERE grade IS NOT NULL GROUP BY slot) SELECT true AS same, (SELECT count(*) FROM w) = (SELECT count(*) FROM v) AND NOT EXISTS (SELECT 1 FROM w FULL JOIN v ON w.slot = v.slot AND w.n = v.n WHERE w.slot IS NULL OR v.slot IS NULL) AS other")
def windows_equal(spark, sf_dir):
    """JOIN11: the windows of all candidates, with themselves and with those that have a grade."""
    rows = relation(spark, sf_dir, "candidates")
    own, other = (materials.layer_windows(df, ["slot"], "slot") for df in (rows, rows.where("grade IS NOT NULL")))
    return materials.windows_match(own, own, ["slot"]).select(F.col("matches").alias("same")).crossJoin(F.broadcast(materials.windows_match(own, other, ["slot"]).select(F.col("matches").alias("other"))))  # one row each


@query("SELECT CAST(count(*) AS BIGINT) AS layers FROM candidates")
def variant_layers(spark, sf_dir):
    """AGG13."""
    return materials.variant_layers(relation(spark, sf_dir, "candidates").groupBy("slot").agg(F.collect_list("id").alias("variants")))


@query("SELECT slot AS biome, 't' || id AS tile, CAST(row_number() OVER (PARTITION BY slot ORDER BY id) - 1 AS INT) AS layer FROM candidates WHERE grade <> 'D'")
def tile_layers(spark, sf_dir):
    """SRC11: layers of the tiles that were loaded."""
    tiles = relation(spark, sf_dir, "candidates").select(F.col("slot").alias("biome"), F.col("id").alias("place"), F.concat(F.lit("t"), "id").alias("tile"), "grade")
    return materials.tile_layers(tiles.drop("grade"), tiles.where("grade <> 'D'"))


@query("SELECT id FROM candidates WHERE grade IS NULL OR grade <> 'A'")
def pending_candidates(spark, sf_dir):
    """UDF14: what is left to do."""
    rows = relation(spark, sf_dir, "candidates")
    return jobs.pending(rows, rows.where("grade = 'A'").select("id"), ["id"]).select("id")


# store, jobs, usage


@query("SELECT key, depends_on FROM deps UNION SELECT key, CAST(1 AS BIGINT) FROM deps WHERE key % 3 = 0")
def declared(spark, sf_dir):
    """GRF01."""
    deps = relation(spark, sf_dir, "deps")
    more = deps.where("key % 3 = 0").withColumn("depends_on", F.lit(1).cast("bigint"))
    return store.declare(deps, more.unionByName(more))


@query("WITH RECURSIVE d AS (SELECT CAST(3 AS BIGINT) AS key UNION SELECT deps.key FROM d JOIN deps ON deps.depends_on = d.key) SELECT key FROM artifacts WHERE key IN (SELECT key FROM d)")
def invalidated(spark, sf_dir):
    """GRF03: the keys that went."""
    return store.invalidate(relation(spark, sf_dir, "artifacts"), relation(spark, sf_dir, "deps"), 3)[1]


@query("SELECT a.key AS key, last_access, coalesce(o.size_bytes, 0) AS size_bytes FROM artifacts a LEFT JOIN (SELECT key, size_bytes FROM artifacts WHERE key % 5 > 0) o ON o.key = a.key")
def artifact_list(spark, sf_dir):
    """GRF04."""
    rows = relation(spark, sf_dir, "artifacts")
    return store.artifacts_with_size(rows.select("key", "last_access"), rows.where("key % 5 > 0"))


@query("SELECT d.key * 3 AS key, a.key IS NOT NULL AS has, coalesce(a.size_bytes, -1) AS size_bytes FROM deps d LEFT JOIN artifacts a ON a.key = d.key * 3")
def artifact_lookup(spark, sf_dir):
    """GRF05."""
    return store.looked_up(relation(spark, sf_dir, "deps").select((F.col("key") * 3).alias("key")), relation(spark, sf_dir, "artifacts").select("key", "size_bytes")).withColumn("size_bytes", F.coalesce("size_bytes", F.lit(-1)))


@query("SELECT key AS id FROM artifacts WHERE NOT (size_bytes % 3000 < 2000 AND 100000 - last_access * 50 > 45000)")
def swept_jobs(spark, sf_dir):
    """STR09: jobs that ended long ago go."""
    rows = relation(spark, sf_dir, "artifacts")
    done = F.when(rows.size_bytes % 3000 == 0, "completed").when(rows.size_bytes % 3000 == 1000, "failed").otherwise("running")
    return jobs.swept(rows.select(F.col("key").alias("id"), done.alias("status"), (F.col("last_access") * 50).alias("ended_ms")), 100_000, 45_000).select("id")


@query("SELECT CAST(sum(CASE WHEN size_bytes % 3000 = 2000 THEN 1 ELSE 0 END) AS BIGINT) AS queued, CAST(sum(CASE WHEN size_bytes % 3000 = 1000 THEN 1 ELSE 0 END) AS BIGINT) AS running, CAST(sum(CASE WHEN size_bytes % 3000 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS completed FROM artifacts")
def job_totals(spark, sf_dir):
    """AGG11's counts by state."""
    left = F.col("size_bytes") % 3000
    return jobs.totals(relation(spark, sf_dir, "artifacts").select(F.when(left == 0, "completed").when(left == 1000, "running").otherwise("queued").alias("status")))


_KEY_LIST = ", ".join(f"('{k}')" for k in store.USAGE_KEYS)


@query(f"SELECT s.system AS system, k.key AS key, coalesce(u.value, 0) AS value FROM (SELECT DISTINCT system FROM usage) s CROSS JOIN (VALUES {_KEY_LIST}) AS k(key) LEFT JOIN (SELECT system, key, max(value) AS value FROM usage WHERE value > 90 GROUP BY system, key) u ON u.system = s.system AND u.key = k.key")
def usage_normalized(spark, sf_dir):
    """PRJ11."""
    usage = relation(spark, sf_dir, "usage")
    rows = usage.where("value > 90").groupBy("system", "key").agg(F.max("value").alias("value"))
    return store.normalized_usage(rows.unionByName(usage.select("system").distinct().selectExpr("system", "'other' AS key", "CAST(7 AS BIGINT) AS value")))


@query("SELECT system, key, value FROM (SELECT u.system AS system, key, value, row_number() OVER (PARTITION BY u.system, key ORDER BY ts DESC, id DESC) AS n FROM usage u LEFT JOIN (SELECT system, max(ts) AS t FROM usage WHERE id % 500 = 7 GROUP BY system) c ON c.system = u.system WHERE t IS NULL OR ts > t) q WHERE n = 1")
def usage_after_clear(spark, sf_dir):
    """STR04: readings before a system's last clearing don't count."""
    usage = relation(spark, sf_dir, "usage")
    return store.latest_usage(usage, usage.where("id % 500 = 7").select("system", "ts"))


@query("SELECT moment, array_to_string(list_sort(list(u.key)), ',') AS over_keys FROM (SELECT id // 100 AS moment, key, sum(value) AS total FROM usage GROUP BY 1, 2) u JOIN (VALUES ('draw_calls', 800), ('cpu_pages', 900)) AS b(key, budget) ON b.key = u.key WHERE total > budget GROUP BY moment")
def over_budget(spark, sf_dir):
    """AGG03's keys over budget, by moment."""
    totals = relation(spark, sf_dir, "usage").groupBy(F.expr("id div 100").alias("at"), "key").agg(F.sum("value").alias("total"))
    budgets = spark.createDataFrame([("draw_calls", 800), ("cpu_pages", 900)], "key string, budget long")
    return store.over_budget(totals, budgets).select(F.col("at").alias("moment"), F.array_join("over", ",").alias("over_keys"))


@query("WITH RECURSIVE e AS (SELECT key AS scope, id AS moment FROM usage WHERE value > 95), t AS (SELECT scope, min(moment) AS moment FROM e GROUP BY scope UNION ALL SELECT t.scope, min(e.moment) FROM t JOIN e ON e.scope = t.scope AND e.moment >= t.moment + 200 GROUP BY t.scope, t.moment) SELECT scope, moment FROM t")
def throttled_alerts(spark, sf_dir):
    """STR05 in batch form: alerts of a key at least 200 apart."""
    return store.throttled(relation(spark, sf_dir, "usage").where("value > 95").select(F.col("key").alias("scope"), F.col("id").alias("moment")), "moment", 200, ["scope"])


@query("SELECT id AS event, CAST(row_number() OVER (ORDER BY z0, x0, id) + 9 AS BIGINT) AS id FROM changes")
def published_ids(spark, sf_dir):
    """STR01: rising ids in a total order, without one task for all."""
    rows = relation(spark, sf_dir, "changes").select(F.col("id").alias("event"), "z0", "x0")
    return store.published(rows, ["z0", "x0", "event"], 10).select("event", "id")


@query("SELECT sub_id FROM subscriptions WHERE names = '' OR list_contains(string_split(names, ','), 'view')")
def source_subscribers(spark, sf_dir):
    """JOIN08."""
    return store.subscribers(relation(spark, sf_dir, "subscriptions").withColumn("sources", F.filter(F.split("names", ","), lambda s: s != "")), "view").select("sub_id")


_REQUIRED = "SELECT DISTINCT id // 500 AS frame, id * 7 % 97 AS page FROM usage WHERE value > 60"


@query(f"WITH r AS ({_REQUIRED}) SELECT r.frame AS frame, r.page AS page, 'load' AS action FROM r LEFT JOIN r p ON p.frame = r.frame - 1 AND p.page = r.page WHERE p.page IS NULL UNION ALL SELECT p.frame + 1, p.page, 'evict' FROM r p LEFT JOIN r ON r.frame = p.frame + 1 AND r.page = p.page WHERE r.page IS NULL AND p.frame + 1 IN (SELECT frame FROM r)")
def residency_steps(spark, sf_dir):
    """STR07 in batch form."""
    rows = relation(spark, sf_dir, "usage").where("value > 60").selectExpr("id div 500 AS frame", "id * 7 % 97 AS page")
    return store.residency_steps(rows, "frame", ["page"])


@query("SELECT event_id AS id, level, level IN ('WARN', 'ERROR') AS to_stderr, '[' || rpad(level, 5, ' ') || '] [' || rpad(substr(event_type, 1, 15), 15, ' ') || '] [' || lpad(CAST(event_id % 100000 AS VARCHAR), 6, ' ') || '] hit user=' || user_id AS line FROM (SELECT *, CASE event_type WHEN 'click' THEN 'WARN' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS level FROM {events}) e WHERE level <> 'DEBUG' OR user_id % 2 = 0".replace("level <> 'DEBUG' OR user_id % 2 = 0", "level IN ('WARN', 'ERROR') OR level = 'DEBUG'"))
def log_routing(spark, sf_dir):
    """PRJ10, FN41, SNK06: the least level is WARN, and one system is verbose."""
    level = F.when(F.col("event_type") == "click", "WARN").when(F.col("event_type") == "view", "DEBUG").otherwise("INFO")
    rows = table(spark, sf_dir, "events").withColumn("level", level).where(fn.should_log(F.col("level"), F.col("event_type"), "WARN", ["view"]))
    line = fn.log_line("human", F.col("level"), F.col("event_type"), F.col("event_id") % 100000, F.lit("hit"), {"user": F.col("user_id")})
    return rows.select(F.col("event_id").alias("id"), "level", fn.to_stderr(F.col("level")).alias("to_stderr"), line.alias("line"))


@query("SELECT id, CASE WHEN version = '1.2.3' THEN '' ELSE '1.2.3' END AS path FROM versions")
def migration_paths(spark, sf_dir):
    """FN30."""
    return relation(spark, sf_dir, "versions").select("id", F.array_join(fn.migration_path(F.col("version"), F.lit("1.2.3")), ",").alias("path"))


# points, weights, rasters, images


@query("SELECT id, x, z, id % 2 = 0 AS known FROM (SELECT id, CASE WHEN id % 4 = 0 THEN x + 2e0 ELSE x END AS x, z FROM points) p")
def index_updates(spark, sf_dir):
    """UDF08: moves of known ids only, and which ids are held."""
    points = relation(spark, sf_dir, "points")
    moves = points.where("id % 4 = 0").withColumn("x", F.col("x") + 2.0).unionByName(points.selectExpr("-id - 1 AS id", "x", "z"))
    held = spatial.contains(points.where("id % 2 = 0"), points.select("id"))
    return spatial.moved(points, moves).join(held.withColumnRenamed("contained", "known"), "id")


@query("SELECT id, round(sum(b * v) / sum(b), 6) AS value FROM (SELECT p_partkey AS id, k % 2 AS biome, max(CASE k % 2 WHEN 0 THEN 0.25e0 ELSE p_size / 50e0 END) AS b, sum(p_size % (k + 2) * (k + 1e0)) / sum(p_size % (k + 2)) AS v FROM {part}, (SELECT CAST(range AS INT) AS k FROM range(4)) r WHERE p_size % (k + 2) > 0.001e0 GROUP BY 1, 2) q GROUP BY id")
def slot_blend_levels(spark, sf_dir):
    """AGG09 in two levels: slots in their biome, then biomes."""
    k = F.col("k")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    rows = rows.select("id", (k % 2).alias("biome"), (F.col("p_size") % (k + 2)).alias("w"), F.when(k % 2 == 0, F.lit(0.25)).otherwise(F.col("p_size") / 50.0).alias("b"), (k + 1.0).alias("v"))
    return weights.blended(rows, ["id"], "biome", "w", "b", "v").select("id", F.round("v", 6).alias("value"))


_CORNERS = "SELECT page_x, r, c, o, px, pz, fx * fx * (3 - 2 * fx) AS s, fz * fz * (3 - 2 * fz) AS t, i + di AS cx, j + dj AS cz, di, dj FROM (SELECT *, px - floor(px) AS fx, pz - floor(pz) AS fz, CAST(floor(px) AS BIGINT) AS i, CAST(floor(pz) AS BIGINT) AS j FROM base) b, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) AS d(di, dj)"
_STEP = "(({x}) * 668265261) & 4294967295"


def _wang(column: str, source: str, name: str) -> str:
    """CTEs that end in `name`, with Wang's hash of `column` of `source` as h."""
    return (
        f"{name}1 AS (SELECT *, xor(xor(CAST({column} AS BIGINT), 61), CAST({column} AS BIGINT) >> 16) AS a1 FROM {source}), {name}2 AS (SELECT *, (a1 * 9) & 4294967295 AS a2 FROM {name}1), "
        f"{name}3 AS (SELECT *, xor(a2, a2 >> 4) AS a3 FROM {name}2), {name}4 AS (SELECT *, CAST((CAST(a3 AS HUGEINT) * 668265261) % 4294967296 AS BIGINT) AS a4 FROM {name}3), {name} AS (SELECT * EXCLUDE (a1, a2, a3, a4), xor(a4, a4 >> 15) AS h FROM {name}4)"
    )


@query(
    "WITH p AS (SELECT DISTINCT page_x, page_z FROM (SELECT CAST(px * 64e0 AS DOUBLE) AS page_x, CAST(pz * 64e0 AS DOUBLE) AS page_z FROM (SELECT px, unnest(range(CAST(floor((z - 32e0) / 64e0) AS BIGINT), CAST(floor((z + 32e0 - 0.001e0) / 64e0) AS BIGINT) + 1)) AS pz FROM (SELECT z, unnest(range(CAST(floor((x - 32e0) / 64e0) AS BIGINT), CAST(floor((x + 32e0 - 0.001e0) / 64e0) AS BIGINT) + 1)) AS px FROM cameras) a) b) q), "
    "base AS (SELECT page_x, page_z, CAST(k // 16 AS INT) AS r, CAST(k % 16 AS INT) AS c, o, (page_x + (k % 16) * (64e0 / 15)) * (1e0 / 64 * (1 << o)) AS px, (page_z + (k // 16) * (64e0 / 15)) * (1e0 / 64 * (1 << o)) AS pz FROM p, (SELECT range AS k FROM range(256)) a, (SELECT range AS o FROM range(6)) b), "
    f"corner AS ({_CORNERS.replace('page_x, r', 'page_x, page_z, r')}), " + _wang("42 + o * 1013", "corner", "s0").replace("EXCLUDE (a1, a2, a3, a4), xor(a4, a4 >> 15) AS h", "EXCLUDE (a1, a2, a3, a4), xor(a4, a4 >> 15) AS h0") + ", "
    + _wang("xor(cz & 4294967295, h0)", "s0", "sz").replace("xor(a4, a4 >> 15) AS h ", "xor(a4, a4 >> 15) AS hz ") + ", " + _wang("xor(cx & 4294967295, hz)", "sz", "sx") + ", "
    "lattice AS (SELECT page_x, page_z, r, c, o, s, t, max(CASE WHEN di = 0 AND dj = 0 THEN v END) AS a, max(CASE WHEN di = 1 AND dj = 0 THEN v END) AS b, max(CASE WHEN di = 0 AND dj = 1 THEN v END) AS d, max(CASE WHEN di = 1 AND dj = 1 THEN v END) AS e FROM (SELECT *, (h & 16777215) / 16777216e0 AS v FROM sx) x GROUP BY ALL), "
    "octave AS (SELECT page_x, page_z, r, c, o, 2 * ((a + (b - a) * s) + ((d + (e - d) * s) - (a + (b - a) * s)) * t) - 1 AS n FROM lattice) "
    "SELECT page_x, page_z, r, c, round(50 * sum(n * pow(0.5e0, o)) / 1.96875e0, 4) AS h FROM octave GROUP BY page_x, page_z, r, c"
)
def noise_page(spark, sf_dir):
    """SRC01, FN02 to FN04: pages of fractal noise at the cameras."""
    pages = spatial.page_cover(relation(spark, sf_dir, "cameras"), 64.0, 64.0).select("page_x", "page_z").distinct()
    return raster.noise_pages(pages, 16, 64.0, seed=42, frequency=1 / 64).select("page_x", "page_z", "r", "c", F.round("h", 4).alias("h"))


@query()
def dem_features(spark, sf_dir):
    """UDF07, FN38: every mode of a noise page for each camera frame, resampled."""
    pages = relation(spark, sf_dir, "cameras").selectExpr("frame AS page", "frame * 64e0 AS page_x", "0e0 AS page_z")
    rows = raster.noise_pages(pages, 16, 64.0, seed=5, frequency=1 / 48)
    return raster.features(rows, ["page"], 12).withColumn("v", F.round("v", 4))


@query("SELECT img, 16 AS rows, 16 AS cols, 768 AS bytes, CAST(sum(red + green + blue) AS BIGINT) AS total FROM pixels GROUP BY img HAVING count(*) = 256")
def packed_images(spark, sf_dir):
    """SRC10's images as packed rows, of whole images."""
    whole = relation(spark, sf_dir, "pixels").join(relation(spark, sf_dir, "pixels").groupBy("img").count().where("count = 256").select("img"), "img", "left_semi")
    out = images.packed(whole)
    return out.join(whole.groupBy("img").agg(F.sum(F.col("red") + F.col("green") + F.col("blue")).alias("total")), "img").select("img", "rows", "cols", F.length("rgb").alias("bytes"), "total")


def _images(spark, sf_dir):
    pixels = relation(spark, sf_dir, "pixels")
    whole = pixels.groupBy("img").count().where("count = 256").select("img")  # the last image of the table may not be whole
    return images.packed(pixels.join(whole, "img", "left_semi"))


@query()
def image_mips(spark, sf_dir):
    """AGG18."""
    return images.mip_stdevs(_images(spark, sf_dir), (16, 8, 4)).withColumn("stdev", F.round("stdev", 4))


@query()
def image_means(spark, sf_dir):
    """AGG31."""
    return images.mean_colors(_images(spark, sf_dir))


@query()
def palette_lock(spark, sf_dir):
    """FN22, UDF12: families of four images, the first of which is the anchor."""
    rows = _images(spark, sf_dir).withColumns({"family": F.expr("img div 4"), "is_anchor": F.col("img") % 4 == 0})
    return images.locked_to_anchor(rows, "family", "is_anchor").select("family", "img", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"))


@query()
def roughness(spark, sf_dir):
    """FN25."""
    return images.roughness_maps(_images(spark, sf_dir), 0.88, 0.10).select("img", F.sha2("rough", 256).alias("hash"))


@query("SELECT id, x AS h FROM (SELECT id, CAST(CAST(x AS FLOAT) AS DOUBLE) AS x FROM points) p")
def page_bytes(spark, sf_dir):
    """SNK02: heights to bytes and back."""
    rows = relation(spark, sf_dir, "points").select("id", files.page_bytes(F.array("x", "z")).alias("b"))
    return rows.select("id", F.get(files.bytes_page(F.col("b")), 0).cast("double").alias("h"))
