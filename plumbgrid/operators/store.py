"""Content store tables: dependents, invalidation, eviction, budgets, usage, rules as issues."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut_lineage
from .spatial import rect_overlaps


def dependents(deps: DataFrame, keys: DataFrame) -> DataFrame:
    """All keys that depend on `keys` (start, key), directly or not; safe on cycles. A start on a cycle is its own dependent.

    One join for each step away from the start; only pairs seen first go on.
    """
    edges = deps.select(F.col("depends_on").alias("key"), F.col("key").alias("next")).distinct()
    front = cut_lineage(keys.select("start", "key").join(edges, "key").select("start", F.col("next").alias("key")).distinct(), "front")
    found = front
    while not front.isEmpty():
        step = front.join(edges, "key").select("start", F.col("next").alias("key")).distinct()
        front = cut_lineage(step.join(found, ["start", "key"], "left_anti"), "front")
        found = found.union(front)
    return found


def running(df: DataFrame, order: list[Column], amount: Column, name: str) -> DataFrame:
    """Adds `name`: the sum of `amount` over all rows before a row in a total order, however the values are spread.

    Rows are range-partitioned by the whole order, whose last parts break ties, so that equal access times don't gather
    in one task; each partition's sum is added up, then the rows inside. Nothing orders all rows in one task.
    """
    keyed = df.withColumns({f"__o{k}": c for k, c in enumerate(order)} | {"__a": amount})
    by = [F.col(f"__o{k}") for k in range(len(order))]
    placed = cut_lineage(keyed.repartitionByRange(*by).withColumn("__p", F.spark_partition_id()), "ranges")
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = placed.groupBy("__p").agg(F.sum("__a").alias("__s"))  # as many rows as partitions
    sums = sums.select("__p", before(Window.partitionBy(F.lit(0)).orderBy("__p"), "__s").alias("__f"))
    total = F.col("__f") + before(Window.partitionBy("__p").orderBy(*by), "__a")
    return placed.join(F.broadcast(sums), "__p").withColumn(name, total).drop("__p", "__f", "__a", *(f"__o{k}" for k in range(len(order))))


def keep_newest(access: DataFrame, cap: int, size: str = "size_bytes", last: str = "last_access", key: str = "key") -> DataFrame:
    """Rows to evict, oldest first, until what is left fits `cap`: those before which less than the excess is freed. Null times are the oldest."""
    total = access.agg(F.sum(size)).first()[0]
    if total is None or total <= cap:
        return access.limit(0)
    return running(access, [F.col(last), F.col(key)], F.coalesce(F.col(size), F.lit(0)), "freed_before").where(F.col("freed_before") < total - cap)


def keep_recent(access: DataFrame, count: int, last: str = "last_access", key: str = "key") -> DataFrame:
    """Rows to evict so that the `count` most recent stay; of equal times the greater key stays."""
    total = access.count()
    return running(access, [F.col(last), F.col(key)], F.lit(1), "__n").where(F.col("__n") < max(0, total - count)).drop("__n")


def store_size(artifacts: DataFrame, size: str = "size_bytes") -> DataFrame:
    """bytes, whole megabytes, and artifacts; zeros for none."""
    total = F.coalesce(F.sum(size), F.lit(0))
    return artifacts.agg(total.alias("bytes"), F.floor(total / 1048576).alias("mb"), F.count("*").alias("n"))


def unreferenced(access: DataFrame, now: float, max_age: float, last: str = "last_access") -> DataFrame:
    """Rows last accessed longer ago than `max_age`."""
    return access.where(F.col(last) < now - max_age)


def declare(deps: DataFrame, more: DataFrame) -> DataFrame:
    """Dependencies (key, depends_on) with others added, each once."""
    return deps.select("key", "depends_on").unionByName(more.select("key", "depends_on")).distinct()


def invalidate(artifacts: DataFrame, deps: DataFrame, key) -> tuple[DataFrame, DataFrame]:
    """(artifacts that are left, keys that went) when a key and all that depends on it go; only keys that existed are in the second."""
    one = artifacts.sparkSession.createDataFrame([(key, key)], artifacts.select(F.col("key").alias("start"), "key").schema)
    gone = dependents(deps, one).select("key").union(one.select("key")).distinct()
    return artifacts.join(gone, "key", "left_anti"), artifacts.join(gone, "key", "left_semi").select("key")


def artifacts_with_size(metadata: DataFrame, objects: DataFrame) -> DataFrame:
    """Metadata rows (key, ...) with the size of their object, 0 where it is missing."""
    return metadata.join(objects.select("key", "size_bytes"), "key", "left").withColumn("size_bytes", F.coalesce("size_bytes", F.lit(0)))


def looked_up(keys: DataFrame, artifacts: DataFrame) -> DataFrame:
    """`keys` (key) with `has` and what is known of each artifact."""
    return keys.join(artifacts.withColumn("has", F.lit(True)), "key", "left").withColumn("has", F.coalesce("has", F.lit(False)))


def cache_stats(pages: DataFrame, cells: str, status: str) -> DataFrame:
    """bytes (four for each cell), and how many pages are in flight and cached."""
    return pages.agg(F.coalesce(F.sum(F.col(cells) * 4), F.lit(0)).alias("bytes"), F.count_if(F.col(status) == "in_flight").alias("in_flight"), F.count_if(F.col(status) == "cached").alias("cached"))


def issues(df: DataFrame, rules: list[tuple[str, str, Column]], key: str) -> DataFrame:
    """(key, severity, code) for each rule (severity, code, condition that breaks it) that a row breaks."""
    broken = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(sev).alias("severity"), F.lit(code).alias("code"))) for sev, code, cond in rules]))
    return df.select(F.col(key), F.explode(broken).alias("i")).select(key, "i.severity", "i.code")


def all_issues(checks: list[tuple[str, DataFrame]]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.withColumn("check", F.lit(name)) for name, df in checks])


def verdict(found: DataFrame, strict: bool = False) -> DataFrame:
    """One row: errors, warnings, infos, and whether they pass; strict lets no warning pass."""
    out = found.agg(*[F.count_if(F.col("severity") == s).alias(f"{s}s") for s in ("error", "warning", "info")])
    return out.withColumn("passed", (F.col("errors") == 0) & ((F.col("warnings") == 0) | F.lit(not strict)))


def issue_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("severity").agg(F.count("*").alias("n"))


#: The keys of a usage reading, in their order.
USAGE_KEYS = ("active_tris", "resident_texture_mb", "draw_calls", "active_jobs", "cpu_pages", "gpu_pages", "asset_cache_mb")


def normalized_usage(readings: DataFrame, keys: tuple[str, ...] = USAGE_KEYS) -> DataFrame:
    """(system, key, value): every system has every known key, 0 where it gave none; other keys are dropped."""
    systems = readings.select("system").distinct().select("system", F.explode(F.array(*map(F.lit, keys))).alias("key"))
    return systems.join(readings.select("system", "key", "value"), ["system", "key"], "left").withColumn("value", F.coalesce("value", F.lit(0)))


def usage_totals(usage: DataFrame) -> DataFrame:
    return usage.groupBy("key").agg(F.sum("value").alias("total"))


def latest_usage(readings: DataFrame, cleared: DataFrame | None = None) -> DataFrame:
    """The last reading of each system and key by time, then by id; with `cleared` (system, ts), only readings after a system's last clearing."""
    if cleared is not None:
        ends = cleared.groupBy("system").agg(F.max("ts").alias("__end"))
        readings = readings.join(ends, "system", "left").where(F.col("__end").isNull() | (F.col("ts") > F.col("__end"))).drop("__end")
    return readings.groupBy("system", "key").agg(F.max_by("value", F.struct("ts", "id")).alias("value"))


def top_publishers(usage: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The n systems with the greatest values of a key; ties by name."""
    return usage.where(F.col("key") == key).groupBy("system").agg(F.sum("value").alias("total")).orderBy(F.desc("total"), "system").limit(n)


def recent(changes: DataFrame, n: int = 100) -> DataFrame:
    """The last n changes by id, in order."""
    return changes.orderBy(F.desc("id")).limit(n).orderBy("id")


def published(changes: DataFrame, order: list[str], first: int = 1) -> DataFrame:
    """Changes with rising ids from `first`, in the given total order."""
    return running(changes, [F.col(c) for c in order], F.lit(1), "id").withColumn("id", F.col("id") + first)


def since(rows: DataFrame, cutoff: Column, ts: str = "ts") -> DataFrame:
    return rows.where(F.col(ts) >= cutoff)


def owner_totals(resources: DataFrame, owner: list[str], size: str, large: int) -> DataFrame:
    """(owner, n, bytes, large): allocations, their bytes, and those over `large`."""
    return resources.groupBy(*owner).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"), F.count_if(F.col(size) > large).alias("large"))


def leaks(events: DataFrame, resource: str, delta: str) -> DataFrame:
    """(resource, open): what was registered (delta 1) more often than unregistered (-1)."""
    return events.groupBy(resource).agg(F.sum(delta).alias("open")).where("open > 0")


def over_budget(totals: DataFrame, budgets: DataFrame) -> DataFrame:
    """(at, over): moments (at, key, total) whose totals exceed a budget, with the keys that do, sorted."""
    rows = totals.join(F.broadcast(budgets), "key").where(F.col("total") > F.col("budget"))  # budgets are a row a key of a fixed list
    return rows.groupBy("at").agg(F.array_sort(F.collect_set("key")).alias("over"))


def throttled(moments: DataFrame, at: str, gap: int, scope: list[str]) -> DataFrame:
    """Of each scope's moments (integers) the first, then each that is `gap` or more after the last one taken.

    What comes first after a gap decides what follows, so a scope is one task; only its moments go there.
    """

    def run(key, pdf):
        taken, last = [], None
        for t in sorted(pdf[at]):
            if last is None or t - last >= gap:
                taken.append(t)
                last = t
        return pd.DataFrame({**{k: [v] * len(taken) for k, v in zip(scope, key, strict=True)}, at: taken})

    kinds = {f.name: f.dataType.simpleString() for f in moments.schema}
    return moments.select(*scope, at).groupBy(*scope).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in (*scope, at)))


def residency_steps(required: DataFrame, frame: str, keys: list[str]) -> DataFrame:
    """(frame, keys, action): what each frame loads, not required by the frame before it, and what it evicts, required before and no longer."""
    now = required.select(frame, *keys).distinct()
    moved = now.withColumn(frame, F.col(frame) + 1)
    frames = now.select(frame).distinct()
    loads = now.join(moved, [frame, *keys], "left_anti").withColumn("action", F.lit("load"))
    evicts = moved.join(frames, frame, "left_semi").join(now, [frame, *keys], "left_anti").withColumn("action", F.lit("evict"))
    return loads.unionByName(evicts)


def headroom(usage: DataFrame, budgets: DataFrame) -> DataFrame:
    rows = budgets.join(usage_totals(usage), "key", "left").withColumn("headroom", F.col("budget") - F.coalesce("total", F.lit(0)))
    return rows.select("key", "headroom", (F.col("headroom") < 0).alias("over"))


def matched_changes(changes: DataFrame, subscriptions: DataFrame, cell: float = 64.0) -> DataFrame:
    """Which subscription hears which change: sources empty or holding the change's, and no region or one that overlaps it strictly.

    Subscriptions that name sources join by source. Those that hear every source within a region join by the cells that
    both regions touch, of the greater one's level (`spatial.rect_overlaps`); a stream of changes joins them by a
    constant, as those without a region, where every pair is a result. No side is broadcast by force.
    """
    overlap = F.col("sx0").isNull() | ((F.col("x0") < F.col("sx1")) & (F.col("x1") > F.col("sx0")) & (F.col("z0") < F.col("sz1")) & (F.col("z1") > F.col("sz0")))
    named = changes.join(subscriptions.withColumn("source", F.explode("sources")).distinct(), "source").where(overlap).select("id", "sub_id")
    every = subscriptions.where(F.size("sources") == 0).drop("sources")
    by_place = not changes.isStreaming
    anywhere = every.where("sx0 IS NULL") if by_place else every
    all_of = changes.withColumn("__k", F.lit(1)).join(anywhere.withColumn("__k", F.lit(1)), "__k").where(overlap).select("id", "sub_id")
    out = named.unionByName(all_of)
    if by_place:
        out = out.unionByName(rect_overlaps(changes, every.where("sx0 IS NOT NULL"), cell).select("id", "sub_id"))
    return out


def subscribers(subscriptions: DataFrame, source: str) -> DataFrame:
    """Who hears a source."""
    return subscriptions.where((F.size("sources") == 0) | F.array_contains("sources", source))
