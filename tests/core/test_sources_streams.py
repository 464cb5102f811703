"""Readers on small files, and streams against their batch forms."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbgrid.operators import raster, store
from plumbgrid.plans.relations import relation
from plumbgrid.sources import files
from plumbgrid.streaming import events


def test_json(spark, tmp_path):
    (tmp_path / "catalog.json").write_text(json.dumps({"biomes": [{"name": "alpine", "kit_dir": "k", "auto_rule": {"elevation_m": [10, 60], "slope_deg": [0, 90], "band_width_elevation_m": 10}}, {"name": "bare"}]}, indent=1))
    rows = files.catalog(spark, str(tmp_path / "catalog.json")).orderBy("place").collect()
    assert [(r.biome, r.kit, r.lo_e, r.hi_s, r.band_s) for r in rows] == [("alpine", "k", 10.0, 90.0, 0.0), ("bare", None, None, None, 0.0)]
    (tmp_path / "m.json").write_text(json.dumps({"world_seed": 3, "slots": [{"biome": "a", "slot": "s", "variants": [{"id": "x", "source": "p", "weight": 1}, {"id": "y"}]}]}))
    assert [(r.slot, r.n, r.id) for r in files.manifest(spark, str(tmp_path / "m.json")).collect()] == [("s", 0, "x"), ("s", 1, "y")]
    (tmp_path / "t.json").write_text(json.dumps({"high": {"rings": 5}, "low": {"rings": 2}}))
    tiers = files.keyed_json(spark, str(tmp_path / "t.json"))
    assert [files.tier(tiers, n).first().value["rings"] for n in ("low", None, "none")] == ["2", "5", "5"]
    (tmp_path / "bad.json").write_text("{")
    assert files.keyed_json(spark, str(tmp_path / "bad.json")).count() == 0
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        files.keyed_json(spark, str(tmp_path / "bad.json"), strict=True).collect()


def test_files(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(12.0).reshape(3, 4))
    np.savez(tmp_path / "b.npz", x=np.arange(3), y=np.ones((2, 2)))
    (tmp_path / "n.txt").write_text("one\ntwo")
    got = {r.file.rsplit("/")[-1]: (r.rows, r.cols) for r in files.rasters(spark, str(tmp_path)).collect()}
    assert got == {"a.npy": (3, 4), "b.npz": (2, 2)}
    long = files.unpacked(files.rasters(spark, str(tmp_path), "*.npy"), ["file"])
    assert {(r.r, r.c): r.h for r in long.collect()} == {(k // 4, k % 4): float(k) for k in range(12)}
    assert raster.halve(long, ["file"], 3, 4).count() == 2
    assert [(r.line, r.text) for r in files.lines(spark, str(tmp_path), "*.txt").collect()] == [(1, "one"), (2, "two")]
    assert files.files(spark, str(tmp_path), "*.txt").first().size_bytes == 7
    store_path = str(tmp_path / "store")
    files.write_artifacts(spark.createDataFrame([("ab12", 3), ("cd34", 4)], "key string, size_bytes long"), store_path)
    old = spark.read.parquet(store_path).drop("shard")
    assert {tuple(r) for r in files.replace_by_key(old, old.where("key = 'ab12'").withColumn("size_bytes", F.lit(9)), ["key"]).collect()} == {("ab12", 9), ("cd34", 4)}


def drained(df, name, mode="append"):
    df.sparkSession.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        return _drained(df, name, mode)
    finally:
        df.sparkSession.conf.set("spark.sql.shuffle.partitions", "8")


def _drained(df, name, mode):
    """Until the query ends, or, with timers that never let it end, until a batch has come after the one with the rows."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    for _ in range(40):
        if q.awaitTermination(1):
            break
        if any(p["numInputRows"] for p in q.recentProgress) and not q.lastProgress["numInputRows"]:
            break
    q.stop()
    return q


def test_streams(spark, sf, tmp_path):
    batch = relation(spark, sf, "changes")
    subs = relation(spark, sf, "subscriptions").withColumn("sources", F.filter(F.split("names", ","), lambda s: s != ""))
    batch.repartition(3).write.parquet(str(tmp_path / "changes"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "changes"))
    drained(events.change_matches(stream, subs), "matches")
    assert sorted(spark.table("matches").collect()) == sorted(store.matched_changes(batch, subs).collect())
    usage = relation(spark, sf, "usage")
    usage.repartition(2).write.parquet(str(tmp_path / "usage"))
    stream = spark.readStream.schema(usage.schema).parquet(str(tmp_path / "usage"))
    drained(events.running_totals(stream), "totals", "complete")
    assert sorted(spark.table("totals").collect()) == sorted(store.usage_totals(usage).collect())


def test_coalesced(spark, tmp_path):
    rows = [("a", "k", i, f"2024-01-01 00:00:00.{ms:03d}") for i, ms in enumerate((0, 50, 99, 100, 150, 300))] + [("b", "k", 7, "2024-01-01 00:00:00.010")]
    df = spark.createDataFrame(rows, "system string, key string, value long, t string").selectExpr("system", "key", "value", "CAST(t AS TIMESTAMP) AS ts")
    df.coalesce(1).write.parquet(str(tmp_path / "r"))
    drained(events.coalesced_usage(spark.readStream.schema(df.schema).parquet(str(tmp_path / "r"))), "coalesced")
    assert sorted((r.system, r.value) for r in spark.table("coalesced").where("NOT coalesced").collect()) == [("a", 0), ("a", 3), ("a", 5), ("b", 7)]


def test_log_lint(spark):
    from plumbgrid.operators import rules

    text = ["print('x')", "  push_error(a) ; print(b)", "# print(1)", "x = print_msg(1)", "prints(1) # LINT_OK", "a # print(", "", "printt ( 1 )", "printt(2)"]
    rows = [(f, k + 1, t) for f in ("src/a.gd", "src/Log.gd", "src/tests/b.gd") for k, t in enumerate(text)]
    got = rules.log_lint(spark.createDataFrame(rows, "file string, line int, text string")).collect()
    assert sorted(map(tuple, got)) == [("src/a.gd", 1, "print"), ("src/a.gd", 2, "print"), ("src/a.gd", 9, "printt")]


def test_change_log(spark, tmp_path):
    log = events.ChangeLog(str(tmp_path / "log"), ["ts", "source"])
    df = spark.createDataFrame([(k % 7, f"s{k}") for k in range(20)], "ts long, source string")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    q = stream.writeStream.foreachBatch(log.publish).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = log.history(spark).collect()
    assert [r.id for r in rows] == list(range(1, 21)) and {r.source for r in rows} == {f"s{k}" for k in range(20)}
    log.publish(df.limit(3), 1)  # a batch that runs again gets its own ids and replaces its rows
    assert [r.id for r in log.history(spark, 5).collect()] == sorted(r.id for r in log.history(spark, 5).collect())
    first, second = log.subscribe(["s1"]), log.subscribe(region=(0.0, 0.0, 1.0, 1.0), dispatch="job")
    assert (first, second) == (1, 2) and log.unsubscribe(1) and not log.unsubscribe(1) and [r.sub_id for r in log.table(spark).collect()] == [2]
    with pytest.raises(ValueError):
        log.subscribe(dispatch="later")


def test_alerts_and_residency(spark, tmp_path):
    rows = [("w", "k", 10, f"2024-01-01 00:00:{s:02d}") for s in (0, 2, 4, 5, 6, 11, 12)] + [("w", "k", 3, "2024-01-01 00:00:30"), ("v", "j", 9, "2024-01-01 00:00:01"), ("w", "j", 8, "2024-01-01 00:00:05")]
    df = spark.createDataFrame(rows, "scope string, key string, total long, t string").selectExpr("scope", "key", "total", "CAST(t AS TIMESTAMP) AS ts")
    df.coalesce(1).write.parquet(str(tmp_path / "t"))
    drained(events.over_budget_alerts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "t")), {"k": 5, "j": 7}), "alerts")
    got = sorted((r.scope, r.ts.second, r.over) for r in spark.table("alerts").collect())
    assert got == [("v", 1, ["j"]), ("w", 0, ["k"]), ("w", 5, ["j", "k"]), ("w", 11, ["k"])]
    frames = spark.createDataFrame([(0, 1, ["a", "b"]), (0, 2, ["b", "c"]), (0, 3, []), (1, 1, ["z"])], "ring int, frame long, keys array<string>")
    frames.coalesce(1).write.parquet(str(tmp_path / "f"))
    drained(events.residency(spark.readStream.schema(frames.schema).parquet(str(tmp_path / "f"))), "residency")
    got = sorted((r.ring, r.frame, r.loads, r.evicts) for r in spark.table("residency").collect())
    assert got == [(0, 1, ["a", "b"], []), (0, 2, ["c"], ["a"]), (0, 3, [], ["b", "c"]), (1, 1, ["z"], [])]


def test_usage_history(spark, tmp_path):
    keep = events.usage_history(str(tmp_path / "h"), 3)
    for n in range(6):
        keep(spark.createDataFrame([("k", n)], "key string, total int"), n)
    assert {r.total for r in spark.read.parquet(str(tmp_path / "h")).collect()} == {3, 4, 5}
    lines = spark.createDataFrame([("WARN", "a"), ("INFO", "b"), ("ERROR", "c")], "level string, line string")
    events.routed(lines, str(tmp_path / "out"), str(tmp_path / "err"))
    assert {r.value for r in spark.read.text(str(tmp_path / "err")).collect()} == {"a", "c"} and spark.read.text(str(tmp_path / "out")).first().value == "b"
