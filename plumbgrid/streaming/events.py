"""Structured Streaming forms of the event operators; each has a batch form in operators.store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalar import to_stderr
from ..operators.store import matched_changes, published, recent

READINGS = "system string, key string, value long, ts timestamp, coalesced boolean"


def change_matches(changes: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """STR02, JOIN07: a stream of changes against the table of subscriptions."""
    return matched_changes(changes, subscriptions)


def coalesced_usage(readings: DataFrame, gap_ms: int = 100) -> DataFrame:
    """STR03: readings (system, key, value, ts) of a system and key; one less than the gap after the last published is marked as coalesced.

    State is the time of the last published reading of each system and key; it goes an hour after the last one.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        close = []
        for at in (rows.ts.astype("datetime64[us]").astype("int64") // 1000).tolist():
            close.append(last is not None and at - last < gap_ms)
            last = last if close[-1] else at
        state.update((last,))
        state.setTimeoutDuration(3_600_000)
        yield pd.DataFrame({"system": key[0], "key": key[1], "value": rows.value, "ts": rows.ts, "coalesced": close})

    return readings.groupBy("system", "key").applyInPandasWithState(update, READINGS, "last long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def running_totals(readings: DataFrame) -> DataFrame:
    """STR06: totals of each key, as the stream goes on (update or complete mode)."""
    return readings.groupBy("key").agg(F.sum("value").alias("total"))


def open_resources(events: DataFrame) -> DataFrame:
    """STR10: registrations (rid, delta of 1 or -1) that are open."""
    return events.groupBy("rid").agg(F.sum("delta").alias("open")).where("open > 0")


def windowed_usage(readings: DataFrame, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Totals by event time; an addition, the model's events have no windows."""
    return readings.withWatermark("ts", late).groupBy(F.window("ts", size), "key").agg(F.sum("value").alias("total")).select("window.start", "key", "total")


class ChangeLog:
    """STR01, STR02: a folder of published changes with rising ids, and the subscriptions that hear them.

    `publish` is a foreachBatch function: a batch's changes get ids behind the last one, in the order of their columns.
    A batch that runs again after a failure replaces what it wrote: its rows lie in a folder of its own number.
    """

    def __init__(self, folder: str, order: list[str]):
        self.folder, self.order, self.subscriptions = folder, order, {}

    def publish(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = 0
        if (log := self._read(spark)) is not None:
            last = log.where(F.col("batch") < number).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        published(batch, self.order, last + 1).withColumn("at", F.current_timestamp()).write.mode("overwrite").parquet(f"{self.folder}/batch={number}")

    def _read(self, spark) -> DataFrame | None:
        place = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            return None
        return spark.read.parquet(self.folder)

    def history(self, spark, n: int = 1000) -> DataFrame:
        """The last n changes, in order."""
        return recent(self._read(spark), n)

    def subscribe(self, sources: list[str] = (), region: tuple[float, float, float, float] | None = None, dispatch: str = "sync") -> int:
        if dispatch not in ("sync", "async", "job"):
            raise ValueError(f"dispatch is sync, async or job, not {dispatch!r}")
        number = max(self.subscriptions, default=0) + 1
        self.subscriptions[number] = (list(sources), region or (None,) * 4, dispatch)
        return number

    def unsubscribe(self, number: int) -> bool:
        return self.subscriptions.pop(number, None) is not None

    def table(self, spark) -> DataFrame:
        """(sub_id, sources, sx0, sz0, sx1, sz1, dispatch); numbers are never given twice while they are held."""
        rows = [(k, s, *r, d) for k, (s, r, d) in self.subscriptions.items()]
        return spark.createDataFrame(rows, "sub_id long, sources array<string>, sx0 double, sz0 double, sx1 double, sz1 double, dispatch string")


def usage_history(folder: str, most: int = 600):
    """STR06: a foreachBatch function that adds the totals after each batch to a folder, and keeps the last `most` batches."""

    def run(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/snapshot={number}")
        spark = batch.sparkSession
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/snapshot={number - most}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return run


def over_budget_alerts(totals: DataFrame, budgets: dict[str, int], gap_ms: int = 5000) -> DataFrame:
    """STR05: of totals (scope, key, total, ts) as they come, the moments over budget that are `gap_ms` or more behind the last alert of their scope: scope, ts, over (the keys, sorted).

    State is the last alert of each scope; it goes an hour after the last reading.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches))
        rows = rows[[t > budgets.get(k, t) for k, t in zip(rows.key, rows.total, strict=True)]]
        found = []
        for ts, part in rows.groupby("ts", sort=True):
            at = int(pd.Timestamp(ts).timestamp() * 1000)
            if last is None or at - last >= gap_ms:
                found.append((key[0], ts, sorted(set(part.key))))
                last = at
        if last is not None:
            state.update((last,))
            state.setTimeoutDuration(3_600_000)
        yield pd.DataFrame(found, columns=["scope", "ts", "over"])

    return totals.groupBy("scope").applyInPandasWithState(update, "scope string, ts timestamp, over array<string>", "last long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def residency(required: DataFrame) -> DataFrame:
    """STR07: loads and evicts of a stream of required pages (ring, frame, keys: array<string>), a row a frame: ring, frame, loads, evicts.

    State is the set of each ring, of a window's bounded size; frames of a ring are taken in order within a batch.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = set(state.get[0]) if state.exists else set()
        found = []
        for row in pd.concat(list(batches)).sort_values("frame").itertuples(index=False):
            now = set(row.keys)
            found.append((key[0], row.frame, sorted(now - held), sorted(held - now)))
            held = now
        state.update((sorted(held),))
        yield pd.DataFrame(found, columns=["ring", "frame", "loads", "evicts"])

    return required.select("ring", "frame", "keys").groupBy("ring").applyInPandasWithState(update, "ring int, frame long, loads array<string>, evicts array<string>", "held array<string>", "append", GroupStateTimeout.NoTimeout)


def routed(lines: DataFrame, out: str, err: str):
    """SNK06: a foreachBatch function's work: warnings and errors (level, line) to one folder of text, the others to another."""
    lines.where(to_stderr(F.col("level"))).select("line").write.mode("append").text(err)
    lines.where(~to_stderr(F.col("level"))).select("line").write.mode("append").text(out)
