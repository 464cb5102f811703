"""Jobs and their dependencies as tables: readiness, order, counts, lifetimes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DONE = "completed"
#: States that a job does not leave.
TERMINAL = ("completed", "failed", "cancelled")


def ready(jobs: DataFrame, deps: DataFrame) -> DataFrame:
    """Jobs (id, status, ...) none of whose dependencies (id, depends_on) is a known job that is not completed.

    A dependency on a job that is not in the table counts as satisfied; one that failed or was cancelled blocks until
    it is swept.
    """
    open_ = jobs.where(F.col("status") != DONE).select(F.col("id").alias("depends_on"))
    blocked = deps.join(open_, "depends_on", "left_semi").select("id")
    return jobs.join(blocked, "id", "left_anti")


def next_jobs(jobs: DataFrame, n: int = 1) -> DataFrame:
    """The first n by priority (0 first), then by order of submission."""
    return jobs.orderBy("priority", "seq", "id").limit(n)


def queue_depth(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("priority").agg(F.count("*").alias("n"))


def totals(jobs: DataFrame) -> DataFrame:
    """queued, running, completed."""
    return jobs.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("queued", "running", DONE)])


def swept(jobs: DataFrame, now_ms: int, ttl_ms: int = 60_000) -> DataFrame:
    """Jobs less those that ended more than the time to live ago."""
    gone = F.col("status").isin(*TERMINAL) & (F.lit(now_ms) - F.col("ended_ms") > ttl_ms)
    return jobs.where(~F.coalesce(gone, F.lit(False)))


def pending(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is wanted and not done yet."""
    return wanted.dropDuplicates(keys).join(done, keys, "left_anti")
