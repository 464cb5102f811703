"""Tables in the folder that driver and executors share, which end a plan's lineage, and their removal."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_made: list[str] = []
_scopes: list[list[str]] = []


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """A path as Spark resolves it: one without a scheme lies on the default file system, not on each machine's disk."""
    place, store = _hadoop(spark, path)
    uri = store.makeQualified(place).toString()
    return "file://" + uri[len("file:") :] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a temporary folder serves a local master only; on a cluster each executor would see its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir is unset: with the master {master}, tables need a folder that all executors reach")
        if not (found := getattr(shared_dir, "own", None)):
            found = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="plumbgrid-")
    return qualified(spark, found).rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/plumbgrid-{tag}-{uuid.uuid4().hex}"
    (_scopes[-1] if _scopes else _made).append(path)
    return path


def cut_lineage(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again, so that a lost executor costs no recomputation of what led to it."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place, store = _hadoop(spark, path)
    store.delete(place, True)


def release(*tables: DataFrame) -> None:
    """Delete the files of tables that cut_lineage returned and that no plan reads any more."""
    for df in tables:
        if path := _paths.pop(df, None):
            _delete(df.sparkSession, path)
            for held in (_made, *_scopes):
                if path in held:
                    held.remove(path)


def release_all(spark: SparkSession) -> None:
    """Delete all tables of this session that are left; for the end of a job, when its results are stored."""
    while _made:
        _delete(spark, _made.pop())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables made inside are deleted at the end, but for those that the yielded function is given."""
    made: list[str] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(_paths[df])
        return df

    _scopes.append(made)
    try:
        yield keep
    finally:
        _scopes.remove(made)
        for path in made:
            if path in kept:
                (_scopes[-1] if _scopes else _made).append(path)
            else:
                _delete(spark, path)
