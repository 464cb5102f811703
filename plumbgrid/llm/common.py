"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from ..lineage import cut_lineage, qualified, release, scratch, shared_dir, shared_path  # noqa: F401

#: One word after A-Z are lower-cased; written for the text before lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: What stands between two such words; single characters match faster than ranges.
GAP = "[" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"
#: What stands between words that white space delimits.
SPACE = r"[\x20\x09\x0A\x0B\x0C\x0D]+"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """A column by its whole name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    return F.struct(*[column(c).alias(c) for c in df.columns])


def schema_of(name: str, kind: DataType, rest: str) -> StructType:
    """A column of a given type, then those of a DDL string. Names in nested types can't be spelled in DDL, so the type is passed on."""
    return StructType([StructField(name, kind), *StructType.fromDDL(rest).fields])


def file_system(path: str):
    """The Arrow file system and the path on it of a URI, on the driver or in a task, without a JVM."""
    from pyarrow import fs

    return fs.FileSystem.from_uri("s3://" + path.split("://", 1)[1] if path.startswith(("s3a://", "s3n://")) else path)


def open_file(path: str, mode: str = "rb"):
    store, place = file_system(path)
    if mode == "rb":
        return store.open_input_file(place)
    store.create_dir(place.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(place)


def trimmed(run):
    """A function of batches after which the worker gives its free memory back: workers live on between stages, and what one stage freed would count beside the next one's."""

    def wrapped(batches):
        import ctypes

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


def text_or_empty(col: str | Column) -> Column:
    """Null texts count as empty."""
    col = column(col) if isinstance(col, str) else col
    return F.coalesce(col.cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of lower-cased words, perhaps with empty strings at its ends."""
    return F.split(F.lower(text), GAP, -1)


def count_words(text: Column, gap: str) -> Column:
    """How many words stand between gaps. Splitting is far cheaper than extracting matches: no copy of the text for each."""

    def inner(parts: Column) -> Column:
        empty = lambda at: F.when(F.element_at(parts, at) == "", 1).otherwise(0)
        return F.size(parts) - empty(1) - empty(-1)

    return F.when(F.length(text) == 0, F.lit(0)).otherwise(F.get(F.transform(F.array(F.split(text, gap, -1)), inner), F.lit(0))).cast("long")
