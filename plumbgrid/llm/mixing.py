"""Mixing sources to target weights: hash-random order within each source, prefix sums of sizes, exact cuts.

Each row gets a random key, the leading 32 bits of the MD5 of its id and text. Within a source rows stand in the
order of their keys, which is dealt into buckets of about ``bucket_rows`` rows by the key's leading part. Sizes are
summed per source and bucket, and per run of ``FAN`` buckets; the runs' sums are added up along each source, the
buckets' along their run, and a window adds up the rows of one bucket. So no task holds a source, however large: the
longest windows are a bucket's rows, a run's buckets and a source's runs (one for eight million rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, column, count_words, cut_lineage, load, text_or_empty, whole_row

#: Weights of the sources in their order, repeating; share of all sizes; most epochs.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2.0
_KEYS = 1 << 32
#: Buckets of a run, whose sums one window adds up.
FAN = 4096


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> dict[str | None, float]:
    """Words to take from each source: by weight, at most `epochs` times its size, the excess shared anew by weight until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    most = {s: epochs * sizes[s] for s in names}
    out: dict[str | None, float] = {}
    left, open_ = share * sum(sizes.values()), list(names)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        if not (full := [s for s in open_ if unit * weight[s] > most[s]]):
            out |= {s: unit * weight[s] for s in open_}
            break
        for s in full:
            out[s] = most[s]
            left -= most[s]
        open_ = [s for s in open_ if s not in full]
    return out


def random_key(doc_id: Column, text: Column) -> Column:
    """A number below 2**32 from the row alone, so that reruns agree."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", doc_id.cast("string"), text)), 1, 8), 16, 10).cast("long")


def _offsets(sums: DataFrame) -> DataFrame:
    """(__s, __b, offset) of sums (source, bucket, s): what stands before each bucket in its source."""
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("run", F.floor(F.col("bucket") / FAN))
    runs = sums.groupBy("source", "run").agg(F.sum("s").alias("r"))
    runs = runs.select(F.col("source").alias("__o"), F.col("run").alias("__r"), before(Window.partitionBy("source").orderBy("run"), "r").alias("far"))
    near = sums.select("source", "bucket", "run", before(Window.partitionBy("source", "run").orderBy("bucket"), "s").alias("near"))
    joined = near.join(runs, F.col("source").eqNullSafe(F.col("__o")) & (F.col("run") == F.col("__r")))
    return joined.select(F.col("source").alias("__s"), F.col("bucket").alias("__b"), (F.col("near") + F.col("far")).alias("offset"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, bucket_rows: int = 2000) -> DataFrame:
    """One row per row of `docs`: the id, source, size, source_size, target, taken, __key.

    `taken` counts the words that the mix takes from the row, repeats counted: all its words in each whole epoch,
    and in the last epoch those before the source's budget ends, so that a source's sum is its target rounded
    down. Null texts and texts without words have size 0 and give nothing. Null sources form one source, which
    stands last. Rows that agree in id and text stand next to each other in a source. The number of sources must
    fit the driver; they are counted there (one row each). Other columns of `docs` are ignored.
    """
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    rows = docs.select(column(id_col).alias("doc"), column(source_col).cast("string").alias("source"), count_words(text, SPACE).alias("size"), random_key(column(id_col), text).alias("key"))
    rows = cut_lineage(rows, "mix")
    per_source = {r.source: (r.size, r.n) for r in rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
    goal = targets({s: size for s, (size, _) in per_source.items()}, weights, share, epochs)
    plan = [(s, size, float(goal[s]), max(1, n // bucket_rows)) for s, (size, n) in per_source.items()]
    plan = spark.createDataFrame(plan, "source string, source_size long, target double, buckets long")
    rows = rows.join(F.broadcast(plan.withColumnRenamed("source", "__s")), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    rows = rows.withColumn("bucket", F.floor(F.col("key") * F.col("buckets") / F.lit(_KEYS)))
    sums = _offsets(rows.groupBy("source", "bucket").agg(F.sum("size").alias("s")))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("__s")) & (F.col("bucket") == F.col("__b")))
    inside = Window.partitionBy("source", "bucket").orderBy("key", F.col("doc"), "size").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.floor(F.col("target")) - whole * F.col("source_size")
    part = F.least(F.greatest(rest - first, F.lit(0)), F.col("size"))
    return rows.select(F.col("doc").alias(id_col), "source", "size", "source_size", "target", (whole * F.col("size") + part).cast("long").alias("taken"), F.col("key").alias("__key"))


def mixed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The rows that the mix takes, with all their columns: one row for each whole epoch, and one with the words before the budget's end.

    Rows that agree in id, source and text get the same number of rows in all as `mix` gives them, dealt evenly
    by its sums: they are numbered alike on both sides. Rows of which nothing is taken go.
    """
    columns = docs.columns
    text = text_or_empty(text_col)
    key = [column(id_col).cast("string").alias("__i"), F.xxhash64(text).alias("__h"), column(source_col).cast("string").alias("__o")]
    taken = mix(docs, id_col, text_col, source_col, **settings)
    taken = taken.select(column(id_col).cast("string").alias("__i"), "__key", F.col("source").alias("__o"), "size", "taken")
    taken = taken.withColumn("__n", F.row_number().over(Window.partitionBy("__i", "__key", "__o").orderBy("taken")))
    rows = docs.select(whole_row(docs).alias("__row"), *key, random_key(column(id_col), text).alias("__key"))
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("__i", "__key", "__o").orderBy("__h")))
    taken = taken.select(*[F.col(c).alias(f"t{c}") for c in ("__i", "__key", "__o", "__n")], "size", "taken")
    same = F.lit(True)
    for c in ("__i", "__key", "__o", "__n"):
        same = same & F.col(c).eqNullSafe(F.col(f"t{c}"))
    joined = rows.join(taken.where("taken > 0"), same)
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    joined = joined.select("__row", "size", "taken", F.explode(F.sequence(F.lit(1), times)).alias("__epoch"))
    words = F.least(F.col("taken") - (F.col("__epoch") - 1) * F.col("size"), F.col("size"))
    whole = F.col("__row")[text_col]
    cut = F.when(words == F.col("size"), whole).otherwise(F.concat_ws(" ", F.slice(F.filter(F.split(whole, SPACE, -1), lambda w: w != ""), F.lit(1), words.cast("int"))))
    return joined.select(*[cut.alias(c) if c == text_col else F.col("__row")[c].alias(c) for c in columns])


def op6_mix(spark, sf_dir):
    return mix(load(spark, sf_dir, "documents")).drop("__key", "source")

