"""SimHash near-duplicates, found by covering locality-sensitive hashing.

A text's fingerprint has a bit set where more than half of its shingles' hashes have it set. To find all pairs of
fingerprints that differ in at most r bits, each bit position is given a vector of r + 1 bits. For each of the
2**(r+1) - 1 vectors v other than zero there is a table, whose key keeps the bits whose vector has an odd product
with v. The vectors of r differing bits leave some v that is even with all of them, so in that table the two keys
agree: no pair is missed.

Equal fingerprints are one class from the start. A table's bucket is compared whole by one task and yields the
least member for each class found in it, never pairs; a bucket of more than ``most`` members is dealt into chunks
whose pairs are compared by tasks of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut_lineage, load, schema_of, scratch, text_or_empty, trimmed, whole_row
from .components import components, union

SHINGLE = 4
SEED = 42
RADIUS = 4
MOST = 4096


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a text (UTF-8): A-Z lower-cased, words between white space, shingles with repeats; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    hash_ = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return hash_(b" ".join(words), seed)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - shingle].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    hashes = np.array([hash_(joined[s:e], seed) for s, e in zip(starts, stops, strict=True)], np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have set; a block of hashes is unpacked at a time."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        block = np.ascontiguousarray(hashes[at : at + (1 << 14)].astype("<u8")).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc, fp) for each row; fp is the fingerprint as a signed long. Null texts have no words."""
    rows = docs.select(column(id_col).alias("doc"), column(text_col).cast("string").cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py() or b"", shingle, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc", "fp"])

    return rows.mapInArrow(trimmed(run), schema_of("doc", rows.schema["doc"].dataType, "fp long"))


def masks(radius: int = RADIUS) -> list[int]:
    """The tables' masks, as signed longs: with the vectors 1 to 2**(radius+1)-1 dealt over the bits in turn, each mask keeps about half the bits."""
    n = (1 << (radius + 1)) - 1
    vectors = [i * 11 % n + 1 for i in range(64)]
    found = [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() & 1) for v in range(1, n + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def _links(fps: np.ndarray, radius: int, strip: int = 512) -> np.ndarray:
    """For each of some fingerprints the place of the least one (by place) in its class of linked ones."""
    values, labels = fps.view(np.uint64), np.arange(len(fps))
    for at in range(0, len(fps), strip):
        near = np.bitwise_count(values[at : at + strip, None] ^ values[None, at:]) <= radius
        i, j = np.nonzero(near)
        union(labels, i + at, j + at)
    return labels


def _bucket_edges(radius: int, most: int):
    """Batches (t, key, fp) sorted by bucket to edges (fp, least fp of its class), kind 0, and the rows of large buckets as they are, kind 1."""

    def out(a, b, t, kind):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(len(a), t) if np.isscalar(t) else t, pa.int32()), pa.array(np.full(len(a), kind), pa.int8())], names=["a", "b", "t", "kind"])

    def run(batches):
        t = key = fp = np.zeros(0, np.int64)
        large = None  # the bucket whose rows go through as they are
        for batch in batches:
            t, key, fp = (np.concatenate([x, batch.column(k).to_numpy(zero_copy_only=False)]) for k, x in enumerate((t, key, fp)))
            new = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            # the last bucket may go on in the next batch
            done = int(new[-1]) if len(new) else 0
            if large is not None:
                n = int(new[0]) if len(new) else len(t)
                if n and (t[0], key[0]) == large:
                    yield out(fp[:n], key[:n], t[:n], 1)
                    t, key, fp = t[n:], key[n:], fp[n:]
                    done = max(0, done - n)
                if len(t):
                    large = None
            yield from buckets(t[:done], key[:done], fp[:done])
            t, key, fp = t[done:], key[done:], fp[done:]
            if len(t) > most:
                large = (t[0], key[0])
                yield out(fp, key, t, 1)
                t = key = fp = np.zeros(0, np.int64)
        yield from buckets(t, key, fp)

    def buckets(t, key, fp):
        if len(t) < 2:
            return
        new = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (key[1:] != key[:-1])]))
        sizes = np.diff(np.append(new, len(t)))
        pairs = new[sizes == 2]
        near = np.bitwise_count(fp[pairs].view(np.uint64) ^ fp[pairs + 1].view(np.uint64)) <= radius
        p, q = fp[pairs][near], fp[pairs + 1][near]
        a, b = [np.maximum(p, q)], [np.minimum(p, q)]
        for s, n in zip(new[sizes > 2], sizes[sizes > 2], strict=True):
            if n > most:
                yield out(fp[s : s + n], key[s : s + n], t[s : s + n], 1)
                continue
            members = np.sort(fp[s : s + n])
            labels = _links(members, radius)
            apart = labels != np.arange(n)
            a.append(members[apart])
            b.append(members[labels[apart]])
        yield out(np.concatenate(a), np.concatenate(b), 0, 0)

    return run


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) whose components are those of all pairs within the radius."""
    tables = F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks(radius))])
    keyed = distinct.select("fp", F.explode(tables).alias("k")).select("k.t", "k.key", "fp")
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = keyed.repartition(parts, "t", "key").sortWithinPartitions("t", "key")
    schema = "a long, b long, t int, kind tinyint"
    found = cut_lineage(keyed.mapInArrow(trimmed(_bucket_edges(radius, most)), schema), "buckets")
    edges = found.where("kind = 0").select("a", "b")
    rest = found.where("kind = 1").select("t", F.col("b").alias("key"), F.col("a").alias("fp"))
    if rest.isEmpty():
        return edges
    half = most // 2
    chunks = rest.groupBy("t", "key").agg(F.ceil(F.count("*") / half).cast("int").alias("chunks"))
    rest = rest.join(chunks, ["t", "key"]).withColumn("c", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    # a row meets every chunk: (c, 0..chunks-1), the pair written smaller first
    rest = rest.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rest = rest.select("t", "key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "fp").repartition(parts, "t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")
    rest = rest.select(F.lit(0).alias("t"), F.xxhash64("t", "key", "i", "j").alias("key"), "fp")
    return edges.unionByName(rest.mapInArrow(trimmed(_bucket_edges(radius, 1 << 62)), schema).where("kind = 0").select("a", "b"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """One row per row of `docs`: the id, fingerprint (16 hex digits), component_id (least id that links reach).

    Null texts, and texts without words, have fingerprint zero, which links as any other. Repeated rows share
    their fingerprint. A null id never is a component's id unless all ids in it are null. Other columns are ignored.
    """
    with scratch(docs.sparkSession) as keep:
        known = keep(cut_lineage(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints"))
        distinct = cut_lineage(known.groupBy("fp").agg(F.min("doc").alias("least")), "distinct")
        roots = components(fingerprint_links(distinct, radius)).select(F.col("node").alias("fp"), "root")
        distinct = distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
        least = distinct.groupBy("root").agg(F.min("least").alias("component"))
        classes = keep(cut_lineage(distinct.select("fp", "root").join(least, "root").select(F.col("fp").alias("f"), "component"), "classes"))
    joined = known.join(classes, F.col("fp") == F.col("f"))
    return joined.select(F.col("doc").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of `docs`, with all their columns, that stand for their groups: one row each, with the least id (null before all), then the least hash of the text."""
    key = F.struct(column(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("h"))
    with scratch(docs.sparkSession) as keep:
        groups = simhash_groups(docs.select(key.alias("key"), column(text_col).alias("text")), "key", "text", **settings)
        stay = keep(cut_lineage(groups.where(F.col("key") == F.col("component_id")).select("key").distinct(), "stay"))
    rows = docs.select(whole_row(docs).alias("row"), key.alias("k"))
    same = F.col("k.id").eqNullSafe(F.col("key.id")) & (F.col("k.h") == F.col("key.h"))
    rows = rows.join(stay, same, "left_semi").select("row", F.col("k.id").alias("__id"), F.col("k.h").alias("__h"))
    return rows.dropDuplicates(["__id", "__h"]).select("row.*")


def op9_simhash(spark, sf_dir):
    return simhash_groups(load(spark, sf_dir, "documents"))
