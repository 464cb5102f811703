"""Embedding near-duplicates by a subspace pigeonhole join.

Vectors are scaled to length 1, so a cosine of c or more is a squared distance of D = 2 - 2c or less. A fixed
random rotation spreads a vector's length evenly, and its coordinates are split into m blocks. If two vectors are
within D, then in some block they are within that block's share of D, by its number of coordinates: every pair is
a candidate in some block.

Vectors are dealt into tiles of about ``tile`` by a k-d tree over the rotated coordinates, whose cuts come from a
sample of at most ``SAMPLE`` vectors; a leaf that turns out larger is dealt into several tiles. Tiles are files of the
shared folder, with their bounds in every coordinate. A row of the plan is a tile and a run of others; its task leaves
out those that are beyond the share in every block, by their bounds, and compares the rest: in each block a matrix
product finds the pairs within the share, and the union of these candidates is verified in all coordinates in double
precision. It returns sums and least members, never pairs. Every vector is shuffled once, and rows of the plan, not
of vectors, grow with the square of the tiles.

Equal vectors are one with a multiplicity from the start. For vectors without structure every exact method
compares a fixed share of all pairs at this radius: work grows with the square of the different vectors.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut_lineage, file_system, load, release, scratch, shared_path, trimmed
from .components import components, union

COSINE = 0.9
BLOCKS = 4
TILE = 4096
#: Tiles that a row of the plan compares its own with, and vectors that the tree's cuts are taken from.
RUN, SAMPLE = 8, 1 << 15
#: What rounding may add to a squared distance of vectors of length 1.
SLACK = 1e-9


@lru_cache(4)
def rotation(dims: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def splits(dims: int, blocks: int) -> list[tuple[int, int]]:
    edges = np.linspace(0, dims, min(blocks, dims) + 1).astype(int).tolist()
    return list(zip(edges, edges[1:], strict=False))


def rotated(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in rotated coordinates; einsum, so that a vector's numbers don't depend on those beside it."""
    unit = vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]
    return np.einsum("ij,jk->ik", unit, rotation(vectors.shape[1]))


class Tile:
    """Vectors with their numbers, multiplicities and rotated forms, and for each block what a matrix product needs to hold pairs against its share."""

    def __init__(self, node: np.ndarray, n: np.ndarray, vectors: np.ndarray, cosine: float, blocks: int):
        self.node, self.n, self.vectors = node, n, vectors
        self.norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        x = rotated(vectors)
        self.low, self.high = x.min(0), x.max(0)
        self.left, self.right = [], []
        for (lo, hi), share in zip(splits(vectors.shape[1], blocks), shares(vectors.shape[1], cosine, blocks), strict=True):
            b = x[:, lo:hi].astype(np.float32)
            half, one = ((b * b).sum(1) / 2)[:, None], np.ones((len(b), 1), np.float32)
            # left @ right.T is (share - squared distance) / 2, and what rounding may take from it
            self.left.append(np.hstack([b, share / 2 + 1e-4 - half, one]).astype(np.float32))
            self.right.append(np.hstack([b, one, -half]).astype(np.float32))


def shares(dims: int, cosine: float, blocks: int) -> list[float]:
    return [(2 - 2 * cosine) * (hi - lo) / dims + SLACK for lo, hi in splits(dims, blocks)]


def reachable(low_a, high_a, low_b, high_b, cosine: float, blocks: int) -> list[int]:
    """The blocks in which boxes with these bounds are within the share."""
    gap = np.maximum(0, np.maximum(low_a - high_b, low_b - high_a)) ** 2
    return [k for k, ((lo, hi), share) in enumerate(zip(splits(len(gap), blocks), shares(len(gap), cosine, blocks), strict=True)) if gap[lo:hi].sum() <= share]


def linked(a: Tile, b: Tile, near: list[int], cosine: float, strip: int = 512):
    """(first row, matrix) of strips of a: which rows of b each row is linked with; of a tile with itself, the later rows only."""
    for at in range(0, len(a.node), strip):
        rows = slice(at, at + strip)
        found = np.zeros((len(a.node[rows]), len(b.node)), bool)
        for k in near:
            found |= a.left[k][rows] @ b.right[k].T >= 0
        if a is b:
            found &= np.arange(len(b.node)) > np.arange(at, at + len(found))[:, None]
        many = int(found.sum())
        if many > found.size // 32:  # the exact check of all at once; near the limit, pair by pair as below
            cosines = a.vectors[rows] @ b.vectors.T / (a.norm[rows][:, None] * b.norm)
            unsure = found & (np.abs(cosines - cosine) < 1e-9)
            found &= cosines >= cosine
        else:
            unsure = found.copy() if many else found
        i, j = np.nonzero(unsure)
        for part in range(0, len(i), 1 << 17):
            p, q = i[part : part + (1 << 17)], j[part : part + (1 << 17)]
            exact = np.einsum("ij,ij->i", a.vectors[rows][p], b.vectors[q]) / (a.norm[rows][p] * b.norm[q])
            found[p, q] = exact >= cosine
        if found.any():
            yield at, found


def compare(a: Tile, b: Tile, near: list[int], cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, links, least node of its class) of the rows of both tiles that are linked."""
    same = a is b
    node = a.node if same else np.concatenate([a.node, b.node])
    order = np.argsort(node, kind="stable")  # the least member of a class stands for it
    rank = np.empty(len(node), np.int64)
    rank[order] = np.arange(len(node))
    of_b = rank if same else rank[len(a.node) :]
    links, labels = np.zeros(len(node), np.int64), np.arange(len(node))
    for at, found in linked(a, b, near, cosine):
        of_a = rank[at : at + len(found)]
        links[of_a] += found @ b.n
        links[of_b] += a.n[at : at + len(found)] @ found
        apart = found
        while apart.any():  # of each row and column one link between different classes, until there is none
            i, j = np.flatnonzero(apart.any(1)), np.flatnonzero(apart.any(0))
            union(labels, of_a[i], of_b[apart.argmax(1)[i]])
            union(labels, of_a[apart.argmax(0)[j]], of_b[j])
            apart = found & (labels[of_a][:, None] != labels[of_b])
    some = np.flatnonzero(links)
    return node[order][some], links[some], node[order][labels[some]]


def cuts(sample: np.ndarray, leaves: int) -> list[tuple[int, float]]:
    """A k-d tree as a heap of (coordinate, value): each node halves its part of the sample (rotated) along the widest coordinate."""
    tree, parts = [], [sample]
    while len(parts) < leaves:
        halves = []
        for part in parts:
            axis = int(part.var(0).argmax()) if len(part) else 0
            value = float(np.median(part[:, axis])) if len(part) else 0.0
            tree.append((axis, value))
            halves += [part[part[:, axis] <= value], part[part[:, axis] > value]]
        parts = halves
    return tree


def leaf_of(x: np.ndarray, tree: list[tuple[int, float]]) -> np.ndarray:
    at = np.zeros(len(x), np.int64)
    if tree:
        axis, value = np.array([t[0] for t in tree]), np.array([t[1] for t in tree])
        while at[0] < len(tree):  # all leaves are equally deep
            at = 2 * at + 1 + (x[np.arange(len(x)), axis[at]] > value[at])
    return at - len(tree)


def _deal(trees: dict[int, list]):
    """Adds to (node, n, dims, embedding) the leaf."""

    def run(batches):
        for batch in batches:
            dims = batch.column(2).to_numpy()
            leaf = np.zeros(len(dims), np.int64)
            for size in np.unique(dims).tolist():
                if trees.get(size):
                    at = np.flatnonzero(dims == size)
                    vectors = batch.column(3).take(pa.array(at)).flatten().to_numpy().reshape(len(at), size)
                    leaf[at] = leaf_of(rotated(vectors), trees[size])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=["node", "n", "dims", "embedding", "leaf"])

    return run


def _load(folder: str, dims: int, tile: int, cosine: float, blocks: int) -> Tile:
    store, root = file_system(folder)
    table = pq.read_table(f"{root}/dims={dims}/tile={tile}", columns=["node", "n", "embedding"], filesystem=store, partitioning=None)
    vectors = table["embedding"].combine_chunks().flatten().to_numpy().reshape(-1, dims)
    order = np.argsort(table["node"].to_numpy())
    return Tile(table["node"].to_numpy()[order], table["n"].to_numpy()[order], vectors[order], cosine, blocks)


_LINKS = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("to", pa.int64())])
_BOUNDS = "dims int, tile int, low array<double>, high array<double>"


def _bounds(folder: str, cosine: float, blocks: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                t = _load(folder, row["dims"], row["tile"], cosine, blocks)
                yield pa.RecordBatch.from_pydict({"dims": pa.array([row["dims"]], pa.int32()), "tile": pa.array([row["tile"]], pa.int32()), "low": [t.low], "high": [t.high]})

    return run


def _compared(folder: str, bounds: str, cosine: float, blocks: int):
    """For rows (dims, tile, tiles, first): the links of the tile with those that stand `first` to `first` + RUN - 1 behind it, around the circle of all."""

    def run(batches):
        known: dict[int, tuple] = {}
        for batch in batches:
            for row in batch.to_pylist():
                dims, i, tiles = row["dims"], row["tile"], row["tiles"]
                if dims not in known:
                    store, root = file_system(bounds)
                    table = pq.read_table(root, filesystem=store, partitioning=None, filters=[("dims", "=", dims)])
                    order = np.argsort(table["tile"].to_numpy())
                    known[dims] = tuple(table[c].combine_chunks().flatten().to_numpy().reshape(tiles, dims)[order] for c in ("low", "high"))
                low, high = known[dims]
                own = None
                for step in range(row["first"], min(row["first"] + RUN, tiles // 2 + 1)):
                    if step and 2 * step == tiles and i >= step:
                        continue  # two tiles that face each other on the circle meet once
                    j = (i + step) % tiles
                    if near := reachable(low[i], high[i], low[j], high[j], cosine, blocks):
                        own = own or _load(folder, dims, i, cosine, blocks)
                        node, links, to = compare(own, own if j == i else _load(folder, dims, j, cosine, blocks), near, cosine)
                        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(links), pa.array(to)], schema=_LINKS)

    return run


def links(one: DataFrame, cosine: float, blocks: int, tile: int) -> DataFrame:
    """(node, links, to) of vectors (node, n, embedding), from every pair of tiles: multiplicities of linked vectors, and a node of the same class."""
    spark = one.sparkSession
    rows = one.select("node", "n", F.size("embedding").alias("dims"), "embedding")
    counts = {r.dims: r["count"] for r in rows.groupBy("dims").count().collect()}
    trees = {}
    for dims, n in counts.items():
        if n > tile:
            share = min(1.0, SAMPLE / n)
            some = rows.where((F.col("dims") == dims) & (F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int(share * (1 << 30)))).select("embedding")
            sample = some.toArrow()["embedding"].combine_chunks().flatten().to_numpy().reshape(-1, dims)
            if len(sample):
                trees[dims] = cuts(rotated(sample), 1 << max(0, (-(-n // tile) - 1).bit_length()))
    dealt = cut_lineage(rows.mapInArrow(trimmed(_deal(trees)), "node long, n long, dims int, embedding array<double>, leaf long"), "dealt")
    # a row a leaf: tiles are numbered leaf by leaf
    placed, tiles = [], dict.fromkeys(counts, 0)
    for dims, leaf, n in sorted(map(tuple, dealt.groupBy("dims", "leaf").count().collect())):
        chunks = -(-n // (2 * tile)) if n > 2 * tile else 1
        placed.append((dims, leaf, tiles[dims], chunks))
        tiles[dims] += chunks
    places = spark.createDataFrame(placed, "dims int, leaf long, first int, chunks int")
    dealt_to = dealt.join(F.broadcast(places), ["dims", "leaf"])
    dealt_to = dealt_to.withColumn("tile", F.col("first") + F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).select("dims", "tile", "node", "n", "embedding")
    folder = shared_path(spark, "tiles")
    dealt_to.repartition("dims", "tile").write.partitionBy("dims", "tile").parquet(folder)
    release(dealt)
    known = dealt_to.sparkSession.createDataFrame([(d, t, n) for d, n in tiles.items() for t in range(n)], "dims int, tile int, tiles int")
    bounds = shared_path(spark, "bounds")
    parts = max(1, min(sum(tiles.values()), 2000))
    known.repartition(parts).mapInArrow(trimmed(_bounds(folder, cosine, blocks)), _BOUNDS).write.parquet(bounds)
    plan = known.select("*", F.explode(F.sequence(F.lit(0), F.expr("tiles div 2").cast("int"), F.lit(RUN))).alias("first"))
    rows_of_plan = sum(n * (n // 2 // RUN + 1) for n in tiles.values())
    return plan.repartition(max(1, min(rows_of_plan, 10_000))).mapInArrow(trimmed(_compared(folder, bounds, cosine, blocks)), "node long, links long, to long")


def embedding_groups(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """One row per row of `table`: the id, n_links (other rows with a cosine of `cosine` or more), component_id, kept.

    Vectors that are null, zero, or hold null or non-finite components, link with nothing, nor do vectors of
    different sizes. Rows with equal vectors link with each other. component_id is the least id that links reach,
    the row's own included. Repeated rows are rows of their own. Other columns are ignored.
    """
    rows = table.select(column(id_col).alias("id"), column(vector_col).cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("fine", F.coalesce(F.col("embedding").isNotNull() & fine, F.lit(False)))
    with scratch(table.sparkSession) as keep:
        one = rows.where("fine").groupBy("embedding").agg(F.count("*").alias("n"), F.min("id").alias("least"))
        one = cut_lineage(one.withColumn("node", F.monotonically_increasing_id()), "vectors")
        found = cut_lineage(links(one.select("node", "n", "embedding"), cosine, blocks, tile), "links")
        sums = found.groupBy("node").agg(F.sum("links").alias("links"))
        roots = components(found.select(F.col("node").alias("a"), F.col("to").alias("b")))
        known = one.join(sums, "node", "left").join(roots, "node", "left").select("embedding", "n", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
        known = cut_lineage(known, "known")
        least = known.groupBy("root").agg(F.min("least").alias("component"))
        known = keep(cut_lineage(known.join(least, "root").select(F.col("embedding").alias("v"), (F.col("links") + F.col("n") - 1).alias("links"), "component"), "classes"))
    joined = rows.join(known, F.col("fine") & (F.col("embedding") == F.col("v")), "left")
    component = F.coalesce("component", "id")
    return joined.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op4_embedding_groups(spark, sf_dir):
    return embedding_groups(load(spark, sf_dir, "embeddings"))
