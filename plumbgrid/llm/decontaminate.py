"""Benchmark decontamination by suffix arrays of the training texts.

Each task builds suffix arrays over shards of its texts: their words, numbered by the benchmark's vocabulary (0
for all other words, which match nothing), with a 0 after each text. The suffixes are ordered by prefix doubling
in steps of k words, k being as many numbers as fit 62 bits, until the order covers a whole window. Every suffix
of every test item is then looked up by binary search of its first window, step by step, which narrows an interval of
the suffix array: the places where the window stands. Windows that follow each other in the text form one longest
match.

The benchmark comes to the tasks in blocks of bounded size; a shard is held against one block after the other.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, load, open_file, schema_of, shared_path, trimmed, whole_row

WINDOW = 13
SHARD_WORDS = 1 << 19
#: Bytes of benchmark text that one pass sends to the tasks.
BLOCK_BYTES = 32 << 20
#: Every byte that belongs to no word becomes a space, A-Z become a-z.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class SuffixArray:
    """Suffixes of an array of word numbers below `base` (0 matches nothing), ordered by their first `depth` words or more."""

    def __init__(self, ids: np.ndarray, base: int, depth: int):
        self.bits = max(1, int(base - 1).bit_length())
        self.k = max(1, 62 // self.bits)
        n, k = len(ids), self.k
        padded = np.concatenate([ids.astype(np.int64), np.zeros(k, np.int64)])
        keys = np.zeros(n, np.int64)
        for i in range(k):
            keys = (keys << self.bits) | padded[i : n + i]
        self.levels: list[np.ndarray] = []  # distinct keys of each level, sorted
        rank = self._rank(keys)
        self.first = rank
        covered = k
        while covered < depth:
            after = np.zeros(n, np.int64)
            if covered < n:
                after[: n - covered] = self.first[covered:]
            # a suffix that ends before `covered` words has no words there; its shard ends in zeros anyway
            rank = self._rank(rank * len(self.levels[0]) + after)
            covered += k
        self.order = self.sorted

    def _rank(self, keys: np.ndarray) -> np.ndarray:
        self.sorted = np.argsort(keys)
        ranked = keys[self.sorted]
        new = np.empty(len(keys), bool)
        if len(keys):
            new[0] = True
            np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
        self.levels.append(ranked[new])
        rank = np.empty(len(keys), np.int64)
        rank[self.sorted] = np.cumsum(new) - 1
        #: where each rank starts in the order of this level
        self.bounds = np.append(np.flatnonzero(new), len(keys))
        return rank

    def _prefix(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Interval of first-level ranks whose keys start with the words of each row of `part` (at most k)."""
        low = np.zeros(len(part), np.int64)
        for i in range(part.shape[1]):
            low = (low << self.bits) | part[:, i]
        free = self.bits * (self.k - part.shape[1])
        low <<= free
        return np.searchsorted(self.levels[0], low), np.searchsorted(self.levels[0], low + (np.int64(1) << free))

    def find(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows of equally many words, at most the depth: the interval of `order` whose suffixes start with them."""
        length, k, m = queries.shape[1], self.k, len(self.levels[0])
        steps = [queries[:, at : at + k] for at in range(0, length, k)]
        lo, hi = self._prefix(steps[0])
        for level in range(1, len(self.levels)):
            keys = self.levels[level]
            if level < len(steps):  # so far one rank each, lo; narrowed by the next words
                a, b = self._prefix(steps[level])
                alive = hi > lo
                hi, lo = np.searchsorted(keys, lo * m + b), np.searchsorted(keys, lo * m + a)
                hi = np.where(alive, hi, lo)
            else:  # all words are matched: the interval is that of the longer ranks
                lo, hi = np.searchsorted(keys, lo * m), np.searchsorted(keys, hi * m)
        return self.bounds[lo], self.bounds[np.maximum(lo, hi)]


class Benchmark:
    """Items and their different windows, grouped by length (shorter than `window` only for short items).

    A window that several items hold, or one item more than once, is one query: the places where different windows of
    one length stand are disjoint, so that a text has at most as many matches as words, whatever repeats.
    """

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        self.window = window
        groups: dict[int, dict[tuple, dict[int, int]]] = {}
        for k, (_, text) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words((text or "").encode())]
            size = min(window, len(ids))
            group = groups.setdefault(size, {}) if size else {}
            for at in range(len(ids) - size + 1 if size else 0):
                group.setdefault(tuple(ids[at : at + size]), {}).setdefault(k, at)
        self.base = len(self.vocabulary) + 1
        #: by length: the windows, and for each of them, one after the other, its items and where it first stands in each
        self.groups = {}
        for size, group in groups.items():
            owners = [list(o.items()) for o in group.values()]
            flat = np.array([x for o in owners for x in o], np.int64).reshape(-1, 2)
            self.groups[size] = (np.array(list(group), np.int64), np.cumsum([0, *map(len, owners)]), flat[:, 0], flat[:, 1])

    def matches(self, ids: np.ndarray, at_once: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(item, place in the item, place in ids, words): the longest runs of ids each window of which stands in the item, by item and place."""
        found = [(np.zeros(0, np.int64),) * 5]
        if len(ids):
            array = SuffixArray(ids, self.base, min(self.window, max(self.groups, default=1)))
            for size, (queries, starts, item, at) in self.groups.items():
                lo, hi = array.find(queries)
                n = hi - lo
                row = np.repeat(np.arange(len(n)), n)
                place = array.order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                # occurrences by place, each with the items of its window; a part of bounded size at a time
                order = np.argsort(place)
                row, place = row[order], place[order]
                many = starts[row + 1] - starts[row]
                ends = np.cumsum(many)
                begin = 0
                while begin < len(row):
                    stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + at_once, "right")))
                    w, k = row[begin:stop], many[begin:stop]
                    of = np.repeat(starts[w], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                    p = np.repeat(place[begin:stop], k)
                    found.append(_longest(item[of], at[of], p, *[np.full(len(of), size)] * 2))
                    begin = stop
        return _longest(*(np.concatenate(x) for x in zip(*found, strict=True)))[:4]


def _longest(item, at, place, size, window):
    """Runs of one item, each of which begins where the window after the last one of the run before it would, joined."""
    order = np.lexsort((place, item))
    item, at, place, size, window = item[order], at[order], place[order], size[order], window[order]
    stop = place + size
    first = np.ones(len(item), bool)
    first[1:] = (item[1:] != item[:-1]) | (place[1:] != (stop - window)[:-1] + 1)
    starts = np.flatnonzero(first)
    last = np.append(starts[1:], len(item))[: len(starts)] - 1
    return item[starts], at[starts], place[starts], stop[last] - place[starts], window[starts]


_MATCH = pa.list_(pa.struct([("item", pa.string()), *((c, pa.int32()) for c in ("item_word", "word", "words"))]))
_SCANNED = "n_words long, n_hit long, items array<string>, matches array<struct<item:string,item_word:int,word:int,words:int>>"


def _scan(rows: DataFrame, blocks: list, window: int, shard_words: int) -> DataFrame:
    """doc, then _SCANNED, of each row of `rows` (doc, text as binary). `blocks` loads each block of the benchmark in turn."""

    def run(batches):
        held = {}

        def block(k):  # one block at a time stays prepared
            if k not in held:
                held.clear()
                held[k] = Benchmark(blocks[k](), window)
            return held[k]

        def shard(docs, texts):
            lengths = [len(t) for t in texts]
            starts = np.cumsum([0, *[n + 1 for n in lengths]])
            out, names = [[] for _ in texts], [set() for _ in texts]
            for b in range(len(blocks)):
                bench = block(b)
                get = bench.vocabulary.get
                flat = np.fromiter((x for t in texts for x in (*(get(w, 0) for w in t), 0)), np.int64, int(starts[-1]))
                item, at, place, size = bench.matches(flat)
                owner = np.searchsorted(starts, place, "right") - 1
                for k, i, a, p, n in zip(owner.tolist(), item.tolist(), at.tolist(), (place - starts[owner]).tolist(), size.tolist(), strict=True):
                    out[k].append({"item": bench.names[i], "item_word": a, "word": p, "words": n})
                    names[k].add(bench.names[i])
            hit = []
            for found in out:
                found.sort(key=lambda m: (m["word"], m["words"], m["item"] or ""))
                n = end = 0
                for m in found:  # in the order of their starts, each adding what it covers beyond those before
                    stop = m["word"] + m["words"]
                    n, end = n + max(0, stop - max(end, m["word"])), max(end, stop)
                hit.append(n)
            items = [sorted(x for x in s if x is not None) for s in names]
            columns = [pa.concat_arrays(docs), pa.array(lengths, pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(out, _MATCH)]
            return pa.RecordBatch.from_arrays(columns, names=["doc", "n_words", "n_hit", "items", "matches"])

        docs, texts, size = [], [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py()
                texts.append(words(text) if text else [])
                docs.append(batch.column(0).slice(k, 1))
                size += len(texts[-1]) + 1
                if size >= shard_words:
                    yield shard(docs, texts)
                    docs, texts, size = [], [], 0
        if texts:
            yield shard(docs, texts)

    return rows.mapInArrow(trimmed(run), schema_of("doc", rows.schema["doc"].dataType, _SCANNED))


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """The items in blocks of at most `block_bytes` (an item larger than that alone); only one is on the driver at a time."""
    rows = benchmark.select(column(item_col).cast("string").alias("name"), column(text_col).cast("string").alias("text")).distinct().orderBy("name", "text")
    block, size = [], 0
    for row in rows.toLocalIterator():
        n = len((row.text or "").encode())
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((row.name, row.text))
        size += n
    yield block


def _block_loaders(spark, blocks) -> list:
    """A function for each block that loads it in a task: one block is broadcast, more of them are files of the shared folder."""
    import pickle

    first, more = next(blocks), next(blocks, None)
    if more is None:
        shared = spark.sparkContext.broadcast(first)
        return [lambda: shared.value]
    folder, loaders = shared_path(spark, "benchmark"), []

    def loader(path):
        def load_block():
            with open_file(path) as source:
                return pickle.loads(source.read())

        return load_block

    for k, block in enumerate(itertools.chain([first, more], blocks)):
        path = f"{folder}/block-{k:06d}.pickle"
        with open_file(path, "wb") as sink:
            sink.write(pickle.dumps(block))
        loaders.append(loader(path))
    return loaders


def verbatim_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of `docs`: doc, n_words, n_hit, items (distinct ids of items with matches, sorted as strings), matches.

    matches: the longest runs of words each window of which stands in the item, as array<struct<item: string,
    item_word, word, words>>, places in words from 0; item_word is where the run's first window first stands in the
    item. Unless an item repeats 12 words of itself, a run is a longest verbatim match. Null texts have no words. Items
    without an id hit words and are in matches, but in `items` they are not listed. Repeated rows are kept.
    """
    rows = docs.select(column(id_col).alias("doc"), column(text_col).cast("string").cast("binary").alias("text"))
    return _scan(rows, _block_loaders(docs.sparkSession, benchmark_blocks(benchmark, item_col, item_text_col, block_bytes)), window, shard_words)


def contaminated(times: int = 20):
    """At least one word in `times` is hit, and one at least."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * times >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **settings) -> DataFrame:
    """The rows of `docs` that are not contaminated, with all their columns."""
    whole = docs.select(whole_row(docs).alias("row"), column(text_col).alias("text"))
    return verbatim_matches(whole, benchmark, "row", "text", **settings).where(~contaminated()).select("doc.*")


def op5_decontaminate(spark, sf_dir):
    found = verbatim_matches(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), contaminated().alias("contaminated"))
