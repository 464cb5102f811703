"""Token-id output: texts in order of their ids, encoded and written to files of packed blocks, and read back.

The texts are range-partitioned by id and sorted; each partition becomes one file in the shared folder, written
piece by piece under a name of its attempt and renamed when complete, so that a task that runs again replaces
its file by an equal one. A small manifest (one row per file, sent to the driver) gives each file's place among all ids.
"""

from __future__ import annotations

import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, LongType

from . import pfor
from .common import column, file_system, load, qualified, schema_of, shared_path, trimmed
from .tokenizing import VOCABULARY, byte_batches, definition, tokenizer

END = 2
#: Words that a worker's cache holds before those that were not met again go.
CACHE_WORDS = 500_000
#: Other parts that it holds; beyond that it starts anew.
CACHE_PARTS = 50_000
#: Bytes of texts that are encoded together; the text that reaches them is the last.
AT_ONCE = 8 << 20
#: Words that are encoded in one line.
TOGETHER = 256


class Encoder:
    """Ids of whole texts. Texts are cut before single spaces that a word follows, where the tokenizer never joins, and what comes often is encoded once."""

    def __init__(self, tok, special: tuple[str, ...]):
        self.tok, self.special = tok, special
        self.known: dict[str, bytes] = {}  # by part: first words, marks, and what is encoded whole
        # words behind a space, and their ids one after the other; the empty word has none
        self.words, self.sizes, self.ids = pa.array([""]), np.zeros(1, np.int64), np.zeros(0, np.uint32)
        vocab = tok.get_vocab()
        self.begins = np.zeros(max(vocab.values(), default=0) + 1, bool)  # tokens that begin with a space
        self.begins[[i for token, i in vocab.items() if token.startswith(_SPACE)]] = True

    def _batch(self, parts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for at in range(0, len(parts), 4096) for e in self.tok.encode_batch_fast(parts[at : at + 4096], add_special_tokens=False)]

    def _part(self, parts: set[str]) -> None:
        if len(self.known) > CACHE_PARTS:
            self.known.clear()
        new = [p for p in parts if p not in self.known]
        self.known.update(zip(new, self._batch(new), strict=True))

    def _places(self, words: pa.Array) -> np.ndarray:
        """Places of words in the cache, -1 for those that it lacks."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)

    def _spaced(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of words behind a space, many to a line: spaces stand before words alone, so a token that begins with one begins a word."""
        lines = [" " + " ".join(words[at : at + TOGETHER]) for at in range(0, len(words), TOGETHER)]
        encoded = [np.array(e.ids, np.uint32) for at in range(0, len(lines), 16) for e in self.tok.encode_batch_fast(lines[at : at + 16], add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, np.uint32), *encoded])
        firsts = np.flatnonzero(self.begins[ids])
        if len(firsts) == len(words):
            return np.diff(np.append(firsts, len(ids))), ids
        apart = self._batch([" " + w for w in words])  # a vocabulary that shows spaces otherwise
        return np.fromiter(map(len, apart), np.int64, len(apart)) // 4, np.frombuffer(b"".join(apart), "<u4")

    def _lists(self, table: list[bytes]) -> tuple[np.ndarray, pa.ListArray]:
        """Sizes and ids by place, of the cache's words and then of a table's parts."""
        sizes = np.concatenate([self.sizes, np.fromiter(map(len, table), np.int64, len(table)) // 4])
        ids = np.concatenate([self.ids, np.frombuffer(b"".join(table), "<u4")])
        return sizes, pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(ids))

    def _learn(self, words: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Add words to the cache; their places."""
        at = len(self.words) + np.arange(len(words))
        self.words = pa.concat_arrays([self.words, words])
        self.sizes, self.ids = np.concatenate([self.sizes, sizes]), np.concatenate([self.ids, ids])
        return at

    def _words(self, new: pa.Array) -> np.ndarray:
        """Learn words behind a space; marks behind letters are tokens of their own, so the letters are learned alone. The words' places."""
        cores = pc.utf8_rtrim(new, _MARKS)
        keys = pc.if_else(pc.utf8_is_alpha(cores), cores, new).dictionary_encode()
        every, which = keys.dictionary, keys.indices.to_numpy()
        held = self._places(every)
        todo = every.filter(pa.array(held < 0))
        held[held < 0] = self._learn(todo, *self._spaced(todo.to_pylist()))
        place = held[which]
        n_marks = pc.subtract(pc.binary_length(new), pc.binary_length(every.take(keys.indices))).to_numpy()
        marked = n_marks > 0
        words = new.filter(pa.array(marked))
        tails = [w[-n:] for w, n in zip(words.to_pylist(), n_marks[marked].tolist(), strict=True)]
        kinds = {tail: k for k, tail in enumerate(dict.fromkeys(tails))}
        self._part(set(kinds))
        sizes, lists = self._lists([self.known[tail] for tail in kinds])
        at = np.empty((len(tails), 2), np.int64)
        at[:, 0], at[:, 1] = place[marked], len(self.words) + np.fromiter(map(kinds.get, tails), np.int64, len(tails))
        place[marked] = self._learn(words, sizes[at].sum(1), lists.take(pa.array(at.ravel())).flatten().to_numpy())
        return place

    def _only(self, at: np.ndarray) -> None:
        """Keep the cache's words at these places, and the empty one."""
        at = np.unique(np.append(0, at))
        begins = np.cumsum(self.sizes) - self.sizes
        lists = pa.ListArray.from_arrays(pa.array(np.append(begins, len(self.ids)), pa.int32()), pa.array(self.ids))
        self.ids = lists.take(pa.array(at)).flatten().to_numpy()
        self.words, self.sizes = self.words.take(pa.array(at)), self.sizes[at]

    def _places_in(self, texts: pa.Array):
        """Where the parts of texts stand in the cache: (places of all parts, first part of each text, ids of the first parts, texts that go another way)."""
        whole = np.zeros(len(texts), bool)
        for special in self.special:
            whole |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(pc.if_else(pa.array(whole), "", texts), " ")
        counts = pc.list_value_length(split).to_numpy()
        words = split.flatten().dictionary_encode()
        at, distinct = words.indices.to_numpy().astype(np.int64), words.dictionary
        first = np.cumsum(counts) - counts
        # a space before another space or a line's end belongs with what stands before it: those texts go another way
        bare = pc.utf8_ltrim_whitespace(distinct)
        unsafe = pc.or_(pc.not_equal(bare, distinct), pc.equal(bare, "")).to_numpy(zero_copy_only=False)
        odd = unsafe[at]
        odd[first] = False
        whole |= np.add.reduceat(odd, first) > 0 if len(first) else whole
        starts = distinct.take(pa.array(at[first])).to_pylist()
        apart = {k: self._joined(texts[k].as_py()) for k in np.flatnonzero(whole).tolist()}
        place = self._places(distinct)
        if len(self.words) > CACHE_WORDS:  # words that were met again stay
            self._only(place[place >= 0])
            place = self._places(distinct)
        missing = (place < 0) & ~unsafe
        if missing.any():
            place[missing] = self._words(distinct.filter(pa.array(missing)))
        place[unsafe] = 0
        self._part(set(starts).union(*apart.values()))
        # the lists of the cache, then of the texts' first words
        table = [self.known[w] for w in starts]
        at = place[at]
        at[first] = len(self.sizes) + np.arange(len(first))
        return at, first, table, apart

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; the words of all are told apart at once, and each different one is looked up once."""
        at, first, table, apart = self._places_in(pc.fill_null(texts, ""))
        sizes, lists = self._lists(table)
        flat = lists.take(pa.array(at)).flatten().to_numpy()
        edges = np.add.reduceat(sizes[at], first).cumsum().tolist() if len(first) else []
        out = [flat[a:b] for a, b in zip([0, *edges], edges, strict=False)]
        for k, parts in apart.items():
            out[k] = np.frombuffer(b"".join([self.known[p] for p in parts]), "<u4")
        return out

    def count(self, texts: pa.Array) -> np.ndarray:
        """How many ids each text has."""
        at, first, table, apart = self._places_in(pc.fill_null(texts, ""))
        sizes = np.concatenate([self.sizes, np.fromiter(map(len, table), np.int64, len(table)) // 4])
        out = np.add.reduceat(sizes[at], first) if len(first) else np.zeros(0, np.int64)
        for k, parts in apart.items():
            out[k] = sum(len(self.known[p]) for p in parts) // 4
        return out

    def _joined(self, text: str) -> list[str]:
        """Parts of a text that are safe to encode alone; words that are empty or start with white space go to the part before them."""
        if any(s in text for s in self.special):
            return [text]
        first, *words = text.split(" ")
        parts = [first]
        for w in words:
            if not w or w[0].isspace():
                parts[-1] += " " + w
            else:
                parts.append(" " + w)
        return parts


#: How the vocabulary shows a space.
_SPACE = "\u0120"
#: Marks at a word's end that the tokenizer parts from letters; an apostrophe isn't one.
_MARKS = ".,!?;:#$%&*|)"


def encoder(text: str) -> Encoder:
    tok = tokenizer(text)
    if getattr(encoder, "of", None) is not tok:
        encoder.of, encoder.kept = tok, Encoder(tok, tuple(t.content for t in tok.get_added_tokens_decoder().values()))
    return encoder.kept


def encoded(enc: Encoder, batches, most: int = AT_ONCE):
    """Id and token ids of each row of batches (id, text); about `most` bytes of texts are encoded together, however long each is."""
    for batch in batches:
        names, texts = batch.column(0), pc.fill_null(batch.column(1), "")
        for a, b in byte_batches(pc.binary_length(texts).to_numpy().astype(np.int64), most):
            yield from zip(names.slice(a, b - a).to_pylist(), enc.encode(texts.slice(a, b - a)), strict=True)


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, vocabulary: str = VOCABULARY) -> DataFrame:
    """Write the files to `folder` (a place that all executors reach) and return the manifest: file, name, counts.

    A folder without a scheme lies on Spark's default file system.
    Ids ascend, nulls first; rows with one id are ordered by the hash of their text. Null texts hold the end id
    only. Texts are encoded whole; special strings inside them as the library does by default.
    """
    folder = qualified(docs.sparkSession, folder)
    rows = docs.select(column(id_col).alias("__id"), column(text_col).cast("string").alias("__text"))
    rows = rows.withColumn("__h", F.xxhash64("__text"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "__id", "__h").sortWithinPartitions("__id", "__h").select("__id", "__text")
    shared = rows.sparkSession.sparkContext.broadcast(definition(vocabulary))
    kind = to_arrow_type(rows.schema["__id"].dataType)

    def write(batches):
        from pyspark import TaskContext

        enc, part = encoder(shared.value), TaskContext.get().partitionId()
        filesystem, root = file_system(folder)
        filesystem.create_dir(root, recursive=True)
        target, trial = f"{root}/tokens-{part:06d}.pfr", f"{root}/.{part:06d}-{uuid.uuid4().hex}"
        with filesystem.open_output_stream(trial) as sink:
            writer = pfor.Writer(sink)
            for name, ids in encoded(enc, batches):
                writer.add(name, np.append(ids, np.uint32(end)))
            writer.close(kind)
        filesystem.move(trial, target)
        yield pa.RecordBatch.from_pydict({"file": [part], "name": [f"tokens-{part:06d}.pfr"], "n_docs": [len(writer.lengths)], "n_ids": [writer.n_ids]})

    # the files are written here, once; a table of one-row files for the manifest would have each task start processes for their modes
    kinds = "file long, name string, n_docs long, n_ids long"
    return rows.sparkSession.createDataFrame(rows.mapInArrow(trimmed(write), kinds).collect(), kinds)


def read_token_files(manifest: DataFrame, folder: str, id_type: DataType = LongType()) -> DataFrame:
    """One row per document from the files alone: id, start (ids of all documents before it), n_tokens, ids_crc32."""
    spark, placed, start = manifest.sparkSession, [], 0
    folder = qualified(spark, folder)
    for _, name, n_docs, n_ids in sorted(map(tuple, manifest.collect())):
        placed += [(name, start)] if n_docs else []
        start += n_ids
    schema = schema_of("id", id_type, "start long, n_tokens long, ids_crc32 long")
    if not placed:
        return spark.createDataFrame([], schema)
    frame = spark.createDataFrame(placed, "name string, start long").repartition(len(placed))

    def read(batches):
        filesystem, root = file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                path = f"{root}/{row['name']}"
                with filesystem.open_input_file(path) as source:
                    reader = pfor.Reader(source, source.size())
                    ends = np.cumsum(reader.lengths)
                    at = 0
                    while at < len(ends):  # about 2**20 ids at once
                        first = int(ends[at] - reader.lengths[at])
                        to = max(at + 1, int(np.searchsorted(ends, first + (1 << 20), "right")))
                        ids = reader.ids(first, int(ends[to - 1])).astype("<u4")
                        edges = [0, *(ends[at:to] - first).tolist()]
                        crc = [zlib.crc32(ids[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
                        yield pa.RecordBatch.from_pydict(
                            {"id": reader.names.slice(at, to - at), "start": ends[at:to] - reader.lengths[at:to] + row["start"], "n_tokens": reader.lengths[at:to], "ids_crc32": np.array(crc, np.int64)}
                        )
                        at = to

    return frame.mapInArrow(trimmed(read), schema)


def token_output(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", end: int = END, vocabulary: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """Write all texts to token files and describe them from the files: the id, start, n_tokens (with the end id), ids_crc32.

    `folder` defaults to a new one in the shared folder. An empty table gives no rows. Rows with one id each have
    their own row, in the files' order. Other columns of `docs` are ignored.
    """
    folder = folder or shared_path(docs.sparkSession, "tokens")
    manifest = write_token_files(docs, folder, id_col, text_col, end, vocabulary)
    return read_token_files(manifest, folder, docs.schema[id_col].dataType).withColumnRenamed("id", id_col)


def op3_token_files(spark, sf_dir):
    return token_output(load(spark, sf_dir, "documents"))
