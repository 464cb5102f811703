"""Patched frame-of-reference blocks of token ids.

A file holds, in order: the magic; blocks; the block index (each block's place in the file, then the end of the
last); the documents (an Arrow stream with the id and the number of token ids of each); and a footer. A block covers BLOCK ids, the last of a file maybe
fewer. It stores its least id, a width, and every id less the least id in `width` bits, 64 ids to `width` words
of 64 bits. The width is the least one that holds all but the largest tenth of the block's values. Ids that do
not fit are kept in the block's exception list, as place and value, and are 0 in the packed words.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

MAGIC = b"PFR1"
BLOCK = 1024
GROUP = 64
#: Share of a block's ids that its width must hold.
PERCENTILE = 90
#: Of a block: number of ids, least id, width, number of exceptions.
HEAD = struct.Struct("<IIII")
#: Of a file: number of blocks and ids, place of the block index, bytes of the documents.
FOOT = struct.Struct("<QQQQ4s")


def widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value, 0 for 0."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64 values below 2**width, as rows of `width` words."""
    out = np.zeros((width, len(values)), np.uint64)
    columns = np.ascontiguousarray(values.T.astype(np.uint64))
    for i in range(GROUP):
        word, shift = divmod(i * width, 64)
        out[word] |= columns[i] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= columns[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    """The inverse of pack."""
    columns = np.ascontiguousarray(words.T)
    mask = np.uint64((1 << width) - 1)
    out = np.empty((GROUP, len(words)), np.uint64)
    for i in range(GROUP):
        word, shift = divmod(i * width, 64)
        v = columns[word] >> np.uint64(shift)
        if shift + width > 64:
            v = v | (columns[word + 1] << np.uint64(64 - shift))
        out[i] = v & mask
    return np.ascontiguousarray(out.T)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """The blocks of an array of uint32 ids; all but the last are full."""
    n = len(ids)
    if not n:
        return []
    count = -(-n // BLOCK)
    padded = np.empty(count * BLOCK, np.int64)
    padded[:n] = ids
    padded[n:] = ids[-1]
    rows = padded.reshape(count, BLOCK)
    least = rows.min(1)
    over = rows - least[:, None]
    bits = widths(over)
    wide = np.percentile(bits, PERCENTILE, axis=1, method="higher").astype(np.int64)
    large = bits > wide[:, None]
    low = np.where(large, 0, over)
    packed: list[bytes] = [b""] * count
    for width in np.unique(wide):
        at = np.flatnonzero(wide == width)
        if width:
            words = pack(low[at].reshape(-1, GROUP), int(width)).astype("<u8").reshape(len(at), -1)
            for k, i in enumerate(at):
                packed[i] = words[k].tobytes()
    out = []
    for i in range(count):
        places = np.flatnonzero(large[i])
        size = BLOCK if i < count - 1 else n - i * BLOCK
        places = places[places < size]
        head = HEAD.pack(size, int(least[i]), int(wide[i]), len(places))
        out.append(head + packed[i] + places.astype("<u2").tobytes() + rows[i][places].astype("<u4").tobytes())
    return out


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that start at `starts` in data."""
    heads = [HEAD.unpack_from(data, int(s)) for s in starts]
    out = np.zeros((len(heads), BLOCK), np.int64)
    by_width: dict[int, list[int]] = {}
    for i, (_, _, width, _) in enumerate(heads):
        by_width.setdefault(width, []).append(i)
    groups = BLOCK // GROUP
    for width, at in by_width.items():
        if width:
            words = np.concatenate([np.frombuffer(data, "<u8", groups * width, int(starts[i]) + HEAD.size) for i in at]).reshape(-1, width)
            out[at] = unpack(words, width).reshape(len(at), BLOCK)
    out += np.array([h[1] for h in heads], np.int64)[:, None]
    for i, (_, _, width, n) in enumerate(heads):
        if n:
            at = int(starts[i]) + HEAD.size + groups * width * 8
            out[i, np.frombuffer(data, "<u2", n, at)] = np.frombuffer(data, "<u4", n, at + 2 * n)
    sizes = [h[0] for h in heads]
    if sizes and sizes[-1] < BLOCK:
        return out.ravel()[: (len(sizes) - 1) * BLOCK + sizes[-1]].astype(np.uint32)
    return out.ravel().astype(np.uint32)


class Writer:
    """Writes a file piece by piece; holds a few blocks at most."""

    def __init__(self, sink, at_once: int = 256 * BLOCK):
        self.sink, self.at_once = sink, at_once
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.starts: list[int] = []
        self.lengths: list[int] = []
        self.names: list = []
        self.place = len(MAGIC)
        sink.write(MAGIC)

    def add(self, name, ids: np.ndarray) -> None:
        self.names.append(name)
        self.lengths.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.at_once:
            self._flush(self.n_held // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        for block in encode_blocks(ids[:n]):
            self.starts.append(self.place)
            self.sink.write(block)
            self.place += len(block)
        self.n_ids += n
        self.held, self.n_held = [ids[n:]], len(ids) - n

    def close(self, kind: pa.DataType) -> None:
        """kind: the type of the documents' ids."""
        self._flush(self.n_held)
        self.sink.write(np.array([*self.starts, self.place], "<u8").tobytes())
        table = pa.table({"id": pa.array(self.names, kind), "n": pa.array(self.lengths, pa.int64())})
        stream = pa.BufferOutputStream()
        with pa.ipc.new_stream(stream, table.schema) as out:
            out.write_table(table)
        documents = stream.getvalue().to_pybytes()
        self.sink.write(documents)
        self.sink.write(FOOT.pack(len(self.starts), self.n_ids, self.place, len(documents), MAGIC))


class Reader:
    """Reads documents of a file; `source` has seek, read and size. Blocks are found by the index."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - FOOT.size)
        blocks, self.n_ids, place, size, magic = FOOT.unpack(source.read(FOOT.size))
        if magic != MAGIC:
            raise ValueError("not a file of token blocks")
        source.seek(place)
        self.starts = np.frombuffer(source.read(8 * (blocks + 1)), "<u8").astype(np.int64)
        documents = pa.ipc.open_stream(source.read(size)).read_all().combine_chunks()
        self.names, self.lengths = documents["id"].combine_chunks(), documents["n"].to_numpy()

    def ids(self, first: int, end: int) -> np.ndarray:
        """Ids first to end (exclusive) of the file; reads only their blocks."""
        if end <= first:
            return np.zeros(0, np.uint32)
        a, b = first // BLOCK, -(-end // BLOCK)
        self.source.seek(int(self.starts[a]))
        data = self.source.read(int(self.starts[b] - self.starts[a]))
        return decode_blocks(data, self.starts[a:b] - self.starts[a])[first - a * BLOCK : end - a * BLOCK]
