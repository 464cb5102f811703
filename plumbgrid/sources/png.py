"""PNG files of grey and colour rasters, 8 or 16 bits, without interlacing."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_HEAD = b"\x89PNG\r\n\x1a\n"
#: Channels by colour type.
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def encode(a: np.ndarray) -> bytes:
    """uint8 or uint16, (rows, cols) or (rows, cols, channels)."""
    rows, cols = a.shape[:2]
    n = 1 if a.ndim == 2 else a.shape[2]
    kind = {v: k for k, v in CHANNELS.items()}[n]
    raw = np.ascontiguousarray(a.astype(">u2" if a.dtype == np.uint16 else np.uint8)).view(np.uint8).reshape(rows, -1)
    body = zlib.compress(np.hstack([np.zeros((rows, 1), np.uint8), raw]).tobytes())
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return _HEAD + part(b"IHDR", struct.pack(">IIBBBBB", cols, rows, 16 if a.dtype == np.uint16 else 8, kind, 0, 0, 0)) + part(b"IDAT", body) + part(b"IEND", b"")


def decode(data: bytes) -> np.ndarray:
    """(rows, cols) or (rows, cols, channels), uint8 or uint16; ValueError for what is no such file."""
    if not data.startswith(_HEAD):
        raise ValueError("no PNG")
    at, body, head = len(_HEAD), [], None
    while at < len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif name == b"IDAT":
            body.append(chunk)
        at += size + 12
    cols, rows, bits, kind, _, _, interlaced = head
    if bits not in (8, 16) or kind not in CHANNELS or interlaced:
        raise ValueError(f"PNG of {bits} bits, colour type {kind}, interlacing {interlaced} is not read")
    step = CHANNELS[kind] * bits // 8
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(rows, 1 + cols * step)
    out, above = np.zeros((rows, cols * step), np.uint8), np.zeros(cols * step, np.uint8)
    for y in range(rows):
        above = out[y] = _unfiltered(int(lines[y, 0]), lines[y, 1:], above, step)
    a = out.view(">u2").astype(np.uint16) if bits == 16 else out
    return a.reshape(rows, cols) if CHANNELS[kind] == 1 else a.reshape(rows, cols, -1)


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 1:  # each byte adds the one a pixel before
        return np.cumsum(line.reshape(-1, step), 0, dtype=np.uint8).ravel()
    if kind == 2:
        return line + above
    out, up = [0] * step, [0] * step + above.tolist()
    for k, v in enumerate(line.tolist()):
        left, over, corner = out[k], up[k + step], up[k]
        if kind == 3:
            guess = (left + over) // 2
        else:  # the neighbour nearest to left + over - corner
            by = (abs(over - corner), abs(left - corner), abs(left + over - 2 * corner))
            guess = left if by[0] <= by[1] and by[0] <= by[2] else over if by[1] <= by[2] else corner
        out.append((v + guess) & 255)
    return np.array(out[step:], np.uint8)
