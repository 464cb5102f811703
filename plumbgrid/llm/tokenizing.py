"""One tokenizer per worker, and places where a text can be cut without changing its tokens."""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import public_tokenizers

#: Parameters: the vocabulary file and its library.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
_loaded: dict[int, object] = {}


def definition(path: str = VOCABULARY) -> str:
    """The tokenizer's file, read on the driver; its size does not depend on the data (about 1.5 MB)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def tokenizer(text: str):
    """The tokenizer of a definition, built once in each Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    key = hash(text)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Tokenizer.from_str(text)
    return _loaded[key]


def byte_batches(sizes: np.ndarray, most: int):
    """(from, to) of runs of rows of about `most` bytes: each ends with the row that reaches it."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = min(len(sizes), int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most)) + 1)
        yield at, to
        at = to


class Cuts:
    """Places where a text can be cut so that the tokens of its parts are those of the whole.

    * Before a single space that stands between two letters or digits: the pre-tokenizer joins a space only to what
      is behind it.
    * Between a letter and a digit, or one of them and a mark (no white space, no apostrophe): the pre-tokenizer never
      joins different kinds.
    * Between two letters, two digits or two marks where no token of the vocabulary holds the last byte of the one
      beside the first of the other: no merge crosses there.

    No cut falls into a special string. A run without any such place stays whole.
    """

    def __init__(self, tok):
        self.special = tuple(t.content for t in tok.get_added_tokens_decoder().values())
        shown = _shown_bytes()
        self.joined = np.zeros((256, 256), bool)
        for token in tok.get_vocab(with_added_tokens=False):
            raw = [shown[c] for c in token if c in shown]
            self.joined[raw[:-1], raw[1:]] = True

    def safe(self, text: str, at: int) -> bool:
        a, b = text[at - 1], text[at]
        if any(s in text[max(0, at - len(s) + 1) : at + len(s) - 1] for s in self.special):
            return False
        if b == " ":
            return at + 1 < len(text) and a.isalnum() and text[at + 1].isalnum()
        if a.isspace() or b.isspace() or "'" in (a, b):
            return False
        kinds = _kind(a), _kind(b)
        return kinds[0] != kinds[1] or not self.joined[a.encode()[-1], b.encode()[0]]

    def pieces(self, text: str, most: int):
        """The text in parts of about `most` characters or more."""
        begin, at = 0, most
        while at < len(text):
            if self.safe(text, at):
                yield text[begin:at]
                begin, at = at, at + most
            else:
                at += 1
        yield text[begin:]


def _kind(c: str) -> str:
    """Letter, number or other, as the pre-tokenizer tells them apart."""
    kind = unicodedata.category(c)[0]
    return kind if kind in "LN" else ""


def _shown_bytes() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
