"""Language of each word, and of each text, by a linear-chain conditional random field.

A word's features are the byte n-grams (2 to 4) of the word between two marks, so that n-grams at a mark are
affixes, and the word itself (its place in the lexicon); they are hashed to rows of a weight table. Transitions
between languages are learned with them, by gradient ascent of the conditional likelihood over sequences made of
runs of words from texts of different languages, so that switches occur. Prediction runs forward-backward over
the whole text: texts are cut into blocks of words, each block's transfer matrix is a product, the products are
chained along each text, and the steps inside of all blocks run together. That gives each word's exact marginals.
A text's language is the one with the largest sum of marginals, its score the mean marginal.

The model is fitted on the driver on a bounded sample: at most ``per_lang`` labelled rows of each language, those
with the least hash of their id, and at most ``per_text`` characters of each. Nothing else is bounded; the languages
must fit the driver.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, load, schema_of, trimmed, whole_row
from .decontaminate import words

DIM = 1 << 16
GRAMS = (2, 3, 4)
#: Bounds of the fit: labelled rows of each language, characters of each row, and steps of a batch of sequences.
PER_LANG, PER_TEXT, STEPS, BATCH, LENGTH = 300, 20_000, 200, 64, 32
BLOCK = 64
#: Words whose scores a worker keeps; beyond that it starts anew.
CACHE_WORDS = 200_000
UNKNOWN = "und"
_LETTER = re.compile(rb"[a-z\x80-\xff]")


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # DIM x K
    moves: np.ndarray  # K x K, log


def features(vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the weight table for each word, one after the other, and where each word's begin."""
    marked = b"".join(b"^" + w + b"$" for w in vocabulary)
    raw = np.frombuffer(marked, np.uint8).astype(np.uint32)
    sizes = np.fromiter((len(w) + 2 for w in vocabulary), np.int64, len(vocabulary))
    ends = np.repeat(np.cumsum(sizes), sizes)
    places = np.arange(len(raw))
    columns, masks = [], []
    for n in GRAMS:
        h = np.full(len(raw), n, np.uint32)
        for i in range(n):
            h = (h * np.uint32(0x01000193)) ^ np.concatenate([raw[i:], np.zeros(i, np.uint32)])
        h ^= h >> np.uint32(15)
        columns.append((h * np.uint32(0x85EBCA6B) >> np.uint32(16)) % np.uint32(DIM))
        masks.append(places + n <= ends)
    # the word itself takes the place of a gram that would start at its last mark
    whole = np.fromiter((zlib.crc32(w) % DIM for w in vocabulary), np.uint32, len(vocabulary))
    last = np.cumsum(sizes) - 1
    columns[0][last], masks[0][last] = whole, True
    table, mask = np.stack(columns, 1), np.stack(masks, 1)
    counts = np.add.reduceat(mask.sum(1), np.cumsum(sizes) - sizes) if len(vocabulary) else np.zeros(0, np.int64)
    return table[mask].astype(np.int64), np.cumsum(counts) - counts


def scores(vocabulary: list[bytes], weights: np.ndarray) -> np.ndarray:
    """The log potential of each language for each word; zeros for a word without letters."""
    if not vocabulary:
        return np.zeros((0, weights.shape[1]), np.float32)
    rows, starts = features(vocabulary)
    found = np.add.reduceat(weights[rows], starts)
    found[[k for k, w in enumerate(vocabulary) if not _LETTER.search(w)]] = 0
    return found.astype(np.float32)


def marginals(potentials: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The marginals of all words; potentials (log) of the texts one after the other, of `lengths` (over 0) words."""
    k, step = potentials.shape[1], np.exp(moves).astype(np.float32)
    blocks = -(-lengths // BLOCK)
    first = np.cumsum(blocks) - blocks
    n = int(blocks.sum())
    text = np.repeat(np.arange(len(lengths)), lengths)
    inside = np.arange(len(potentials)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    row, col = first[text] + inside // BLOCK, inside % BLOCK
    e = np.ones((BLOCK, n, k), np.float32)
    e[col, row] = np.exp(potentials - potentials.max(1, keepdims=True))
    real = np.zeros((BLOCK, n, 1), bool)
    real[col, row] = True
    even = lambda x, axis: x / x.sum(axis, keepdims=True)

    product = np.broadcast_to(np.eye(k, dtype=np.float32), (n, k, k))
    for t in range(BLOCK):
        product = np.where(real[t][:, :, None], (product @ step) * e[t][:, None, :], product)
        product = product / product.max((1, 2), keepdims=True)
    into, after = np.empty((n, k), np.float32), np.empty((n, k), np.float32)
    order = np.argsort(-blocks, kind="stable")
    start, count = first[order], blocks[order]
    a = np.full((len(order), k), 1 / k, np.float32)
    b = np.ones((len(order), k), np.float32)
    most = int(count[0]) if len(count) else 0
    for j in range(most):
        active = int(np.searchsorted(-count, -j, "left"))
        at = start[:active] + j
        into[at] = a[:active]
        a[:active] = even((a[:active, None, :] @ product[at])[:, 0], 1)
    for j in range(most - 1, -1, -1):
        active = int(np.searchsorted(-count, -j, "left"))
        at = start[:active] + j
        after[at] = b[:active]
        b[:active] = even((product[at] @ b[:active, :, None])[:, :, 0], 1)
    forward = np.empty((BLOCK, n, k), np.float32)
    a = into
    for t in range(BLOCK):
        a = np.where(real[t], even((a @ step) * e[t], 1), a)
        forward[t] = a
    b = after
    for t in range(BLOCK - 1, -1, -1):
        forward[t] *= b
        b = np.where(real[t], even((e[t] * b) @ step.T, 1), b)
    return even(forward[col, row], 1)


def fit(sample: list[tuple[str, str]], steps: int = STEPS, seed: int = 11) -> Model | None:
    """From (lang, text) rows; None without a language."""
    langs = sorted({lang for lang, _ in sample})
    if not langs:
        return None
    vocabulary: dict[bytes, int] = {}
    texts: list[list[np.ndarray]] = [[] for _ in langs]
    for lang, text in sample:
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words((text or "").encode()) if _LETTER.search(w)]
        if ids:
            texts[langs.index(lang)].append(np.array(ids))
    k = len(langs)
    weights, moves = np.zeros((DIM, k)), np.zeros((k, k))
    model = Model(langs, weights, moves)
    usable = [y for y in range(k) if texts[y]]
    if not usable:
        return model
    rows, starts = features(list(vocabulary))
    ends = np.append(starts[1:], len(rows))
    r = np.random.default_rng(seed)
    w2, m2 = np.full((DIM, 1), 1e-6), 1e-6
    for _ in range(steps):
        ids, y = np.empty((BATCH, LENGTH), np.int64), np.empty((BATCH, LENGTH), np.int64)
        for s in range(BATCH):
            at = 0
            while at < LENGTH:
                lang = usable[r.integers(len(usable))]
                run = texts[lang][r.integers(len(texts[lang]))]
                n = int(min(LENGTH - at, len(run), r.integers(4, LENGTH + 1)))
                begin = r.integers(len(run) - n + 1)
                ids[s, at : at + n], y[s, at : at + n] = run[begin : begin + n], lang
                at += n
        seen, back = np.unique(ids, return_inverse=True)
        sizes = ends[seen] - starts[seen]
        own = np.repeat(np.arange(len(seen)), sizes)
        flat = rows[np.repeat(starts[seen] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
        e = np.add.reduceat(weights[flat], np.cumsum(sizes) - sizes)[back.reshape(ids.shape)]
        p, pairs = _expected(e, moves)
        gap = -p
        np.put_along_axis(gap, y[:, :, None], np.take_along_axis(gap, y[:, :, None], 2) + 1, 2)
        by_word = np.zeros((len(seen), k))
        np.add.at(by_word, back.ravel(), gap.reshape(-1, k))
        touched, slot = np.unique(flat, return_inverse=True)
        grad = np.stack([np.bincount(slot, by_word[own, c], len(touched)) for c in range(k)], 1) / BATCH - 1e-4 * weights[touched]
        w2[touched] += (grad**2).mean(1, keepdims=True)
        weights[touched] += 0.2 * grad / np.sqrt(w2[touched])
        real = np.zeros((k, k))
        np.add.at(real, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        grad = (real - pairs) / BATCH
        m2 += (grad**2).mean()
        moves += 0.2 * grad / np.sqrt(m2)
    return Model(langs, weights.astype(np.float32), moves)


def _expected(e: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of sequences of one length, and the expected number of each move."""
    e = np.exp(e - e.max(2, keepdims=True))
    step, n, t_end = np.exp(moves), len(e), e.shape[1]
    a, b = np.empty_like(e), np.ones_like(e)
    last = np.full((n, e.shape[2]), 1 / e.shape[2])
    for t in range(t_end):
        last = (last @ step) * e[:, t]
        last /= last.sum(1, keepdims=True)
        a[:, t] = last
    for t in range(t_end - 2, -1, -1):
        x = (e[:, t + 1] * b[:, t + 1]) @ step.T
        b[:, t] = x / x.sum(1, keepdims=True)
    p = a * b
    p /= p.sum(2, keepdims=True)
    x = a[:, :-1, :, None] * step * (e[:, 1:] * b[:, 1:])[:, :, None, :]
    return p, (x / x.sum((2, 3), keepdims=True)).sum((0, 1))


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, usable: Column, per_lang: int = PER_LANG, per_text: int = PER_TEXT) -> list[tuple[str, str]]:
    """Labelled rows for `fit`: of each language the `per_lang` rows with the least hash of their id, over the whole table, and `per_text` characters of each at a place that the hash picks.

    The hashes are even, so a bound on them, from each language's number of rows, leaves about twice `per_lang` rows
    to be ordered, however common the language is; where repeated rows leave too few, the bound doubles.
    """
    known = usable & column(lang_col).isNotNull() & column(text_col).isNotNull()
    doc = column(id_col).cast("string")
    rows = docs.where(known).select(column(lang_col).cast("string").alias("lang"), doc.alias("doc"), F.xxhash64(doc).alias("h"), column(text_col).cast("string").alias("text"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    out, share = [], 2.0
    while counts:
        bounds = [(lang, min(2**63 - 1, int(-(2**63) + share * per_lang / n * 2**64))) for lang, n in counts.items()]
        small = rows.sparkSession.createDataFrame(bounds, "__l string, __b long")  # one row a language
        near = rows.join(F.broadcast(small), F.col("lang") == F.col("__l")).where(F.col("h") <= F.col("__b"))
        begin = F.pmod(F.col("h"), F.greatest(F.length("text") - per_text, F.lit(0)) + 1) + 1
        part = F.col("text").substr(begin.cast("int"), F.lit(per_text))
        # rows that share an id are as few as the ids; the least part stands for them
        near = near.select("lang", "doc", "h", part.alias("part")).groupBy("lang", "doc", "h").agg(F.min("part").alias("part"))
        order = Window.partitionBy("lang").orderBy("h", "doc")
        found = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_lang).select("lang", "part").collect()
        got: dict[str, list[str]] = {}
        for lang, text in found:
            got.setdefault(lang, []).append(text)
        whole = {lang for lang, b in bounds if b == 2**63 - 1}
        done = {lang for lang in counts if lang in whole or len(got.get(lang, ())) == per_lang}
        out += [(lang, text) for lang in done for text in got.get(lang, ())]
        counts = {lang: n for lang, n in counts.items() if lang not in done}
        share *= 4
    return sorted(out)


class Labeller:
    """Scores of words, kept by word."""

    def __init__(self, model: Model):
        self.model, self.at = model, {}
        self.table = np.zeros((1, len(model.langs)), np.float32)

    def potentials(self, texts: list[list[bytes]]) -> np.ndarray:
        if len(self.at) > CACHE_WORDS:
            self.at, self.table = {}, self.table[:1]
        flat = [w for t in texts for w in t]
        if new := [w for w in dict.fromkeys(flat) if w not in self.at]:
            self.at.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
            self.table = np.concatenate([self.table, scores(new, self.model.weights)])
        return self.table[np.fromiter(map(self.at.__getitem__, flat), np.int64, len(flat))]


def label(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", runs: bool = False, batch_words: int = 300_000, inner: bool = False) -> DataFrame:
    """One row per row of `docs`: the id, lang_pred, score, and with `runs` also runs, array<struct<word, words, lang>> (runs of words of one language).

    `und` with score 0 where the text is null or has no letter, or nothing was learned. The text alone is used.
    Repeated rows are kept; other columns of `docs` are ignored. With `inner` the id is a struct that holds the text.
    """
    rows = docs.select(column(id_col).alias("doc"), *[column(text_col).cast("string").alias("text")] * (not inner))
    shared = rows.sparkSession.sparkContext.broadcast(model)
    run_type = pa.list_(pa.struct([("word", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))

    def run(batches):
        labeller = None
        for batch in batches:
            if shared.value is not None and labeller is None:
                labeller = Labeller(shared.value)
            n = batch.num_rows
            lang, score, spans = [UNKNOWN] * n, np.zeros(n), [[] for _ in range(n)]
            held, owners, size = [], [], 0

            def flush(held, owners, lang, score, spans):
                lengths = np.array([len(t) for t in held])
                p = marginals(labeller.potentials(held), lengths, labeller.model.moves)
                starts = np.cumsum(lengths) - lengths
                total = np.add.reduceat(p, starts, dtype=np.float64)
                best = total.argmax(1)
                for i, k in enumerate(owners):
                    lang[k] = labeller.model.langs[best[i]]
                score[owners] = np.clip(total[np.arange(len(best)), best] / lengths, 0, 1)
                if runs:
                    top = p.argmax(1)
                    for k, s, m in zip(owners, starts.tolist(), lengths.tolist(), strict=True):
                        cut = [0, *(np.flatnonzero(np.diff(top[s : s + m])) + 1).tolist(), m]
                        spans[k] = [{"word": a, "words": b - a, "lang": labeller.model.langs[top[s + a]]} for a, b in zip(cut, cut[1:], strict=False)]

            for k, value in enumerate(batch.column(0).field(text_col) if inner else batch.column(1)):
                text = value.as_py()
                if not text or labeller is None or not has_letter(text):
                    continue
                found = words(text.encode())
                if not found:
                    continue
                held.append(found)
                owners.append(k)
                size += len(found)
                if size >= batch_words:
                    flush(held, owners, lang, score, spans)
                    held, owners, size = [], [], 0
            if held:
                flush(held, owners, lang, score, spans)
            columns = [batch.column(0), pa.array(lang, pa.string()), pa.array(score)] + [pa.array(spans, run_type)] * runs
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "lang_pred", "score", "runs"][: len(columns)])

    schema = schema_of("doc", rows.schema["doc"].dataType, "lang_pred string, score double" + ", runs array<struct<word:int,words:int,lang:string>>" * runs)
    return rows.mapInArrow(trimmed(run), schema).withColumnRenamed("doc", id_col)


def in_one_language(docs: DataFrame, model: Model | None, least: float, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, whose text has a letter and a language with a score of `least` or more."""
    whole = docs.select(whole_row(docs).alias("row"))
    return label(whole, model, "row", text_col, inner=True).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")


def has_letter(text: str) -> bool:
    return bool(re.search("[A-Za-z]", text)) or any(map(str.isalpha, text))


def held_out(id_col: str) -> Column:
    """Rows that no learning uses: the remainder of the crc32 of the id as text by 3 is 1; false for a null id."""
    return F.coalesce(F.crc32(column(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> Model | None:
    return fit(training_sample(docs, id_col, text_col, lang_col, ~held_out(id_col) & F.col(id_col).isNotNull(), per_lang))


def op8_langid(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return label(docs, learned(docs)).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
