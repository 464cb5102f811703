"""Token counts: batches of about equal bytes, long texts cut at safe places, lengths only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, load, schema_of, trimmed
from .token_files import encoder
from .tokenizing import VOCABULARY, Cuts, byte_batches, definition

BATCH_BYTES = 4 << 20
PIECE_CHARS = 1 << 16


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, vocabulary: str = VOCABULARY, batch_bytes: int = BATCH_BYTES, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """One row per row of `docs`: the id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null texts count as empty (0 bytes, 0 tokens); repeated rows are kept; other columns are ignored. Texts of
    any length are counted whole: those over `piece_chars` characters piece by piece, cut where no token crosses
    (`Cuts`); a run of characters without such a place stays in one piece. A batch holds pieces of about
    `batch_bytes`, and the words of all its texts are told apart at once and looked up once (`Encoder`).
    """
    rows = docs.select(column(id_col).alias("__id"), column(text_col).cast("string").alias("__text"))
    shared = rows.sparkSession.sparkContext.broadcast(definition(vocabulary))

    def count(batches):
        enc, cuts = encoder(shared.value), None
        for batch in batches:
            n = batch.num_rows
            texts = pc.fill_null(batch.column(1), "")
            n_bytes, n_tokens = pc.binary_length(texts).to_numpy().astype(np.int64), np.zeros(n, np.int64)
            # a row is a text, or a piece of a long one
            long = np.flatnonzero(n_bytes > piece_chars).tolist()
            cuts = cuts or (Cuts(enc.tok) if long else None)
            parts = {k: list(cuts.pieces(texts[k].as_py(), piece_chars)) for k in long}
            owner = np.repeat(np.arange(n), [len(parts.get(k, "1")) for k in range(n)])
            if parts:
                spans, at = [], 0
                for k in long:
                    spans += [texts.slice(at, k - at), pa.array(parts[k], texts.type)]
                    at = k + 1
                texts = pa.concat_arrays([*spans, texts.slice(at)])
            for a, b in byte_batches(pc.binary_length(texts).to_numpy().astype(np.int64), batch_bytes):
                np.add.at(n_tokens, owner[a:b], enc.count(texts.slice(a, b - a)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes), pa.array(n_tokens)], names=["id", "n_bytes", "n_tokens"])

    counted = rows.mapInArrow(trimmed(count), schema_of("id", rows.schema["__id"].dataType, "n_bytes long, n_tokens long"))
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op10_token_counts(spark, sf_dir):
    return token_counts(load(spark, sf_dir, "documents"))
