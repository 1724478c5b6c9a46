"""Token counts: batch encoding in Arrow functions that return lengths only.

Batches are balanced by bytes, and texts are split at the borders of the tokenizer's own pieces, where splitting cannot
change a token; each distinct piece of a batch is encoded once. No id, only counts, leaves the worker.

Defined cases: a null text counts as empty (0 tokens); repeated rows each give a row; a null id stays null; an empty table
gives no rows; other columns are ignored. SentencePiece models and tokenizer files that are not plain byte-level BPE have no
border that is proven safe, so their texts are encoded whole.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import encoding
from . import vectext as V
from .common import id_and_text

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


@functools.cache
def _sentencepiece(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _count_whole(texts: list[str], path: str) -> np.ndarray:
    if path.endswith(".model"):
        return np.array([len(x) for x in _sentencepiece(path).encode(texts, num_threads=1)], np.int64)
    out, batch, room = [], [], 1 << 18
    for t in texts:
        batch.append(t)
        room -= len(t)
        if room <= 0:
            out += [len(e) for e in encoding.library(path).encode_batch_fast(batch, add_special_tokens=False)]
            batch, room = [], 1 << 18
    out += [len(e) for e in encoding.library(path).encode_batch_fast(batch, add_special_tokens=False)]
    return np.array(out, np.int64)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of each row. tokenizer: path of a .json or .model file."""

    def run(batches):
        for b in V.slices_by_bytes(batches, "text"):
            buf, offs = V.text_buffer(b.column("text"))
            if tokenizer.endswith(".json") and encoding.is_plain_byte_level(tokenizer):
                n = encoding.count_texts(buf, offs, tokenizer)
            else:
                n = _count_whole([t or "" for t in b.column("text").to_pylist()], tokenizer)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(offs)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
