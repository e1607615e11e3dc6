"""Token counts with a public SentencePiece model, lengths only.

Batches are cut by bytes.  A text is split where the model cannot join pieces: at a space between two
characters that are not spaces, because no piece holds a space mark after another character (checked when the
model is loaded; a model that does so is run over whole texts).  Such a part stands at the start of a text just as
it stands after its space, since the model puts a space mark before every text, so the counts add up.  Equal parts
of a batch are encoded once.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from specband.llm.common import SLICE_BYTES, buffers, id_text, slices

MARK = "▁"
# a space between characters that are neither a space nor the space mark
SAFE = re.compile(f"(?<=[^ {MARK}]) (?=[^ {MARK}])")


@lru_cache(maxsize=2)
def model(path: str):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
    splits = not any(MARK in p.lstrip(MARK) for p in pieces) and all(
        len(sp.encode(f"{a} {b}")) == len(sp.encode(a)) + len(sp.encode(b)) for a, b in (("a", "b"), ("x\n", "\ty"), (".", "<s>"), ("　", "ﬁ")))
    return sp, splits


def counts(texts: list[str], path: str) -> np.ndarray:
    """Tokens of each text, with every distinct safe part encoded once."""
    sp, splits = model(path)
    if not splits:
        return np.array([len(x) for x in sp.encode(texts, num_threads=1)], np.int64)
    seen: dict[str, int] = {}
    place, sizes = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        parts = SAFE.split(text) if text else []
        sizes[i] = len(parts)
        place += [seen.setdefault(p, len(seen)) for p in parts]
    each = np.array([len(x) for x in sp.encode(list(seen), num_threads=1)] or [0], np.int64)
    total = np.r_[0, np.cumsum(each[np.array(place, np.int64)])] if place else np.zeros(1, np.int64)
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows are counted one by one; a null id stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = model_path
        if not os.path.exists(path):
            raise FileNotFoundError(path)
        for batch in batches:
            text = batch.column(1)
            _, offsets = buffers(text)
            for i, j in slices(offsets, 4 * SLICE_BYTES):
                n = counts([t or "" for t in text.slice(i, j - i).to_pylist()], path)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(offsets[i : j + 1])), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    out = id_text(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
