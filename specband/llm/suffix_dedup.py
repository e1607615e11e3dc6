"""Repeated byte strings, by distributed prefix doubling.

A position's rank at a length names the string of that length that starts there; ranks of two halves give the rank of
twice the length.  Doubling starts at half the threshold: earlier rounds would sort every position of the corpus.  A partition sorts its positions by the first
rank, drops the ones that are unique, sorts the pairs (rank here, rank half a threshold on) of the others and reranks; equal
pairs are equal strings of full length.  Positions that no other document can share are settled before (see ``repeats``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from specband.llm.common import binary, id_text
from specband.llm.repeats import FREQUENT, GROUP_ROWS, cut_repeats, mask_spans

LENGTH, GRAM = 50, 20


def rerank(names: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Positions whose string of full length starts in a smaller document: one doubling step from half the length."""
    _, rank, times = np.unique(names[:, 0], return_inverse=True, return_counts=True)
    live = np.flatnonzero(times[rank] > 1)  # unique already at half the length: done
    order = live[np.lexsort((ids[live], names[live, 1], rank[live]))]
    r, s = rank[order], names[order, 1]
    new = np.r_[True, (r[1:] != r[:-1]) | (s[1:] != s[:-1])] if len(order) else np.zeros(0, bool)
    full = np.cumsum(new) - 1  # rank at the threshold
    out = np.zeros(len(ids), bool)
    out[order] = ids[order] > ids[order][new][full] if len(order) else False
    return out


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, frequent: int = FREQUENT, group_rows: int = GROUP_ROWS,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (the remaining bytes) and ``spans`` (removed byte ranges) for every row.

    A byte goes when a ``length``-byte string over it also starts in a document with a smaller id.  Null is empty; rows
    that share an id do not remove from each other; a row without an id loses nothing.  Cuts may fall inside a character.  A very long
    text is a slice of its own; texts may have up to 2^28 bytes.  An empty table gives no rows.
    """

    def finish(ids, body, offsets, at, mask, w0, w1) -> pa.RecordBatch:
        s, e, by = mask_spans(mask, at)
        base = np.repeat(at[:-1], np.diff(by))
        gone = np.r_[0, np.cumsum(mask)]
        spans = pa.ListArray.from_arrays(pa.array(by.astype(np.int32)), pa.StructArray.from_arrays([pa.array(s - base), pa.array(e - base)], ["a", "b"]))
        return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(at)), pa.array(gone[at[1:]] - gone[at[:-1]]), pa.array(np.diff(by)), binary(body[~mask], at - gone[at]), spans],
                                          names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    return cut_repeats(id_text(docs, id_col, text_col), "bytes", length, gram, length // 2, rerank, finish,
                       "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, spans array<struct<a:bigint,b:bigint>>", frequent, group_rows)


def digest(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
