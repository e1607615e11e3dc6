"""Repeated passages of words, by prefix-partitioned suffix trees.

Suffixes (one per word, as deep as the window) are split into groups by a prefix, a longer one where the shorter would
give a group too large for a task.  Each group is a subtree of the corpus suffix tree: sorted suffixes with the depth
they share with their neighbour.  Internal nodes at least ``window`` words deep are repeats; every suffix below such a node
in a later document than the node's first one starts a repeated window, and overlapping windows make maximal repeats.
Suffixes that cannot meet another document's are settled before (see ``repeats``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from specband.llm.common import binary, id_text
from specband.llm.repeats import FREQUENT, GROUP_ROWS, cut_repeats, mask_spans

WINDOW, GRAM, PREFIX = 13, 6, 6


def deep_repeats(names: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Suffixes below an internal node of full depth whose first document is a smaller one.

    ``names`` hold a suffix as (first words, remaining words of the window); suffixes in sorted order that agree in both
    share a node of full depth.
    """
    order = np.lexsort((ids, names[:, 1], names[:, 0]))
    s = names[order]
    depth = np.zeros(len(s), np.int8)  # names shared with the suffix before: 0, 1 (prefix node) or 2 (deep node)
    depth[1:] = (s[1:, 0] == s[:-1, 0]).astype(np.int8) * (1 + (s[1:, 1] == s[:-1, 1]))
    nodes = np.r_[np.flatnonzero(depth < 2), len(s)]
    first = np.repeat(ids[order][nodes[:-1]], np.diff(nodes)) if len(s) else ids
    out = np.zeros(len(s), bool)
    out[order] = ids[order] > first
    return out


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, prefix: int = PREFIX, frequent: int = FREQUENT, group_rows: int = GROUP_ROWS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text, spans`` (removed word ranges, end exclusive) for every row.

    A word goes when a ``window``-word run over it also starts in a document with a smaller id.  Null and empty texts
    have no words; rows that share an id do not remove from each other; a row without an id loses nothing.  A very long text is a slice of
    its own; texts may have up to 2^28 words.  An empty table gives no rows.
    """

    def finish(ids, body, offsets, at, mask, w0, w1) -> pa.RecordBatch:
        n = len(at) - 1
        keep = np.flatnonzero(~mask)
        size = (w1 - w0)[keep] + 1  # a word and one space
        text = np.searchsorted(keep, at)
        ends = np.r_[0, np.cumsum(size)]
        src = np.repeat(w0[keep] - ends[:-1], size) + np.arange(ends[-1])
        joined = np.where(np.isin(np.arange(ends[-1]), ends[1:] - 1, assume_unique=True), 32, body[np.minimum(src, max(0, len(body) - 1))]) if len(keep) else np.zeros(0, np.uint8)
        stop = ends[text]
        drop = stop[1:][np.diff(stop) > 0] - 1  # no space after the last word of a text
        joined = np.delete(joined.astype(np.uint8), drop)
        stop = stop - np.r_[0, np.cumsum(np.diff(stop) > 0)]
        s, e, by = mask_spans(mask, at)
        base = np.repeat(at[:-1], np.diff(by))
        removed = np.r_[0, np.cumsum(mask)]
        spans = pa.ListArray.from_arrays(pa.array(by.astype(np.int32)), pa.StructArray.from_arrays([pa.array(s - base), pa.array(e - base)], ["a", "b"]))
        return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(at)), pa.array(removed[at[1:]] - removed[at[:-1]]), binary(joined, stop).cast(pa.string()), spans],
                                          names=["doc_id", "n_words", "n_removed", "kept_text", "spans"])

    return cut_repeats(id_text(docs, id_col, text_col), "words", window, gram, prefix, deep_repeats, finish,
                       "doc_id bigint, n_words bigint, n_removed bigint, kept_text string, spans array<struct<a:bigint,b:bigint>>", frequent, group_rows)


def digest(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
