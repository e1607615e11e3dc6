"""Alignment of two tokenizers: where both cut a text, and which tokens end together.

A is a byte-level merge tokenizer (``tokenizers`` file) over a space and the text, B a SentencePiece model, which puts that
space itself.  All texts of a batch are merged in lockstep: one state vector holds a pointer into the A tokens and one into
the B tokens of every text; each step compares the byte ends under the pointers, notes the equal ones as cuts and links,
advances the pointer that is behind (both where equal) and drops texts that are through.  A text longer than ``LANE`` bytes
enters as several byte ranges, which need nothing from each other, so one long text does not prolong the steps.

Both tokenizers always cut before a single space between two characters that are neither white space nor the space mark (checked
when the files are loaded; other files are run over whole texts).  Texts are cut there, and equal parts of a task are encoded and
merged once.

Of two tokens that end together one is a suffix of the other, so the id pairs of a whole corpus are at most as many as the bytes of
both vocabularies together: the table of corpus-wide counts has that bound, whatever the input, and is broadcast.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from specband.llm.common import SLICE_BYTES, binary, buffers, cut_runs, id_text, joined, shared_folder, slices

LANE = 2048  # bytes of one text that one entry of the state vector walks through
CACHE_BYTES = 4 << 20  # parts a task keeps
ENCODE = 4096  # parts handed to a library at once
LINKS = 1 << 18  # links looked up at once
MARK = "▁"
SAFE = re.compile(rf"(?<=[^\s{MARK}]) (?=[^\s{MARK}])")
ROWS = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary"
RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def byte_of_symbol() -> dict[str, int]:
    """Byte-level tokenizers write printable bytes as themselves and the others, in order, as the characters from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Pair:
    """The two tokenizers, the bytes of their tokens, and whether texts may be cut at safe spaces."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        symbol = byte_of_symbol()
        self.a_bytes = {i: bytes(symbol[c] for c in t) if all(c in symbol for c in t) else t.encode() for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)}
        self.bound = sum(map(len, self.a_bytes.values())) + sum(map(len, self.b_bytes.values()))
        self.a_table, self.b_table = Spelling(self.a_bytes), Spelling(self.b_bytes)
        self.digits = [[f"{i}{mark}" for i in range(max(len(self.a_table.size), len(self.b_table.size)))] for mark in ",|;"]
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        plain = not spec.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        self.splits = plain and not any(MARK in p.lstrip(MARK) for p in pieces) and all(
            self.ids([f"{x} {y}"])[k][0] == [i for part in (x, y) for i in self.ids([part])[k][0]] for x, y in (("a", "b"), ("9", "'s"), (".", "<s>"), ("　a", "ﬁ"), ("é", "漢")) for k in (0, 1))

    def ids(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        batch = getattr(self.a, "encode_batch_fast", self.a.encode_batch)
        return [e.ids for e in batch([" " + t for t in texts], add_special_tokens=False)], self.b.encode(texts, num_threads=1)


@lru_cache(maxsize=1)
def pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def gather(values: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``values[at[r]:at[r + 1]]`` of the rows one after another, and their bounds."""
    size = at[rows + 1] - at[rows]
    ends = np.cumsum(size)
    index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(at[rows] - (ends - size), size)
    return values[index], np.r_[0, ends].astype(np.int64)


def flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after another, and the bounds of the texts."""
    at = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int64)
    return np.fromiter(chain.from_iterable(ids), np.int64, at[-1]), at


class Spelling:
    """Bytes of all tokens of a vocabulary."""

    def __init__(self, of: dict[int, bytes]) -> None:
        every = [of.get(i, b"") for i in range(max(of) + 1)]
        self.size = np.array([len(x) for x in every], np.int64)
        self.at, self.bytes = np.r_[0, np.cumsum(self.size)], np.frombuffer(b"".join(every), np.uint8)

    def spells(self, ids: np.ndarray, at: np.ndarray, texts: list[bytes]) -> np.ndarray:
        """Whether the tokens of a text, joined, are its bytes."""
        ends = np.r_[0, np.cumsum(self.size[ids])][at]
        same = np.diff(ends) == np.array([len(t) for t in texts], np.int64)
        if same.all():
            got, want = gather(self.bytes, self.at, ids)[0], np.frombuffer(b"".join(texts), np.uint8)
            if np.array_equal(got, want):
                return same
            off = np.r_[0, np.cumsum(got != want)]
            return off[ends[1:]] == off[ends[:-1]]
        here = np.flatnonzero(same)
        if len(here):
            sub, bounds = gather(ids, at, here)
            same[here] = self.spells(sub, bounds, [texts[k] for k in here])
        return same


def shown(a_id: np.ndarray, a_at: np.ndarray, i: np.ndarray, b_id: np.ndarray, b_at: np.ndarray, j: np.ndarray, digits: list[list[str]]) -> list[str]:
    """Per text its groups as ``a1,a2|b1;a3|b2,b3;``, from the links (i, j) that end them; ``digits`` spells ids with each separator."""
    group = np.r_[2 * np.searchsorted(i, np.arange(len(a_id))), 2 * np.searchsorted(j, np.arange(len(b_id))) + 1]
    order = np.argsort(group, kind="stable")
    group, ids = group[order], np.r_[a_id, b_id][order]
    step = np.diff(np.r_[group, group[-1:] + 2])  # 0: same side of a group, 1: from A to B, else the next group
    kind = np.where(step == 0, 0, np.where((step == 1) & (group % 2 == 0), 1, 2))
    words = [digits[k][x] for k, x in zip(kind.tolist(), ids.tolist())]
    at = (a_at + b_at).tolist()
    return ["".join(words[x:y]) for x, y in zip(at, at[1:])]


def lockstep(a_end: np.ndarray, a_at: np.ndarray, b_end: np.ndarray, b_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (into A, into B) of all tokens of a text that end at the same byte.

    ``a_end`` and ``b_end`` hold the byte ends of the tokens, rising over all texts; ``a_at`` and ``b_at`` the token bounds of the texts.
    """
    i, j, stop_i, stop_j = a_at[:-1].copy(), b_at[:-1].copy(), a_at[1:], b_at[1:]
    out_i, out_j = [], []
    alive = np.flatnonzero((i < stop_i) & (j < stop_j))
    i, j, stop_i, stop_j = i[alive], j[alive], stop_i[alive], stop_j[alive]
    while len(i):
        a, b = a_end[i], b_end[j]
        cut = a == b
        out_i.append(i[cut])
        out_j.append(j[cut])
        i, j = i + (a <= b), j + (b <= a)
        go = (i < stop_i) & (j < stop_j)
        if not go.all():
            i, j, stop_i, stop_j = i[go], j[go], stop_i[go], stop_j[go]
    if not out_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.sort(np.concatenate(out_i)), np.sort(np.concatenate(out_j))  # links of a text never cross, so sorting keeps partners


def lanes(ends: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Token bounds of byte ranges: a token belongs to the range (mark, next mark] in which it ends."""
    return np.searchsorted(ends, marks, side="right")


class Parts:
    """Encoded and merged parts, numbered in order of appearance."""

    def __init__(self, tokenizers: Pair) -> None:
        self.pair = tokenizers
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.shown: list[str] = []
        self.sizes = np.zeros((0, 3), np.int64)  # A tokens, B tokens, links; -1 where the bytes differ
        self.pairs, self.at, self.held = np.zeros(0, np.int64), np.zeros(1, np.int64), 0

    def add(self, texts: list[str]) -> None:
        for k in range(0, len(texts), ENCODE):
            self.merge(texts[k:k + ENCODE])

    def merge(self, texts: list[str]) -> None:
        p = self.pair
        a, b = p.ids(texts)
        raw = [b" " + t.encode() for t in texts]
        (a_id, a_at), (b_id, b_at) = flat(a), flat(b)
        good = p.a_table.spells(a_id, a_at, raw) & p.b_table.spells(b_id, b_at, raw)
        if not good.all():  # a text whose bytes a tokenizer changes has no tokens
            (a_id, a_at), (b_id, b_at) = (flat([x if ok else [] for x, ok in zip(ids, good)]) for ids in (a, b))
        a_end, b_end = np.cumsum(p.a_table.size[a_id]), np.cumsum(p.b_table.size[b_id])
        total = np.r_[0, a_end][a_at]  # the same byte ends in both: the joined bytes are equal
        marks = np.unique(np.concatenate([total, np.arange(0, total[-1], LANE)]))
        i, j = lockstep(a_end, lanes(a_end, marks), b_end, lanes(b_end, marks))
        links = np.searchsorted(i, a_at)
        self.shown += shown(a_id, a_at, i, b_id, b_at, j, p.digits)
        sizes = np.stack([np.diff(a_at), np.diff(b_at), np.diff(links)], 1)
        sizes[sizes[:, 2] == 0] = -1
        self.sizes = np.concatenate([self.sizes, sizes])
        self.pairs = np.concatenate([self.pairs, (a_id[i] << 32) | b_id[j]])
        self.at = np.concatenate([self.at, self.at[-1] + links[1:]])
        for t in texts:
            self.number[t] = len(self.number)
            self.held += len(t) + 16

    def find(self, texts: list[str]) -> np.ndarray:
        new = [t for t in dict.fromkeys(texts) if t not in self.number]
        self.add(new)
        return np.fromiter(map(self.number.__getitem__, texts), np.int64, len(texts))


def aligned(texts: list[str], parts: Parts) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Per text: A tokens, B tokens and links; the digest; and all linked pairs with their bounds."""
    if parts.held > CACHE_BYTES:
        parts.clear()
    pieces = [(SAFE.split(t) if parts.pair.splits else [t]) if t else [] for t in texts]
    place = parts.find([p for x in pieces for p in x])
    bounds = np.r_[0, np.cumsum([len(x) for x in pieces])].astype(np.int64)
    bad = np.flatnonzero(np.add.reduceat(np.r_[(parts.sizes[place, 2] < 0), False].astype(np.int64), bounds[:-1]) * (np.diff(bounds) > 0)) if len(texts) else np.zeros(0, np.int64)
    if len(bad):  # the whole text decides
        for k in bad:
            pieces[k] = [texts[k]]
        place = parts.find([p for x in pieces for p in x])
        bounds = np.r_[0, np.cumsum([len(x) for x in pieces])].astype(np.int64)
    sums = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(np.maximum(parts.sizes[place], 0), axis=0)])
    counts = sums[bounds[1:]] - sums[bounds[:-1]]
    words = list(map(parts.shown.__getitem__, place.tolist()))
    at = bounds.tolist()
    joint = ["".join(words[x:y]) for x, y in zip(at, at[1:])]
    digest = [hashlib.sha256(s[:-1].encode()).hexdigest() if s else "" for s in joint]
    pairs, inner = gather(parts.pairs, parts.at, place)
    return counts, digest, pairs, inner[bounds]


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: token, group and link counts, a digest of the groups, and ``pairs``: linked ids as 64-bit numbers (A id * 2^32 + B id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.collect()  # worker processes are used again: what an earlier task held goes first
        parts = Parts(pair(a_path, b_path))
        for batch in batches:
            text = batch.column(1)
            for i, j in slices(buffers(text)[1], SLICE_BYTES):
                counts, digest, pairs, at = aligned([t or "" for t in text.slice(i, j - i).to_pylist()], parts)
                n_a, n_b, n_links = (pa.array(c) for c in counts.T)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), n_a, n_b, n_links, n_links, pa.array(digest, pa.string()), binary(pairs, at)],
                                                 names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])

    return id_text(docs, id_col, text_col).mapInArrow(run, ROWS)


def held(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a binary column and the bounds of its rows."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    return joined(column, np.int64), ((at - at[0]) // 8).astype(np.int64)


def pair_counts(rows: DataFrame) -> DataFrame:
    """``pair, n``: links over all rows that hold the id pair; every task adds up what it has read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            pairs, _ = held(b.column(0))
            for lo in range(0, len(pairs), LINKS):
                k, n = np.unique(pairs[lo:lo + LINKS], return_counts=True)
                known, at = np.unique(np.r_[known, k], return_inverse=True)
                total = np.bincount(at, np.r_[total, n], len(known)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(total)], names=["pair", "n"])

    return rows.select("pairs").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def tokenizer_alignment(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts per row, and how its links stand among all links of the corpus.

    ``n_best`` counts the links whose pair is the most frequent one of their B id (ties included), ``count_sum`` adds up the corpus-wide
    counts of the links.  Null and empty texts and texts whose bytes a tokenizer changes have zeros and an empty digest; repeated rows
    all count; a null id stays null; an empty table gives no rows; texts of any length are whole, a very long one being a slice of its own.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "alignment")
    align(docs, a_path, b_path, id_col, text_col).write.parquet(folder)  # encoded once; the two passes below read numbers
    rows = spark.read.parquet(folder)
    bound = pair(a_path, b_path).bound
    counts = pair_counts(rows).limit(bound + 1).toPandas().sort_values("pair")  # bounded by the vocabularies
    if len(counts) > bound:
        raise ValueError("more id pairs than two tokenizers of bytes can link")
    keys, n = counts["pair"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)
    b = keys & 0xFFFFFFFF
    order = np.argsort(b, kind="stable")
    runs = cut_runs(b[order])
    best = np.zeros(len(n), bool)
    if len(n):
        best[order] = n[order] == np.repeat(np.maximum.reduceat(n[order], runs[:-1]), np.diff(runs))
    told = spark.sparkContext.broadcast((keys, n, best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = told.value
        for batch in batches:
            pairs, at = held(batch.column(batch.schema.get_field_index("pairs")))
            sums = [np.zeros((2, 0), np.int64)]
            for i, j in slices(at, LINKS):  # few links at a time; one row's links at least
                place = np.searchsorted(keys, pairs[at[i]:at[j]])
                total, top = np.r_[0, np.cumsum(n[place])], np.r_[0, np.cumsum(best[place])]
                lo, hi = at[i:j] - at[i], at[i + 1:j + 1] - at[i]
                sums.append(np.stack([top[hi] - top[lo], total[hi] - total[lo]]))
            n_best, count_sum = np.concatenate(sums, axis=1)
            own = {f: batch.column(batch.schema.get_field_index(f)) for f in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
            own |= {"n_best": pa.array(n_best), "count_sum": pa.array(count_sum)}
            names = [f.split()[0] for f in RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([own[f] for f in names], names=names)

    return rows.mapInArrow(run, RESULT)
