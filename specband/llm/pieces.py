"""SentencePiece encoding and decoding, batched in numpy.

Texts are cut into units where no piece can lie across: at single spaces (a piece holds a space mark only at its front),
and, in long units, between characters that no piece joins.  Distinct units of equal length advance together: all their
substrings are hashed at once and looked up among the sorted hashes of the pieces.

*Unigram models* are searched by Viterbi: for every end and every piece length an elementwise maximum keeps the best sum of
scores and its back pointer.  Characters without a piece cost ten less than the worst piece and become byte pieces; of equal
sums the one with the longer last piece wins.

*Merge models* (the model file says which it is) are no maximum of a sum: on the 32k merge model a Viterbi search gives the
library's pieces for 54 % of the words only.  Their units advance by the same look-ups, but in every step each unit joins the
neighbours whose joint piece has the highest score, the leftmost of equal ones, which is what the library does.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from specband.llm.common import BYTE_CODE, Powers, Rolling, buffers, mix, slices

MARK = 0x2581
LONG_UNIT = 48  # characters beyond which a unit is cut between characters that no piece joins
UNKNOWN = 10.0
CODE = np.uint64(0x9E3779B97F4A7C15)


BPE = 2  # fixed value: the model type of merge models; 1 is unigram, the default


def model_type(path: str) -> int:
    """Type of a model file: field 3 of its trainer specification (field 2 of the file)."""
    with open(path, "rb") as f:
        data = f.read()

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 0x7F) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 0x80:
                return value, at

    def fields(at: int, end: int):
        while at < end:
            key, at = number(at)
            kind = key & 7
            if kind == 2:
                size, at = number(at)
                yield key >> 3, at, at + size
                at += size
            elif kind == 0:
                value, at = number(at)
                yield key >> 3, value, None
            else:
                at += 4 if kind == 5 else 8

    for name, a, b in fields(0, len(data)):
        if name == 2 and b is not None:
            return next((value for field, value, end in fields(a, b) if field == 3 and end is None), 1)
    return 1


class Vocabulary:
    """Piece hashes by length, scores, and what decoding needs."""

    def __init__(self, path: str, search: str | None = None) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.bytes = np.full(256, -1, np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.bytes[int(pieces[i][3:5], 16)] = i
        self.unknown = sp.unk_id()
        self.merges = search == "merges" if search else model_type(path) == BPE
        scores = np.array([sp.get_score(i) for i in range(n)], np.float64)
        self.floor = min(scores[normal].min(), 0.0) - UNKNOWN
        self.by_length = {}
        for length in sorted({len(pieces[i]) for i in normal}):
            ids = np.array([i for i in normal if len(pieces[i]) == length], np.int32)
            chars = np.array([[ord(c) for c in pieces[i]] for i in ids], np.uint64)
            keys = self.hashes(chars, length)[:, 0]
            order = np.argsort(keys)
            near = np.zeros(1 << 18, bool)  # leading bits of the keys: most substrings are no pieces and end here
            near[keys >> np.uint64(46)] = True
            self.by_length[length] = keys[order], ids[order], scores[ids[order]], near
        marks = [pieces[i] for i in normal if chr(MARK) in pieces[i].lstrip(chr(MARK))]
        self.splits = not marks  # no piece has a space mark behind another character
        out = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else p.replace(chr(MARK), " ").encode()
               for i, p in enumerate(pieces)]
        self.sizes = np.array([len(b) for b in out])
        self.starts = np.r_[0, np.cumsum(self.sizes)]
        self.body = np.frombuffer(b"".join(out), np.uint8)

    @staticmethod
    def hashes(chars: np.ndarray, length: int) -> np.ndarray:
        """Hashes of all substrings of a length, for every row of code points."""
        width = chars.shape[1] - length + 1
        h = np.zeros((len(chars), width), np.uint64)
        for k in range(length):
            h = (h + chars[:, k : k + width] + np.uint64(1)) * CODE
            h ^= h >> np.uint64(29)
        return h

    def find(self, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: no piece) and scores of substrings of a length."""
        keys, ids, scores, near = self.by_length[length]
        flat = hashes.ravel()
        maybe = np.flatnonzero(near[flat >> np.uint64(46)])
        at = np.minimum(np.searchsorted(keys, flat[maybe]), len(keys) - 1)
        hit = keys[at] == flat[maybe]
        found, value = np.full(len(flat), -1, np.int32), np.full(len(flat), -np.inf)
        found[maybe[hit]], value[maybe[hit]] = ids[at[hit]], scores[at[hit]]
        return found.reshape(hashes.shape), value.reshape(hashes.shape)

    def viterbi(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best segmentation of units of equal length: ids in order (-1: character without a piece) and piece lengths, 0-padded."""
        rows, n = chars.shape
        best = np.full((rows, n + 1), -np.inf)
        best[:, 0] = 0
        back, piece = np.zeros((rows, n + 1), np.int16 if n < 32000 else np.int32), np.full((rows, n + 1), -1, np.int32)
        tables = {k: self.find(self.hashes(chars, k), k) for k in self.by_length if k <= n}
        for end in range(1, n + 1):
            score, step, got = best[:, end - 1] + self.floor, np.ones(rows, back.dtype), np.full(rows, -1, np.int32)
            for k, (ids, scores) in tables.items():
                if k <= end:
                    s = best[:, end - k] + scores[:, end - k]
                    better = s >= score if k > 1 else s > score  # the longer piece wins ties
                    better &= np.isfinite(scores[:, end - k])
                    score, step, got = np.where(better, s, score), np.where(better, k, step), np.where(better, ids[:, end - k], got)
            best[:, end], back[:, end], piece[:, end] = score, step, got
        ids, lengths = np.full((rows, n), -1, np.int32), np.zeros((rows, n), np.int32)
        at, row = np.full(rows, n), np.arange(rows)
        for slot in range(n - 1, -1, -1):  # filled from the end
            live = at > 0
            if not live.any():
                break
            r, a = row[live], at[live]
            ids[r, slot], lengths[r, slot] = piece[r, a], back[r, a]
            at[live] = a - back[r, a]
        return ids, lengths

    def merged(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of units of equal length after all joins, best score first; ids and lengths as from ``viterbi``."""
        rows, n = chars.shape
        top = max(self.by_length) + 1
        scores, names = np.full((rows, n, top), -np.inf, np.float32), np.full((rows, n, top), -1, np.int32)
        for k in self.by_length:
            if k <= n:
                names[:, : n - k + 1, k], scores[:, : n - k + 1, k] = self.find(self.hashes(chars, k), k)
        scores, names = scores.ravel(), names.ravel()
        pos = np.arange(n)
        end, alive, todo = np.tile(pos + 1, (rows, 1)), np.ones((rows, n), bool), np.arange(rows)
        while len(todo) and n > 1:
            e = end[todo]
            length = np.take_along_axis(e, np.minimum(e, n - 1), 1) - pos  # of the piece joined with its neighbour
            can = alive[todo] & (e < n) & (length < top)
            at = (todo[:, None] * n + pos) * top + np.where(can, length, 0)
            value = np.where(can, scores[at], -np.inf)
            best = value.argmax(1)
            go = value[np.arange(len(todo)), best] > -np.inf
            todo, best = todo[go], best[go]
            gone = end[todo, best]
            end[todo, best] = end[todo, gone]
            alive[todo, gone] = False
        length = np.where(alive, end - pos, 0)
        return np.where(alive, names[(np.arange(rows)[:, None] * n + pos) * top + length], -1), length

    def seams(self, chars: np.ndarray) -> np.ndarray:
        """Places in a long unit that no piece lies across."""
        n = len(chars)
        cover = np.zeros(n + 1, np.int64)
        for k in self.by_length:
            if 1 < k <= n:
                at = np.flatnonzero(self.find(self.hashes(chars[None, :], k), k)[0][0] >= 0)
                np.add.at(cover, at + 1, 1)
                np.add.at(cover, at + k, -1)
        return np.flatnonzero(np.cumsum(cover)[:n] == 0)[1:]

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, one after another, and their offsets; every unit gets a space mark in front."""
        size = np.fromiter(map(len, units), np.int64, len(units)) + 1
        start = np.r_[0, np.cumsum(size)]
        codes = np.full(start[-1], MARK, np.uint32)
        inner = np.ones(len(codes), bool)
        inner[start[:-1]] = False
        codes[inner] = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes[codes == 0x20] = MARK
        # parts: short units whole, long ones cut where no piece lies across
        long = np.flatnonzero(size > LONG_UNIT)
        cuts = [start[i] + self.seams(codes[start[i] : start[i + 1]].astype(np.uint64)) for i in long.tolist()]
        begin = np.sort(np.concatenate([start[:-1], *cuts]))
        length, owner = np.diff(np.r_[begin, start[-1]]), np.searchsorted(start, begin, side="right") - 1
        made, done = np.zeros(len(begin), np.int64), []
        for n in np.unique(length).tolist():
            group = np.flatnonzero(length == n)
            step = max(1, (1 << 16) // n)
            for g in range(0, len(group), step):
                at = group[g : g + step]
                chars = codes[begin[at][:, None] + np.arange(n)].astype(np.uint64)
                ids, lengths = self.merged(chars) if self.merges else self.viterbi(chars)
                used = lengths > 0
                odd = np.flatnonzero(((ids < 0) & used).any(1))
                for r in odd.tolist():
                    row = self.with_bytes(ids[r][used[r]], lengths[r][used[r]], chars[r])
                    made[at[r]] = len(row)
                    done.append((at[r : r + 1], row))
                used[odd] = False
                plain = np.setdiff1d(np.arange(len(at)), odd, assume_unique=True)
                made[at[plain]] = used[plain].sum(1)
                done.append((at[plain], ids[used]))
        to = np.r_[0, np.cumsum(made)]
        out = np.zeros(to[-1], np.int32)
        for at, flat in done:
            count = made[at]
            out[np.repeat(to[at] - (np.cumsum(count) - count), count) + np.arange(len(flat))] = flat
        return out, np.r_[0, np.cumsum(np.bincount(owner, weights=made, minlength=len(units)).astype(np.int64))]

    def with_bytes(self, row: np.ndarray, lengths: np.ndarray, chars: np.ndarray) -> np.ndarray:
        out, ends = [], np.cumsum(lengths)
        for i, id_ in enumerate(row.tolist()):
            if id_ >= 0:
                out.append(id_)
                continue
            raw = chr(int(chars[ends[i] - 1])).encode("utf-8", "surrogatepass")
            ids = self.bytes[list(raw)]
            out += [self.unknown] if (ids < 0).any() else ids.tolist()
        return np.array(out, np.int32)

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """Texts of id lists (``at``: offsets); the space mark put in front is taken off again; ids out of range are nothing."""
        ok = (ids >= 0) & (ids < len(self.sizes))
        ids = np.where(ok, ids, 0)
        size = np.where(ok, self.sizes[ids], 0)
        ends = np.r_[0, np.cumsum(size)]
        src = np.repeat(self.starts[ids] - ends[:-1], size) + np.arange(ends[-1])
        raw = self.body[src].tobytes()
        texts = (raw[ends[a] : ends[b]].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:]))
        return [t[1:] if t.startswith(" ") else t for t in texts]


@lru_cache(maxsize=2)
def vocabulary(path: str, search: str | None = None) -> Vocabulary:
    return Vocabulary(path, search)


def unit_bounds(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of units, and unit offsets of texts: texts are cut at spaces with no space or space mark beside them."""
    n = len(body)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = body == 0x20
    mark = np.zeros(n, bool)
    mark[:-2] = (body[:-2] == 0xE2) & (body[1:-1] == 0x96) & (body[2:] == 0x81)
    blank_next, blank_before = np.ones(n, bool), np.ones(n, bool)
    blank_next[:-1] = (space | mark)[1:]
    blank_before[1:] = space[:-1]
    blank_before[3:] |= mark[:-3]
    edges = offsets[1:-1]
    inner = edges[(edges > 0) & (edges < n)]
    blank_before[inner] = True
    blank_next[inner - 1] = True
    cut = np.flatnonzero(space & ~blank_next & ~blank_before)
    full = np.flatnonzero(np.diff(offsets) > 0)
    starts = np.sort(np.r_[cut + 1, offsets[full]])
    ends = np.sort(np.r_[cut, offsets[full + 1]])
    return starts, ends, np.searchsorted(starts, offsets)


def encode_texts(body: np.ndarray, offsets: np.ndarray, vocab: Vocabulary, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts and their offsets; every distinct unit is searched once."""
    if vocab.splits:
        starts, ends, units = unit_bounds(body, offsets)
    else:
        full = np.flatnonzero(np.diff(offsets) > 0)
        starts, ends = offsets[full], offsets[full + 1]
        units = np.searchsorted(starts, offsets)
    h = mix(Rolling(BYTE_CODE[body], powers).raw(starts, ends) + (ends - starts).astype(np.uint64))
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    raw = body.tobytes()
    ids, at = vocab.encode_units([raw[starts[i] : ends[i]].decode() for i in first])
    size = np.diff(at)[which]
    out = np.r_[0, np.cumsum(size)]
    return ids[np.repeat(at[which] - out[:-1], size) + np.arange(out[-1])], out[units]


def encode(docs: DataFrame, model_path: str, search: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` for every row; null and empty texts have no ids; repeated rows get equal ids.

    ``search``: "viterbi" or "merges"; by default what the model file was trained for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, powers = vocabulary(model_path, search), Powers()
        for batch in batches:
            body, offsets = buffers(batch.column(1))
            for i, j in slices(offsets):
                ids, at = encode_texts(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], vocab, powers)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))], names=["doc_id", "ids"])

    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(tokens: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` for every row; null and empty id lists give the empty text; byte pieces that are no UTF-8 give U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model_path)
        for batch in batches:
            lists = batch.column(1).fill_null([])
            for i in range(0, len(lists), 500):
                part = lists.slice(i, 500)
                at = part.offsets.to_numpy().astype(np.int64)
                ids = part.flatten().fill_null(-1).to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 500), pa.array(vocab.decode(ids, at - at[0]), pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, decoded_sha256, exact`` for every row, encoded and decoded in one pass.

    ``exact``: decoding gave the text back; it does unless the text itself holds the space mark.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        vocab, powers = vocabulary(model_path), Powers()
        for batch in batches:
            body, offsets = buffers(batch.column(1))
            for i, j in slices(offsets):
                here, part = body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                ids, at = encode_texts(here, part, vocab, powers)
                texts, raw = [t.encode() for t in vocab.decode(ids, at)], here.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)), pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                     pa.array([t == raw[a:b] for t, a, b in zip(texts, part[:-1], part[1:])])], names=["doc_id", "ids", "decoded_sha256", "exact"])

    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, ids array<int>, decoded_sha256 string, exact boolean")
