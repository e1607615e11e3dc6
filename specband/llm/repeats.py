"""Windows of ``length`` symbols that also start in a document with a smaller id, found without moving the texts around.

Symbols are bytes or words.  Comparing every window would shuffle the corpus many times over, so most of them are settled
first, without loss:

1. *Anchors.* The smallest ``gram``-symbol hash inside a window is its anchor; equal windows have equal anchors at equal
   places.  Consecutive windows with one anchor occurrence form a run.  A run is sent as two hashes: its anchor and its
   whole content.  In the partition of an anchor, a run whose content starts in a smaller document is *covered* (all of its
   windows repeat); a run whose anchor occurs in no smaller document is settled as new; only runs that share an anchor,
   but not their content, with another run stay *open*: they lie next to edits and at the ends of copied passages.
2. *Suffixes.* Windows of open runs are compared one by one by the caller's method, words in groups by a shorter prefix,
   bytes in groups by their anchor; a prefix or anchor that is frequent is split again by the full window.
3. Documents meet their covered runs and repeated windows once, by a key, and are cut.

Slices combine equal entries before every exchange, and what is frequent inside a slice is told to the partition as one
entry, so one passage in a third of all documents is no large group anywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from specband.functions.scale import cut
from specband.llm.common import BYTE_CODE, SPACE, Powers, Rolling, binary, buffers, cut_runs, finished, joined, mix, owners, partitions, slices, within, word_spans
from specband.llm.decontaminate import winnowed

FREQUENT = 16  # entries of one slice that make an anchor or prefix frequent
GROUP_ROWS = 200_000  # suffixes of one prefix in a partition, beyond which the prefix is lengthened
RUNS, COVERED, OPEN, SUFFIX, LONG, REPEAT = range(6)
BLOBS = "part int, kind int, keys binary, ids binary, counts binary, values binary, body binary"
Resolver = Callable[[np.ndarray, np.ndarray], np.ndarray]  # names (n x 2), ids -> which repeat a smaller document


def symbols(body: np.ndarray, offsets: np.ndarray, unit: str, powers: Powers):
    """Symbol codes and their offsets by text, with the byte bounds of words."""
    if unit == "bytes":
        return BYTE_CODE[body], offsets, None, None
    starts, ends, words = word_spans(body, offsets, ~SPACE)
    return Rolling(BYTE_CODE[body], powers).raw(starts, ends), words, starts, ends


def anchor_runs(codes: np.ndarray, at: np.ndarray, length: int, gram: int, powers: Powers):
    """Runs of windows with one anchor: text, first and last window, anchor hash, content hash; and the rolling hash."""
    roll = Rolling(codes, powers)
    own = owners(at)
    w = np.flatnonzero(within(at, length, max(0, len(codes) - length + 1)))
    if not len(w):
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64), roll
    grams = roll.windows(gram)
    a = winnowed(grams, length - gram + 1)[w]
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (w[1:] != w[:-1] + 1)])
    first, last, anchor = w[new], w[np.r_[new[1:] - 1, len(w) - 1]], a[new]
    shape = ((anchor - first) << 32 | (last - first)).astype(np.uint64)
    return own[first], first, last, grams[anchor], mix(roll.raw(first, last + length) + mix(shape)), roll


def rows_of(part, kind: int, keys: np.ndarray, ids: np.ndarray, who: np.ndarray, values: np.ndarray, pieces: tuple | None = None) -> pa.RecordBatch:
    """Blob rows: the values (one or more numbers each) that go to every partition, grouped by document.

    ``pieces`` (bytes, starts, ends) adds a byte string to every value.
    """
    order = np.lexsort((who, part))
    part, who, values = part[order], who[order], np.ascontiguousarray(values[order])
    heads = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (who[1:] != who[:-1])]) if len(part) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[heads, len(part)]).astype(np.int32)
    rows = cut_runs(part[heads])
    first = heads[rows[:-1]]
    cuts = np.r_[first, len(part)] if len(first) else np.zeros(1, np.int64)
    width = values.shape[1] if values.ndim == 2 else 1
    if pieces is None:
        text = pa.nulls(len(first), pa.binary())
    else:
        raw, a, b = pieces[0], pieces[1][order], pieces[2][order]
        at, which = spread(a, b - 1)
        text = binary(raw[at], np.r_[0, np.cumsum(b - a)][cuts])
    return pa.RecordBatch.from_arrays(
        [pa.array(part[first].astype(np.int32)), pa.array(np.full(len(first), kind, np.int32)), binary(keys[who[heads]], rows), binary(ids[who[heads]], rows), binary(counts, rows),
         binary(values.ravel(), cuts * width), text], names=["part", "kind", "keys", "ids", "counts", "values", "body"])


def read_blobs(batches: list[pa.RecordBatch], width: int, dtype=np.uint64):
    """Keys, ids, document index per value, and values of blob rows."""
    keys, ids, counts, values = ([joined(b.column(c), t) for b in batches] for c, t in ((2, np.int64), (3, np.int64), (4, np.int32), (5, dtype)))
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    keys, ids, counts, values = cat(keys, np.int64), cat(ids, np.int64), cat(counts, np.int32), cat(values, dtype)
    return keys, ids, np.repeat(np.arange(len(keys)), counts), values.reshape(-1, width) if width > 1 else values


def run_entries(h: np.ndarray, content: np.ndarray) -> np.ndarray:
    """(anchor, content) in 12 bytes: the partition already tells part of the anchor, and anchors that meet by chance only
    keep a run open; contents are compared by all 64 bits."""
    return np.stack([h >> np.uint64(32), content & np.uint64(0xFFFFFFFF), content >> np.uint64(32)], 1).astype(np.uint32)


def entry_parts(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return v[:, 0], v[:, 1].astype(np.uint64) | v[:, 2].astype(np.uint64) << np.uint64(32)


def home(keys: np.ndarray, parts: int) -> np.ndarray:
    return (keys.view(np.uint64) % np.uint64(parts)).astype(np.int32)


def in_pieces(n: int, step: int = 1 << 19) -> Iterator[slice]:
    for i in range(0, n, step):
        yield slice(i, min(i + step, n))


MERGED_ROWS = 256  # rows that are handed on as one


def merged(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Rows of one kind and partition as one row: their blobs, one after another."""
    one = lambda c: pa.array([joined(pa.concat_arrays([b.column(c) for b in rows]).fill_null(b""), np.uint8).tobytes()], pa.binary())
    return pa.RecordBatch.from_arrays([*(rows[0].column(c).slice(0, 1) for c in range(2)), *map(one, range(2, 7))], names=rows[0].schema.names)


def split_kinds(batches: Iterator[pa.RecordBatch], kinds: tuple[int, ...]):
    """Batches of the wanted kinds, kept for the end; rows of other kinds are handed on, many as one."""
    mine: dict[int, list] = {k: [] for k in kinds}
    rest: dict[tuple[int, int], list] = {}
    for b in batches:
        part, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
        for k in np.unique(kind).tolist():
            if k in mine:
                mine[k].append(b.filter(pa.array(kind == k)))
                continue
            for p in np.unique(part[kind == k]).tolist():
                held = rest.setdefault((k, p), [])
                held.append(b.filter(pa.array((kind == k) & (part == p))))
                if sum(x.num_rows for x in held) >= MERGED_ROWS:
                    yield None, merged(rest.pop((k, p)))
    for held in rest.values():
        yield None, merged(held)
    yield mine, None


def scan_runs(docs: DataFrame, unit: str, length: int, gram: int, parts: int, frequent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            body, offsets = buffers(batch.column(2))
            keys_all, ids_all = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, j in slices(offsets):
                codes, at, _, _ = symbols(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], unit, powers)
                own, _, _, h, content, _ = anchor_runs(codes, at, length, gram, powers)
                keys, ids = keys_all[i:j], ids_all[i:j]
                # once per document and content, the smallest document of a content first
                order = np.lexsort((own, ids[own], content))
                own, h, content = own[order], h[order], content[order]
                again = np.r_[False, (content[1:] == content[:-1]) & (own[1:] == own[:-1])] if len(own) else np.zeros(0, bool)
                own, h, content = own[~again], h[~again], content[~again]
                runs = cut_runs(content)
                low = np.repeat(ids[own[runs[:-1]]], np.diff(runs))
                late = ids[own] > low
                yield rows_of(home(keys[own[late]], parts), COVERED, keys, ids, own[late], content[late])
                own, h, content = own[~late], h[~late], content[~late]
                _, inverse, times = np.unique(h, return_inverse=True, return_counts=True)
                often = times[inverse] >= frequent
                yield rows_of((h[~often] % np.uint64(parts)).astype(np.int32), RUNS, keys, ids, own[~often], run_entries(h[~often], content[~often]))
                if often.any():
                    hot = np.unique(h[often])
                    yield rows_of((hot % np.uint64(parts)).astype(np.int32), RUNS, np.zeros(1, np.int64), np.array([NO_ID]), np.zeros(len(hot), np.int64), run_entries(hot, hot * 0))
                    yield rows_of(home(keys[own[often]], parts), OPEN, keys, ids, own[often], content[often])

    return docs.mapInArrow(run, BLOBS)


NO_ID = -(1 << 63)  # marks entries that stand for a frequent anchor or prefix


def settle_runs(blobs: DataFrame, parts: int) -> DataFrame:
    """Per anchor: which runs are covered by a smaller document, which stay open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mine, other in split_kinds(batches, (RUNS,)):
            if mine is None:
                yield other
                continue
            keys, ids, who, v = read_blobs(mine.pop(RUNS), 3, np.uint32)
            if not len(v):
                return
            h, content = entry_parts(v)
            order = np.lexsort((ids[who], content, h))
            who, h, content = who[order], h[order], content[order]
            id_ = ids[who]
            groups = cut_runs(h)
            size = np.diff(groups)
            same = np.r_[False, (h[1:] == h[:-1]) & (content[1:] == content[:-1])]
            classes = np.r_[np.flatnonzero(~same), len(v)]
            low = np.repeat(id_[classes[:-1]], np.diff(classes))
            covered = id_ > low
            smallest = np.minimum.reduceat(id_, groups[:-1])  # the mark of a frequent anchor is below all ids
            open_ = ~covered & (np.repeat(smallest, size) < id_)
            met = np.repeat(np.maximum.reduceat(open_, groups[:-1]), size)
            for kind, pick in ((COVERED, covered), (OPEN, ~covered & met & (id_ != NO_ID))):
                at = np.flatnonzero(pick)
                for s in in_pieces(len(at)):
                    w = who[at[s]]
                    yield rows_of(home(keys[w], parts), kind, keys, ids, w, content[at[s]])

    return blobs.repartitionById(parts, "part").mapInArrow(run, BLOBS)


def per_document(blobs: DataFrame, parts: int, kinds: dict[int, str]) -> DataFrame:
    """``key`` and one binary column of distinct sorted values per kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mine, _ in split_kinds(batches, tuple(kinds)):
            if mine is None:
                continue
            lists = {}
            for k in kinds:
                keys, _, who, v = read_blobs(mine[k], 1)
                key = keys[who]
                order = np.lexsort((v, key))
                key, v = key[order], v[order]
                if len(v):
                    once = np.r_[True, (key[1:] != key[:-1]) | (v[1:] != v[:-1])]
                    key, v = key[once], v[once]
                lists[k] = key, v
            every = np.unique(np.concatenate([key for key, _ in lists.values()]))
            for s in in_pieces(len(every), 1000):
                part, cols = every[s], []
                for key, v in lists.values():
                    a, b = np.searchsorted(key, part[0]), np.searchsorted(key, part[-1], side="right")
                    cols.append(binary(v[a:b], np.r_[np.searchsorted(key[a:b], part), b - a]))
                yield pa.RecordBatch.from_arrays([pa.array(part), *cols], names=["key", *kinds.values()])

    return blobs.repartitionById(parts, "part").mapInArrow(run, "key bigint, " + ", ".join(f"{c} binary" for c in kinds.values()))


def listed(own: np.ndarray, content: np.ndarray, column: pa.Array) -> np.ndarray:
    """Whether each (text, content) is in that text's list."""
    column = column.fill_null(b"")
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    tag = lambda text, v: mix(v + mix(text.astype(np.uint64)))
    return np.isin(tag(own, content), tag(np.repeat(np.arange(len(column)), np.diff(at) // 8), joined(column, np.uint64)))


def spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges first..last, and the range each belongs to."""
    size = last - first + 1
    which = np.repeat(np.arange(len(first)), size)
    return first[which] + np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size), which


def open_suffixes(docs: DataFrame, unit: str, length: int, gram: int, prefix: int, parts: int, frequent: int) -> DataFrame:
    """Windows of open runs as (prefix name, rest name, start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            body, offsets = buffers(batch.column(2))
            keys_all, ids_all = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, j in slices(offsets):
                codes, at, _, _ = symbols(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], unit, powers)
                own, first, last, _, content, roll = anchor_runs(codes, at, length, gram, powers)
                use = listed(own, content, batch.column(3).slice(i, j - i))
                start, which = spread(first[use], last[use])
                own = own[use][which]
                keys, ids = keys_all[i:j], ids_all[i:j]
                a, b = roll.raw(start, start + prefix), roll.raw(start + prefix, start + length)
                order = np.lexsort((ids[own], b, a))
                own, a, b, start = own[order], a[order], b[order], start[order]
                new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
                runs = np.r_[np.flatnonzero(new), len(a)]
                late = ids[own] > np.repeat(ids[own[runs[:-1]]], np.diff(runs))
                pos = (start - at[own]).astype(np.uint64)
                yield rows_of(home(keys[own[late]], parts), REPEAT, keys, ids, own[late], pos[late])
                own, v = own[~late], np.stack([a[~late], b[~late], pos[~late]], 1)
                _, inverse, times = np.unique(v[:, 0], return_inverse=True, return_counts=True)
                often = times[inverse] >= frequent
                yield rows_of((v[~often, 0] % np.uint64(parts)).astype(np.int32), SUFFIX, keys, ids, own[~often], v[~often])
                if often.any():
                    hot = np.unique(v[often, 0])
                    yield rows_of((hot % np.uint64(parts)).astype(np.int32), SUFFIX, np.zeros(1, np.int64), np.array([NO_ID]), np.zeros(len(hot), np.int64), np.stack([hot, hot * 0, hot * 0], 1))
                    yield rows_of(longer(v[often], parts), LONG, keys, ids, own[often], v[often])

    return docs.mapInArrow(run, BLOBS)


def open_runs(docs: DataFrame, length: int, gram: int, prefix: int, parts: int, frequent: int) -> DataFrame:
    """Open runs of bytes, as their content, to the partitions of their anchors: a run's windows overlap, so its bytes are
    far less than the names of its windows.  Runs of an anchor that is frequent in the slice go window by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            body, offsets = buffers(batch.column(2))
            keys_all, ids_all = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, j in slices(offsets):
                here, at = body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                own, first, last, h, content, roll = anchor_runs(BYTE_CODE[here], at, length, gram, powers)
                use = listed(own, content, batch.column(3).slice(i, j - i))
                own, first, last, h = own[use], first[use], last[use], h[use]
                keys, ids = keys_all[i:j], ids_all[i:j]
                _, inverse, times = np.unique(h, return_inverse=True, return_counts=True)
                often = times[inverse] >= frequent
                few, part = np.flatnonzero(~often), lambda x: (x % np.uint64(parts)).astype(np.int32)
                values = np.stack([h, (first - at[own]).astype(np.uint64), (last - first).astype(np.uint64)], 1)
                yield rows_of(part(h[few]), SUFFIX, keys, ids, own[few], values[few], (here, first[few], last[few] + length))
                if often.any():
                    hot = np.unique(h[often])
                    none = np.zeros(len(hot), np.int64)
                    yield rows_of(part(hot), SUFFIX, np.zeros(1, np.int64), np.array([NO_ID]), none, np.stack([hot, hot * 0, hot * 0], 1), (here, none, none))
                    start, which = spread(first[often], last[often])
                    who = own[often][which]
                    names = np.stack([roll.raw(start, start + prefix), roll.raw(start + prefix, start + length), (start - at[who]).astype(np.uint64)], 1)
                    yield rows_of(longer(names, parts), LONG, keys, ids, who, names)

    return docs.mapInArrow(run, BLOBS)


def compare_runs(blobs: DataFrame, length: int, prefix: int, parts: int, resolve: Resolver, group_rows: int) -> DataFrame:
    """Windows of open runs that repeat one of a smaller document; runs of a frequent anchor go on, window by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mine, other in split_kinds(batches, (SUFFIX,)):
            if mine is None:
                yield other
                continue
            got = mine.pop(SUFFIX)
            keys, ids, who, v = read_blobs(got, 3)
            if not len(v):
                return
            body = np.concatenate([joined(b.column(6), np.uint8) for b in got])
            del got
            mark = ids[who] == NO_ID  # entries for frequent anchors hold no bytes
            hot = np.unique(v[mark, 0])
            who, v = who[~mark], v[~mark]
            size = v[:, 2].astype(np.int64) + 1  # windows of a run
            begin = np.r_[0, np.cumsum(size + length - 1)][:-1]
            order = np.argsort(v[:, 0], kind="stable")
            groups = cut_runs(v[order, 0])
            far = np.isin(v[order[groups[:-1]], 0], hot)  # this anchor's other runs went window by window
            total = np.r_[0, np.cumsum(size[order])]
            powers, g = Powers(), 0
            while g < len(groups) - 1:  # anchors together, up to a bounded number of windows
                e = max(g + 1, int(np.searchsorted(total[groups], total[groups[g]] + group_rows, side="right")) - 1)
                e = g + 1 if far[g] else min([e, *(g + np.flatnonzero(far[g:e])[:1])])
                r = order[groups[g] : groups[e]]
                # windows of these runs over their own bytes, one run after another
                at, _ = spread(begin[r], begin[r] + size[r] + length - 2)
                roll = Rolling(BYTE_CODE[body[at]], powers)
                head = np.r_[0, np.cumsum(size[r] + length - 1)][:-1]
                start, which = spread(head, head + size[r] - 1)
                names = np.stack([roll.raw(start, start + prefix), roll.raw(start + prefix, start + length)], 1)
                owner = who[r][which]
                pos = v[r, 1][which] + (start - head[which]).astype(np.uint64)
                if far[g] or total[groups[e]] - total[groups[g]] > group_rows:  # one frequent anchor
                    for s in in_pieces(len(pos)):
                        values = np.stack([names[s, 0], names[s, 1], pos[s]], 1)
                        yield rows_of(longer(values, parts), LONG, keys, ids, owner[s], values)
                else:
                    hit = np.flatnonzero(resolve(names, ids[owner]))
                    yield rows_of(home(keys[owner[hit]], parts), REPEAT, keys, ids, owner[hit], pos[hit])
                g = e

    return blobs.repartitionById(parts, "part").mapInArrow(run, BLOBS)


def longer(v: np.ndarray, parts: int) -> np.ndarray:
    """Partition by the full window instead of its prefix."""
    return (mix(v[:, 0] + mix(v[:, 1])) % np.uint64(parts)).astype(np.int32)


def compare(blobs: DataFrame, parts: int, kind: int, resolve: Resolver, group_rows: int) -> DataFrame:
    """Windows that repeat one of a smaller document; prefixes that are frequent go on to be split by the full window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mine, other in split_kinds(batches, (kind,)):
            if mine is None:
                yield other
                continue
            keys, ids, who, v = read_blobs(mine.pop(kind), 3)
            if not len(v):
                return
            if kind == SUFFIX:
                order = np.argsort(v[:, 0], kind="stable")
                who, v = who[order], v[order]
                groups = cut_runs(v[:, 0])
                size = np.diff(groups)
                far = np.repeat((np.minimum.reduceat(ids[who], groups[:-1]) == NO_ID) | (size > group_rows), size)
                at = np.flatnonzero(far & (ids[who] != NO_ID))
                for s in in_pieces(len(at)):
                    yield rows_of(longer(v[at[s]], parts), LONG, keys, ids, who[at[s]], v[at[s]])
                who, v = who[~far], v[~far]
            at = np.flatnonzero(resolve(v[:, :2], ids[who]))
            for s in in_pieces(len(at)):
                w = who[at[s]]
                yield rows_of(home(keys[w], parts), REPEAT, keys, ids, w, v[at[s], 2])

    return blobs.repartitionById(parts, "part").mapInArrow(run, BLOBS)


def cut_repeats(docs: DataFrame, unit: str, length: int, gram: int, prefix: int, resolve: Resolver, finish: Callable, schema: str,
                frequent: int = FREQUENT, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``docs`` (doc_id, text) with what ``finish`` says about every text, given the mask of its repeated symbols.

    Rows with a null id neither cover others nor lose anything.  Rows of one id never cover each other.
    """
    spark, parts = docs.sparkSession, partitions(docs)
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
    lists = cut(per_document(settle_runs(scan_runs(keyed.where(F.col("doc_id") != NO_ID), unit, length, gram, parts, frequent), parts), parts, {COVERED: "covered", OPEN: "open"}))
    finished(spark)
    opened = keyed.join(lists.where(F.octet_length("open") > 0).select("key", "open").hint("shuffle_hash"), "key").select("key", "doc_id", "text", "open")
    if unit == "bytes":
        found = compare_runs(open_runs(opened, length, gram, prefix, parts, frequent), length, prefix, parts, resolve, group_rows)
    else:
        found = compare(open_suffixes(opened, unit, length, gram, prefix, parts, frequent), parts, SUFFIX, resolve, group_rows)
    starts = per_document(compare(found, parts, LONG, resolve, group_rows), parts, {REPEAT: "starts"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            body, offsets = buffers(batch.column(2))
            for i, j in slices(offsets):
                here = body[offsets[i] : offsets[j]]
                codes, at, w0, w1 = symbols(here, offsets[i : j + 1] - offsets[i], unit, powers)
                own, first, last, _, content, _ = anchor_runs(codes, at, length, gram, powers)
                covered, single = batch.column(3).slice(i, j - i), batch.column(4).slice(i, j - i).fill_null(b"")
                use = listed(own, content, covered)
                lens = np.diff(np.frombuffer(single.buffers()[1], np.int32)[single.offset : single.offset + len(single) + 1]) // 8
                more = joined(single, np.uint64).astype(np.int64) + np.repeat(at[:-1], lens)
                step = np.zeros(len(codes) + 1, np.int64)
                np.add.at(step, np.r_[first[use], more], 1)
                np.add.at(step, np.r_[last[use] + length, more + length], -1)
                yield finish(batch.column(1).slice(i, j - i), here, offsets[i : j + 1] - offsets[i], at, np.cumsum(step)[:-1] > 0, w0, w1)

    both = keyed.join(lists.select("key", "covered").hint("shuffle_hash"), "key", "left").join(starts.hint("shuffle_hash"), "key", "left")
    out = both.select("key", "doc_id", "text", "covered", "starts").mapInArrow(run, schema)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def mask_spans(mask: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal true runs inside texts: starts, ends, offsets by text."""
    before = np.r_[False, mask[:-1]] if len(mask) else mask
    after = np.r_[mask[1:], False] if len(mask) else mask
    heads = np.zeros(len(mask), bool)
    heads[at[:-1][np.diff(at) > 0]] = True
    tails = np.zeros(len(mask), bool)
    tails[at[1:][np.diff(at) > 0] - 1] = True
    starts = np.flatnonzero(mask & (~before | heads))
    ends = np.flatnonzero(mask & (~after | tails)) + 1
    return starts, ends, np.searchsorted(starts, at)
