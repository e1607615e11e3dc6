"""Benchmark decontamination by winnowing.

Both sides keep, of every ``t - k + 1`` consecutive k-gram hashes, the smallest (the leftmost of equal ones).  A span of at
least ``t`` words that a document shares with an item then shares a kept fingerprint at the same place, so only windows
around matching fingerprints are looked at.  A match is extended: every ``t``-word window that covers the fingerprint is
a candidate, and candidates are joined with the items' windows by hash; hit windows join to spans.  Items shorter than
``t`` words are one window of their own length, which winnowing cannot promise to find; those few lengths are looked up at
every word.

Fingerprints and windows of the benchmark reach the tasks as bit tables of a fixed size, which never miss and only
sometimes let a stranger through; the exact test is a shuffled join of candidates and windows, the same for a benchmark of
any size.  Of the benchmark, the driver holds nothing but the bit tables.  Rows without a candidate are never shuffled; the others
are numbered and written once, so that hits find their row whatever the scan order was.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from specband.functions.scale import cut
from specband.llm.common import ALNUM, BYTE_CODE, LOWER, Powers, Rolling, buffers, mix, owners, slices, within, word_spans

WINDOW, GRAM = 10, 5
BLOCK_WINDOWS = 2_000_000  # windows the bit tables are sized for: 16 bits each, three tables of 4 MB
SALTS = 16  # parts of the candidates of one window, which many documents may share
POSITION_BITS = 28
PRINT, FULL, SHORT, LENGTH = range(4)  # bit tables, and the lengths of short windows
RANGES = "array<struct<a:bigint,b:bigint,s:bigint,e:bigint>>"


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def winnowed(grams: np.ndarray, width: int, bits: int = POSITION_BITS) -> np.ndarray:
    """For every window of ``width`` grams, the position of its smallest gram (leftmost of equal ones).

    Positions take the low ``bits`` of a hash; a longer sequence goes in parts that overlap by a window.
    """
    part = 1 << bits
    if len(grams) > part:
        step = part - width + 1
        return np.concatenate([at + winnowed(grams[at : at + part], width, bits) for at in range(0, len(grams) - width + 1, step)])
    at = np.arange(len(grams), dtype=np.uint64)
    low = np.uint64(part - 1)
    return (sliding_min((grams & ~low) | at, width) & low).astype(np.int64)


def word_hashes(body: np.ndarray, offsets: np.ndarray, powers: Powers):
    low = LOWER[body]
    starts, ends, words = word_spans(low, offsets, ALNUM)
    return Rolling(BYTE_CODE[low], powers).raw(starts, ends), starts, ends, words


def item_windows(bench: DataFrame, window: int, gram: int) -> DataFrame:
    """``item, length, hash`` of every window of every item, and of its winnowed fingerprints with length 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            body, offsets = buffers(batch.column(1))
            for i, j in slices(offsets):
                part = offsets[i : j + 1] - offsets[i]
                h, _, _, words = word_hashes(body[offsets[i] : offsets[j]], part, powers)
                roll, sizes, own = Rolling(h, powers), np.diff(words), owners(words)
                full = np.flatnonzero(within(words, window, len(h)))
                short = np.flatnonzero((sizes > 0) & (sizes < window))
                grams = roll.windows(gram)
                best = winnowed(grams, window - gram + 1)
                prints = np.unique(best[within(words, window, len(best))])
                start = np.r_[full, words[short]]
                length = np.r_[np.full(len(full), window), sizes[short]]
                who = np.r_[own[full], short, own[prints]]
                hashes = np.r_[roll.raw(start, start + length), grams[prints]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).take(pa.array(who)), pa.array(np.r_[length, np.zeros(len(prints))].astype(np.int32)), pa.array(hashes.view(np.int64))],
                    names=["item", "length", "hash"])

    return bench.mapInArrow(run, "item string, length int, hash bigint")


def probes(hashes: np.ndarray, cells: int) -> list[np.ndarray]:
    """Three cells of a bit table for every hash."""
    shift = np.uint64(64 - (cells.bit_length() - 1))
    return [h >> shift for h in (hashes, mix(hashes), mix(~hashes))]


def held(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the table may hold; it never misses one that it does."""
    ok = np.ones(len(hashes), bool)
    for cell in probes(hashes, len(table) * 64):
        ok &= (table[cell >> np.uint64(6)] >> (cell & np.uint64(63))) & np.uint64(1) == 1
    return ok


def bit_tables(windows: DataFrame, window: int, cells: int) -> tuple[np.ndarray, list[int]]:
    """Bit tables of fingerprints, full and short windows, and the lengths that windows have.

    Every partition fills its own tables, their words are combined by OR; the driver gets at most three tables.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, lengths = np.zeros((3, cells // 64), np.uint64), set()
        for batch in batches:
            length, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            kind = np.where(length == 0, PRINT, np.where(length == window, FULL, SHORT))
            lengths.update(np.unique(length[length > 0]).tolist())
            for cell in probes(hashes, cells):
                np.bitwise_or.at(tables, (kind, (cell >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (cell & np.uint64(63)))
        kind, word = np.nonzero(tables)
        more = np.array(sorted(lengths), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[kind, np.full(len(more), LENGTH)].astype(np.int32)), pa.array(np.r_[word, more].astype(np.int32)),
                                          pa.array(np.r_[tables[kind, word].view(np.int64), np.ones(len(more), np.int64)])], names=["kind", "word", "bits"])

    parts = windows.select("length", "hash").mapInArrow(run, "kind int, word int, bits bigint")
    got = parts.groupBy("kind", "word").agg(F.bit_or("bits").alias("bits")).toPandas()
    kind, word, bits = (got[c].to_numpy(t) for c, t in (("kind", np.int64), ("word", np.int64), ("bits", np.int64)))
    tables, cell = np.zeros((3, cells // 64), np.uint64), kind < LENGTH
    tables[kind[cell], word[cell]] = bits[cell].view(np.uint64)
    return tables, sorted(word[~cell].tolist())


def candidates(body: np.ndarray, offsets: np.ndarray, tables: np.ndarray, lengths: list[int], window: int, gram: int, powers: Powers):
    """Word offsets of the texts of a slice, and windows that may be an item's: text, first word, length, hash, first and last byte in the slice."""
    h, starts, ends, words = word_hashes(body, offsets, powers)
    roll, own, out = Rolling(h, powers), owners(words), []
    for n in lengths:
        if n == window:
            grams = roll.windows(gram)
            at = np.unique(winnowed(grams, n - gram + 1)[within(words, n, max(0, len(h) - n + 1))])
            at = at[held(tables[PRINT], grams[at])]
            # extend: every window that covers a matching fingerprint
            start = np.unique((at[:, None] - np.arange(n - gram + 1)[None, :]).ravel())
            start = start[(start >= 0) & (start + n <= len(h))]
            start = start[own[start] == own[start + n - 1]]
        else:
            start = np.flatnonzero(within(words, n, len(h)))
        hashes = roll.raw(start, start + n)
        ok = held(tables[FULL if n == window else SHORT], hashes)
        out.append((start[ok], np.full(int(ok.sum()), n), hashes[ok]))
    start, length, hashes = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, t) for k, t in enumerate((np.int64, np.int64, np.uint64)))
    order = np.lexsort((length, start))
    start, length, hashes = start[order], length[order], hashes[order]
    return words, own[start], start, length, hashes, starts[start], ends[start + length - 1]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, block_windows: int = BLOCK_WINDOWS,
                  id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per input row: ``doc_id, text, n_words, spans`` (hit word ranges, end exclusive), ``cuts`` (their byte ranges),
    ``items`` (ids as strings, sorted) and the columns named in ``keep``.

    ``block_windows`` sizes the bit tables; a larger benchmark only lets more candidates through to the exact join.
    Null and empty texts and items have no words, hence no hits; repeated rows get equal results; an empty benchmark hits
    nothing; items with a null id count as the item "null"; texts are whole at any length.
    """
    bench = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("null")).alias("item"), F.col(f"`{item_text}`").cast("string").alias("text"))
    rest = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("_"))
    src = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), rest.alias("in"))
    every = item_windows(bench, window, gram)
    tables, lengths = bit_tables(every, window, max(64, 1 << (16 * block_windows).bit_length()))
    shared = docs.sparkSession.sparkContext.broadcast(tables)
    schema = f"doc_id bigint, text string, in {src.schema['in'].dataType.simpleString()}, n_words bigint, near array<struct<length:int,hash:bigint,a:bigint,s:bigint,e:bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            body, offsets = buffers(batch.column(1))
            for i, j in slices(offsets):
                part, n = offsets[i : j + 1] - offsets[i], j - i
                words, who, start, length, hashes, s, e = candidates(body[offsets[i] : offsets[j]], part, shared.value, lengths, window, gram, powers)
                fields = [length.astype(np.int32), hashes.view(np.int64), start - words[who], s - part[who], e - part[who]]
                near = pa.StructArray.from_arrays([pa.array(f) for f in fields], ["length", "hash", "a", "s", "e"])
                at = np.searchsorted(who, np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, n) for c in range(3)), pa.array(np.diff(words)), pa.ListArray.from_arrays(pa.array(at), near)],
                                                 names=["doc_id", "text", "in", "n_words", "near"])

    marked = src.mapInArrow(run, schema)
    none = F.array()
    out = marked.where(F.size("near") == 0).select("doc_id", "text", "in", "n_words", none.cast(RANGES).alias("hit"), none.cast("array<string>").alias("items"))
    if lengths:
        suspects = cut(marked.where(F.size("near") > 0).withColumn("row", F.monotonically_increasing_id()))
        near = suspects.select("row", F.explode("near").alias("w")).select("row", "w.*", F.pmod(F.hash("row"), F.lit(SALTS)).alias("salt"))
        windows = every.where("length > 0").groupBy("length", "hash").agg(F.array_sort(F.collect_set("item")).alias("items"))
        windows = windows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        span = F.struct("a", (F.col("a") + F.col("length")).alias("b"), "s", "e")
        # neighbouring windows mostly have the same items, so a row gathers few different lists
        hits = near.join(windows, ["length", "hash", "salt"]).groupBy("row").agg(F.collect_list(span).alias("w"), F.collect_set("items").alias("i"))
        hits = hits.select("row", joined_ranges(F.col("w")).alias("hit"), F.array_sort(F.array_distinct(F.flatten("i"))).alias("items"))
        empty = {"hit": RANGES, "items": "array<string>"}
        found = suspects.join(hits, "row", "left").select("doc_id", "text", "in", "n_words", *[F.coalesce(c, none.cast(t)).alias(c) for c, t in empty.items()])
        out = out.union(found)
    ranges = lambda a, b: F.transform("hit", lambda r: F.struct(r[a].alias("a"), r[b].alias("b")))
    return out.select("doc_id", "text", "n_words", ranges("a", "b").alias("spans"), ranges("s", "e").alias("cuts"), "items",
                      *([F.col(f"in.`{c}`").alias(c) for c in keep if c not in (id_col, text_col)] if keep else []))


def joined_ranges(windows: Column) -> Column:
    """Union of word ranges (a, b) with their byte ranges (s, e); ranges whose words touch are joined."""

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"), last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))
        touches = (F.size(acc) > 0) & F.coalesce(last["b"] >= x["a"], F.lit(False))
        return F.when(touches, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, F.array(x))).cast(RANGES)

    return F.aggregate(F.array_sort(windows), F.array().cast(RANGES), step)


def without_hits(df: DataFrame, text_col: str = "text"):
    """``text`` less the bytes from the first to the last word of every hit span."""
    raw = F.to_binary(F.col(text_col), F.lit("utf-8"))
    ends = F.transform(F.col("cuts"), lambda c: c["b"])
    begin = F.concat(F.array(F.lit(0).cast("bigint")), ends)
    stop = F.concat(F.transform(F.col("cuts"), lambda c: c["a"]), F.array(F.octet_length(text_col).cast("bigint")))
    kept = F.transform(F.arrays_zip(begin.alias("s"), stop.alias("e")), lambda z: F.decode(F.substring(raw, (z["s"] + 1).cast("int"), (z["e"] - z["s"]).cast("int")), "utf-8"))
    return F.when(F.size("cuts") == 0, F.col(text_col)).otherwise(F.array_join(kept, ""))


def digest(out: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["b"] - s["a"])
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
