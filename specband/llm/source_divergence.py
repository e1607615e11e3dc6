"""How far the sources of a language use its words differently, in exact integers.

Every (language, source) group gives each kept term of its language a smoothed share, in thousand millionths.  Sources
are compared over the whole vocabulary by run-length columns: terms with the same counts in every source are one entry
with a run length, the vocabulary is ordered so that equal counts lie together, and in blocks of that order each source
becomes a short list of runs; a pair of sources meets at the joint run boundaries, where one difference counts for the
whole run.  Blocks are bounded and their sums add up, so no task holds a vocabulary or a source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from specband.functions.scale import cut
from specband.llm.common import LOWER, SLICE_BYTES, buffers, cut_runs, owners, slices, word_spans

UNIT = 1_000_000_000
SMOOTH = 5
BLOCK = 4096  # entries of the ordered vocabulary that meet in one task
LETTER = np.zeros(256, bool)  # after lower-casing: a-z and every byte of a non-ASCII character
LETTER[0x61:0x7B] = LETTER[0x80:] = True
COUNTS = "lang string, source string, term string, n bigint, d bigint"


def slice_counts(text: pa.Array, lang: pd.Series, source: pd.Series) -> pa.RecordBatch:
    """Occurrences and documents of every term in every (language, source) of one slice."""
    body, offsets = buffers(text)
    low = LOWER[body]
    starts, ends, words = word_spans(low, offsets, LETTER)
    at = np.r_[0, np.cumsum(ends - starts)].astype(np.int32)
    spelled = pa.StringArray.from_buffers(len(starts), pa.py_buffer(at.tobytes()), pa.py_buffer(low[LETTER[low]].tobytes())).dictionary_encode()
    terms, size = spelled.dictionary, max(1, len(spelled.dictionary))
    keys, n = np.unique(owners(words) * size + spelled.indices.to_numpy().astype(np.int64), return_counts=True)  # (document, term)
    groups = pd.DataFrame({"l": lang, "s": source}).groupby(["l", "s"], sort=False)
    of, first = groups.ngroup().to_numpy(), ~pd.DataFrame({"l": lang, "s": source}).duplicated().to_numpy()
    key = of[keys // size] * size + keys % size
    order = np.argsort(key, kind="stable")
    runs = cut_runs(key[order])
    head, total = key[order][runs[:-1]], np.r_[0, np.cumsum(n[order])]
    row = np.flatnonzero(first)[head // size]
    return pa.RecordBatch.from_arrays(
        [pa.array(lang.to_numpy()[row], pa.string()), pa.array(source.to_numpy()[row], pa.string()), terms.take(pa.array(head % size)),
         pa.array(total[runs[1:]] - total[runs[:-1]]), pa.array(np.diff(runs))], names=["lang", "source", "term", "n", "d"])


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text, lang, source = b.column(0), b.column(1).to_pandas(), b.column(2).to_pandas()
        for i, j in slices(buffers(text)[1], 4 * SLICE_BYTES):
            yield slice_counts(text.slice(i, j - i), lang[i:j].reset_index(drop=True), source[i:j].reset_index(drop=True))


def share(count: Column, total: Column, size: Column) -> Column:
    """1 + floor(UNIT * (count + SMOOTH) / (total + SMOOTH * size)), in decimals that do not overflow."""
    top = F.lit(UNIT).cast("decimal(12,0)") * (count + SMOOTH).cast("decimal(19,0)")
    return F.call_function("div", top, (total + SMOOTH * size).cast("decimal(19,0)")) + 1


def exact_share(count: np.ndarray, total: int, size: int) -> np.ndarray:
    below = int(total) + SMOOTH * int(size)
    if len(count) and int(count.max()) + SMOOTH > (1 << 62) // UNIT:
        return np.array([1 + UNIT * (int(c) + SMOOTH) // below for c in count], np.int64)
    return 1 + UNIT * (count.astype(np.int64) + SMOOTH) // below


def runs_of(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of equal values, and the values."""
    starts = cut_runs(column)[:-1]
    return starts, column[starts]


def run_differences(columns: list[tuple[np.ndarray, np.ndarray]], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every pair g < h of run-length columns: the sum of absolute differences over all terms.

    ``ends`` holds, per entry of the order, the number of terms up to and with it.
    """
    before = np.r_[0, ends]
    g, h, value = [], [], []
    for a in range(len(columns)):
        start_a, value_a = columns[a]
        for b in range(a + 1, len(columns)):
            start_b, value_b = columns[b]
            cuts = np.union1d(start_a, start_b)
            f = np.abs(value_a[np.searchsorted(start_a, cuts, "right") - 1] - value_b[np.searchsorted(start_b, cuts, "right") - 1])
            g.append(a)
            h.append(b)
            value.append(int((f * np.diff(before[np.r_[cuts, len(ends)]])).sum()))
    return np.array(g, np.int64), np.array(h, np.int64), np.array(value, np.int64)


def block_pairs(entries: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Differences of all sources over one block; a source that does not occur in it is one run of zeros."""
    groups = groups.sort_values("source", ignore_index=True)
    place, row = np.unique(entries["pos"].to_numpy(), return_inverse=True)
    ends = np.zeros(len(place), np.int64)
    ends[row] = entries["terms"].to_numpy()
    ends = np.cumsum(ends)
    who = groups["source"].searchsorted(entries["source"])
    order = np.argsort(who, kind="stable")
    bounds = np.searchsorted(who[order], np.arange(len(groups) + 1))
    columns = []
    for k, (total, size) in enumerate(zip(groups["total"], groups["size"])):
        mine = order[bounds[k]:bounds[k + 1]]
        counts = np.zeros(len(place), np.int64)
        counts[row[mine]] = entries["n"].to_numpy()[mine]
        starts, values = runs_of(counts)
        columns.append((starts, exact_share(values, total, size)))
    g, h, value = run_differences(columns, ends)
    name = groups["source"].to_numpy()
    return pd.DataFrame({"lang": groups["tongue"].iloc[0], "g": name[g], "h": name[h], "value": value})


def source_divergence(docs: DataFrame, min_docs: int = 30, top: int = 50, block: int = BLOCK, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank``: distances between sources (part ``pair``) and over-used terms (part ``term``).

    Null text, language and source count as empty; a text without letters has no terms but its group occurs; a language without kept
    terms has distances of 0 and no term rows; a language with one source has no pairs; repeated rows count as often as they occur;
    ties are ranked by item.  Texts are whole at any length (a text is one slice at least).  An empty table gives no rows.  Sums stay
    exact while a language keeps fewer than 9 * 10^9 terms and a source holds fewer than 10^18 of their occurrences.
    """
    named = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    base = docs.select(named(text_col).alias("text"), named(lang_col).alias("lang"), named(source_col).alias("source"))
    counts = base.mapInArrow(count_terms, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    kept = counts.groupBy("lang", "term").agg(F.sum("d").alias("docs"), F.sum("n").alias("all"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("profile"))
    kept = cut(kept.where(F.col("docs") >= min_docs).drop("docs"))  # a profile has at most one entry per source
    rows = kept.select("lang", "term", "all", F.inline("profile"))

    sizes = kept.groupBy("lang").agg(F.count("*").alias("size"), F.sum("all").alias("all"))
    totals = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = base.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = cut(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "size")], F.coalesce("all", F.lit(0)).alias("whole")))

    by_group = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    excess = share(F.col("n"), F.col("total"), F.col("size")) - share(F.col("all"), F.col("whole"), F.col("size"))
    terms = rows.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), excess.alias("value")).where("value > 0")
    terms = terms.withColumn("rank", F.row_number().over(by_group)).where(F.col("rank") <= top)

    entries = kept.groupBy("lang", "profile").agg(F.count("*").alias("terms"))  # equal columns: one entry and its run length
    near = [F.col("lang"), F.slice("profile", 1, 3), F.xxhash64("profile")]  # short keys: Spark samples them on the driver
    placed = cut(entries.repartitionByRange(*near).sortWithinPartitions("lang", "profile").withColumn("pos", F.monotonically_increasing_id()))
    placed = placed.withColumn("block", F.floor(F.col("pos") / block))
    told = placed.select("lang", "block").distinct().join(groups, "lang").select(F.col("lang").alias("tongue"), F.col("block").alias("at"), "source", "total", "size")
    sums = placed.select("lang", "block", "pos", "terms", F.inline("profile")).groupBy("lang", "block").cogroup(told.groupBy("tongue", "at")).applyInPandas(
        block_pairs, "lang string, g string, h string, value bigint")
    sums = sums.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    bare = groups.where("size = 0").select("lang", F.col("source").alias("g"))
    sums = sums.unionByName(bare.join(bare.withColumnRenamed("g", "h"), "lang").where("g < h").withColumn("value", F.lit(0).cast("bigint")))
    both = F.array(F.struct(F.col("g").alias("source"), F.col("h").alias("item")), F.struct(F.col("h").alias("source"), F.col("g").alias("item")))
    pairs = sums.select("lang", "value", F.inline(both)).withColumn("rank", F.row_number().over(by_group))

    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("bigint").alias("value"), "rank")
    return columns(pairs, "pair").union(columns(terms, "term"))
