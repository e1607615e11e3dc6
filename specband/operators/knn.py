"""Exact nearest neighbours through a metric partition index.

Training rows are dealt to the cells of a few pivots and lie in blocks of bounded size, sorted by their distance to the pivot, so a block is
a ring of a cell.  By the triangle inequality a block cannot hold a row nearer to x than ``max(d(x, pivot) - hi, lo - d(x, pivot))``, nor, in
Euclidean space, nearer than the plane between x's own pivot and the block's.  Pixels are passed over once: each visits the blocks in the
order of these bounds, and leaves out those beyond its k-th neighbour so far.  Blocks are files which tasks read; neither training rows
nor neighbours pass the driver, and pixels are never shuffled.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from specband.functions.blocks import Blocks, matrix, write_blocks
from specband.functions.scale import cut

BLOCK_ROWS = 2048
PIVOTS, PIVOT_SAMPLE = 256, 4096
CELLS = 1_000_000  # entries of the bound matrix handled at once
PAIRS = 262_144  # pairs measured at once: they stay in the cache
OPEN = np.iinfo(np.int64).max


def distances(x: np.ndarray, t: np.ndarray, metric: str) -> np.ndarray:
    """All distances, by matrix products or band by band; rounding errors are far below the slack of the callers."""
    if metric == "euclidean":
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (t * t).sum(1)[None, :] - 2 * x @ t.T, 0))
    total = np.zeros((len(x), len(t)))
    for b in range(x.shape[1]):
        total += np.abs(x[:, b, None] - t[None, :, b])
    return total


def pivots_of(rows: np.ndarray, n: int, rounds: int = 3) -> np.ndarray:
    """Centres of a sample; any points would do, these keep the rings narrow."""
    rows = np.unique(rows, axis=0)
    p = rows[np.random.default_rng(5).permutation(len(rows))[:n]]
    for _ in range(rounds):
        near = distances(rows, p, "euclidean").argmin(1)
        total, count = np.zeros_like(p), np.bincount(near, minlength=len(p))
        np.add.at(total, near, rows)
        p = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], p)
    return p


def nearest(x: np.ndarray, t: np.ndarray, ids: np.ndarray, k: int, metric: str, barred: np.ndarray | None = None,
            within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Columns and exact distances (rows x k, by distance then id) of the k nearest rows; -1 and infinity where there are fewer.

    Rough distances shortlist the candidates with a slack far above their rounding error; only the shortlist is measured exactly.
    ``barred`` marks pairs that do not count; rows beyond ``within``, a distance per row of ``x``, need not be found.
    """
    within = np.full(len(x), np.inf) if within is None else within
    if metric == "euclidean":
        sx, st = (x * x).sum(1), (t * t).sum(1)
        rough = x @ (-2 * t).T  # squared
        rough += sx[:, None]
        rough += st[None, :]
        size, limit = sx + (float(st.max()) if len(t) else 0.0), within * within
    else:
        rough = distances(x, t, metric)
        size, limit = np.abs(x).sum(1) + (float(np.abs(t).sum(1).max()) if len(t) else 0.0), within
    if barred is not None:
        rough[barred] = np.inf
    slack = 1e-9 * (size + 1.0)
    short = rough <= (limit + slack)[:, None]
    many = np.flatnonzero(np.count_nonzero(short, axis=1) > k)
    if len(many):
        own = rough[many]
        short[many] &= own <= (np.partition(own, k - 1, axis=1)[:, k - 1] + slack[many])[:, None]
    r, c = np.nonzero(short)
    real = np.isfinite(rough[r, c])
    r, c = r[real], c[real]
    diff = x[r] - t[c]
    d = np.sqrt((diff * diff).sum(1)) if metric == "euclidean" else np.abs(diff).sum(1)
    order = np.lexsort((ids[c], d, r))
    r, c, d = r[order], c[order], d[order]
    at = np.arange(len(r)) - np.searchsorted(r, r)
    keep = at < k
    column, dist = np.full((len(x), k), -1), np.full((len(x), k), np.inf)
    column[r[keep], at[keep]], dist[r[keep], at[keep]] = c[keep], d[keep]
    return column, dist


class Index:
    """Pivots and block ranges as a task sees them, and the search."""

    def __init__(self, folder: str, pivots: np.ndarray, metric: str) -> None:
        self.blocks, self.pivots, self.metric = Blocks(folder), pivots, metric
        self.ranges = self.blocks.ranges()
        self.part = self.ranges["part"].astype(np.int64)
        self.visits = 0  # (pixel, block) pairs looked into

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """Lower bound of the distance from every pixel to the rows of every block."""
        d = distances(x, self.pivots, self.metric)
        own = d.argmin(1)
        to = d[:, self.part]
        low = np.maximum(np.maximum(to - self.ranges["hi"], self.ranges["lo"] - to), 0)
        if self.metric == "euclidean":  # a row of another cell is beyond the plane between the pivots
            gap = distances(self.pivots, self.pivots, self.metric)[own][:, self.part]
            beyond = (to * to - (d[np.arange(len(x)), own] ** 2)[:, None]) / np.maximum(2 * gap, 1e-300)
            low = np.maximum(low, np.where(gap > 1e-9, beyond, 0))
        size = np.abs(x).max(1, initial=0) * x.shape[1] + np.abs(self.pivots).max(initial=0) * x.shape[1] + 1
        return low - 1e-7 * size[:, None]

    def search(self, x: np.ndarray, tags: np.ndarray, k: int, bar_same_tag: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distances, ids and labels of the k nearest rows (rows x k), infinity where there are fewer."""
        best_d, best_i, best_c = np.full((len(x), k), np.inf), np.full((len(x), k), OPEN), np.zeros((len(x), k), np.int32)
        if not len(self.part):
            return best_d, best_i, best_c
        low = self.bounds(x)
        first = low.argmin(1)
        done = np.zeros(low.shape, bool)

        def visit(block: int, rows: np.ndarray) -> None:
            t, ids, labels, own = self.blocks.read(int(self.ranges["block"][block]))
            step = max(1, PAIRS // len(t))
            for at in range(0, len(rows), step):
                r = rows[at:at + step]
                column, d = nearest(x[r], t, ids, k, self.metric, own[None, :] == tags[r][:, None] if bar_same_tag else None, best_d[r, -1])
                hit = np.flatnonzero(column[:, 0] >= 0)  # most rows find nothing nearer
                r, column, d = r[hit], column[hit], d[hit]
                d = np.concatenate([best_d[r], d], axis=1)
                i = np.concatenate([best_i[r], np.where(column >= 0, ids[column], OPEN)], axis=1)
                c = np.concatenate([best_c[r], labels[column]], axis=1)
                order = np.lexsort((i, d), axis=1)[:, :k]
                best_d[r], best_i[r], best_c[r] = (np.take_along_axis(a, order, 1) for a in (d, i, c))
            done[rows, block] = True
            self.visits += len(rows)

        for block in np.unique(first):  # the most promising block of every pixel gives a bound for the others
            visit(block, np.flatnonzero(first == block))
        for block in np.argsort(low.mean(0), kind="stable") if len(x) else ():
            rows = np.flatnonzero(~done[:, block] & (low[:, block] <= best_d[:, -1]))
            if len(rows):
                visit(block, rows)
        return best_d, best_i, best_c


def build(train: DataFrame, k: int, metric: str, shift: tuple[np.ndarray, np.ndarray] | None, key: str, block_rows: int, tag: str | None) -> tuple[str, np.ndarray]:
    """Write the blocks of the training rows (``key, class, spectrum``); returns their folder and the pivots.

    Of equal rows (with one tag) only the k smallest ids can be neighbours; the others are left out before anything is sorted.
    """
    own = F.col(tag).cast("int") if tag else F.lit(0)
    rows = train.select(F.col(key).cast("bigint").alias("id"), own.alias("tag"), F.col("class").cast("int").alias("label"), "spectrum")
    copies = Window.partitionBy("spectrum", "tag").orderBy("id")
    rows = cut(rows.withColumn("__n", F.row_number().over(copies)).where(F.col("__n") <= k).drop("__n"))
    scaled = lambda x: (x - shift[0]) / shift[1] if shift and len(x) else x
    some = rows.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).select("spectrum").toArrow().column(0).combine_chunks()
    sample = scaled(matrix(some))
    pivots = pivots_of(sample, min(PIVOTS, max(1, int(np.sqrt(len(sample)))))) if len(sample) else np.zeros((0, 0))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = scaled(matrix(b.column(3)))
            d = distances(x, pivots, metric) if len(x) else np.zeros((0, 1))
            part = d.argmin(1)
            off = pa.array(np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(d[np.arange(len(x)), part]), b.column(0), b.column(1), b.column(2), pa.ListArray.from_arrays(off, pa.array(x.ravel()))],
                                             names=["part", "at", "id", "tag", "label", "spectrum"])

    dealt = rows.mapInArrow(deal, "part int, at double, id bigint, tag int, label int, spectrum array<double>")
    placed = dealt.repartitionByRange("part", "at", "id").sortWithinPartitions("part", "at", "id")
    return write_blocks(placed, block_rows, "training"), pivots


def neighbors(pixels: DataFrame, train: DataFrame, k: int, metric: str = "euclidean", scale: bool = True, key: str = "pixel_id", block_rows: int = BLOCK_ROWS,
              outside: str | None = None) -> DataFrame:
    """``pixels`` with the k nearest training rows as arrays ``nn_d, nn_id, nn_class`` (nearest first, ties by id).

    ``outside`` names an integer column of both tables: a pixel's neighbours are taken from rows with another value of it.
    """
    from specband.operators.stats import band_moments

    shift = None
    if scale:
        m = band_moments(train).first()
        shift = (np.array(m["mean"]), np.array([s if s else 1.0 for s in m["std"]]))
    folder, pivots = build(train, k, metric, shift, key, block_rows, outside)
    names = [c for c in pixels.columns if c not in ("nn_d", "nn_id", "nn_class")]
    types = dict(pixels.dtypes)
    schema = ", ".join(f"`{n}` {types[n]}" for n in names) + ", nn_d ARRAY<DOUBLE>, nn_id ARRAY<BIGINT>, nn_class ARRAY<INT>"
    at, tag_at = names.index("spectrum"), names.index(outside) if outside else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.collect()  # worker processes are used again: blocks of an earlier task go first
        index = None
        for batch in batches:
            index = index or Index(folder, pivots, metric)
            x = matrix(batch.column(at))
            x = (x - shift[0]) / shift[1] if shift and len(x) else x
            tags = batch.column(tag_at).to_numpy(zero_copy_only=False).astype(np.int64) if outside else np.zeros(len(x), np.int64)
            step = max(1, CELLS // max(1, len(index.part)))
            found = [index.search(x[lo:lo + step], tags[lo:lo + step], k, outside is not None) for lo in range(0, len(x), step)]
            d, i, c = (np.concatenate([f[j] for f in found]) if found else np.zeros((0, k)) for j in range(3))
            real = np.isfinite(d)
            off = pa.array(np.r_[0, np.cumsum(real.sum(1))].astype(np.int32))
            lists = [pa.ListArray.from_arrays(off, pa.array(v[real])) for v in (d.astype(float), i.astype(np.int64), c.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in range(len(names))] + lists, names=names + ["nn_d", "nn_id", "nn_class"])

    return pixels.select(*names).mapInArrow(run, schema)
