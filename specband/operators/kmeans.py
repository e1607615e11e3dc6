"""K-means with all starts, subsets and cluster counts advancing together: one pass over the pixels per round."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from specband.operators.stats import matrix_sum, spectra_matrix


@dataclass
class Run:
    """One K-means search: its columns, cluster count and seed, then its centres and cost."""

    columns: np.ndarray
    k: int
    seed: int
    centers: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    cost: float = np.inf
    active: bool = True
    filled: int = 0  # clusters with rows


def nearest_center(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (x * x).sum(1)[:, None] + (centers * centers).sum(1)[None, :] - 2 * x @ centers.T
    lab = d.argmin(1)
    return lab, np.maximum(d[np.arange(len(x)), lab], 0.0)


def row_noise(first: int, n: int, seed: int) -> np.ndarray:
    """Reproducible numbers in (0, 1) for the rows ``first``, ``first + 1``, ...: every row has its own, equal rows too."""
    h = np.arange(first, first + n, dtype=np.uint64) + np.uint64((seed * 2 + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53) + 1e-17


OVER, ROUNDS = 2, 2  # candidates per round and cluster, rounds after the uniform one


def draw_candidates(pixels: DataFrame, runs: list[Run], shape, step: int) -> None:
    """Each run draws ``OVER * k`` rows more, with probabilities proportional to the squared distance to its candidates (the first time uniformly).

    The rows with the smallest exponential waiting times are such a draw without replacement; partitions offer their own smallest ones.
    """
    todo = [(i, r.columns, r.centers, r.seed, OVER * r.k) for i, r in enumerate(runs)]

    def draw(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            if not batch.num_rows:
                continue
            z = shape(spectra_matrix(batch.column(0)))
            for i, cols, centers, seed, most in todo:
                part = z[:, cols]
                weight = nearest_center(part, centers)[1] if len(centers) else np.ones(len(part))
                with np.errstate(divide="ignore"):
                    wait = np.where(weight > 1e-12, -np.log(row_noise(row, len(part), seed * 1009 + step)) / np.maximum(weight, 1e-12), np.inf)
                wait, part = (np.concatenate([h, new]) for h, new in zip(held[i], (wait, part))) if i in held else (wait, part)
                at = np.argsort(wait, kind="stable")[:most]
                held[i] = wait[at], part[at]
            row += batch.num_rows
        out = [(i, float(w), v.tolist()) for i, (wait, part) in held.items() for w, v in zip(wait, part) if np.isfinite(w)]
        if out:
            i, w, v = zip(*out)
            yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "wait": pa.array(w), "row": pa.array(v, pa.list_(pa.float64()))})

    offers = pixels.select("spectrum").mapInArrow(draw, "i INT, wait DOUBLE, row ARRAY<DOUBLE>")
    most = F.element_at(F.lit([OVER * r.k for r in runs]), F.col("i") + 1)
    first = offers.withColumn("__n", F.row_number().over(Window.partitionBy("i").orderBy("wait"))).where(F.col("__n") <= OVER * max(r.k for r in runs)).where(F.col("__n") <= most)
    for r in first.orderBy("i", "wait").collect():  # OVER * k rows per run
        run = runs[r["i"]]
        run.centers = np.vstack([run.centers, np.array(r["row"])[None, :]]) if len(run.centers) else np.array(r["row"])[None, :]


def reduced(candidates: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k starting centres from weighted candidates: weighted k-means++ and a few weighted rounds; copies pad where there are fewer."""
    rng = np.random.default_rng(seed)
    live = weights > 0
    x, w = candidates[live], weights[live]
    chosen = [int(rng.choice(len(x), p=w / w.sum()))]
    near = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k and (near * w).sum() > 1e-12:
        chosen.append(int(rng.choice(len(x), p=near * w / (near * w).sum())))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
    c = x[chosen]
    for _ in range(10):
        hot = (nearest_center(x, c)[0][:, None] == np.arange(len(c))[None, :]) * w[:, None]
        total = hot.sum(0)
        c = np.where(total[:, None] > 0, hot.T @ x / np.maximum(total, 1e-300)[:, None], c)
    return np.vstack([c, np.repeat(c[:1], k - len(c), 0)])


def spread_centers(pixels: DataFrame, runs: list[Run], shape, partitions: int | None = None) -> None:
    """Starting centres by oversampling: a few passes draw candidates for all runs, one more counts the rows nearest to each, and the weighted
    candidates, ``OVER * k * (ROUNDS + 1)`` per run, are clustered.  The number of passes does not depend on k, and a thousand equal rows weigh a thousand."""
    for step in range(ROUNDS + 1 if runs else 0):
        draw_candidates(pixels, runs, shape, step)
    found = [r for r in runs if len(r.centers)]
    if not found:
        return
    work = [(r.columns, r.centers) for r in found]
    v = matrix_sum(pixels, lambda x: (lambda z: np.concatenate([np.bincount(nearest_center(z[:, cols], c)[0], minlength=len(c)).astype(float) for cols, c in work]))(shape(x)), partitions=partitions)
    at = np.cumsum([0] + [len(c) for _, c in work])
    for r, lo, hi in zip(found, at, at[1:]):
        r.centers = reduced(r.centers, v[lo:hi], r.k, r.seed)


def lockstep(pixels: DataFrame, runs: list[Run], shape, max_iter: int, tol: float) -> list[Run]:
    """Seed and fit all runs on ``shape(spectra)`` of cached pixels; a run stops when its centres move by at most ``tol`` (squared)."""
    partitions = pixels.rdd.getNumPartitions()  # of cached rows
    spread_centers(pixels, [r for r in runs if not len(r.centers)], shape, partitions)  # runs with given centres keep them
    runs = [r for r in runs if len(r.centers)]
    for _ in range(max_iter + 1):
        work = [(r.columns, r.centers) for r in runs if r.active]
        if not work:
            break

        def sums(x, work=work):
            z, out = shape(x), []
            for cols, c in work:
                lab, d = nearest_center(z[:, cols], c)
                hot = (lab[:, None] == np.arange(len(c))[None, :]).astype(float)
                out += [(hot.T @ z[:, cols]).ravel(), hot.sum(0), [d.sum()]]
            return np.concatenate(out)

        v, at = matrix_sum(pixels, sums, partitions=partitions), 0
        for r in [r for r in runs if r.active]:
            k, m = len(r.centers), r.centers.size
            total, count, r.cost = v[at:at + m].reshape(r.centers.shape), v[at + m:at + m + k], float(v[at + m + k])
            at += m + k + 1
            r.filled = int((count > 0).sum())
            new = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], r.centers)
            r.active = ((new - r.centers) ** 2).sum() > tol
            r.centers = new if r.active else r.centers
    return runs


def best_of(runs: list[Run]) -> Run:
    return min(runs, key=lambda r: r.cost)


def label(pixels: DataFrame, run: Run, shape, name: str = "cluster") -> DataFrame:
    """``pixels`` with the number of the nearest centre."""
    return labels(pixels, {name: run}, shape)


def labels(pixels: DataFrame, runs: dict[str, Run], shape) -> DataFrame:
    """``pixels`` with the number of the nearest centre of every run, in a column of that name: one Python worker per task, however many runs."""
    keep, names = pixels.columns, [*runs]
    at, work = keep.index("spectrum"), [(r.columns, r.centers) for r in runs.values()]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in pixels.dtypes), *(f"{n} INT" for n in names)])

    def run_labels(batches):
        for b in batches:
            z = shape(spectra_matrix(b.column(at))) if b.num_rows else None
            found = [nearest_center(z[:, columns], centers)[0] if b.num_rows else np.zeros(0) for columns, centers in work]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(lab.astype(np.int32)) for lab in found)], names=[*keep, *names])

    return pixels.mapInArrow(run_labels, schema)
