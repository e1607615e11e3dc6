"""Factorization of pixels x bands into concentrations and spectral profiles.

The pixel side never moves: with the profiles S (k x B) at hand each partition solves for its own
concentrations and contributes k x k and k x B sums; S is then updated from those sums.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from specband.functions.linalg import ls_solve
from specband.functions.scale import MAX_BANDS, checked_broadcast, quantiles, require_bounded
from specband.operators.stats import gram, matrix_sum, moments, spectra_matrix


@dataclass
class Mcr:
    """Profiles, how the fit went, and the way to concentrations."""

    profiles: np.ndarray
    error: float
    explained_variance: float
    errors: list[float] = field(default_factory=list)
    method: str = "clip"
    alpha: float = 1e-6

    def concentrations(self, pixels: DataFrame, target: str = "concentration") -> DataFrame:
        s, method, alpha = self.profiles, self.method, self.alpha
        return map_spectra(pixels, lambda x: ls_solve(s @ s.T, s @ x.T, method, alpha).T, target)

    def profile_table(self, spark) -> DataFrame:
        rows = [(c, b, float(v)) for c, row in enumerate(self.profiles) for b, v in enumerate(row)]
        return spark.createDataFrame(rows, "component INT, band_id INT, value DOUBLE")


def map_spectra(pixels: DataFrame, fn, target: str, source: str = "spectrum") -> DataFrame:
    """Add an array column computed from blocks of spectra (rows x bands -> rows x m)."""
    names = [c for c in pixels.columns if c != target]
    at = names.index(source)
    types = dict(pixels.dtypes)
    schema = ", ".join(f"`{n}` {types[n]}" for n in names) + f", `{target}` ARRAY<DOUBLE>"

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            out = np.ascontiguousarray(fn(spectra_matrix(b.column(at))))
            off = pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(names))] + [pa.ListArray.from_arrays(off, pa.array(out.ravel()))], names=names + [target])

    return pixels.select(*names).mapInArrow(run, schema)


def unfold(cells: DataFrame, bands: DataFrame, n_bands: int) -> DataFrame:
    from specband.operators.reshape import cube_to_spectrum

    return cube_to_spectrum(cells, bands, n_bands, rule=None)


def fold(concentrations: DataFrame, column: str = "concentration") -> DataFrame:
    """One value per pixel and component; ``scan_id`` stays where there is one."""
    keys = [c for c in ("scan_id", "y", "x") if c in concentrations.columns]
    return concentrations.select(*keys, F.posexplode(column).alias("component", "value"))


def mcr_clean(cells: DataFrame, fill: str = "zero", band: list[str] = ("excitation", "em_idx")) -> DataFrame:
    """Missing or infinite cells become 0 or the band's median."""
    v = F.col("value")
    finite = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    if fill == "zero":
        return cells.withColumn("value", F.coalesce(finite, F.lit(0.0)))
    clean = cells.withColumn("value", finite)
    med = quantiles(clean, "value", {"__med": 0.5}, list(band))
    return clean.join(checked_broadcast(med), list(band), "left").withColumn("value", F.coalesce("value", "__med", F.lit(0.0))).drop("__med")


def mcr_init(pixels: DataFrame, k: int, method: str = "pca", seed: int = 0) -> np.ndarray:
    """Starting profiles: |axes| of the centred (``pca``) or raw (``svd``) data, seeded ``random``, a short
    non-negative fit (``nmf``), or successively most distant spectra (``farthest``)."""
    width = len(pixels.select("spectrum").first()[0])
    return starts(pixels, [(np.arange(width), k)], method, seed)[0]


def starts(pixels: DataFrame, sets: list[tuple[np.ndarray, int]], method: str, seed: int) -> list[np.ndarray]:
    """Starting profiles of every set ``(band numbers, components)``, from passes that serve all sets."""
    if method in ("pca", "svd"):
        n, total, g = gram(pixels)
        g = g / max(n, 1) - np.outer(total, total) / max(n, 1) ** 2 if method == "pca" else g
        out = []
        for cols, k in sets:
            values, vectors = np.linalg.eigh(g[np.ix_(cols, cols)])
            out.append(np.abs(vectors[:, np.argsort(values)[::-1][:k]].T))
        return out
    if method == "random":
        return [np.random.default_rng(seed).random((k, len(cols))) for cols, k in sets]
    if method == "nmf":
        return [m.profiles for m in nmf_many(pixels, sets, max_iter=10, seed=seed)]
    if method == "farthest":
        return _farthest(pixels, sets)
    raise ValueError(f"unknown initialization {method}")


def _farthest(pixels: DataFrame, sets: list[tuple[np.ndarray, int]]) -> list[np.ndarray]:
    """Each step takes, for every set, the spectrum with the largest residual against those chosen (one row per set comes back)."""
    chosen = [np.zeros((0, len(cols))) for cols, _ in sets]
    for step in range(max(k for _, k in sets)):
        todo = [(i, cols, np.linalg.qr(chosen[i].T)[0].copy() if step else None) for i, (cols, k) in enumerate(sets) if step < k]

        def farthest(batches, todo=todo):
            best: dict[int, tuple[float, list[float]]] = {}
            for b in batches:
                x = spectra_matrix(b.column(0))
                for i, cols, basis in todo if len(x) else ():
                    y = x[:, cols]
                    r = y - (y @ basis) @ basis.T if basis is not None else y
                    size = (r * r).sum(axis=1)
                    top = np.flatnonzero(size == size.max())
                    row = max((float(size[t]), y[t].tolist()) for t in top)
                    best[i] = max(best[i], row) if i in best else row
            if best:
                yield pa.RecordBatch.from_pydict({"i": pa.array(list(best), pa.int32()), "r": pa.array([r for r, _ in best.values()]), "s": pa.array([v for _, v in best.values()], pa.list_(pa.float64()))})

        for r in pixels.select("spectrum").mapInArrow(farthest, "i INT, r DOUBLE, s ARRAY<DOUBLE>").groupBy("i").agg(F.max_by("s", F.struct("r", "s")).alias("s")).collect():
            chosen[r["i"]] = np.vstack([chosen[r["i"]], np.array(r["s"], dtype=float)])
    return [np.abs(c) for c in chosen]


def als_sums(x: np.ndarray, s: np.ndarray, method: str, alpha: float) -> np.ndarray:
    """What one alternation needs of a block of spectra, as one vector that adds up."""
    c = ls_solve(s @ s.T, s @ x.T, method, alpha)
    return np.concatenate([(c @ c.T).ravel(), (c @ x).ravel(), c.sum(1), [len(x), x.sum(), (x * x).sum()]])


def als_update(v: np.ndarray, shape: tuple[int, int], method: str, alpha: float, normalize: bool) -> tuple[np.ndarray, dict]:
    """New profiles from the sums, and the fit of (concentrations from the old profiles, new profiles)."""
    k, b = shape
    cc, cx, c1 = v[: k * k].reshape(k, k), v[k * k: k * k + k * b].reshape(k, b), v[k * k + k * b: k * k + k * b + k]
    n, total, sq = v[k * k + k * b + k:]
    new = ls_solve(cc, cx, method, alpha)
    cells = n * b
    sse = max(0.0, sq - 2 * float((new * cx).sum()) + float((new @ new.T * cc).sum()))
    res_mean = (total - float(c1 @ new.sum(axis=1))) / cells
    var = sq / cells - (total / cells) ** 2
    ev = 1 - (sse / cells - res_mean**2) / var if var > 1e-12 else 0.0
    if normalize:
        norm = np.linalg.norm(new, axis=1, keepdims=True)
        new = new / np.where(norm < 1e-12, 1.0, norm)
    return new, {"mse": sse / cells, "explained_variance": ev}


def als_step(pixels: DataFrame, s: np.ndarray, method: str = "clip", alpha: float = 1e-6, normalize: bool = True) -> tuple[np.ndarray, dict]:
    """One alternation.  Returns the new profiles and the fit of (C from old S, new S), all from one pass."""
    return als_update(matrix_sum(pixels, lambda x: als_sums(x, s, method, alpha)), s.shape, method, alpha, normalize)


@dataclass
class _Run:
    """One factorization under way: its bands, profiles, history and the best profiles so far."""

    columns: np.ndarray
    s: np.ndarray
    errors: list[float] = field(default_factory=list)
    best: tuple[float, np.ndarray, float] | None = None
    stale: int = 0
    active: bool = True

    def note(self, s: np.ndarray, fit: dict, tol: float, patience: int | None, stop: str) -> None:
        best = self.best or (np.inf, self.s, 0.0)
        self.s, mse = s, fit["mse"]
        self.errors.append(mse)
        self.stale = 0 if mse < best[0] - 1e-15 else self.stale + 1
        self.best = (mse, s, fit["explained_variance"]) if mse < best[0] else best
        if patience is not None:
            self.active = self.stale < patience
        elif stop == "error":
            self.active = mse >= tol
        else:
            self.active = len(self.errors) < 2 or abs(self.errors[-1] - self.errors[-2]) >= tol


SUM_WIDTH = 4_000_000  # numbers that one pass adds up


def _batches(sizes: list[int], limit: int = SUM_WIDTH) -> list[list[int]]:
    """Consecutive groups whose sums fit into one vector; one item at least."""
    out: list[list[int]] = []
    room = 0
    for i, n in enumerate(sizes):
        if not out or n > room:
            out.append([])
            room = limit
        out[-1].append(i)
        room -= n
    return out


def fit_many(pixels: DataFrame, sets: list[tuple[np.ndarray, int]], max_iter: int = 100, tol: float = 1e-6, init: str | list[np.ndarray] = "pca", method: str = "clip",
             alpha: float = 1e-6, patience: int | None = None, normalize: bool = True, seed: int = 0, stop: str = "change") -> list[Mcr]:
    """Factorize the pixels over several band sets ``(band numbers, components)`` at once.

    All sets alternate in lockstep: one pass over the pixels per round returns the sums of every set that has not converged, so the number
    of jobs does not depend on the number of sets (beyond ``SUM_WIDTH`` numbers a round takes one more).  A set ends when its error
    changes by less than ``tol`` (``stop="error"``: falls below it), or has not improved for ``patience`` rounds; its best profiles are kept.
    """
    src = pixels.select("spectrum").persist()
    try:
        first = starts(src, sets, init, seed) if isinstance(init, str) else init
        runs = [_Run(cols, np.asarray(s, dtype=float)) for (cols, _), s in zip(sets, first)]
        for _ in range(max_iter):
            active = [r for r in runs if r.active]
            for group in _batches([r.s.size + r.s.shape[0] ** 2 + r.s.shape[0] + 3 for r in active]):
                work = [(active[i].columns, active[i].s) for i in group]
                v, at = matrix_sum(src, lambda x: np.concatenate([als_sums(x[:, cols], s, method, alpha) for cols, s in work])), 0
                for i in group:
                    k, b = active[i].s.shape
                    size = k * k + k * b + k + 3
                    active[i].note(*als_update(v[at:at + size], (k, b), method, alpha, normalize), tol, patience, stop)
                    at += size
            if not active:
                break
        return [Mcr(r.best[1], r.best[0], r.best[2], r.errors, method, alpha) if r.best else Mcr(r.s, np.inf, 0.0, [], method, alpha) for r in runs]
    finally:
        src.unpersist()


def fit_mcr(pixels: DataFrame, k: int = 3, max_iter: int = 100, tol: float = 1e-6, init: str | np.ndarray = "pca", method: str = "clip",
            alpha: float = 1e-6, patience: int | None = None, normalize: bool = True, seed: int = 0, stop: str = "change") -> Mcr:
    """``fit_many`` for all bands: several excitations are fitted together as one concatenated spectrum."""
    width = len(pixels.select("spectrum").first()[0])
    return fit_many(pixels, [(np.arange(width), k)], max_iter, tol, init if isinstance(init, str) else [init], method, alpha, patience, normalize, seed, stop)[0]


def profile_blocks(fit: Mcr, bands: DataFrame) -> DataFrame:
    """Profiles of a joint fit with the excitation and emission of every band."""
    return fit.profile_table(bands.sparkSession).join(checked_broadcast(bands), "band_id")


def mcr_metrics(cells: DataFrame, original: str = "baseline", fitted: str = "perturbed", clamp: bool = False) -> DataFrame:
    """Mean squared error and explained variance of a reconstruction."""
    r = F.col(original) - F.col(fitted)
    ev = F.when(F.var_pop(original) > 1e-12, 1 - F.var_pop(r) / F.nullif(F.var_pop(original), F.lit(0.0))).otherwise(0.0)
    if clamp:
        ev = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ev))
    return cells.agg(F.avg(r * r).alias("mse"), ev.alias("explained_variance"))


def component_stats(maps: DataFrame) -> DataFrame:
    return maps.groupBy("component").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.max("value").alias("max"))


def scale_components(c: DataFrame, s: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Concentrations to a maximum of 1 per component, the profiles take the inverse factor; components that are zero or lack one side stay."""
    s_norm = s.groupBy("component").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("__s"))
    c_agg = c.groupBy("component").agg(F.max("value").alias("__m"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("__c"))
    f = s_norm.join(c_agg, "component", "full").na.fill(0.0, ["__s", "__m", "__c"])
    top = F.col("__m") * F.col("__s")
    live = (F.col("__s") > 1e-12) & (F.col("__c") > 1e-12)
    factor = F.when(live & (top > 1e-12), 1 / F.nullif(F.col("__m"), F.lit(0.0))).when(live, F.col("__s")).otherwise(1.0)
    f = checked_broadcast(f.select("component", factor.alias("__f")))
    up = lambda t, e: t.join(f, "component").withColumn("value", e).drop("__f")
    return up(c, F.col("value") * F.col("__f")), up(s, F.col("value") / F.col("__f"))


def mcr_over_combinations(pixels: DataFrame, bands: DataFrame, combinations: DataFrame, k: int = 3, **fit) -> DataFrame:
    """Fit every named excitation subset on its slice of the spectrum, all of them in lockstep; one summary row each."""
    cat = require_bounded(bands.select("band_id", "excitation"), "bands", MAX_BANDS).sort_values("band_id")
    named = [(name, set(ex)) for name, ex in require_bounded(combinations, "combinations").itertuples(index=False)]
    ids = [cat["band_id"].to_numpy(np.int64)[cat["excitation"].isin(list(ex)).to_numpy()] for _, ex in named]
    fits = fit_many(pixels, [(cols, min(k, len(cols))) for cols in ids], **fit)
    rows = [(name, len(ex), len(cols), float(m.explained_variance), float(m.error), len(m.errors)) for (name, ex), cols, m in zip(named, ids, fits)]
    return pixels.sparkSession.createDataFrame(rows, "name STRING, n_excitations INT, n_bands INT, explained_variance DOUBLE, mse DOUBLE, iterations INT")


def best_combinations_report(summary: DataFrame, n: int = 5) -> DataFrame:
    """The n best overall and the best of every number of excitations."""
    top = summary.orderBy(F.desc("explained_variance"), "name").limit(n).select(F.lit("top").alias("kind"), "n_excitations", "name", "explained_variance")
    per = summary.groupBy("n_excitations").agg(F.min_by(F.struct("name", "explained_variance"), F.struct(-F.col("explained_variance"), F.col("name"))).alias("b"))
    return top.unionByName(per.select(F.lit("best_of_count").alias("kind"), "n_excitations", F.col("b.name").alias("name"), F.col("b.explained_variance").alias("explained_variance")))


def performance_by_count(summary: DataFrame) -> DataFrame:
    return summary.groupBy("n_excitations").agg(F.avg("explained_variance").alias("mean"), F.stddev_pop("explained_variance").alias("std"), F.count("*").alias("n"))


# -- other reductions ------------------------------------------------------------------------------

def nmf(pixels: DataFrame, k: int, max_iter: int = 200, tol: float = 1e-6, seed: int = 0) -> Mcr:
    """Non-negative factorization of |X|: exact non-negative weights per pixel, multiplicative profile updates."""
    width = len(pixels.select("spectrum").first()[0])
    return nmf_many(pixels, [(np.arange(width), k)], max_iter, tol, seed)[0]


def nmf_many(pixels: DataFrame, sets: list[tuple[np.ndarray, int]], max_iter: int = 200, tol: float = 1e-6, seed: int = 0) -> list[Mcr]:
    """``nmf`` over several band sets ``(band numbers, components)`` in lockstep: one pass a round for all that still change."""
    src = pixels.select(F.transform("spectrum", lambda v: F.abs(v)).alias("spectrum")).persist()
    try:
        runs = [_Run(cols, np.random.default_rng(seed).random((k, len(cols))) + 1e-3) for cols, k in sets]
        shares = [0.0] * len(runs)
        for _ in range(max_iter):
            active = [i for i, r in enumerate(runs) if r.active]
            for group in _batches([runs[i].s.size + runs[i].s.shape[0] ** 2 + 3 for i in active]):
                work = [(runs[active[g]].columns, runs[active[g]].s) for g in group]

                def sums(x, work=work):
                    out = []
                    for cols, h in work:
                        y = x[:, cols]
                        w = ls_solve(h @ h.T, h @ y.T, "nnls")
                        out += [(w @ w.T).ravel(), (w @ y).ravel(), [len(y), y.sum(), (y * y).sum()]]
                    return np.concatenate(out)

                v, at = matrix_sum(src, sums), 0
                for i in (active[g] for g in group):
                    h = runs[i].s
                    k, width = h.shape
                    ww, wx, (n, total, sq) = v[at:at + k * k].reshape(k, k), v[at + k * k:at + k * k + h.size].reshape(h.shape), v[at + k * k + h.size:at + k * k + h.size + 3]
                    at += k * k + h.size + 3
                    h = h * wx / np.maximum(ww @ h, 1e-12)
                    sse = max(0.0, sq - 2 * float((h * wx).sum()) + float((h @ h.T * ww).sum()))
                    runs[i].s = h
                    runs[i].errors.append(sse / (n * width))
                    shares[i] = 1 - runs[i].errors[-1] / max(sq / (n * width) - (total / (n * width)) ** 2, 1e-12)
                    runs[i].active = len(runs[i].errors) < 2 or abs(runs[i].errors[-1] - runs[i].errors[-2]) >= tol
            if not active:
                break
        return [Mcr(r.s, r.errors[-1], share, r.errors, "nnls") for r, share in zip(runs, shares)]
    finally:
        src.unpersist()


def fast_ica(pixels: DataFrame, k: int, max_iter: int = 200, tol: float = 1e-4, seed: int = 0) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Mean, unmixing matrix (k x bands) and convergence history: whitening from the band covariance, then
    symmetric fixed-point rounds whose expectations are sums over all pixels."""
    src = pixels.select("spectrum").persist()
    try:
        n, mean, cov, _ = moments(src)
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(values)[::-1][:k]
        white = vectors[:, order].T / np.sqrt(np.maximum(values[order], 1e-12))[:, None]

        def decorrelate(w):
            u, _, vt = np.linalg.svd(w)
            return u @ vt

        w = decorrelate(np.random.default_rng(seed).normal(size=(k, k)))
        history: list[float] = []
        for _ in range(max_iter):
            def sums(x, w=w):
                z = white @ (x - mean).T
                g = np.tanh(w @ z)
                return np.concatenate([(g @ z.T).ravel(), (1 - g * g).sum(1)])

            v = matrix_sum(src, sums) / n
            new = decorrelate(v[: k * k].reshape(k, k) - v[k * k:][:, None] * w)
            history.append(float(np.max(np.abs(np.abs(np.sum(new * w, axis=1)) - 1))))
            w = new
            if history[-1] < tol:
                break
        return mean, w @ white, history
    finally:
        src.unpersist()


def ica_sources(pixels: DataFrame, mean: np.ndarray, unmixing: np.ndarray, target: str = "sources") -> DataFrame:
    return map_spectra(pixels, lambda x: (x - mean) @ unmixing.T, target)
