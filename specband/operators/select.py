"""Ranking and band selection.

Greedy choices need single rows of band x band matrices, which Spark computes from all pixels and keeps as a table of tiles; the loop over
the chosen bands reads the rows it needs.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from specband.functions.scale import argmax_rows, rank_rows, require_bounded, scalars
from specband.operators.gram import GramTable
from specband.operators.stats import correlation_matrix, moments


def rank_bands(influence: DataFrame) -> DataFrame:
    """Influence descending; ties keep band order (excitation, emission index)."""
    return rank_rows(influence, [F.desc("influence"), F.asc("excitation"), F.asc("em_idx")], "rank", 1)


def top_n(ranked: DataFrame, n: int) -> DataFrame:
    return ranked.where(F.col("rank") <= n)


def mmr_order(influence: np.ndarray, similarity: np.ndarray | Callable[[int], np.ndarray], n: int, lam: float = 0.5, form: str = "code") -> list[int]:
    """Indexes chosen greedily by relevance minus similarity to the chosen ones.

    ``form='code'``: relevance - lam * similarity; ``'convex'``: lam * relevance - (1 - lam) * similarity.
    The candidates come in ranked order, the first of equal scores wins.  ``similarity``: a matrix, or a function that gives its rows.
    """
    row = similarity if callable(similarity) else lambda i: similarity[:, i]
    order = np.argsort(-influence, kind="stable")
    top = influence[order[0]]
    rel = influence / top if top > 0 else np.zeros_like(influence)
    chosen, closest = [int(order[0])], np.abs(row(int(order[0]))).copy()
    free = np.ones(len(influence), dtype=bool)
    free[order[0]] = False
    while len(chosen) < n and free.any():
        score = rel - lam * closest if form == "code" else lam * rel - (1 - lam) * closest
        ranked = score[order]
        ranked[~free[order]] = -np.inf
        pick = int(order[int(np.argmax(ranked))])
        chosen.append(pick)
        free[pick] = False
        closest = np.maximum(closest, np.abs(row(pick)))
    return chosen


def select_mmr(pixels: DataFrame, influence: DataFrame, n: int, lam: float = 0.5, form: str = "code") -> DataFrame:
    """Diverse top n: ``influence`` has band_id (= position in ``spectrum``) and influence."""
    gram = GramTable(pixels)
    inf = require_bounded(influence.select("band_id", "influence").orderBy("band_id"), "influence", gram.width)  # one row per band
    ids = inf["band_id"].to_numpy()
    picked = mmr_order(inf["influence"].to_numpy(dtype=float), lambda i: gram.cosine_row(int(ids[i]))[ids], n, lam, form)
    rows = [(r + 1, int(ids[i])) for r, i in enumerate(picked)]
    sel = pixels.sparkSession.createDataFrame(rows, "rank INT, band_id INT")
    return sel.join(influence, "band_id").orderBy("rank")


def select_min_distance(ranked: DataFrame, nm: float, n: int, by: list[str] = ()) -> DataFrame:
    """Walk the ranking; a band closer than ``nm`` to a chosen band of its excitation is skipped.

    Excitations do not influence each other, so each one's (short) band list is folded on its own and
    the survivors are cut to the first n.
    """
    by = list(by)
    items = F.array_sort(F.collect_list(F.struct("rank", "emission", "em_idx", "influence")))
    far = lambda acc, e: F.forall(acc, lambda s: F.abs(s["emission"] - e["emission"]) >= nm)
    kept = F.aggregate("__i", F.slice("__i", 1, 0), lambda acc, e: F.when(far(acc, e), F.concat(acc, F.array(e))).otherwise(acc))
    survivors = ranked.groupBy(*by, "excitation").agg(items.alias("__i")).select(*by, "excitation", F.inline(kept))
    w = Window.partitionBy(*by, F.lit(0)).orderBy("rank")  # one row per band
    return survivors.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def _frame(spark: SparkSession, indexes: list[int]) -> DataFrame:
    return spark.createDataFrame([(i + 1, int(b)) for i, b in enumerate(indexes)], "position INT, band_id INT")


def _loadings(pixels: DataFrame, k: int, standardize: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Absolute loadings (components x bands) of the standardized bands and the population variances."""
    _, _, cov, _ = moments(pixels)
    values, vectors = np.linalg.eigh(correlation_matrix(cov) if standardize else cov)
    order = np.argsort(values)[::-1][:k]
    return np.abs(vectors[:, order].T), np.diag(cov).copy()


def loadings_sequential(loadings: np.ndarray, variances: np.ndarray, n: int) -> list[int]:
    """The n bands that enter first when components list their bands one after another, strongest loading first.

    A band enters at its best place over all components; bands no component lists follow by variance.
    """
    k, width = loadings.shape
    place = lambda v: width - 1 - v.argsort(-1).argsort(-1)  # 0 for the largest
    turns = np.vstack([place(loadings), place(variances)[None, :]]) + width * np.arange(k + 1)[:, None]
    return turns.min(0).argsort()[:n].tolist()


def loadings_top5(loadings: np.ndarray, n: int) -> list[int]:
    """Bands that lead a component, with the five strongest of every component reached before n bands are known; the first n by index."""
    k, width = loadings.shape
    among = loadings.argsort(1).argsort(1) >= width - 5
    leads = np.zeros_like(among)
    leads[np.arange(k), loadings.argmax(1)] = True
    since = lambda m: np.where(m.any(0), m.argmax(0), k)  # first component that names the band
    five, lead = since(among), since(leads)
    known = ((five[None, :] < np.arange(k)[:, None]) | (lead[None, :] <= np.arange(k)[:, None])).sum(1)
    full = int(np.argmax(known >= n)) if (known >= n).any() else k
    return np.flatnonzero((five < full) | (lead < k))[:n].tolist()


def select_pca_loadings_seq(pixels: DataFrame, n: int) -> DataFrame:
    return _frame(pixels.sparkSession, loadings_sequential(*_loadings(pixels, n), n))


def select_pca_loadings_top5(pixels: DataFrame, n: int) -> DataFrame:
    return _frame(pixels.sparkSession, loadings_top5(_loadings(pixels, n)[0], n))


def select_variance(cells: DataFrame, n: int, band: list[str] = ("band_id",)) -> DataFrame:
    """n largest population variances (the later band wins ties), in band order."""
    var = cells.groupBy(*band).agg(F.var_pop("value").alias("variance"))
    return var.orderBy(F.desc("variance"), *[F.desc(b) for b in band]).limit(n).orderBy(*band)


def greedy_diversity(cov: np.ndarray, n: int, lam: float = 0.5) -> list[int]:
    """Start with the most varying band; add by lam * scaled variance + (1 - lam) * (1 - mean |correlation|)."""
    corr = correlation_matrix(cov)
    return greedy_order(np.diag(cov), lambda b: corr[b], n, lam)


def greedy_order(var: np.ndarray, row: Callable[[int], np.ndarray], n: int, lam: float = 0.5) -> list[int]:
    """The greedy choice from the variances and a function that gives rows of the correlation matrix."""
    rel = (var - var.min()) / (var.max() - var.min() + 1e-8)
    chosen = [int(np.argmax(var))]
    total = np.abs(row(chosen[0]))
    for _ in range(min(n, len(var)) - 1):
        score = lam * rel + (1 - lam) * (1 - total / len(chosen))
        score[chosen] = -np.inf
        chosen.append(int(np.argmax(score)))
        total = total + np.abs(row(chosen[-1]))
    return sorted(chosen)


def select_greedy_diversity(pixels: DataFrame, n: int, lam: float = 0.5) -> DataFrame:
    gram = GramTable(pixels)
    return _frame(pixels.sparkSession, greedy_order(gram.variances(), gram.correlation_row, n, lam))


def dedupe_pairs(selection: DataFrame, order: str = "ord", by: list[str] = ()) -> DataFrame:
    """First occurrence of each (excitation, emission)."""
    return argmax_rows(selection, [*by, "excitation", "emission"], [F.col(order)])


def selection_stats(influence: DataFrame, selection: DataFrame) -> DataFrame:
    total = scalars(influence.agg(F.count("*").alias("n"))).getField("n")
    s = selection.agg(F.count("*").alias("n_selected"), F.max("influence").alias("max_influence"), F.min("influence").alias("min_influence"))
    return s.select(total.alias("n_available"), "n_selected", (total / F.col("n_selected")).alias("compression_ratio"),
                    ((1 - F.col("n_selected") / total) * 100).alias("reduction_pct"), "max_influence", "min_influence")


def bands_per_excitation(selection: DataFrame) -> DataFrame:
    return selection.groupBy("excitation").agg(F.count("*").alias("n"))


def excluded_bands(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.join(after.select("band_id"), "band_id", "left_anti")


def ranking_export(ranked: DataFrame) -> DataFrame:
    name = F.format_string("Ex%s_Em%s", F.col("excitation").cast("string"), F.col("emission").cast("string"))
    return ranked.select("rank", (F.col("rank") - 1).alias("layer_index"), F.col("excitation").alias("excitation_nm"), F.col("emission").alias("emission_nm"),
                         F.col("influence").alias("coefficient"), name.alias("layer_name"))


def format_combinations(selection: DataFrame, by: list[str] = ()) -> DataFrame:
    """``Ex365nm: [420.0, 430.0]nm | ...`` per configuration; pairs are distinct bands, so lists stay short."""
    pairs = selection.select(*by, "excitation", "emission").distinct()
    em = F.transform(F.array_sort(F.collect_list("emission")), lambda e: F.format_string("%.1f", e))
    per = pairs.groupBy(*by, "excitation").agg(F.concat(F.lit("["), F.array_join(em, ", "), F.lit("]")).alias("t"))
    text = F.transform(F.array_sort(F.collect_list(F.struct("excitation", "t"))), lambda s: F.concat(F.format_string("Ex%.0fnm: ", s["excitation"]), s["t"], F.lit("nm")))
    return per.groupBy(*by).agg(F.array_join(text, " | ").alias("combinations"))


def config_grid(spark: SparkSession, params: dict[str, list], limit: int | None = None) -> DataFrame:
    """Cartesian product of parameter lists, last parameter fastest, cut to the first ``limit``.

    Each row decodes its own number, so no product of frames is built.
    """
    total = int(np.prod([len(v) for v in params.values()]))
    rows = spark.range(total if limit is None else min(limit, total))
    step = total
    cols = []
    for name, values in params.items():
        step //= len(values)
        cols.append(F.element_at(F.lit(values), (F.floor(F.col("id") / step) % len(values) + 1).cast("int")).alias(name))
    return rows.select("id", *cols)


def config_series(spark: SparkSession, dedupe: bool = False) -> DataFrame:
    """Band counts 3..30 by one, then 30..170 by ten (30 occurs twice unless ``dedupe``), with names."""
    a = spark.range(3, 31).select(F.col("id").cast("int").alias("n_bands"))
    b = spark.range(40 if dedupe else 30, 180, 10).select(F.col("id").cast("int").alias("n_bands"))
    return a.unionAll(b).select(F.concat(F.lit("mmr_lambda050_variance_1dim_"), "n_bands", F.lit("bands")).alias("name"), "n_bands")


def excitation_combinations(excitations: DataFrame, kinds: list[str] = ("single", "pairs", "triplets", "all"),
                            custom: dict[str, list[float]] | None = None, max_sets: int = 100_000) -> DataFrame:
    """Named subsets of the (few) excitations."""
    ex = sorted(require_bounded(excitations.select("excitation").distinct(), "excitations", 512)["excitation"].tolist())
    size = {"single": 1, "pairs": 2, "triplets": 3, "all": len(ex)}
    label = {"single": "single", "pairs": "pair", "triplets": "triplet", "all": "all"}
    rows = []
    for kind in kinds:
        for subset in combinations(ex, size[kind]):
            rows.append((f"{label[kind]}_{'_'.join(map(str, subset))}", list(subset)))
            if len(rows) > max_sets:
                raise ValueError(f"more than {max_sets} combinations")
    rows += [(f"custom_{n}", [float(e) for e in s]) for n, s in (custom or {}).items()]
    return excitations.sparkSession.createDataFrame(rows, "name STRING, excitations ARRAY<DOUBLE>")
