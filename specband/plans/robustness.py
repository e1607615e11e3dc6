"""K-means on many band subsets at once, over all pixels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from specband.functions.scale import require_bounded
from specband.operators.compare import apply_mapping, hungarian_mapping, scores
from specband.operators.kmeans import Run, best_of, lockstep, nearest_center
from specband.operators.stats import matrix_sum, moments

def robustness_evaluate(pixels: DataFrame, subsets: DataFrame, k: int = 4, n_init: int = 10, seed: int = 42, max_iter: int = 100,
                        tol: float = 1e-4, batch: int = 500) -> DataFrame:
    """Per band subset: z-score, K-means, best one-to-one relabelling, then accuracy, weighted scores and kappa.

    ``pixels``: ``pixel_id, spectrum, class`` (-1 = unlabelled); ``subsets``: ``subset ARRAY<INT>``.
    """
    sets = [sorted(int(b) for b in s) for s in require_bounded(subsets.select("subset"), "subsets", 1_000_000)["subset"]]
    spark = pixels.sparkSession
    _, mean, cov, _ = moments(pixels)
    std = np.sqrt(np.clip(np.diag(cov), 0, None)) + 1e-8
    shape = lambda x: (x[:, :-1] - mean) / std  # spectra end with the class, which is not clustered
    labelled = pixels.select(F.concat("spectrum", F.array(F.col("class").cast("double"))).alias("spectrum")).persist()
    n_class = int(pixels.agg(F.max("class")).first()[0]) + 1
    rows = []
    try:
        for lo in range(0, len(sets), batch):
            part = sets[lo:lo + batch]
            runs = [[Run(np.array(s), k, seed + i) for i in range(n_init)] for s in part]
            lockstep(labelled, [r for own in runs for r in own], shape, max_iter, tol)
            centers = [best_of(own).centers for own in runs]

            def table(x, part=part, centers=centers):
                cls = x[:, -1].astype(int)
                z, keep = shape(x), cls >= 0
                return np.concatenate([np.bincount(cls[keep] * k + nearest_center(z[keep][:, s], c)[0], minlength=n_class * k).astype(float) for s, c in zip(part, centers)])

            counts = matrix_sum(labelled, table).reshape(len(part), n_class, k)
            for i, t, c in zip(*np.nonzero(counts)):
                rows.append((lo + int(i), int(t), int(c), int(counts[i, t, c])))
    finally:
        labelled.unpersist()
    ct = spark.createDataFrame(rows, "run INT, class INT, cluster INT, n BIGINT")
    mapped = apply_mapping(ct, hungarian_mapping(ct, ["run"]), ["run"])
    names = spark.createDataFrame([(i, ",".join(map(str, s)), len(s)) for i, s in enumerate(sets)], "run INT, subset STRING, n_bands INT")
    s = scores(mapped, ["run"]).select("run", "accuracy", "f1_weighted", "precision_weighted", "recall_weighted", "cohen_kappa")
    return names.join(s, "run")
