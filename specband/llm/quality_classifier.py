"""Quality scores from document statistics: random Fourier features, ridge regression, isotonic calibration.

A text becomes some twenty statistics (one pass, no shuffle of texts).  Random Fourier features of the standardised statistics
approximate a Gaussian kernel; every partition sums its own normal equations per fold, the sums are added by row, and
the driver solves systems whose size is the number of features.  Each fold is scored by a model of the other folds; those
scores, counted in fixed bins, are made monotone by pooling adjacent violators, which turns scores into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from specband.functions.scale import cut
from specband.operators.stats import matrix_sum
from specband.llm.common import BYTE_CODE, SPACE, Powers, Rolling, buffers, id_text, owners, slices, word_spans

STATISTICS = ("log_words", "log_bytes", "word_bytes", "long_words", "upper", "digits", "symbols", "pipes", "bangs", "stops", "commas", "other_punct", "non_ascii",
              "spaces", "lines_per_word", "distinct_words", "repeated_next", "distinct_pairs", "ends_in_stop", "ends_in_symbol", "upper_words", "top_word")
FEATURES, BINS, FOLDS = 256, 2048, 3
LOW, HIGH = -0.5, 1.5  # raw ridge scores are binned in this range


def statistics(body: np.ndarray, offsets: np.ndarray, powers: Powers) -> np.ndarray:
    """One row of STATISTICS per text; an empty text has zeros."""
    n = len(offsets) - 1
    kinds = np.zeros(256, np.int8)
    for k, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>", b"|", b"!", b".", b",;:", b"\"'()[]{}?-_/\\@^~`+="), 1):
        kinds[list(chars)] = k
    kinds[0x80:] = 9
    kinds[SPACE] = 10
    code = kinds[body]
    own = owners(offsets)
    counts = np.bincount(own * 11 + code, minlength=n * 11).reshape(n, 11).astype(float) if len(body) else np.zeros((n, 11))
    lines = np.bincount(own[body == 10], minlength=n) + 1.0
    starts, ends, words = word_spans(body, offsets, ~SPACE)
    who, size, m = owners(words), ends - starts, np.diff(words)
    h = Rolling(BYTE_CODE[body], powers).raw(starts, ends)
    per_text = lambda x: np.bincount(who, weights=x, minlength=n)
    next_ = np.zeros(len(h), bool)
    next_[1:] = (h[1:] == h[:-1]) & (who[1:] == who[:-1])

    def distinct(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(x):
            return np.zeros(n), np.zeros(n)
        order = np.lexsort((x, w))
        x, w = x[order], w[order]
        heads = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (w[1:] != w[:-1])])
        most = np.zeros(n)
        np.maximum.at(most, w[heads], np.diff(np.r_[heads, len(x)]))
        return np.bincount(w[heads], minlength=n), most

    kinds_of_words, top = distinct(h, who)
    pair = np.flatnonzero(who[1:] == who[:-1]) if len(h) > 1 else np.zeros(0, np.int64)
    pairs, _ = distinct(h[pair] * np.uint64(3) + h[pair + 1], who[pair])
    upper_before = np.r_[0, np.cumsum(code == 1)]
    ups = upper_before[ends] - upper_before[starts]
    last = code[ends - 1] if len(ends) else np.zeros(0, np.int8)
    bytes_, word_n = np.maximum(np.diff(offsets), 1), np.maximum(m, 1)
    share = counts / bytes_[:, None]
    out = [np.log1p(m), np.log1p(np.diff(offsets)), per_text(size) / word_n, per_text(size > 20) / word_n, *(share[:, k] for k in range(1, 11)), np.where(m > 0, lines / word_n, 0),
           kinds_of_words / word_n, per_text(next_) / word_n, pairs / word_n, per_text(last == 6) / word_n, per_text((last == 3) | (last == 5)) / word_n,
           per_text((ups > 1) & (ups * 2 > size)) / word_n, top / word_n]
    return np.stack(out, 1)


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, x`` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            body, offsets = buffers(batch.column(1))
            for i, j in slices(offsets):
                x = statistics(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], powers)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.mapInArrow(run, "doc_id bigint, x array<double>")


@dataclass
class Model:
    """Everything needed to score a text."""

    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    levels: np.ndarray

    def raw(self, x: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return fourier(x, self.mean, self.scale, self.frequencies, self.phases) @ (self.weights if weights is None else weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.edges, self.levels), 0.0, 1.0) if len(self.edges) else np.full(len(x), 0.5)


def fourier(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, frequencies: np.ndarray, phases: np.ndarray) -> np.ndarray:
    """cos(w x + b) features with a constant; statistics far outside the corpus are held at eight deviations."""
    z = np.clip((x - mean) / scale, -8, 8)
    return np.hstack([np.ones((len(x), 1)), np.sqrt(2 / len(phases)) * np.cos(z @ frequencies + phases)])


def pooled(counts: np.ndarray, positives: np.ndarray) -> np.ndarray:
    """Isotonic means of bins, by pooling adjacent violators; empty bins take no part."""
    blocks: list[list[float]] = []
    for c, p in zip(counts, positives):
        blocks.append([c, p, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            c2, p2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + c2, blocks[-1][1] + p2, blocks[-1][2] + k2]
    return np.concatenate([np.full(int(k), p / c) for c, p, k in blocks]) if blocks else np.zeros(0)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels may not be learnt from; a null id has no label."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def as_matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, len(STATISTICS)))


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", ridge: float = 1e-2, width: float = 3.0, features: int = FEATURES, seed: int = 7) -> Model:
    """Learn from all labelled rows outside the held-out part; several labels of one id are averaged, nulls ignored."""
    d = len(STATISTICS)
    m = stats.select(F.count(F.lit(1)).alias("n"), *[F.avg(F.col("x")[k]).alias(f"m{k}") for k in range(d)], *[F.stddev_pop(F.col("x")[k]).alias(f"s{k}") for k in range(d)]).first()
    mean, scale = (np.array([m[f"{c}{k}"] or 0.0 for k in range(d)]) for c in "ms")
    scale = np.where(scale > 1e-9, scale, 1.0)
    r = np.random.default_rng(seed)
    model = Model(mean, scale, r.normal(size=(d, features)) / (width * np.sqrt(d) / 4), r.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.zeros(0), np.zeros(0))
    y = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.avg(F.col(label).cast("double")).alias("y"))
    known = stats.join(y, "doc_id").where(~held_out(F.col("doc_id"))).withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int"))
    known = cut(known.select("x", "y", "fold"))

    def sums(rows: np.ndarray) -> np.ndarray:
        z, target, fold = fourier(rows[:, :d], mean, scale, model.frequencies, model.phases), rows[:, d], rows[:, d + 1]
        return np.concatenate([(z[fold == k].T @ np.hstack([z[fold == k], target[fold == k, None]])).ravel() for k in range(FOLDS)])

    packed = known.select(F.concat("x", F.array(F.col("y"), F.col("fold").cast("double"))).alias("r"))
    parts = matrix_sum(packed, sums, "r")  # each partition adds up its own equations; partial sums meet in shrinking rounds
    if parts is None:
        return model
    total = parts.reshape(FOLDS, features + 1, features + 2)
    penalty = ridge * np.eye(features + 1)
    penalty[0, 0] = 1e-9
    solve = lambda s: np.linalg.lstsq(s[:, :-1] + penalty * max(1.0, s[0, 0] / 1000), s[:, -1], rcond=None)[0]
    every = total.sum(0)
    model.weights = solve(every)
    others = [solve(every - total[k]) for k in range(FOLDS)]

    def histogram(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros((BINS, 3))
        for f in frames:
            x, fold = as_matrix(f["x"]), f["fold"].to_numpy()
            for k in range(FOLDS):
                raw = model.raw(x[fold == k], others[k])
                b = np.clip((raw - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(int)
                np.add.at(table, b, np.stack([np.ones(len(raw)), f["y"].to_numpy()[fold == k], raw], 1))
        at = np.flatnonzero(table[:, 0])
        yield pd.DataFrame({"b": at, "n": table[at, 0], "p": table[at, 1], "r": table[at, 2]})

    bins = known.mapInPandas(histogram, "b int, n double, p double, r double").groupBy("b").agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum("r").alias("r")).orderBy("b").toPandas()
    model.edges, model.levels = (bins["r"] / bins["n"]).to_numpy(), pooled(bins["n"].to_numpy(), bins["p"].to_numpy())
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; without any label every score is 0.5.

    Null and empty texts are scored by their (zero) statistics; repeated rows get equal scores; statistics cover whole texts, a very long one
    being a slice of its own; an empty table gives no rows.
    """
    stats = cut(document_statistics(id_text(docs, id_col, text_col)))
    model = fit(stats, labels, label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    out = stats.mapInArrow(run, "doc_id bigint, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
