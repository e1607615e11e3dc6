"""Near-duplicate vectors by product quantisation: all pairs with a cosine of at least ``t``.

1. Equal vectors are one class with a count.  Unit vectors are dealt to coarse lists (nearest centre); centres and the
   codebooks are fitted on a bounded sample, every vector is indexed.
2. A list may hold a huge group of near copies.  Some of its vectors are tried as *leaders*: vectors within half the
   angle of ``t`` of the nearest leader form a ball, all of whose members are linked with each other, which needs no search.
3. Residuals to the centre of the list (or to the leader of the ball) are coded, one byte per subspace, and each vector keeps the length
   of its coding error.
4. A vector searches its own list, the lists before it that its partners may lie in, and the balls its partners may lie in.  Asymmetric
   distances come from per-query tables of squared distances to the codewords; a candidate is kept when table distance minus coding
   error is within reach, so coding loses no pair; candidates are ranked by the exact cosine.  A ball that lies within reach as a whole is
   one entry.
5. Searches are dealt out as (list, block of vectors, block of queries) of bounded size.  They return, per vector, how many rows it links
   with and one edge to the root of its links within the task: never the pairs.

Which lists suffice: a partner x of q at distance d lies in the cell of another centre only if x - q crosses the plane between the two
centres.  Balls use the full reach (triangle inequality).  Lists use ``spread`` standard deviations d / sqrt(dimensions) of that
projection for a difference without preferred direction; ``spread=None`` takes the whole distance, which loses no pair at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from specband.llm.common import shared_folder
from specband.llm.components import components

SAMPLE = 65_536  # rows that centres and codebooks are fitted on, in expectation; all rows of smaller tables
LISTS = 4_096
LEADERS = 16  # tried per list
BALL = 32  # members that make a ball
CODES, SUBSPACES = 256, 8
TARGETS, QUERIES = 2_048, 4_096  # vectors of a list and queries that meet in one task
ASKED, RANKED = 256, 1 << 14  # queries looked up at once, candidates measured at once
SLACK = 1e-7


def spherical_centres(x: np.ndarray, k: int, t: float, rounds: int = 8) -> np.ndarray:
    """Up to ``k`` unit centres, no two of them as close as ``t``: copies in the sample do not draw centres of their own."""

    def apart(rows: np.ndarray, most: int) -> np.ndarray:
        chosen = rows[:1]
        for at in range(1, len(rows), 256):
            block = rows[at:at + 256]
            for r in block[(block @ chosen.T).max(1) < t]:
                if len(chosen) < most and (chosen[-256:] @ r).max() < t:
                    chosen = np.vstack([chosen, r])
            if len(chosen) >= most:
                break
        return chosen

    c = apart(x, k)
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), c)
    return apart(c, k)


def codebook(x: np.ndarray, k: int, seed: int, rounds: int = 6) -> np.ndarray:
    c = np.unique(x, axis=0)
    c = c[np.random.default_rng(seed).permutation(len(c))[:k]]
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


@dataclass
class Index:
    """Centres of the lists, then leaders of the balls; codebooks; ball sizes and radii."""

    t: float
    margin: float
    centres: np.ndarray
    books: list[np.ndarray]
    leaders: np.ndarray
    list_of: np.ndarray  # list of every leader
    radius: np.ndarray  # angle of every ball

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return np.array_split(x, len(self.books), axis=1)

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, one byte per subspace, and the length of what they miss."""
        codes, missed = np.zeros((len(residual), len(self.books)), np.uint8), np.zeros(len(residual))
        for s, (x, book) in enumerate(zip(self.parts(residual), self.books)):
            codes[:, s] = np.argmin((book * book).sum(1) - 2 * x @ book.T, axis=1)
            missed += ((x - book[codes[:, s]]) ** 2).sum(1)
        return codes, np.sqrt(missed)

    def distances(self, residual: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances (queries x coded vectors): table look-ups, added over the subspaces."""
        total = np.zeros((len(residual), len(codes)))
        for s, (x, book) in enumerate(zip(self.parts(residual), self.books)):
            tables = np.maximum((x * x).sum(1)[:, None] + (book * book).sum(1) - 2 * x @ book.T, 0)
            total += tables[:, codes[:, s]]
        return np.sqrt(total)

    def cell(self, k: int) -> np.ndarray:
        return self.centres[k] if k < len(self.centres) else self.leaders[k - len(self.centres)]

    def ball_of(self, u: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest leader of the own list within half the angle, or -1; and the cosine to it."""
        ball, best = np.full(len(u), -1), np.full(len(u), np.cos(np.arccos(self.t) / 2) + SLACK)
        for k in np.unique(lists):
            own, rows = np.flatnonzero(self.list_of == k), np.flatnonzero(lists == k)
            if len(own):
                c = u[rows] @ self.leaders[own].T
                top = c.argmax(1)
                c = c[np.arange(len(rows)), top]
                near = c >= best[rows]
                ball[rows[near]], best[rows[near]] = own[top[near]], c[near]
        return ball, best

    def probes(self, u: np.ndarray, lists: np.ndarray, ball: np.ndarray) -> tuple[list[list[int]], list[list[int]]]:
        """Per vector: the cells to search, and the balls within reach as a whole."""
        n = len(self.centres)
        c = u @ self.centres.T
        own = c[np.arange(len(u)), lists]
        gap = np.maximum(2 - 2 * self.centres @ self.centres.T, 0)[lists]  # squared distance from the own centre to every centre
        reach = (own[:, None] - c) <= self.margin * np.sqrt(gap) + SLACK
        reach &= (np.arange(n) < lists[:, None]) & (ball < 0)[:, None]
        reach[np.arange(len(u)), lists] = ball < 0
        search = [np.flatnonzero(r).tolist() for r in reach]
        whole: list[list[int]] = [[] for _ in search]
        if len(self.leaders):
            angle, most = np.arccos(np.clip(u @ self.leaders.T, -1, 1)), np.arccos(self.t)
            other = np.where(ball < 0, len(self.leaders), ball)[:, None] > np.arange(len(self.leaders))  # pairs of balls meet once
            inside = other & (angle + self.radius <= most - SLACK)
            for q, y in zip(*np.nonzero(other & ~inside & (angle <= most + self.radius + SLACK))):
                search[q].append(n + int(y))
            for q, y in zip(*np.nonzero(inside)):
                whole[q].append(int(y))
        return search, whole


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(v: Column) -> Column:
    """No null, no component that is null or not finite, not all zero."""
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~odd & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(v: Column, size: int) -> Column:
    """Scaled to length 1 by way of the largest component, so that no square over- or underflows; shorter vectors end in zeros."""
    most = F.array_max(F.transform(v, F.abs))
    scaled = F.transform(F.array(F.transform(F.array(most), lambda m: F.transform(v, lambda x: x / m))[0]), lambda w: F.struct(
        w.alias("w"), F.sqrt(F.aggregate(w, F.lit(0.0), lambda a, x: a + x * x)).alias("n")))[0]
    body = F.transform(F.array(scaled), lambda s: F.transform(s["w"], lambda x: x / s["n"]))[0]
    return F.concat(body, F.array_repeat(F.lit(0.0), F.lit(size) - F.size(v)))


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index that each of ``n`` nodes reaches over the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        nxt = label.copy()
        np.minimum.at(nxt, label[a], low)
        np.minimum.at(nxt, label[b], low)
        nxt = nxt[nxt]
        if (nxt == label).all():
            return label
        label = nxt


def searched(index: Index, cell: int, q_key, q_m, q_u, q_own, t_key, t_m, t_u, codes, missed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys that have links here, the rows they link with, and the root of their links."""
    far, centre = np.sqrt(2 - 2 * index.t) + SLACK, index.cell(cell)
    keys, place = np.unique(np.r_[q_key, t_key], return_inverse=True)
    q_at, t_at = place[:len(q_key)], place[len(q_key):]
    n, label = np.zeros(len(keys), np.int64), np.arange(len(keys))
    for at in range(0, len(q_key), ASKED):  # links of a few queries at a time: only counts and roots are kept
        i, j = np.nonzero(index.distances(q_u[at:at + ASKED] - centre, codes) - missed <= far)
        i += at
        ok = ~q_own[i] | (q_key[i] < t_key[j])  # inside a list every pair is met from both ends
        i, j = i[ok], j[ok]
        near = np.concatenate([np.zeros(0, bool)] + [np.einsum("ij,ij->i", q_u[i[p:p + RANKED]], t_u[j[p:p + RANKED]]) >= index.t for p in range(0, len(i), RANKED)])
        i, j = i[near], j[near]
        n += (np.bincount(q_at[i], t_m[j], len(keys)) + np.bincount(t_at[j], q_m[i], len(keys))).astype(np.int64)
        if len(i):
            label = roots(np.r_[q_at[i], np.arange(len(keys))], np.r_[t_at[j], label], len(keys))
    linked = np.flatnonzero(n)
    return keys[linked], n[linked], keys[label[linked]]


def embedding_join(vectors: DataFrame, t: float = 0.9, spread: float | None = 4.0, sample: int = SAMPLE, lists: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding",
                   targets: int = TARGETS, queries: int = QUERIES) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Vectors that are null, empty or zero or hold null or non-finite components link with nothing; a shorter vector counts as ending in
    zeros.  Equal vectors and repeated rows are rows that link with each other; one id on several rows may belong to several components.  A row
    without id links like any other, is never the smallest id, and is kept only where its component has no id.  An empty table gives no rows.
    ``sample`` and ``spread`` are described above; ``t`` must be positive.
    """
    spark = vectors.sparkSession
    folder = shared_folder(spark, "vectors")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    base = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    base = base.withColumn("ok", usable(F.col("v")))
    alone = base.where("NOT ok").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    good = base.where("ok").select("vec_id", "v")
    size = good.agg(F.max(F.size("v"))).first()[0]
    if size is None:
        return alone
    classes = good.groupBy("v").agg(F.count("*").alias("m"), F.min("vec_id").alias("low")).withColumn("key", F.monotonically_increasing_id())
    classes = written(classes.withColumn("u", unit(F.col("v"), size)), "classes")
    n = classes.count()

    # fitted on a bounded sample: rows by a hash of their number
    share = min(1.0, sample / n)
    some = classes.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else classes
    x = matrix(some.select("u").limit(2 * sample).toArrow().column("u").combine_chunks())
    x = x[np.random.default_rng(11).permutation(len(x))]
    k = lists or min(LISTS, max(1, 1 << int(np.log2(max(1.0, np.sqrt(n))))))
    centres = spherical_centres(x, k, t) if len(x) else np.eye(1, size)
    residual = (x - centres[np.argmax(x @ centres.T, axis=1)])[: sample // 4]
    books = [codebook(p, CODES, s) for s, p in enumerate(np.array_split(residual if len(residual) else np.zeros((1, size)), min(SUBSPACES, size), axis=1))]
    far = np.sqrt(2 - 2 * t)
    index = Index(t, far if spread is None else min(far, spread * far / np.sqrt(size)), centres, books, np.zeros((0, size)), np.zeros(0, np.int64), np.zeros(0))
    told = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = np.argmax(matrix(b.column(2)) @ told.value.centres.T, axis=1) if len(b) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(near.astype(np.int32))], names=["key", "m", "u", "list"])

    dealt = written(classes.select("key", "m", "u").mapInArrow(assign, "key bigint, m bigint, u array<double>, list int"), "lists")

    # leaders: some vectors of each list, none within half the angle of an earlier one; at most LEADERS x LISTS rows
    by_list = Window.partitionBy("list").orderBy(F.xxhash64("key"), "key")
    tried = dealt.withColumn("k", F.row_number().over(by_list)).where(F.col("k") <= LEADERS).orderBy("list", "k").select("key", "list", "u").toArrow()
    lead_u, lead_list, lead_key = matrix(tried.column("u").combine_chunks()), tried.column("list").to_numpy(), tried.column("key").to_numpy()
    stay: list[int] = []
    for rows in np.split(np.arange(len(lead_list)), np.flatnonzero(np.diff(lead_list)) + 1):
        mine: list[int] = []
        for r in rows:
            if not mine or (lead_u[mine] @ lead_u[r]).max() < np.cos(np.arccos(t) / 2):
                mine.append(int(r))
        stay += mine
    index.leaders, index.list_of, lead_key = lead_u[stay], lead_list[stay], lead_key[stay]
    tries = spark.sparkContext.broadcast(index)

    def try_leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ball, cosine = tries.value.ball_of(matrix(b.column(1)), b.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(ball.astype(np.int32)), b.column(0), pa.array(cosine)], names=["ball", "m", "cosine"])

    balls = dealt.select("m", "u", "list").mapInArrow(try_leaders, "ball int, m bigint, cosine double").where("ball >= 0")
    balls = balls.groupBy("ball").agg(F.count("*").alias("members"), F.sum("m").alias("rows"), F.min("cosine").alias("cosine")).where(F.col("members") >= BALL).orderBy("ball").toPandas()
    at = balls["ball"].to_numpy(np.int64)
    final = Index(t, index.margin, centres, books, index.leaders[at], index.list_of[at], np.arccos(np.clip(balls["cosine"].to_numpy(float), -1, 1)) + SLACK)
    told.unpersist()
    tries.unpersist()
    shared = spark.sparkContext.broadcast(final)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        every = np.vstack([index.centres, index.leaders])
        for b in batches:
            u, own = matrix(b.column(2)), b.column(3).to_numpy().astype(np.int64)
            if not len(b):
                continue
            ball, _ = index.ball_of(u, own)
            cell = np.where(ball < 0, own, len(index.centres) + ball)
            codes, missed = index.encode(u - every[cell])
            search, whole = index.probes(u, own, ball)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(missed),
                 pa.array(search, pa.list_(pa.int32())), pa.array(whole, pa.list_(pa.int32()))], names=["key", "m", "u", "cell", "codes", "missed", "search", "whole"])

    coded = written(dealt.mapInArrow(code, "key bigint, m bigint, u array<double>, cell int, codes binary, missed double, search array<int>, whole array<int>"), "coded")

    # how many blocks of vectors and of queries each cell needs: at most LISTS x (LEADERS + 1) rows
    asked = coded.select("key", "m", "u", F.col("cell").alias("own"), F.explode("search").alias("cell"))
    blocks = coded.groupBy("cell").agg(F.ceil(F.count("*") / targets).alias("nt")).join(asked.groupBy("cell").agg(F.ceil(F.count("*") / queries).alias("nq")), "cell")
    blocks = F.broadcast(written(blocks, "blocks"))
    block = lambda count: F.pmod(F.xxhash64("key"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), (F.col(count) - 1).cast("int")))
    fields = ["cell", "tb", "qb", "key", "m", "u", "codes", "missed", "own"]
    kept = coded.join(blocks, "cell").withColumn("tb", block("nt")).withColumn("qb", every("nq")).withColumn("own", F.lit(-1)).select(*fields)
    asks = asked.join(blocks, "cell").withColumn("qb", block("nq")).withColumn("tb", every("nt")).withColumns({"codes": F.lit(None).cast("binary"), "missed": F.lit(None).cast("double")}).select(*fields)

    def search(group: pa.Table) -> pa.Table:
        own, cell = group.column("own").to_numpy(), group.column("cell")[0].as_py()
        t_rows, q_rows = np.flatnonzero(own < 0), np.flatnonzero(own >= 0)
        key, m, u = group.column("key").to_numpy(), group.column("m").to_numpy(), matrix(group.column("u").combine_chunks())
        codes = np.frombuffer(b"".join(c for c in group.column("codes").to_pylist() if c is not None), np.uint8).reshape(len(t_rows), -1)
        missed = group.column("missed").to_numpy()[t_rows]
        out = searched(shared.value, cell, key[q_rows], m[q_rows], u[q_rows], own[q_rows] == cell, key[t_rows], m[t_rows], u[t_rows], codes, missed)
        return pa.table(dict(zip(("key", "n", "root"), map(pa.array, out))), schema=pa.schema([("key", pa.int64()), ("n", pa.int64()), ("root", pa.int64())]))

    found = written(kept.union(asks).groupBy("cell", "tb", "qb").applyInArrow(search, "key bigint, n bigint, root bigint"), "found")

    # balls: their members link with each other, and with every vector that reaches the whole ball
    whole = coded.select("key", "m", F.explode("whole").alias("ball"))
    ball_of = F.col("cell") - F.lit(len(centres))
    about = spark.createDataFrame([(k, int(r), int(lead_key[b])) for k, (b, r) in enumerate(zip(at, balls["rows"]))], "ball int, rows bigint, leader bigint")
    about = F.broadcast(about.join(whole.groupBy("ball").agg(F.sum("m").alias("more")), "ball", "left").na.fill(0, ["more"]))  # at most LISTS x LEADERS rows
    member = coded.where(F.col("cell") >= len(centres)).select("key", "m", ball_of.alias("ball")).join(about, "ball")
    reached = whole.join(about, "ball")
    counts = found.select("key", "n").union(member.select("key", F.expr("rows - m + more"))).union(reached.select("key", "rows"))
    counts = counts.groupBy("key").agg(F.sum("n").alias("n"))
    edges = found.select(F.col("key").alias("u"), F.col("root").alias("v")).union(member.select("key", "leader")).union(reached.select("key", "leader"))
    parts = components(edges).withColumnRenamed("node", "key")
    known = classes.select("key", "v", "m", "low").join(counts, "key", "left").join(parts, "key", "left").withColumn("root", F.coalesce("root", "key"))
    known = written(known.select("v", "low", "root", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")), "known")
    least = known.groupBy("root").agg(F.min("low").alias("component_id"))
    out = good.join(known.join(least, "root").select("v", "n_links", "component_id"), "v")
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")).union(alone)
