"""The band x band Gram matrix as a table of tiles.

With tens of thousands of bands the matrix fits neither a task nor the driver.  Bands are cut into tiles; every partition adds up products
of pairs of tiles, for as many pairs at a time as ``GROUP_BYTES`` allow, and partial products are added by pair in streaming rounds.  The
result is written and stays a table; the driver holds vectors of one number per band and, for greedy choices, single strips of it.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from specband.functions.blocks import matrix, shared_folder

TILE = 256
GROUP_BYTES = 128 << 20  # products that one task adds up during one pass
STRIP_BYTES = 64 << 20  # strips that the driver keeps
SALTS = 64
SCHEMA = "a int, b int, salt int, n bigint, g binary, s binary"


def tile_groups(tiles: int, size: int, limit: int = GROUP_BYTES) -> list[list[tuple[int, int]]]:
    """Pairs of tiles a <= b in groups whose products fit ``limit`` bytes; one pass over the pixels per group."""
    pairs = [(a, b) for a in range(tiles) for b in range(a, tiles)]
    step = max(1, limit // (size * size * 8))
    return [pairs[i:i + step] for i in range(0, len(pairs), step)]


def _rows(sums: dict[tuple[int, int], list], salt: int) -> Iterator[pa.RecordBatch]:
    for (a, b), (n, g, s) in sums.items():
        yield pa.RecordBatch.from_pydict({"a": pa.array([a], pa.int32()), "b": pa.array([b], pa.int32()), "salt": pa.array([salt], pa.int32()), "n": pa.array([n], pa.int64()),
                                          "g": pa.array([np.ascontiguousarray(g).tobytes()], pa.binary()), "s": pa.array([s.tobytes()], pa.binary())})


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add rows of one pair as they come: memory holds one product per pair, however many rows arrive."""
    sums: dict[tuple[int, int], list] = {}
    salt = 0
    for batch in batches:
        for i in range(batch.num_rows):
            a, b, salt, n = (batch.column(c)[i].as_py() for c in range(4))
            g, s = (np.frombuffer(batch.column(c)[i].as_buffer()) for c in (4, 5))
            if (a, b) in sums:
                held = sums[a, b]
                held[0] += n
                held[1] += g
                held[2] += s
            else:
                sums[a, b] = [n, g.copy(), s.copy()]
    yield from _rows(sums, salt)


class GramTable:
    """Row count, column sums and squares on the driver; products as written tiles."""

    def __init__(self, pixels: DataFrame, tile: int = TILE, column: str = "spectrum", group_bytes: int = GROUP_BYTES) -> None:
        self.spark, self.tile = pixels.sparkSession, tile
        first = pixels.select(F.size(column)).first()
        self.width = int(first[0]) if first else 0
        tiles = -(-self.width // tile)
        parts = None
        for pairs in tile_groups(tiles, tile, group_bytes):
            part = pixels.select(column).mapInArrow(self._products(pairs, tile), SCHEMA)
            parts = part if parts is None else parts.unionAll(part)
        self.folder = shared_folder(self.spark, "gram")
        empty = self.spark.createDataFrame([], SCHEMA)
        for keys in (["a", "b", "salt"], ["a", "b"]):
            parts = (empty if parts is None else parts).repartition(*keys).mapInArrow(_add, SCHEMA)
        parts.drop("salt").write.parquet(self.folder)
        self.tiles = self.spark.read.schema("a int, b int, n bigint, g binary, s binary").parquet(self.folder)
        self.n, self.total, self.squares = 0, np.zeros(self.width), np.zeros(self.width)
        for r in self.tiles.where("a = b").select("a", "n", "s").collect():  # two numbers per band
            s = np.frombuffer(r["s"]).reshape(2, -1)
            self.n = int(r["n"])
            self.total[r["a"] * tile:r["a"] * tile + s.shape[1]], self.squares[r["a"] * tile:r["a"] * tile + s.shape[1]] = s
        self._strips: OrderedDict[int, np.ndarray] = OrderedDict()

    @staticmethod
    def _products(pairs: list[tuple[int, int]], tile: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int], list] = {}
            for batch in batches:
                x = matrix(batch.column(0))
                for a, b in pairs if len(x) else ():
                    u, v = x[:, a * tile:(a + 1) * tile], x[:, b * tile:(b + 1) * tile]
                    new = [len(x), (u.T @ v).ravel(), np.r_[u.sum(0), (u * u).sum(0)] if a == b else np.zeros(0)]
                    sums[a, b] = [p + q for p, q in zip(sums[a, b], new)] if (a, b) in sums else new
            yield from _rows(sums, TaskContext.get().partitionId() % SALTS)

        return run

    def variances(self) -> np.ndarray:
        return np.maximum(self.squares / max(self.n, 1) - (self.total / max(self.n, 1)) ** 2, 0.0)

    def row(self, band: int) -> np.ndarray:
        """Products of one band with all bands; the strip of its tile is read, and kept within a bound."""
        t = band // self.tile
        if t not in self._strips:
            strip = np.zeros((min(self.tile, self.width - t * self.tile), self.width))
            for r in self.tiles.where((F.col("a") == t) | (F.col("b") == t)).select("a", "b", "g").collect():
                rows = min(self.tile, self.width - r["a"] * self.tile)
                g = np.frombuffer(r["g"]).reshape(rows, -1)
                other, g = (r["b"], g) if r["a"] == t else (r["a"], g.T)
                strip[:, other * self.tile:other * self.tile + g.shape[1]] = g
            self._strips[t] = strip
            while sum(s.nbytes for s in self._strips.values()) > STRIP_BYTES and len(self._strips) > 1:
                self._strips.popitem(last=False)
        self._strips.move_to_end(t)
        return self._strips[t][band - t * self.tile]

    def cosine_row(self, band: int) -> np.ndarray:
        size = np.sqrt(self.squares)
        size = np.where(size == 0, 1.0, size)
        return self.row(band) / (size[band] * size)

    def correlation_row(self, band: int) -> np.ndarray:
        sd, mean = np.sqrt(self.variances()), self.total / max(self.n, 1)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.nan_to_num((self.row(band) / max(self.n, 1) - mean[band] * mean) / (sd[band] * sd))

    def long(self, name: str, how: str) -> DataFrame:
        """``band_a, band_b, <name>`` for all pairs of bands: ``correlation`` or ``cosine``."""
        n, tile, total = max(self.n, 1), self.tile, self.total
        scale = np.sqrt(self.variances() if how == "correlation" else self.squares)
        scale = np.where(scale == 0, np.nan if how == "correlation" else 1.0, scale)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    a, b = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                    i, j = np.arange(a * tile, min((a + 1) * tile, len(total))), np.arange(b * tile, min((b + 1) * tile, len(total)))
                    g = np.frombuffer(batch.column(2)[k].as_buffer()).reshape(len(i), len(j))
                    if how == "correlation":
                        g = g / n - np.outer(total[i] / n, total[j] / n)
                    v = np.nan_to_num(g / np.outer(scale[i], scale[j]))
                    for p, q, m in ((i, j, v), (j, i, v.T))[: 1 if a == b else 2]:
                        p, q = np.repeat(p, len(q)), np.tile(q, len(p))
                        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(q.astype(np.int32)), pa.array(m.ravel())], names=["band_a", "band_b", name])

        return self.tiles.select("a", "b", "g").mapInArrow(run, f"band_a int, band_b int, `{name}` double")
