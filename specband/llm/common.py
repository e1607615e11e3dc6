"""What the text operators share: column hygiene, byte-level tokens, rolling hashes and blob exchanges.

Text is handled inside tasks as the UTF-8 bytes of an Arrow column, in slices of bounded size; hashes of words,
shingles and byte windows come from one prefix sum per slice.  Large sets of hashes travel as *blobs*: a row holds
the hashes that one slice sends to one partition, so a shuffle costs little more than the hashes themselves.
"""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from specband.functions.scale import ensure_checkpoint_dir

SLICE_BYTES = 1 << 20  # text handled at once inside a task; one longer text is a slice of its own
PRIME = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
ALNUM = np.zeros(256, bool)  # after lower-casing: digits, a-z and every byte of a non-ASCII character
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
BYTE_CODE = np.random.default_rng(20240117).integers(0, 1 << 64, 256, dtype=np.uint64)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a written table where all executors can reach it: beside the checkpoints."""
    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def finished(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of earlier phases now: it does so when the driver collects their handles.

    The first round drops the handles held from Python, the second what hung on them.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.7)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, under fixed names: extra columns never clash."""
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def partitions(df: DataFrame) -> int:
    """Partitions of a blob exchange: the session's shuffle setting, which is sized to the data."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the rolling-hash base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, min(2 * len(self.up), SLICE_BYTES + 1024))
            for name, base in (("up", PRIME), ("down", pow(PRIME, -1, 1 << 64))):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p))
        return self.up, self.down


class Rolling:
    """Hashes of any runs of a symbol sequence, from one prefix sum."""

    def __init__(self, symbols: np.ndarray, powers: Powers) -> None:
        up, self.down = powers.upto(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * up[: len(symbols)], out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def windows(self, n: int) -> np.ndarray:
        """Hash of the ``n`` symbols from every position on (document bounds are the caller's business)."""
        m = len(self.sums) - n
        if m <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[n:] - self.sums[:-n]) * self.down[:m])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null is an empty text."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``limit`` bytes together (or one text)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(body: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word, and the word offsets of the texts; words never cross texts."""
    ok = inside[body]
    first = np.ones(len(body) + 1, bool)
    first[1:-1] = ok[1:] != ok[:-1]
    first[offsets] = True
    edges = np.flatnonzero(first)
    starts = edges[:-1][ok[edges[:-1]]] if len(edges) > 1 else np.zeros(0, np.int64)
    ends = edges[1:][ok[edges[:-1]]] if len(edges) > 1 else np.zeros(0, np.int64)
    return starts, ends, np.searchsorted(starts, offsets)


def owners(offsets: np.ndarray) -> np.ndarray:
    """Text index of every position of a sequence with these offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def within(offsets: np.ndarray, n: int, length: int) -> np.ndarray:
    """Positions 0..length-1 at which ``n`` symbols still fit into the text."""
    end = np.repeat(offsets[1:], np.diff(offsets))[:length]
    return np.arange(len(end)) + n <= end


def binary(parts: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Rows of a binary column cut out of one array; ``offsets`` count items."""
    at = (np.asarray(offsets, np.int64) * parts.dtype.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(np.ascontiguousarray(parts).tobytes())])


def cut_runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Offsets of the runs of equal values, with the end."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    return np.r_[0, np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, len(sorted_keys)]


def joined(column: pa.Array, dtype) -> np.ndarray:
    """All values of a binary column, one after another."""
    if not len(column):
        return np.zeros(0, dtype)
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(dtype) if data is not None else np.zeros(0, dtype)
