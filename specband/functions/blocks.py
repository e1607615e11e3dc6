"""Rows as numbered blocks of bounded size in the shared folder, read by tasks one at a time.

A table that every task must see in full, such as the training rows of a neighbour search, is neither collected nor broadcast: it is
written once as blocks, and a task reads the blocks it needs.  What a task keeps of them is bounded in bytes.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from specband.functions.scale import ensure_checkpoint_dir

KEEP_BYTES = 128 << 20


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, where driver and executors see the same files."""
    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def matrix(column: pa.Array) -> np.ndarray:
    """Arrow list column -> rows x bands (missing cells 0)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if len(column) and len(flat) % len(column):
        raise ValueError("spectra of different lengths")
    return np.nan_to_num(flat.reshape(len(column), -1)) if len(column) else np.zeros((0, 0))


def write_blocks(df: DataFrame, rows: int, name: str) -> str:
    """Write ``part, at, id, tag, label, spectrum``, sorted within partitions, as blocks of at most ``rows`` rows with one ``part``; returns the folder.

    ``at`` is a position (a distance, say) whose range is kept per block.
    """
    def pack(part, held):
        at, ids, tags, labels, x = (np.concatenate(c) for c in zip(*held))
        return {"part": part, "lo": float(at.min()), "hi": float(at.max()), "n": len(at), "id": ids.tobytes(), "tag": tags.tobytes(), "label": labels.tobytes(),
                "spectra": np.ascontiguousarray(x).tobytes()}

    schema = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("n", pa.int32()),
                        ("id", pa.binary()), ("tag", pa.binary()), ("label", pa.binary()), ("spectra", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        part, held, size = None, [], 0
        for b in batches:
            own, x = b.column(0).to_numpy(), matrix(b.column(5))
            columns = [b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy(), b.column(4).to_numpy(), x]
            lo = 0
            while lo < len(own):
                if held and (own[lo] != part or size >= rows):
                    yield pa.RecordBatch.from_pylist([{"block": number} | pack(part, held)], schema)
                    number, held, size = number + 1, [], 0
                part = int(own[lo])
                hi = lo + min(int(np.searchsorted(own[lo:], part, side="right")), rows - size)
                held.append([c[lo:hi] for c in columns])
                size, lo = size + hi - lo, hi
        if held:
            yield pa.RecordBatch.from_pylist([{"block": number} | pack(part, held)], schema)

    spark, folder = df.sparkSession, shared_folder(df.sparkSession, name)
    ddl = "block bigint, part int, lo double, hi double, n int, id binary, tag binary, label binary, spectra binary"
    df.select("part", "at", "id", "tag", "label", "spectrum").mapInArrow(run, ddl).write.partitionBy("block").parquet(folder)
    known = spark.read.schema(ddl).parquet(folder).select("block", "part", "lo", "hi", "n", F.col("_metadata.file_path").alias("path"))
    known.repartition(1).sortWithinPartitions("block").write.parquet(f"{folder}-ranges")  # a line per block, for tasks that choose among them
    return folder


class Blocks:
    """What a task sees of written blocks: the ranges of all, and the rows of those it asks for."""

    def __init__(self, folder: str, keep: int = KEEP_BYTES) -> None:
        from pyarrow import fs, parquet

        if folder.startswith("file:"):
            folder = "/" + folder.removeprefix("file:").lstrip("/")
        self.files, self.folder = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        self.keep, self.held, self.bytes, self.reads = keep, OrderedDict(), 0, 0
        found = [f.path for f in self.files.get_file_info(fs.FileSelector(f"{self.folder}-ranges")) if f.path.endswith(".parquet")]
        self.known = pa.concat_tables([parquet.read_table(p, filesystem=self.files, partitioning=None) for p in found])
        self.paths = dict(zip(self.known.column("block").to_pylist(), self.known.column("path").to_pylist()))

    def ranges(self) -> dict[str, np.ndarray]:
        """``block, part, lo, hi, n`` of every block, in block order."""
        return {c: self.known.column(c).to_numpy() for c in ("block", "part", "lo", "hi", "n")}

    def read(self, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Spectra, ids, labels and tags of one block; recently read blocks are kept within a bound of bytes."""
        import pyarrow.parquet as pq

        if block in self.held:
            self.held.move_to_end(block)
            return self.held[block]
        name = self.folder.rsplit("/", 1)[1]
        row = pq.read_table(f"{self.folder}/{self.paths[block].rsplit(f'/{name}/', 1)[1]}", filesystem=self.files, partitioning=None).to_pylist()[0]
        n = row["n"]
        out = (np.frombuffer(row["spectra"]).reshape(n, -1), np.frombuffer(row["id"], np.int64), np.frombuffer(row["label"], np.int32), np.frombuffer(row["tag"], np.int32))
        self.reads += 1
        self.held[block] = out
        self.bytes += out[0].nbytes
        while self.bytes > self.keep and len(self.held) > 1:
            self.bytes -= self.held.popitem(last=False)[1][0].nbytes
        return out
