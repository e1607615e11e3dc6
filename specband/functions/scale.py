"""Helpers that keep global steps (ranks, percentiles, lookups) distributed."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

# Row bounds below which a table may be sent to every task.
MAX_BROADCAST_ROWS = 20_000
MAX_BANDS = 4_096


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; only a local session may fall back to a temp folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        shared = tempfile.mkdtemp(prefix="specband-ckpt-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)  # this process made it and nobody else knows it
    sc.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Materialize to the shared folder: lineage ends here and lost executors cost nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_pandas(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> pd.DataFrame | None:
    """The rows as pandas when there are at most ``max_rows``; otherwise None."""
    pdf = df.limit(max_rows + 1).toPandas()
    return None if len(pdf) > max_rows else pdf


def require_bounded(df: DataFrame, what: str, max_rows: int = MAX_BROADCAST_ROWS) -> pd.DataFrame:
    pdf = bounded_pandas(df, max_rows)
    if pdf is None:
        raise ValueError(f"{what}: more than {max_rows} rows, this table must be a small dimension")
    return pdf


def scalars(one_row: DataFrame) -> Column:
    """A one-row frame as a struct-valued scalar subquery; read fields with ``.getField``."""
    return one_row.select(F.struct(*[F.col(c) for c in one_row.columns])).scalar()


def ordinal(df: DataFrame, order: Sequence[str | Column], name: str = "ordinal") -> DataFrame:
    """0-based position in the total order, without a single-task window.

    Rows are range-partitioned and sorted, each partition numbers its own rows and a
    table with one row per partition supplies the offsets.  Give a key that makes the
    order total: a unique last key also splits runs of equal values over partitions.
    """
    placed = cut(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__m", F.monotonically_increasing_id())
    )
    part = F.shiftright("__m", 33)
    pos = F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("__p")).agg((F.max(pos) + 1).alias("__n"))
    offsets = sizes.select(
        "__p",
        F.coalesce(
            F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("__off"),
    )
    return (
        placed.withColumn("__p", part)
        .join(F.broadcast(offsets), "__p")  # one row per partition
        .withColumn(name, F.col("__off") + pos)
        .drop("__p", "__off", "__m")
    )


LOG_BINS, SUB_BINS = 256, 4096  # bins per factor e in the first round; sub-bins of a bin in the second


def quantiles(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linearly interpolated percentiles per group, as columns ``by + probs``.

    Selection by refining histograms.  Round one counts values per logarithmic bin, round two counts sub-bins of equal width, but only of
    the bins that hold a wanted position, round three counts the single values of the sub-bins that hold one.  Counts combine in the tasks,
    so what is shuffled are bin counts and, at last, a few values; nothing is sorted or written.  The binning functions never fall as the
    value grows, so bins keep the order of the values.  Nulls and NaN are left out; a group without values has no row.
    """
    by = list(by)
    v = F.col("__v")
    rows = df.select(*by, F.col(value).cast("double").alias("__v")).where(v.isNotNull() & ~F.isnan(v))
    size = F.floor(F.least(F.log(F.abs(v)) * LOG_BINS, F.lit(2.0**40))) + (1 << 20)  # above 0 for every number but 0
    rows = rows.withColumn("__b", F.when(v == 0, F.lit(0).cast("bigint")).when(v > 0, size).otherwise(-size))
    tallies = [F.count("*").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")]

    def placed(h: DataFrame, group: list[str], order: str, start: Column | None) -> DataFrame:
        """Position of the first value of every bin, and the bins that hold a wanted position."""
        w = Window.partitionBy(*group).orderBy(order)
        before = F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        h = h.withColumn("__below", before if start is None else before + start)
        if start is None:
            h = h.withColumn("__total", F.sum("__n").over(Window.partitionBy(*group)))
        holds = F.lit(False)
        for p in probs.values():
            pos = F.lit(float(p)) * (F.col("__total") - 1)
            for k in (F.floor(pos), F.ceil(pos)):
                holds = holds | ((F.col("__below") <= k) & (k < F.col("__below") + F.col("__n")))
        return h.where(holds)

    def matched(wanted: DataFrame) -> DataFrame:
        """Rows in the wanted bins, beside what is known of the bin: few bins per group, so rows stay where they are."""
        names = {c: f"__w{c}" for c in [*by, "__b"]}
        side = checked_broadcast(wanted.withColumnsRenamed(names))
        cond = F.col("__b") == F.col("__w__b")
        for c in by:
            cond = cond & F.col(c).eqNullSafe(F.col(f"__w{c}"))
        return rows.join(side, cond).drop(*names.values())

    width = F.col("__hi") - F.col("__lo")
    part = F.when(width > 0, F.least(F.floor((v - F.col("__lo")) / width * SUB_BINS), F.lit(SUB_BINS - 1))).otherwise(F.lit(0).cast("bigint"))
    first = placed(rows.groupBy(*by, "__b").agg(*tallies), by, "__b", None).drop("__n")
    known = ["__lo", "__hi", "__below", "__total"]
    second = matched(first).withColumn("__s", part).groupBy(*by, "__b", "__s", *known).agg(F.count("*").alias("__n"))
    second = placed(second, [*by, "__b"], "__s", F.col("__below")).drop("__n").withColumnRenamed("__s", "__want")
    third = matched(second).where(part == F.col("__want")).groupBy(*by, "__b", "__want", "__below", "__total", "__v").agg(F.count("*").alias("__n"))
    found = placed(third, [*by, "__b", "__want"], "__v", F.col("__below"))
    aggs = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("__total") - 1)
        for tag, k in (("a", F.floor(pos)), ("b", F.ceil(pos))):
            aggs.append(F.max(F.when((F.col("__below") <= k) & (k < F.col("__below") + F.col("__n")), v)).alias(f"__{tag}_{name}"))
    picked = found.groupBy(*by).agg(F.max("__total").alias("__total"), *aggs)
    out = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("__total") - 1)
        a, b = F.col(f"__a_{name}"), F.col(f"__b_{name}")
        out.append((a + (b - a) * (pos - F.floor(pos))).alias(name))
    return picked.select(*by, *out)


def argmax_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of every group in ``order`` (built from orderable columns); partial aggregation, no sort.

    ``order`` columns are compared ascending; negate numbers for descending order.
    """
    cols = [c for c in df.columns if c not in by]
    key = F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)])
    best = df.groupBy(*by).agg(F.min_by(F.struct(*cols), key).alias("__r"))
    return best.select(*by, *[F.col("__r").getField(c).alias(c) for c in cols])


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], key: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), [F.col(v).cast("double").alias(v) for v in values], key, value)


def checked_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast a side proven to have at most ``max_rows`` rows; it is computed once, by the check itself.

    A larger side comes back unchanged, so that the join stays a shuffled (and skew-handled) one.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema, verifySchema=False))


def rank_rows(df: DataFrame, order: Sequence[str | Column], name: str, start: int = 0) -> DataFrame:
    """Number rows in a total order: a window for proven small tables, ``ordinal`` beyond."""
    if df.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1 + start)
    return ordinal(df, order, name).withColumn(name, F.col(name) + start)



def prefix_max(df: DataFrame, order: Sequence[str], value: str, name: str, inclusive: bool = False) -> DataFrame:
    """Largest ``value`` of the rows before (or up to) each row in a total order, range-partitioned."""
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order)
                 .withColumn("__p", F.shiftright(F.monotonically_increasing_id(), 33)))
    w = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    parts = placed.groupBy("__p").agg(F.max(value).alias("__x")).select("__p", F.max("__x").over(w).alias("__b"))
    inner = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return placed.withColumn("__i", F.max(value).over(inner)).join(F.broadcast(parts), "__p").withColumn(
        name, F.greatest("__i", "__b")).drop("__p", "__i", "__b")
