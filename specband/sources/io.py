"""Readers, parsers, label images and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from specband.functions.columns import PIXEL, color_key
from specband.functions.scale import checked_broadcast, rank_rows, scalars
from specband.operators.calibrate import full_grid

POWER_COLUMNS = ("Excitation Wavelength (nm)", "Average Power (W)")
# Annotation background colours (r, g, b, a).
BACKGROUND = [(24, 24, 24, 255), (168, 168, 168, 255)]


def scan_cubes(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """All cube files matching a glob; the excitation is the file name up to its first dot."""
    name = F.col("_metadata.file_name")
    return (
        spark.read.option("pathGlobFilter", pattern).parquet(path)
        .withColumn("file_name", name)
        .withColumn("excitation_text", F.substring_index("file_name", ".", 1))
    )


def read_trace_files(spark: SparkSession, path: str, pattern: str = "*.trq") -> DataFrame:
    """One row per (small) instrument text file: ``file, text``."""
    return (
        spark.read.option("wholetext", True).option("pathGlobFilter", pattern).text(path)
        .select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    )


def scan_power_traces(files: DataFrame) -> DataFrame:
    """``file, text`` -> ``file, wavelength, power``: data lines follow ``//DATA//``; the ``X`` header is skipped."""
    body = F.when(F.col("text").contains("//DATA//"), F.substring_index("text", "//DATA//", -1))
    fields = F.split(F.col("line"), "\t")
    return (
        files.select("file", F.explode(F.split(body, "\r?\n")).alias("line"))
        .where(~F.col("line").startswith("X\t") & (F.size(fields) >= 2))
        .select("file", F.expr("try_cast(split(line, '\t')[0] AS DOUBLE)").alias("wavelength"),
                F.expr("try_cast(split(line, '\t')[1] AS DOUBLE)").alias("power"))
        .where("wavelength IS NOT NULL AND power IS NOT NULL")
    )


def average_power(traces: DataFrame) -> DataFrame:
    """Mean power per wavelength rounded half-even to 10 nm."""
    return (
        traces.groupBy((F.bround(F.col("wavelength") / 10) * 10).alias("wavelength"))
        .agg(F.avg("power").alias("power")).orderBy("wavelength")
    )


def read_power_table(df: DataFrame, row: str | None = None) -> DataFrame:
    """Named wavelength and power columns, else the first two; a later row for the same excitation wins."""
    ex, pw = POWER_COLUMNS if set(POWER_COLUMNS) <= set(df.columns) else df.columns[:2]
    seq = F.col(row) if row else F.monotonically_increasing_id()
    t = df.select(F.col(f"`{ex}`").cast("double").alias("excitation"), F.col(f"`{pw}`").cast("double").alias("power"), seq.alias("__seq"))
    return t.groupBy("excitation").agg(F.max_by("power", "__seq").alias("power"))


def label_from_colors(colors: DataFrame, background: list[tuple[int, int, int, int]] = BACKGROUND) -> DataFrame:
    """Distinct non-background colours in sorted order become classes 0, 1, ...; background is -1."""
    back = [F.struct(*[F.lit(v) for v in c]) for c in background]
    key = color_key()
    distinct = colors.select("r", "g", "b", "a").where(~_in(key, back)).distinct()
    ranked = rank_rows(distinct, ["r", "g", "b", "a"], "class")
    return (
        colors.join(checked_broadcast(ranked), ["r", "g", "b", "a"], "left")
        .withColumn("class", F.coalesce(F.col("class").cast("int"), F.lit(-1)))
    )


def _in(key: Column, values: list[Column]) -> Column:
    hit = F.lit(False)
    for v in values:
        hit = hit | (key == v)
    return hit


def label_from_frequent_colors(colors: DataFrame, min_count: int = 1000) -> DataFrame:
    """Colours with more than ``min_count`` pixels and some red, ordered by red, become classes 0, 1, ..."""
    frequent = (
        colors.groupBy("r", "g", "b", "a").count()
        .where((F.col("count") > min_count) & (F.col("r") != 0)).drop("count")
    )
    ranked = rank_rows(frequent, ["r", "g", "b", "a"], "class")
    return (
        colors.join(checked_broadcast(ranked), ["r", "g", "b", "a"], "left")
        .withColumn("class", F.coalesce(F.col("class").cast("int"), F.lit(-1)))
    )


def center_pad_crop(image: DataFrame, shape: tuple[int, int], height: int, width: int, fill: dict[str, int]) -> DataFrame:
    """Centred crop of the larger axes and centred padding of the smaller ones (offset = difference // 2)."""
    dy, dx = ((abs(a - b) // 2) * (1 if b >= a else -1) for a, b in zip(shape, (height, width)))
    moved = image.withColumns({"y": F.col("y") + dy, "x": F.col("x") + dx}).where(
        F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))
    grid = full_grid(image.sparkSession, height, width)
    return grid.join(moved, ["y", "x"], "left").select(
        "y", "x", *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in fill.items()])


def mask_from_background(colors: DataFrame, background: list[tuple[int, int, int, int]]) -> DataFrame:
    back = [F.struct(*[F.lit(v) for v in c]) for c in background]
    return colors.withColumn("keep", ~_in(color_key(), back))


def write_table(df: DataFrame, path: str, fmt: str | None = None, partition_by: list[str] | None = None) -> None:
    """CSV (with header) or Parquet, chosen by ``fmt`` or the extension of ``path``."""
    fmt = fmt or ("csv" if path.endswith(".csv") else "parquet")
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def layers(cubes: DataFrame, selection: DataFrame, n: int) -> DataFrame:
    """The n best bands as images, each scan's scaled from its own minimum..maximum to 0..65535."""
    best = checked_broadcast(selection.where(F.col("rank") <= n).select("rank", "excitation", "em_idx"))
    cells = cubes.join(best, ["excitation", "em_idx"]).withColumn("value", F.coalesce("value", F.lit(0.0)))
    lim = cells.groupBy("scan_id", "rank").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    span = F.col("hi") - F.col("lo")
    scaled = F.when(span > 0, F.floor((F.col("value") - F.col("lo")) / span * 65535)).otherwise(0)
    return cells.join(lim, ["scan_id", "rank"]).select(
        *PIXEL, "rank", "excitation", "em_idx", scaled.cast("int").alias("layer"))


def layer_metadata(cubes: DataFrame, selection: DataFrame, n: int) -> DataFrame:
    best = checked_broadcast(selection.where(F.col("rank") <= n))
    return cubes.join(best.select("rank", "excitation", "em_idx", "influence"), ["excitation", "em_idx"]).groupBy(
        "rank", "excitation", "em_idx", "influence").agg(F.min("value").alias("min_value"), F.max("value").alias("max_value"),
                                                         F.count("*").alias("n_pixels"))


def selection_report(influence: DataFrame, selection: DataFrame) -> DataFrame:
    """Ranked bands with the totals of the run on every line."""
    total = influence.agg(F.count("*").alias("n_available"))
    top = selection.agg(F.count("*").alias("n_selected"), F.max("influence").alias("max_influence"),
                        F.min("influence").alias("min_influence"))
    a, b = scalars(total), scalars(top)
    return selection.select(
        "rank", "excitation", "emission", "influence", a.getField("n_available").alias("n_available"),
        b.getField("n_selected").alias("n_selected"), b.getField("max_influence").alias("max_influence"),
        b.getField("min_influence").alias("min_influence"),
        (a.getField("n_available") / b.getField("n_selected")).alias("compression_ratio"))


def flatten_result_to_row(df: DataFrame) -> DataFrame:
    """Nested columns become JSON text so that a row fits a CSV line."""
    nested = [n for n, t in df.dtypes if t.startswith(("array", "map", "struct"))]
    return df.withColumns({n: F.to_json(n) for n in nested})


def read_results_partitions(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """Same-schema result files below ``<key>=<value>`` folders as one table with the folder value as a column."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    return (reader.schema(schema) if schema else reader).load(path)


def tag_from_path(df: DataFrame, pattern: str, name: str) -> DataFrame:
    """For folders without ``key=value`` names: the first group of ``pattern`` in the file path."""
    return df.withColumn(name, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def export_wide(pixels: DataFrame, names: list[str], keep: list[str] = ("y", "x")) -> DataFrame:
    """Array form to one column per band."""
    return pixels.select(*keep, *[F.col("spectrum")[i].alias(n) for i, n in enumerate(names)])


def scan_summary(cubes: DataFrame) -> DataFrame:
    return cubes.groupBy("excitation").agg(
        (F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), F.countDistinct("em_idx").alias("n_bands"),
        F.min("emission").alias("em_min"), F.max("emission").alias("em_max"), F.count("value").alias("n_values"))


def write_cubes(cubes: DataFrame, path: str) -> DataFrame:
    """Store long cubes by scan and excitation, with their manifest beside them; returns the manifest."""
    from specband.operators.calibrate import scan_manifest

    cubes.repartition("scan_id", "excitation").write.mode("overwrite").partitionBy("scan_id", "excitation").parquet(f"{path}/cells")
    scan_manifest(cubes.sparkSession.read.schema(cubes.schema).parquet(f"{path}/cells")).write.mode("overwrite").parquet(f"{path}/manifest")
    return read_manifest(cubes.sparkSession, path)


def read_cubes(spark: SparkSession, path: str) -> DataFrame:
    """Cells stored by ``write_cubes``; filters on scan and excitation prune files."""
    return spark.read.parquet(f"{path}/cells").withColumn("scan_id", F.col("scan_id").cast("string")).withColumn("excitation", F.col("excitation").cast("double"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/manifest")


# -- co-located tables ------------------------------------------------------------------------------

def write_colocated(df: DataFrame, name: str, path: str, buckets: int, by: list[str] = PIXEL) -> DataFrame:
    """Store a pixel table bucketed and sorted by its keys, and return it as table ``name``.

    Tables of one number of buckets over the same keys (labels, predictions, objects, masks) are joined bucket by bucket: no pixel is
    moved again.  One file per bucket; choose ``buckets`` so that a bucket fits a task, for the largest of the tables.
    """
    df.repartition(buckets, *by).write.mode("overwrite").bucketBy(buckets, *by).sortBy(*by).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def read_colocated(spark: SparkSession, name: str, path: str, buckets: int, by: list[str] = PIXEL) -> DataFrame:
    """A table of ``write_colocated`` in a session that does not know it yet; the layout is that of the files."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    keys = ", ".join(f"`{c}`" for c in by)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)
