"""Calibration, projection and filtering of long cube tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from specband.functions.columns import PIXEL, hash_order_key, in_polygon
from specband.functions.scale import scalars


def spectral_cutoff(cubes: DataFrame, offset: float = 40.0) -> DataFrame:
    """Drop first and second order excitation light."""
    ex, em = F.col("excitation"), F.col("emission")
    return cubes.where((em >= ex + offset) & ((em < 2 * ex - offset) | (em > 2 * ex + offset)))


def scan_manifest(cubes: DataFrame) -> DataFrame:
    """What is known of every band of every scan without its cells: ``scan_id, excitation, em_idx, emission, cells, measured, h, w``.

    One combinable aggregate, made once when a scan is stored (``io.write_cubes``); later steps take references, validity and shapes from it.
    """
    return cubes.groupBy("scan_id", "excitation", "em_idx").agg(
        F.max("emission").alias("emission"), F.count("*").alias("cells"), F.count("value").alias("measured"), (F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))


def _per_scan(table: DataFrame) -> list[str]:
    """Keys of an exposure or power table: by scan where the table tells scans apart."""
    return [c for c in ("scan_id", "excitation") if c in table.columns]


def _unique(table: DataFrame, column: str) -> DataFrame:
    """One row per key; two rows of one key fail the job instead of multiplying cells."""
    twice = F.raise_error(F.lit(f"{column} table has several rows for one key")).cast("double")
    return table.groupBy(*_per_scan(table)).agg(F.when(F.count("*") > 1, twice).otherwise(F.max(F.col(column).cast("double"))).alias(column))


def attach_exposure(cubes: DataFrame, exposure: DataFrame) -> DataFrame:
    """Exposure per excitation, or per scan and excitation if the table has ``scan_id``; NULL where the metadata has none."""
    return cubes.join(_unique(exposure, "exposure"), _per_scan(exposure), "left")


def _reference(table: DataFrame, column: str, ref: str | float) -> DataFrame:
    """``ref`` of the whole table, or one per scan if the table has ``scan_id``."""
    value = {"min": F.min, "max": F.max, "mean": F.avg}[ref](column) if isinstance(ref, str) else F.max(F.lit(float(ref)))
    return table.groupBy(*[c for c in ("scan_id",) if c in table.columns]).agg(value.alias("ref"))


def _with_reference(cells: DataFrame, table: DataFrame, column: str, ref: str | float) -> DataFrame:
    refs = _reference(table, column, ref)
    return cells.join(refs, "scan_id", "left") if "scan_id" in refs.columns else cells.withColumn("ref", scalars(refs).getField("ref"))


def normalize_exposure(cubes: DataFrame, exposure: DataFrame, ref: str | float = "max", excitations: DataFrame | None = None) -> DataFrame:
    """value * ref / exposure; ``ref`` is taken over the excitations the cubes contain, per scan if the table tells scans apart.

    ``excitations`` (from the scan metadata) saves the pass over the cubes that finds them.
    """
    used = exposure
    if isinstance(ref, str):  # a given number needs no look at the cubes
        present = cubes.select(*_per_scan(exposure)).distinct() if excitations is None else excitations
        used = exposure.join(present, _per_scan(exposure), "left_semi")
    return (
        _with_reference(attach_exposure(cubes, exposure), used, "exposure", ref)
        .withColumn("value", F.col("value") * F.when(F.col("exposure") > 0, F.col("ref") / F.col("exposure")).otherwise(1.0)).drop("ref")
    )


def normalize_power(cubes: DataFrame, power: DataFrame, ref: str | float = "min") -> DataFrame:
    """value * ref / power; ``ref`` is taken over the power table; excitations without power stay as they are."""
    return (
        _with_reference(cubes.join(_unique(power, "power"), _per_scan(power), "left"), power, "power", ref)
        .withColumn("value", F.col("value") * F.coalesce(F.col("ref") / F.nullif(F.col("power"), F.lit(0.0)), F.lit(1.0))).drop("ref")
    )


def calibrate(
    cubes: DataFrame, exposure: DataFrame, power: DataFrame,
    offset: float = 40.0, exposure_ref: str | float = "max", power_ref: str | float = "min", manifest: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Cut-off, exposure and power in sequence; every stage is kept (lazily) under its name.

    With the ``manifest`` of the scans (``scan_id, excitation, emission``) the cells are read once: the cut-off is applied to it to find the
    excitations whose exposures give the reference.
    """
    excitations = None if manifest is None else spectral_cutoff(manifest, offset).select(*_per_scan(exposure)).distinct()
    cut_off = spectral_cutoff(cubes, offset)
    exposed = normalize_exposure(cut_off, exposure, exposure_ref, excitations)
    return {"raw": cubes, "cutoff": cut_off, "exposure": exposed, "power": normalize_power(exposed, power, power_ref)}


def select_excitation(cubes: DataFrame, excitation: float) -> DataFrame:
    return cubes.where(F.col("excitation") == float(excitation))


def pixel_spectrum(cubes: DataFrame, excitation: float, y: int, x: int) -> DataFrame:
    return (
        cubes.where((F.col("excitation") == float(excitation)) & (F.col("y") == y) & (F.col("x") == x))
        .select("em_idx", "emission", "value").orderBy("em_idx")
    )


def crop(df: DataFrame, y0: int, y1: int, x0: int, x1: int, rebase: bool = False) -> DataFrame:
    """Half-open rectangle, optionally with coordinates counted from its corner."""
    out = df.where((F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1))
    return out.withColumns({"y": F.col("y") - y0, "x": F.col("x") - x0}) if rebase else out


def apply_mask(cubes: DataFrame, mask: DataFrame, check: bool = True) -> DataFrame:
    """NULL values where the mask does not keep the pixel; a pixel the mask does not cover fails the job."""
    kept = F.when(F.col("keep"), F.col("value"))
    if check:
        kept = F.when(F.col("keep").isNull(), F.raise_error(F.lit("mask and cubes cover different pixels")).cast("double")).otherwise(kept)
    return cubes.join(mask, PIXEL, "left").withColumn("value", kept).drop("keep")


def mask_from_rectangle(pixels: DataFrame, xa: int, ya: int, xb: int, yb: int, height: int, width: int) -> DataFrame:
    """Corners in any order, clamped to the image, both ends included."""
    x0, x1 = (min(max(v, 0), width - 1) for v in sorted((xa, xb)))
    y0, y1 = (min(max(v, 0), height - 1) for v in sorted((ya, yb)))
    return pixels.select(*PIXEL, (F.col("y").between(y0, y1) & F.col("x").between(x0, x1)).alias("keep"))


def mask_from_polygon(pixels: DataFrame, points: list[tuple[float, float]]) -> DataFrame:
    return pixels.select(*PIXEL, in_polygon(F.col("y"), F.col("x"), points).alias("keep"))


def _combine(a: DataFrame, b: DataFrame, expr) -> DataFrame:
    left = a.select(*PIXEL, F.col("keep").alias("old"))
    right = b.select(*PIXEL, F.col("keep").alias("new"))
    old, new = F.coalesce("old", F.lit(False)), F.coalesce("new", F.lit(False))
    joined = left.join(right, PIXEL, "full")
    return joined.select(*PIXEL, expr(old, new).alias("keep"), (expr(old, new) != old).alias("changed"))


def mask_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Logical OR; ``changed`` marks added pixels."""
    return _combine(a, b, lambda old, new: old | new)


def mask_subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keep of ``a`` and not of ``b``; ``changed`` marks removed pixels."""
    return _combine(a, b, lambda old, new: old & ~new)


def mask_coverage(mask: DataFrame) -> DataFrame:
    masked = F.coalesce(F.sum(F.col("keep").cast("bigint")), F.lit(0))
    total = F.count("*")
    return mask.agg(masked.alias("masked"), total.alias("total"), (100.0 * masked / F.nullif(total, F.lit(0))).alias("pct"))


def valid_pixels(cubes: DataFrame, rule: str = "all_excitations", manifest: DataFrame | None = None) -> DataFrame:
    """Pixels that count as measured; with a ``manifest`` of the scans one aggregate of the cells says which.

    ``all_excitations``: every excitation of the pixel's scan has at least one value there; ``first_band``: the scan's
    first band of its first excitation has a value; ``per_cell``: the non-NULL cells themselves.
    """
    if rule == "per_cell":
        return cubes.where(F.col("value").isNotNull())
    if rule not in ("all_excitations", "first_band"):
        raise ValueError(f"unknown rule {rule}")
    per_scan = (cubes if manifest is None else manifest).groupBy("scan_id").agg(F.count_distinct("excitation").alias("__n"), F.min(F.struct("excitation", "em_idx")).alias("__first"))
    measured = cubes.where(F.col("value").isNotNull())
    if rule == "all_excitations":
        seen = measured.groupBy(*PIXEL).agg(F.size(F.collect_set("excitation")).alias("__seen"))  # excitations of a pixel are few
        return seen.join(per_scan, "scan_id").where(F.col("__seen") == F.col("__n")).select(*PIXEL)
    at_first = measured.join(per_scan, "scan_id").where(F.struct("excitation", "em_idx") == F.col("__first"))
    return at_first.select(*PIXEL).distinct()


def fill_null(cubes: DataFrame, value: float = 0.0) -> DataFrame:
    return cubes.withColumn("value", F.coalesce(F.nanvl(F.col("value"), F.lit(value)), F.lit(value)))


def image_shape(df: DataFrame) -> tuple[int, int]:
    row = df.agg(F.max("y"), F.max("x")).first()
    return row[0] + 1, row[1] + 1


def scan_shapes(df: DataFrame) -> DataFrame:
    """``scan_id, h, w`` from the largest coordinates of every scan."""
    return df.groupBy("scan_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))


def downscale(cubes: DataFrame, factor: int, shape: tuple[int, int] | None = None) -> DataFrame:
    """Block means; incomplete blocks at the far edges are dropped, a missing cell empties its block.

    Without ``shape`` every scan has its own.
    """
    if shape:
        sized = cubes.withColumns({"h": F.lit(shape[0]), "w": F.lit(shape[1])})
    else:
        sized = cubes.join(scan_shapes(cubes), "scan_id")
    whole = lambda c, n: F.col(c) < F.floor(F.col(n) / factor) * factor
    kept = sized.where(whole("y", "h") & whole("x", "w"))
    return kept.groupBy(
        "scan_id", F.floor(F.col("y") / factor).cast("int").alias("y"), F.floor(F.col("x") / factor).cast("int").alias("x"),
        "excitation", "em_idx",
    ).agg(F.when(F.count("value") == F.count("*"), F.avg("value")).alias("value"))


def scan_grid(shapes: DataFrame) -> DataFrame:
    """Every position of every scan from ``scan_id, h, w``."""
    rows = shapes.select("scan_id", "w", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"))
    return rows.select("scan_id", F.col("y").cast("int").alias("y"), F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("x")).withColumn("x", F.col("x").cast("int"))


def full_grid(spark: SparkSession, height: int, width: int) -> DataFrame:
    """One row per image position."""
    return spark.range(height * width).select(
        F.floor(F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))


def downscale_mask(mask: DataFrame, factor: int, shape: tuple[int, int] | None = None) -> DataFrame:
    """Nearest-neighbour reduction of a mask: output cell -> nearest source pixel on the stretched index.

    Without ``shape`` every scan has its own.
    """
    shapes = mask.select("scan_id").distinct().withColumns({"h": F.lit(shape[0]), "w": F.lit(shape[1])}) if shape else scan_shapes(mask)
    small = shapes.select("scan_id", F.col("h").alias("sh"), F.col("w").alias("sw"), F.bround(F.col("h") / factor).cast("int").alias("h"), F.bround(F.col("w") / factor).cast("int").alias("w"))
    grid = scan_grid(small.select("scan_id", "h", "w").where("h > 0 AND w > 0")).join(small, "scan_id")

    def source(c: str, n: str, m: str):
        step = F.when(F.col(m) > 1, (F.col(n) - 1) / F.nullif(F.col(m) - 1, F.lit(0))).otherwise(0.0)
        return F.floor(F.col(c) * step + 0.5).cast("int")

    grid = grid.select("scan_id", "y", "x", source("y", "sh", "h").alias("sy"), source("x", "sw", "w").alias("sx"))
    src = mask.select("scan_id", F.col("y").alias("sy"), F.col("x").alias("sx"), "keep")
    return grid.join(src, ["scan_id", "sy", "sx"]).select("scan_id", "y", "x", "keep")


def nearest_band(bands: DataFrame, target: float) -> DataFrame:
    """Per excitation the band whose emission is closest to ``target``; the lower index wins ties."""
    key = F.struct(F.abs(F.col("emission") - float(target)), F.col("em_idx"))
    return bands.groupBy("excitation").agg(
        F.min_by("em_idx", key).alias("em_idx"), F.min_by("emission", key).alias("emission"))


def sample_pixels(pixels: DataFrame, n: int, seed: int = 42, key: str = "pixel_id") -> DataFrame:
    """``n`` pixels without replacement, reproducible for a seed."""
    return pixels.orderBy(hash_order_key(key, seed), key).limit(n)
