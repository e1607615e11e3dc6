"""Long, array and wide forms; tiles, patches, band subsets and image composites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from specband.functions.columns import PIXEL, clip, let
from specband.functions.scale import MAX_BROADCAST_ROWS, checked_broadcast, quantiles, require_bounded, scalars
from specband.operators.calibrate import scan_grid, scan_shapes, valid_pixels


def band_catalog(cubes: DataFrame) -> DataFrame:
    """Distinct bands with a dense id in (excitation, emission index) order."""
    distinct = cubes.groupBy("excitation", "em_idx").agg(F.max("emission").alias("emission"))
    require_bounded(distinct.select("em_idx"), "band catalog")
    order = Window.orderBy("excitation", "em_idx")  # a few hundred rows
    return distinct.withColumn("band_id", F.row_number().over(order) - 1)


def wide_name(emission: Column, excitation: Column) -> Column:
    return F.concat(emission.cast("int").cast("string"), F.lit("-"), excitation.cast("int").cast("string"))


def cube_to_wide(cubes: DataFrame, names: list[str], only_valid: str | None = None) -> DataFrame:
    """One row per pixel, one column per ``emission-excitation`` name; absent names stay NULL.

    The names are given, so no extra job looks for pivot values; of several values of a cell the largest stays.  The rows of a pixel meet in
    one exchange as narrow cells, the present bands become a short map, and the columns are read from it: no aggregate holds a wide row.
    """
    if only_valid:
        cubes = cubes.join(valid_pixels(cubes, only_valid), PIXEL, "left_semi")
    spark = cubes.sparkSession
    known = spark.range(1).select(F.posexplode(F.array(*[F.lit(n) for n in names]).cast("array<string>")).alias("__i", "__band"))
    known = F.broadcast(known) if len(names) <= MAX_BROADCAST_ROWS else known
    cells = cubes.select(*PIXEL, wide_name(F.col("emission"), F.col("excitation")).alias("__band"), "value").join(known, "__band", "left")
    # dealt by position, which serves both aggregates even if there is one scan; a given number of partitions is not merged again, so a task's share stays small
    cells = cells.select(*PIXEL, "__i", "value").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "y", "x")
    one = cells.groupBy(*PIXEL, "__i").agg(F.max("value").alias("__v"))
    short = one.groupBy(*PIXEL).agg(F.collect_list(F.when(F.col("__i").isNotNull() & F.col("__v").isNotNull(), F.struct("__i", "__v"))).alias("__s"))
    found = short.withColumn("__m", F.map_from_entries("__s"))
    return found.select(*PIXEL, *[F.col("__m")[i].alias(n) for i, n in enumerate(names)])


def cube_to_spectrum(cubes: DataFrame, bands: DataFrame, n_bands: int, rule: str | None = "all_excitations", manifest: DataFrame | None = None) -> DataFrame:
    """Valid pixels with one ordered array over all bands; missing cells become 0.

    With a ``manifest`` of the scans the cells are aggregated once: what is measured of a pixel is counted with its array.
    """
    named = checked_broadcast(bands.select("excitation", "em_idx", "band_id"))
    cells = cubes.join(named, ["excitation", "em_idx"])
    agg = [F.array_sort(F.collect_list(F.struct("band_id", F.coalesce("value", F.lit(0.0)).alias("v")))).alias("__s")]
    if rule == "all_excitations":
        agg.append(F.size(F.collect_set(F.when(F.col("value").isNotNull(), F.col("excitation")))).alias("__seen"))
    elif rule == "first_band":
        agg.append(F.max(F.when(F.col("value").isNotNull(), F.col("band_id") == 0)).alias("__ok"))
    else:
        agg.append(F.lit(True).alias("__ok"))
    filled = let(F.map_from_entries("__s"), lambda by_id: F.transform(
        F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda b: F.coalesce(by_id[b], F.lit(0.0))))
    dense = F.transform("__s", lambda e: e["v"])
    grouped = cells.groupBy(*PIXEL).agg(*agg)
    if rule == "all_excitations":  # of the scan, not of the pixel
        known = cells if manifest is None else manifest.join(named, ["excitation", "em_idx"], "left_semi")
        every = known.groupBy("scan_id").agg(F.count_distinct("excitation").alias("__n"))
        every = every if manifest is None else checked_broadcast(every)
        grouped = grouped.join(every, "scan_id").withColumn("__ok", F.col("__seen") == F.col("__n"))
    return (
        grouped.where("__ok")
        .select(*PIXEL, F.when(F.size("__s") == n_bands, dense).otherwise(filled).alias("spectrum"))
    )


def spectrum_to_long(pixels: DataFrame, bands: DataFrame) -> DataFrame:
    keep = [c for c in pixels.columns if c != "spectrum"]
    return pixels.select(*keep, F.posexplode("spectrum").alias("band_id", "value")).join(checked_broadcast(bands), "band_id")


def cluster_map(pred: DataFrame, shape: tuple[int, int] | None = None) -> DataFrame:
    """Labels on the full image of every scan; -1 where there is none."""
    if shape:
        shapes = pred.select("scan_id").distinct().withColumns({"h": F.lit(shape[0]), "w": F.lit(shape[1])})
    else:
        shapes = scan_shapes(pred)
    return scan_grid(shapes).join(pred.select(*PIXEL, "cluster"), PIXEL, "left").select(*PIXEL, F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def tile_starts(length: int, size: int, overlap: int) -> list[int]:
    """Tile starts along one axis; a tile that would leave the image is shifted back."""
    stride = size - overlap
    n = max(1, (length - overlap) // stride)
    n += stride * n + overlap < length
    return [max(0, length - size) if i * stride + size >= length else i * stride for i in range(n)]


def _axis_tiles(c: str, length: Column, size: int, overlap: int) -> Column:
    """Indexes of the tiles that contain a coordinate, by arithmetic (no join with a tile table)."""
    stride = size - overlap
    whole = F.greatest(F.lit(1), F.floor((length - overlap) / stride)).cast("int")
    last = whole - F.when(whole * stride + overlap < length, 0).otherwise(1)
    start = F.when(last * stride + size >= length, F.greatest(F.lit(0), length - size)).otherwise(last * stride)
    lo = F.greatest(F.lit(0), F.ceil((F.col(c) - size + 1) / stride))
    hi = F.least(last - 1, F.floor(F.col(c) / stride))
    inner = F.when(lo <= hi, F.sequence(lo.cast("int"), hi.cast("int"))).otherwise(F.array().cast("array<int>"))
    at_end = F.when(F.col(c) >= start, F.array(last)).otherwise(F.array().cast("array<int>"))
    return F.concat(inner, at_end)


def tile(cells: DataFrame, shape: tuple[int, int] | None = None, size: int = 128, overlap: int = 16) -> DataFrame:
    """Every row once per tile that covers it, with tile numbers and the tile's start; without ``shape`` every scan has its own."""
    stride = size - overlap
    sized = cells.withColumns({"__h": F.lit(shape[0]), "__w": F.lit(shape[1])}) if shape else cells.join(scan_shapes(cells).withColumnsRenamed({"h": "__h", "w": "__w"}), "scan_id")
    out = sized
    for axis, n in (("y", F.col("__h")), ("x", F.col("__w"))):
        out = out.withColumn(f"tile_{axis}", F.explode(_axis_tiles(axis, n, size, overlap)))
    for axis, n in (("y", F.col("__h")), ("x", F.col("__w"))):
        t = F.col(f"tile_{axis}") * stride
        out = out.withColumn(f"{axis}_start", F.when(t + size >= n, F.greatest(F.lit(0), n - size)).otherwise(t))
    return out.drop("__h", "__w")


def merge_tiles(tiles: DataFrame, keys: list[str] = ("excitation", "em_idx")) -> DataFrame:
    """Mean of the overlapping contributions."""
    return tiles.groupBy(*PIXEL, *keys).agg(F.avg("value").alias("value"))


def merge_tiles_running(tiles: DataFrame, keys: list[str] = ("excitation", "em_idx")) -> DataFrame:
    """Order-dependent variant: each later tile is averaged with the value so far; 0 counts as empty."""
    seq = F.array_sort(F.collect_list(F.struct("tile_y", "tile_x", "value")))
    merged = F.aggregate(
        "__s", F.lit(0.0), lambda acc, e: F.when(acc == 0, e["value"]).otherwise((acc + e["value"]) / 2))
    return tiles.groupBy(*PIXEL, *keys).agg(seq.alias("__s")).select(*PIXEL, *keys, merged.alias("value"))


def patches(mask: DataFrame, shape: tuple[int, int] | None = None, size: int = 32, stride: int = 16, max_n: int | None = None,
            min_valid: float = 0.5) -> DataFrame:
    """Patches in raster order that lie inside the image and are more than ``min_valid`` kept, on request only ``max_n`` per scan.

    Without ``shape`` every scan has its own.
    """
    sized = mask.withColumns({"__h": F.lit(shape[0]), "__w": F.lit(shape[1])}) if shape else mask.join(scan_shapes(mask).withColumnsRenamed({"h": "__h", "w": "__w"}), "scan_id")

    def starts(c: str, n: str) -> Column:
        lo = F.greatest(F.lit(0), F.ceil((F.col(c) - size + 1) / stride)).cast("int")
        hi = F.least(F.floor((F.col(n) - size) / stride), F.floor(F.col(c) / stride)).cast("int")
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

    cells = sized.withColumn("py", F.explode(starts("y", "__h"))).withColumn("px", F.explode(starts("x", "__w")))
    share = F.sum(F.col("keep").cast("bigint")) / float(size * size)
    valid = (
        cells.groupBy("scan_id", (F.col("py") * stride).alias("y0"), (F.col("px") * stride).alias("x0"))
        .agg(share.alias("valid_share")).where(F.col("valid_share") > min_valid)
    )
    if max_n is None:
        return valid
    w = Window.partitionBy("scan_id").orderBy("y0", "x0")  # top-n per scan, limited before the shuffle
    return valid.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= max_n).drop("__r")


def subset_bands(bands: DataFrame, requests: DataFrame, by: list[str] = (), ex_tol: float = 1.0, em_tol: float = 10.0) -> DataFrame:
    """Bands matching requested (excitation, emission) pairs.

    Excitation within ``ex_tol`` (first requested group wins), each target to the nearest emission if
    closer than ``em_tol``, duplicates dropped, request order kept in ``ord``.
    """
    by = list(by)
    req = requests.groupBy(*by, "excitation", "emission").agg(F.min("ord").alias("ord"))
    req = req.select(*by, F.col("excitation").alias("r_ex"), F.col("emission").alias("r_em"), "ord",
                     F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor("excitation") + d)).alias("__k"))
    cand = (
        req.join(checked_broadcast(bands.withColumn("__k", F.floor("excitation"))), "__k")
        .where(F.abs(F.col("excitation") - F.col("r_ex")) < ex_tol)
    )
    near = F.struct(F.abs(F.col("emission") - F.col("r_em")).alias("d"), F.col("em_idx"), F.col("emission"))
    nearest = cand.groupBy(*by, "excitation", "r_ex", "r_em", "ord").agg(F.min(near).alias("__b"))
    first = nearest.groupBy(*by, "excitation").agg(F.min_by("r_ex", "ord").alias("r_ex"))
    return (
        nearest.join(first, [*by, "excitation", "r_ex"])
        .where(F.col("__b.d") < em_tol)
        .groupBy(*by, "excitation", F.col("__b.em_idx").alias("em_idx"), F.col("__b.emission").alias("emission"))
        .agg(F.min("ord").alias("ord"))
    )


def subset_bands_emission_only(bands: DataFrame, emissions: DataFrame, em_tol: float = 10.0, by: list[str] = ()) -> DataFrame:
    """Older rule: targets apply to every excitation; an excitation without a match keeps all bands.

    ``by`` (configuration columns of ``emissions``) applies every configuration's targets to the bands at once.
    """
    by = list(by)
    band = F.struct("excitation", "em_idx", "emission")
    every = scalars(bands.agg(F.collect_list(band).alias("b"))).getField("b")  # the band dimension
    groups = emissions.select(*by).distinct() if by else bands.sparkSession.range(1).select(F.lit(0).alias("__g"))
    keys = by or ["__g"]
    targets = emissions.select(*by, *([] if by else [F.lit(0).alias("__g")]), F.col("emission").cast("double").alias("t")).distinct()
    key = F.struct(F.abs(F.col("emission") - F.col("t")).alias("d"), F.col("em_idx"))
    near = targets.select(*keys, "t", F.inline(every)).groupBy(*keys, "excitation", "t").agg(F.min(key).alias("k"))
    hit = near.where(F.col("k.d") < em_tol).select(*keys, "excitation", F.col("k.em_idx").alias("em_idx")).distinct()
    any_hit = hit.select(*keys, "excitation").distinct().withColumn("__any", F.lit(1))
    rows = groups.select(*keys, F.inline(every)).join(hit.withColumn("__hit", F.lit(1)), [*keys, "excitation", "em_idx"], "left")
    kept = rows.join(any_hit, [*keys, "excitation"], "left").where("__hit IS NOT NULL OR __any IS NULL")
    return kept.select(*by, "excitation", "em_idx", "emission")


def combine_cubes(pixels: DataFrame, slices: list[tuple[int, int]], normalize=None, normalize_first: bool = True) -> DataFrame:
    """Concatenate band ranges of a spectrum, normalizing each part before, or the whole after."""
    def part(a: int, b: int) -> Column:
        return F.slice("spectrum", a + 1, b - a)

    if normalize is None:
        joined = F.concat(*[part(a, b) for a, b in slices])
    elif normalize_first:
        joined = F.concat(*[normalize(part(a, b)) for a, b in slices])
    else:
        joined = normalize(F.concat(*[part(a, b) for a, b in slices]))
    return pixels.withColumn("spectrum", joined)


def per_pixel_features(cubes: DataFrame, method: str = "mean") -> DataFrame:
    """One number per (pixel, excitation): mean or max over its bands; ``flatten`` keeps the cells."""
    if method == "flatten":
        return cubes
    fn = {"mean": F.avg, "max": F.max}[method]
    return cubes.groupBy(*PIXEL, "excitation").agg(fn("value").alias("feature"))


def features_array(features: DataFrame) -> DataFrame:
    """Per-excitation features of a pixel as one array in excitation order."""
    s = F.array_sort(F.collect_list(F.struct("excitation", "feature")))
    return features.groupBy(*PIXEL).agg(F.transform(s, lambda e: e["feature"]).alias("spectrum"))


def false_color(cube: DataFrame, n_bands: int, percentile: float = 99.0, by: list[str] = ()) -> DataFrame:
    """Bands at 20, 50 and 80 % of an excitation's list, each divided by its percentile and clipped.

    With fewer than three bands the maximum projection is used for all channels.  ``by=["excitation"]`` makes one image per excitation.
    """
    by = list(by)
    if n_bands < 3:
        p = projection(cube, "max", percentile, by)
        return p.select("scan_id", "y", "x", *by, *[F.col("value").alias(c) for c in "rgb"])
    idx = {c: int(n_bands * s) for c, s in zip("rgb", (0.2, 0.5, 0.8))}
    picked = cube.where(F.col("em_idx").isin(list(idx.values())))
    limits = quantiles(picked, "value", {"p": percentile / 100}, ["scan_id", *by, "em_idx"])
    scaled = picked.join(limits, ["scan_id", *by, "em_idx"]).withColumn("value", clip(F.col("value") / F.nullif(F.col("p"), F.lit(0.0))))
    return scaled.groupBy(*PIXEL, *by).agg(*[F.max(F.when(F.col("em_idx") == i, F.col("value"))).alias(c) for c, i in idx.items()])


def projection(cube: DataFrame, how: str = "max", percentile: float = 99.0, by: list[str] = ()) -> DataFrame:
    """Maximum or mean over a pixel's bands, divided by its percentile over the image and clipped; one image per value of ``by``."""
    by, fn = list(by), {"max": F.max, "mean": F.avg}[how]
    flat = cube.groupBy(*PIXEL, *by).agg(fn("value").alias("value"))
    limits = quantiles(flat, "value", {"p": percentile / 100}, ["scan_id", *by])
    return flat.join(limits, ["scan_id", *by], "left").withColumn("value", clip(F.col("value") / F.nullif(F.col("p"), F.lit(0.0)))).drop("p")


def rgb_by_wavelength(cubes: DataFrame, mask: DataFrame | None = None, targets: tuple[float, float, float] = (650.0, 550.0, 450.0),
                      normalization: str = "global") -> DataFrame:
    """Nearest band per channel and excitation, scaled by global or per-excitation limits or p1-p99; NULL -> 0."""
    known = cubes.select("excitation", "em_idx", "emission").distinct()
    near = lambda target: F.min_by("em_idx", F.struct(F.abs(F.col("emission") - float(target)), F.col("em_idx")))
    chosen = [F.struct(F.lit(c).alias("channel"), near(target).alias("em_idx")) for c, target in zip("rgb", targets)]
    picks = known.groupBy("excitation").agg(F.array(*chosen).alias("p")).select("excitation", F.inline("p"))
    cells = cubes.join(checked_broadcast(picks), ["excitation", "em_idx"])
    inside = F.lit(True)
    if mask is not None:
        cells, inside = cells.join(mask, PIXEL, "left"), F.coalesce(F.col("keep"), F.lit(False))
    shown = F.when(inside, F.col("value")).otherwise(F.col("value") * 0)  # masked pixels are black
    values = cells.withColumn("value", shown)
    if normalization == "global":
        lim = cells.where(inside).groupBy("scan_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    elif normalization == "local":
        lim = values.groupBy("scan_id", "excitation").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    elif normalization == "percentile":
        lim = quantiles(values, "value", {"lo": 0.01, "hi": 0.99}, ["scan_id", "excitation"])
    else:
        raise ValueError(f"unknown normalization {normalization}")
    cells = cells.join(lim, [c for c in ("scan_id", "excitation") if c in lim.columns], "left")
    lo, hi = F.col("lo"), F.col("hi")
    scaled = F.coalesce(clip((shown - lo) / (hi - lo + 1e-8)), F.lit(0.0))
    return cells.groupBy(*PIXEL, "excitation").agg(
        *[F.coalesce(F.max(F.when(F.col("channel") == c, scaled)), F.lit(0.0)).alias(c) for c in "rgb"])


def rgb_enhance(channels: DataFrame, brightness: float = 2.5, gamma: float | None = None) -> DataFrame:
    """Long ``channel, value``: stretch p2..p98 of an image's positive values, brighten, clip, optional gamma."""
    by = [c for c in ("scan_id", "channel") if c in channels.columns]
    lim = quantiles(channels.where(F.col("value") > 0), "value", {"lo": 0.02, "hi": 0.98}, by)
    out = channels.join(lim, by, "left")
    lo, hi = F.coalesce("lo", F.lit(0.0)), F.coalesce("hi", F.lit(1.0))
    v = clip(clip((F.col("value") - lo) / (hi - lo + 1e-10)) * brightness)
    return out.withColumn("value", F.pow(v, F.lit(gamma)) if gamma else v).drop("lo", "hi")
