"""Calibration queries."""

from pyspark.sql import functions as F

from specband.operators import calibrate as cal
from specband.functions.columns import emission_axis
from workload.registry import case
from workload.tables import Tables

R4 = lambda c: F.round(c, 5).alias(c)


@case("a03_attach_exposure", """SELECT c.excitation, c.em_idx, c.y, c.x, e.exposure FROM cubes c LEFT JOIN exposure e ON c.excitation = e.excitation""")
def _(t: Tables):
    return cal.attach_exposure(t.cubes, t.exposure).select("excitation", "em_idx", "y", "x", "exposure")


CUT = "emission >= excitation + 40 AND (emission < 2 * excitation - 40 OR emission > 2 * excitation + 40)"


@case("b01_spectral_cutoff", f"SELECT excitation, em_idx, y, x, round(value, 6) AS value FROM cubes WHERE {CUT}")
def _(t):
    return cal.spectral_cutoff(t.cubes).select("excitation", "em_idx", "y", "x", F.round("value", 6).alias("value"))


EXPO = """SELECT c.excitation, c.em_idx, c.emission, c.y, c.x, c.value * CASE WHEN e.exposure > 0 THEN
    (SELECT {fn}(exposure) FROM exposure WHERE excitation IN (SELECT excitation FROM {src})) / e.exposure ELSE 1 END AS value
    FROM {src} c LEFT JOIN exposure e ON c.excitation = e.excitation"""


@case("b02_normalize_exposure", "WITH n AS (" + EXPO.format(fn="max", src="cubes") + ") SELECT excitation, em_idx, y, x, round(value, 5) AS value FROM n")
def _(t):
    return cal.normalize_exposure(t.cubes, t.exposure, "max").select("excitation", "em_idx", "y", "x", R4("value"))


@case("b02_normalize_exposure_mean", "WITH n AS (" + EXPO.format(fn="avg", src="cubes") + ") SELECT excitation, em_idx, y, x, round(value, 5) AS value FROM n")
def _(t):
    return cal.normalize_exposure(t.cubes, t.exposure, "mean").select("excitation", "em_idx", "y", "x", R4("value"))


@case("b03_normalize_power", """SELECT c.excitation, c.em_idx, c.y, c.x, round(c.value * coalesce((SELECT min(power) FROM power) / p.power, 1), 5) AS value
    FROM cubes c LEFT JOIN power p ON c.excitation = p.excitation""")
def _(t):
    return cal.normalize_power(t.cubes, t.power, "min").select("excitation", "em_idx", "y", "x", R4("value"))


@case("b04_calibrate", f"""WITH k AS (SELECT * FROM cubes WHERE {CUT}), n AS ({EXPO.format(fn="max", src="k")}) SELECT n.excitation, em_idx, y, x,
    round(n.value * coalesce((SELECT min(power) FROM power) / p.power, 1), 5) AS value
    FROM n LEFT JOIN power p ON n.excitation = p.excitation""")
def _(t):
    return cal.calibrate(t.cubes, t.exposure, t.power, manifest=t.scan_bands)["power"].select("excitation", "em_idx", "y", "x", R4("value"))


@case("b05_select_excitation", "SELECT y, x, em_idx, round(value, 6) AS value FROM cubes WHERE excitation = 360")
def _(t):
    return cal.select_excitation(t.cubes, 360).select("y", "x", "em_idx", F.round("value", 6).alias("value"))


@case("b06_pixel_spectrum", "SELECT em_idx, emission, round(value, 6) AS value FROM cubes WHERE excitation = 360 AND y = 7 AND x = 3")
def _(t):
    return cal.pixel_spectrum(t.cubes, 360, 7, 3).withColumn("value", F.round("value", 6))


@case("b07_crop", "SELECT excitation, em_idx, y - 20 AS y, x - 5 AS x, round(value, 6) AS value FROM cubes WHERE y >= 20 AND y < 120 AND x >= 5 AND x < 40")
def _(t):
    return cal.crop(t.cubes, 20, 120, 5, 40, rebase=True).select("excitation", "em_idx", "y", "x", F.round("value", 6).alias("value"))


@case("b08_apply_mask", """SELECT c.excitation, c.em_idx, c.y, c.x, CASE WHEN m.keep THEN round(c.value, 6) END AS value
    FROM cubes c LEFT JOIN mask m ON c.y = m.y AND c.x = m.x""")
def _(t):
    return cal.apply_mask(t.cubes, t.mask).select("excitation", "em_idx", "y", "x", F.round("value", 6).alias("value"))


@case("b09_mask_from_rectangle", "SELECT y, x, y BETWEEN 12 AND 90 AND x BETWEEN 0 AND 40 AS keep FROM grid")
def _(t):
    return cal.mask_from_rectangle(t.truth, 40, 90, -5, 12, 10**6, 150).select("y", "x", "keep")


POLY = [(10.5, 5.5), (140.5, 20.5), (100.5, 95.5), (60.5, 30.5), (20.5, 90.5)]


def _poly_sql():
    terms = []
    for (xa, ya), (xb, yb) in zip(POLY, POLY[1:] + POLY[:1]):
        terms.append(f"CASE WHEN ({ya} > y) <> ({yb} > y) AND x < (y - {ya}) * (CAST({xb - xa} AS DOUBLE) / {yb - ya}) + {xa} THEN 1 ELSE 0 END")
    return f"SELECT y, x, ({' + '.join(terms)}) % 2 = 1 AS keep FROM grid"


@case("b10_mask_from_polygon", _poly_sql())
def _(t):
    return cal.mask_from_polygon(t.truth, POLY).select("y", "x", "keep")


B11 = """WITH j AS (SELECT a.y, a.x, a.keep AS old, p.x < 20 AS new FROM mask a JOIN mask p ON a.y = p.y AND a.x = p.x)
    SELECT y, x, {e} AS keep, ({e}) <> old AS changed FROM j"""


@case("b11_mask_union", B11.format(e="old OR new"))
def _(t):
    return cal.mask_union(t.mask, t.mask.withColumn("keep", F.col("x") < 20)).select("y", "x", "keep", "changed")


@case("b11_mask_subtract", B11.format(e="old AND NOT new"))
def _(t):
    return cal.mask_subtract(t.mask, t.mask.withColumn("keep", F.col("x") < 20)).select("y", "x", "keep", "changed")


@case("b12_mask_coverage", "SELECT CAST(sum(CASE WHEN keep THEN 1 ELSE 0 END) AS BIGINT) AS masked, count(*) AS total, round(100.0 * CAST(sum(CASE WHEN keep THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6) AS pct FROM mask")
def _(t):
    return cal.mask_coverage(t.mask).withColumn("pct", F.round("pct", 6))


@case("b13_valid_pixels_all", """SELECT y, x FROM cells WHERE value IS NOT NULL GROUP BY y, x
    HAVING count(DISTINCT excitation) = (SELECT count(DISTINCT excitation) FROM cells)""")
def _(t):
    return cal.valid_pixels(t.cells, manifest=t.scan_bands).select("y", "x")


@case("b13_valid_pixels_first", """SELECT DISTINCT y, x FROM cells c JOIN (SELECT excitation, em_idx FROM cells ORDER BY excitation, em_idx LIMIT 1) f
    ON c.excitation = f.excitation AND c.em_idx = f.em_idx WHERE value IS NOT NULL""")
def _(t):
    return cal.valid_pixels(t.cells, "first_band", t.scan_bands).select("y", "x")


@case("b13_valid_pixels_cell", "SELECT y, x, count(*) AS n FROM cells WHERE value IS NOT NULL GROUP BY y, x")
def _(t):
    return cal.valid_pixels(t.cells, "per_cell").groupBy("y", "x").agg(F.count("*").alias("n"))


@case("b14_fill_null", "SELECT excitation, em_idx, y, x, round(coalesce(value, 0), 6) AS value FROM cells")
def _(t):
    return cal.fill_null(t.cells).select("excitation", "em_idx", "y", "x", F.round("value", 6).alias("value"))


@case("b15_downscale", """SELECT CAST(floor(y / 3) AS INT) AS y, CAST(floor(x / 3) AS INT) AS x, excitation, em_idx,
    CASE WHEN count(value) = count(*) THEN round(avg(value), 6) END AS value FROM cells
    WHERE y < floor(((SELECT max(y) FROM cells) + 1) / 3) * 3 AND x < floor(((SELECT max(x) FROM cells) + 1) / 3) * 3
    GROUP BY floor(y / 3), floor(x / 3), excitation, em_idx""")
def _(t):
    return cal.downscale(t.cells, 3).select("y", "x", "excitation", "em_idx", F.round("value", 6).alias("value"))


@case("b16_downscale_mask", """WITH d AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM mask),
    o AS (SELECT h, w, CAST(round_even(h / 3.0, 0) AS BIGINT) AS oh, CAST(round_even(w / 3.0, 0) AS BIGINT) AS ow FROM d),
    g AS (SELECT h, w, oh, ow, unnest(range(oh * ow)) AS i FROM o),
    s AS (SELECT CAST(floor(i / ow) AS INT) AS y, CAST(i % ow AS INT) AS x,
      floor(floor(i / ow) * (CAST(h - 1 AS DOUBLE) / (oh - 1)) + 0.5) AS sy, floor((i % ow) * (CAST(w - 1 AS DOUBLE) / (ow - 1)) + 0.5) AS sx FROM g)
    SELECT s.y, s.x, m.keep FROM s JOIN mask m ON m.y = s.sy AND m.x = s.sx""")
def _(t):
    return cal.downscale_mask(t.mask, 3).select("y", "x", "keep")


@case("b17_nearest_band", """SELECT excitation, em_idx, emission FROM (SELECT excitation, em_idx, emission, row_number() OVER (PARTITION BY excitation
    ORDER BY abs(emission - 555), em_idx) AS rn FROM (SELECT DISTINCT excitation, em_idx, emission FROM cubes) d) q WHERE rn = 1""")
def _(t):
    return cal.nearest_band(t.cubes, 555.0)


@case("b18_sample_pixels", "SELECT pixel_id, y, x FROM grid ORDER BY md5(concat(CAST(pixel_id AS VARCHAR), '|42')), pixel_id LIMIT 200")
def _(t):
    return cal.sample_pixels(t.truth, 200).select("pixel_id", "y", "x")


@case("a02_emission_axis", """SELECT excitation, em_idx, count(*) AS n, CASE WHEN excitation <= 400 THEN 420 ELSE excitation + 20 END + em_idx * 10.0 AS axis
    FROM cubes GROUP BY excitation, em_idx""")
def _(t):
    return t.cubes.groupBy("excitation", "em_idx").agg(F.count("*").alias("n")).withColumn("axis", emission_axis(F.col("excitation"), F.col("em_idx")))
