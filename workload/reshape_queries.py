"""Reshape queries."""

from pyspark.sql import functions as F

from specband.operators import calibrate as cal, reshape as rs, stats as st
from workload.registry import case

NAMES = [f"{420 + 10 * e}-{300 + 20 * k}" for k in range(1, 8) for e in range(31)]


def r(c, n=6):
    return F.round(c, n).alias(c)


def _pivot(src):
    cols = ", ".join(f"""round(max(CASE WHEN emission = {n.split('-')[0]} AND excitation = {n.split('-')[1]} THEN value END), 6) AS "{n}" """ for n in NAMES)
    return f"SELECT y, x, {cols} FROM {src} GROUP BY y, x"


VALID = "(SELECT y, x FROM cells WHERE value IS NOT NULL GROUP BY y, x HAVING count(DISTINCT excitation) = (SELECT count(DISTINCT excitation) FROM cells))"


@case("c01_cube_to_wide", _pivot("cubes"))
def _(t):
    return rs.cube_to_wide(t.cubes, NAMES).select("y", "x", *[F.round(f"`{n}`", 6).alias(n) for n in NAMES])


@case("c02_cube_to_wide_masked", "WITH v AS " + VALID + ", k AS (SELECT c.* FROM cells c JOIN v ON c.y = v.y AND c.x = v.x) " + _pivot("k"))
def _(t):
    return rs.cube_to_wide(t.cells, NAMES, "all_excitations").select("y", "x", *[F.round(f"`{n}`", 6).alias(n) for n in NAMES])


@case("c03_cube_to_spectrum", "WITH v AS " + VALID + """ SELECT c.y, c.x, CAST((excitation - 320) / 20 * 31 + em_idx AS INT) AS band_id, round(value, 6) AS value
    FROM cells c JOIN v ON c.y = v.y AND c.x = v.x WHERE value <> 0""")
def _(t):
    bands = t.influence.select("excitation", "em_idx", "band_id")
    spec = rs.cube_to_spectrum(t.cells, bands, 7 * 31, manifest=t.scan_bands)
    return spec.select("y", "x", F.posexplode("spectrum").alias("band_id", "value")).where("value <> 0").select("y", "x", "band_id", r("value"))


@case("c04_spectrum_to_long", "SELECT pixel_id, band_id, excitation, em_idx, emission, round(value, 6) AS value FROM longpix")
def _(t):
    return rs.spectrum_to_long(t.pixels, t.bands).select("pixel_id", "band_id", "excitation", "em_idx", "emission", r("value"))


@case("c05_cluster_map", """WITH d AS (SELECT max(y) + 1 AS h FROM pred), i AS (SELECT unnest(range(h * 150)) AS i FROM d),
    g AS (SELECT CAST(floor(i / 150) AS INT) AS y, CAST(i % 150 AS INT) AS x FROM i), p AS (SELECT * FROM pred WHERE cluster >= 0)
    SELECT g.y, g.x, coalesce(p.cluster, -1) AS cluster FROM g LEFT JOIN p ON g.y = p.y AND g.x = p.x""")
def _(t):
    h = t.pred.agg(F.max("y")).first()[0] + 1
    return rs.cluster_map(t.pred.where("cluster >= 0"), (h, 150)).drop("scan_id")


# tiles of 64 with overlap 8 over 200 rows and W columns
TILES = """WITH d AS (SELECT max(x) + 1 AS w FROM cubes),
    n AS (SELECT w, greatest(1, CAST(floor((w - 8) / 56) AS INT)) AS k FROM d), m AS (SELECT w, k + CASE WHEN 56 * k + 8 < w THEN 1 ELSE 0 END AS k FROM n),
    tx AS (SELECT i AS tile_x, CASE WHEN i * 56 + 64 >= w THEN greatest(0, w - 64) ELSE i * 56 END AS s FROM (SELECT w, unnest(range(k)) AS i FROM m) q),
    ty AS (SELECT i AS tile_y, CASE WHEN i * 56 + 64 >= 200 THEN 136 ELSE i * 56 END AS s FROM (SELECT unnest(range(4)) AS i) q),
    tl AS (SELECT c.*, CAST(tile_y AS INT) AS tile_y, CAST(tile_x AS INT) AS tile_x, CAST(ty.s AS INT) AS y_start, CAST(tx.s AS INT) AS x_start FROM cubes c
      JOIN ty ON c.y >= ty.s AND c.y < ty.s + 64 JOIN tx ON c.x >= tx.s AND c.x < tx.s + 64)"""


def _tiles(t):
    w = t.cubes.agg(F.max("x")).first()[0] + 1
    return rs.tile(t.cubes, (200, w), 64, 8)


@case("c06_tile", TILES + " SELECT tile_y, tile_x, y_start, x_start, count(*) AS n, round(sum(value), 4) AS total FROM tl GROUP BY ALL")
def _(t):
    return _tiles(t).groupBy("tile_y", "tile_x", "y_start", "x_start").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@case("c07_merge_tiles", TILES + " SELECT y, x, excitation, em_idx, round(avg(value * (1 + 0.1 * tile_x + 0.2 * tile_y)), 7) AS value FROM tl GROUP BY y, x, excitation, em_idx")
def _(t):
    varied = _tiles(t).withColumn("value", F.col("value") * (1 + 0.1 * F.col("tile_x") + 0.2 * F.col("tile_y")))
    return rs.merge_tiles(varied).select("y", "x", "excitation", "em_idx", r("value", 7))


@case("c08_merge_tiles_running", TILES + """, o AS (SELECT y, x, excitation, em_idx, value * (1 + 0.1 * tile_x + 0.2 * tile_y) AS v,
      row_number() OVER (PARTITION BY y, x, excitation, em_idx ORDER BY tile_y, tile_x) AS rn FROM tl),
    w AS (SELECT y, x, excitation, em_idx, max(CASE WHEN rn = 1 THEN v END) AS a, max(CASE WHEN rn = 2 THEN v END) AS b,
      max(CASE WHEN rn = 3 THEN v END) AS c, max(CASE WHEN rn = 4 THEN v END) AS d FROM o GROUP BY y, x, excitation, em_idx)
    SELECT y, x, excitation, em_idx, round(CASE WHEN b IS NULL THEN a WHEN c IS NULL THEN (a + b) / 2 ELSE (((a + b) / 2 + c) / 2 + d) / 2 END, 7) AS value FROM w""")
def _(t):
    varied = _tiles(t).withColumn("value", F.col("value") * (1 + 0.1 * F.col("tile_x") + 0.2 * F.col("tile_y")))
    return rs.merge_tiles_running(varied).select("y", "x", "excitation", "em_idx", r("value", 7))


@case("c09_patches", """WITH d AS (SELECT max(y) + 1 AS h FROM grid), py AS (SELECT unnest(range(0, h - 31, 16)) AS y0 FROM d), px AS (SELECT unnest(range(0, 119, 16)) AS x0)
    SELECT CAST(y0 AS INT) AS y0, CAST(x0 AS INT) AS x0, round(CAST(sum(CASE WHEN fg THEN 1 ELSE 0 END) AS DOUBLE) / 1024, 6) AS valid_share
    FROM grid g JOIN py ON g.y >= y0 AND g.y < y0 + 32 JOIN px ON g.x >= x0 AND g.x < x0 + 32 GROUP BY y0, x0
    HAVING sum(CASE WHEN fg THEN 1 ELSE 0 END) / 1024.0 > 0.35 ORDER BY y0, x0 LIMIT 20""")
def _(t):
    h = t.grid.agg(F.max("y")).first()[0] + 1
    m = t.grid.select(F.lit("s").alias("scan_id"), "y", "x", F.col("fg").alias("keep"))
    return rs.patches(m, (h, 150), 32, 16, 20, 0.35).select("y0", "x0", r("valid_share"))


@case("c10_subset_bands", """WITH b AS (SELECT excitation + 0.4 AS excitation, em_idx, emission + 3 AS emission FROM influence),
    rq AS (SELECT config, excitation AS r_ex, emission AS r_em, min(ord) AS ord FROM picks GROUP BY 1, 2, 3),
    c AS (SELECT rq.*, b.excitation, b.em_idx, b.emission, row_number() OVER (PARTITION BY config, r_ex, r_em, b.excitation ORDER BY abs(b.emission - r_em), em_idx) AS rn
      FROM rq JOIN b ON abs(b.excitation - r_ex) < 1),
    k AS (SELECT *, min(ord) OVER (PARTITION BY config, excitation) AS f FROM c WHERE rn = 1),
    z AS (SELECT *, max(CASE WHEN ord = f THEN r_ex END) OVER (PARTITION BY config, excitation) AS fx FROM k)
    SELECT config, excitation, em_idx, emission, min(ord) AS ord FROM z WHERE r_ex = fx AND abs(emission - r_em) < 10 GROUP BY config, excitation, em_idx, emission""")
def _(t):
    bands = t.influence.select((F.col("excitation") + 0.4).alias("excitation"), "em_idx", (F.col("emission") + 3).alias("emission"))
    return rs.subset_bands(bands, t.picks, ["config"])


@case("c11_subset_bands_emission_only", """WITH tg AS (SELECT DISTINCT config, emission + 4 AS t FROM picks), g AS (SELECT DISTINCT config FROM tg),
    b AS (SELECT excitation, em_idx, emission + excitation / 2 AS emission FROM influence),
    n AS (SELECT config, excitation, t, min(abs(emission - t)) AS d, arg_min(em_idx, abs(emission - t) * 1000 + em_idx) AS em_idx FROM b, tg GROUP BY config, excitation, t),
    h AS (SELECT DISTINCT config, excitation, em_idx FROM n WHERE d < 10), e AS (SELECT DISTINCT config, excitation FROM h)
    SELECT g.config, b.excitation, b.em_idx, b.emission FROM g CROSS JOIN b LEFT JOIN h ON h.config = g.config AND b.excitation = h.excitation AND b.em_idx = h.em_idx
    LEFT JOIN e ON e.config = g.config AND e.excitation = b.excitation WHERE h.em_idx IS NOT NULL OR e.excitation IS NULL""")
def _(t):
    bands = t.influence.select("excitation", "em_idx", (F.col("emission") + F.col("excitation") / 2).alias("emission"))
    return rs.subset_bands_emission_only(bands, t.picks.select("config", (F.col("emission") + 4).alias("emission")), by=["config"])


C12 = """WITH l AS (SELECT pixel_id, band_id, value, CAST(floor(band_id / 24) AS INT) AS part FROM longpix),
    s AS (SELECT pixel_id, {p} AS part, avg(value) AS m, stddev_pop(value) AS sd FROM l GROUP BY ALL)
    SELECT l.pixel_id, CAST(l.band_id AS INT) AS pos, round((l.value - s.m) / s.sd, 6) AS value FROM l JOIN s ON l.pixel_id = s.pixel_id AND ({p2}) = s.part"""


@case("c12_combine_cubes_each", C12.format(p="part", p2="l.part"))
def _(t):
    d = rs.combine_cubes(t.pixels, [(0, 24), (24, 48), (48, 64)], st.snv, True)
    return d.select("pixel_id", F.posexplode("spectrum").alias("pos", "value")).withColumn("value", F.round("value", 6))


@case("c12_combine_cubes_whole", C12.format(p="0", p2="0"))
def _(t):
    d = rs.combine_cubes(t.pixels, [(0, 24), (24, 48), (48, 64)], st.snv, False)
    return d.select("pixel_id", F.posexplode("spectrum").alias("pos", "value")).withColumn("value", F.round("value", 6))


@case("c13_per_pixel_features_mean", "SELECT y, x, excitation, round(avg(value), 6) AS feature FROM cells GROUP BY y, x, excitation")
def _(t):
    return rs.per_pixel_features(t.cells, "mean").select("y", "x", "excitation", r("feature"))


@case("c13_per_pixel_features_max", """WITH f AS (SELECT y, x, excitation, max(value) AS feature FROM cubes GROUP BY y, x, excitation)
    SELECT y, x, CAST(row_number() OVER (PARTITION BY y, x ORDER BY excitation) - 1 AS INT) AS pos, round(feature, 6) AS feature FROM f""")
def _(t):
    f = rs.features_array(rs.per_pixel_features(t.cubes, "max"))
    return f.select("y", "x", F.posexplode("spectrum").alias("pos", "feature")).withColumn("feature", F.round("feature", 6))


@case("c14_false_color", """WITH k AS (SELECT * FROM cubes WHERE em_idx IN (6, 15, 24)), p AS (SELECT excitation, em_idx, quantile_cont(value, 0.99) AS p FROM k GROUP BY excitation, em_idx),
    s AS (SELECT k.y, k.x, k.excitation, k.em_idx, least(1, k.value / p.p) AS v FROM k JOIN p ON k.em_idx = p.em_idx AND k.excitation = p.excitation)
    SELECT y, x, excitation, round(max(CASE WHEN em_idx = 6 THEN v END), 6) AS r, round(max(CASE WHEN em_idx = 15 THEN v END), 6) AS g, round(max(CASE WHEN em_idx = 24 THEN v END), 6) AS b
    FROM s GROUP BY y, x, excitation""")
def _(t):
    return rs.false_color(t.cubes, 31, by=["excitation"]).select("y", "x", "excitation", r("r"), r("g"), r("b"))


C15 = """WITH f AS (SELECT y, x, excitation, {fn}(value) AS v FROM cubes GROUP BY y, x, excitation), p AS (SELECT excitation, quantile_cont(v, 0.99) AS p FROM f GROUP BY excitation)
    SELECT y, x, f.excitation, round(least(1, v / p), 6) AS value FROM f JOIN p ON p.excitation = f.excitation"""


@case("c15_projection_max", C15.format(fn="max"))
def _(t):
    return rs.projection(t.cubes, "max", by=["excitation"]).select("y", "x", "excitation", r("value"))


@case("c15_projection_mean", C15.format(fn="avg"))
def _(t):
    return rs.projection(t.cubes, "mean", by=["excitation"]).select("y", "x", "excitation", r("value"))


C16 = """WITH b AS (SELECT DISTINCT excitation, em_idx, emission FROM cubes), tg AS (SELECT 'r' AS ch, 650.0 AS t UNION ALL SELECT 'g', 550 UNION ALL SELECT 'b', 450),
    n AS (SELECT ch, excitation, em_idx, row_number() OVER (PARTITION BY ch, excitation ORDER BY abs(emission - t), em_idx) AS rn FROM b, tg),
    c AS (SELECT c.y, c.x, c.excitation, n.ch, m.keep, CASE WHEN m.keep THEN value ELSE 0 END AS v, CASE WHEN m.keep THEN value END AS kv
      FROM cubes c JOIN n ON c.excitation = n.excitation AND c.em_idx = n.em_idx AND n.rn = 1 LEFT JOIN mask m ON c.y = m.y AND c.x = m.x),
    s AS (SELECT y, x, excitation, ch, greatest(0, least(1, (v - {lo}) / ({hi} - {lo} + 1e-8))) AS v FROM c)
    SELECT y, x, excitation, round(coalesce(max(CASE WHEN ch = 'r' THEN v END), 0), 6) AS r, round(coalesce(max(CASE WHEN ch = 'g' THEN v END), 0), 6) AS g,
    round(coalesce(max(CASE WHEN ch = 'b' THEN v END), 0), 6) AS b FROM s GROUP BY y, x, excitation"""


@case("c16_rgb_by_wavelength_global", C16.format(lo="(SELECT min(kv) FROM c)", hi="(SELECT max(kv) FROM c)"))
def _(t):
    return rs.rgb_by_wavelength(t.cubes, t.mask).select("y", "x", "excitation", r("r"), r("g"), r("b"))


@case("c16_rgb_by_wavelength_local", C16.format(lo="(min(v) OVER (PARTITION BY excitation))", hi="(max(v) OVER (PARTITION BY excitation))"))
def _(t):
    return rs.rgb_by_wavelength(t.cubes, t.mask, normalization="local").select("y", "x", "excitation", r("r"), r("g"), r("b"))


@case("c16_rgb_by_wavelength_percentile", C16.format(lo="(quantile_cont(v, 0.01) OVER (PARTITION BY excitation))", hi="(quantile_cont(v, 0.99) OVER (PARTITION BY excitation))"))
def _(t):
    return rs.rgb_by_wavelength(t.cubes, t.mask, normalization="percentile").select("y", "x", "excitation", r("r"), r("g"), r("b"))


@case("c17_rgb_enhance", """WITH k AS (SELECT y, x, excitation, em_idx AS channel, value FROM cells WHERE em_idx IN (6, 15, 24)),
    p AS (SELECT channel, quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM k WHERE value > 0 GROUP BY channel)
    SELECT y, x, excitation, k.channel, round(sqrt(least(1, greatest(0, least(1, (value - lo) / (hi - lo + 1e-10))) * 2.5)), 6) AS value
    FROM k JOIN p ON k.channel = p.channel WHERE value IS NOT NULL""")
def _(t):
    ch = t.cells.where("em_idx IN (6, 15, 24) AND value IS NOT NULL").withColumnRenamed("em_idx", "channel")
    return rs.rgb_enhance(ch, gamma=0.5).select("y", "x", "excitation", "channel", r("value"))
