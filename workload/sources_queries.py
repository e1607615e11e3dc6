"""Source, label image and sink queries."""

import uuid

from pyspark.sql import functions as F

from specband.functions.scale import ensure_checkpoint_dir
from specband.operators import select as sel
from specband.sources import io
from workload.registry import case


def scratch(spark) -> str:
    """A fresh folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/out-{uuid.uuid4().hex}"


@case("a01_scan_cubes", "SELECT 'lineitem' AS excitation_text, l_linenumber, count(*) AS n, round(avg(l_extendedprice), 2) AS mean_value FROM lineitem GROUP BY l_linenumber")
def _(t):
    cubes = io.scan_cubes(t.spark, t.path, "lineitem.parquet")
    return cubes.groupBy("excitation_text", "l_linenumber").agg(F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 2).alias("mean_value"))


@case("a04_scan_power_traces", "SELECT concat('f', event_id) AS file, 300 + event_id % 200 AS wavelength, value AS power FROM events")
def _(t):
    e = t.raw("events")
    text = F.concat(F.lit("laser log\n1\t2\n//DATA//\nX\tY\n"), (300 + F.col("event_id") % 200).cast("string"), F.lit("\t"),
                    F.col("value").cast("string"), F.lit("\nend\n"))
    files = e.select(F.concat(F.lit("f"), "event_id").alias("file"), text.alias("text"))
    return io.scan_power_traces(files).withColumn("wavelength", F.col("wavelength").cast("bigint"))


@case("a05_average_power", "SELECT round_even(wavelength / 10, 0) * 10 AS wavelength, round(avg(power), 6) AS power FROM traces GROUP BY 1")
def _(t):
    return io.average_power(t.traces).withColumn("power", F.round("power", 6))


@case("a06_read_power_table", """SELECT CAST(c_nationkey * 10 + 300 AS DOUBLE) AS excitation, max_by(c_acctbal, c_custkey) AS power FROM customer GROUP BY c_nationkey""")
def _(t):
    raw = t.raw("customer").select("c_custkey", (F.col("c_nationkey") * 10 + 300).alias("Excitation Wavelength (nm)"), F.col("c_acctbal").alias("Average Power (W)"))
    return io.read_power_table(raw, row="c_custkey")


A7 = """WITH d AS (SELECT DISTINCT r, g, b, a FROM colors WHERE NOT (r = 11 AND g = 1 AND b = 0 AND a = 255) AND NOT (r = 28 AND g = 1 AND b = 0 AND a = 255)),
    k AS (SELECT *, CAST(row_number() OVER (ORDER BY r, g, b, a) - 1 AS INT) AS class FROM d)
    SELECT c.y, c.x, coalesce(k.class, -1) AS class FROM colors c LEFT JOIN k ON c.r = k.r AND c.g = k.g AND c.b = k.b AND c.a = k.a"""
BACK = [(11, 1, 0, 255), (28, 1, 0, 255)]


@case("a07_label_from_colors", A7)
def _(t):
    return io.label_from_colors(t.colors, BACK).select("y", "x", "class")


@case("a08_label_from_frequent_colors", """WITH d AS (SELECT r, g, b, a FROM colors WHERE r <> 0 GROUP BY r, g, b, a HAVING count(*) > 8),
    k AS (SELECT *, CAST(row_number() OVER (ORDER BY r, g, b, a) - 1 AS INT) AS class FROM d)
    SELECT c.y, c.x, coalesce(k.class, -1) AS class FROM colors c LEFT JOIN k ON c.r = k.r AND c.g = k.g AND c.b = k.b AND c.a = k.a""")
def _(t):
    return io.label_from_frequent_colors(t.colors, 8).select("y", "x", "class")


@case("a09_center_pad_crop", """WITH s AS (SELECT max(y) + 1 AS h FROM colors),
    m AS (SELECT CAST(y + floor(abs(h - (h + 7)) / 2) AS INT) AS y, x - 10 AS x, r, g FROM colors, s),
    o AS (SELECT h + 7 AS oh FROM s), i AS (SELECT unnest(range(oh * 30)) AS i FROM o),
    gr AS (SELECT CAST(floor(i / 30) AS INT) AS y, CAST(i % 30 AS INT) AS x FROM i)
    SELECT gr.y, gr.x, coalesce(m.r, 24) AS r, coalesce(m.g, 25) AS g FROM gr LEFT JOIN m ON gr.y = m.y AND gr.x = m.x""")
def _(t):
    h = t.colors.agg(F.max("y")).first()[0] + 1
    return io.center_pad_crop(t.colors.select("y", "x", "r", "g"), (h, 50), h + 7, 30, {"r": 24, "g": 25})


@case("a10_mask_from_background", "SELECT y, x, NOT (r = 11 AND g = 1 OR r = 28 AND g = 1) AS keep FROM colors")
def _(t):
    return io.mask_from_background(t.colors, BACK).select("y", "x", "keep")


@case("a11_write_table", "SELECT y, x, r, g FROM colors")
def _(t):
    path = scratch(t.spark)
    io.write_table(t.colors.select("y", "x", "r", "g"), path, "csv")
    return t.spark.read.option("header", True).schema("y INT, x INT, r INT, g INT").csv(path)


RANKED = """SELECT excitation, em_idx, emission, band_id, influence, CAST(row_number() OVER (ORDER BY influence DESC, excitation, em_idx) AS INT) AS rank FROM influence"""


@case("a12_write_layers", f"""WITH k AS ({RANKED}), c AS (SELECT c.y, c.x, k.rank, c.value FROM cubes c JOIN k ON c.excitation = k.excitation AND c.em_idx = k.em_idx WHERE k.rank <= 5),
    l AS (SELECT rank, min(value) AS lo, max(value) AS hi FROM c GROUP BY rank)
    SELECT c.y, c.x, c.rank, CAST(floor((c.value - l.lo) / (l.hi - l.lo) * 65535) AS INT) AS layer FROM c JOIN l ON c.rank = l.rank""")
def _(t):
    return io.layers(t.cubes, sel.rank_bands(t.influence), 5).select("y", "x", "rank", "layer")


@case("a12_layer_metadata", f"""WITH k AS ({RANKED}) SELECT k.rank, k.excitation, k.em_idx, k.influence, round(min(c.value), 6) AS min_value, round(max(c.value), 6) AS max_value, count(*) AS n_pixels
    FROM cubes c JOIN k ON c.excitation = k.excitation AND c.em_idx = k.em_idx WHERE k.rank <= 5 GROUP BY ALL""")
def _(t):
    return io.layer_metadata(t.cubes, sel.rank_bands(t.influence), 5).withColumns(
        {"min_value": F.round("min_value", 6), "max_value": F.round("max_value", 6)})


@case("a13_write_selection_report", f"""WITH k AS ({RANKED}), s AS (SELECT * FROM k WHERE rank <= 10)
    SELECT rank, excitation, emission, influence, (SELECT count(*) FROM influence) AS n_available, (SELECT count(*) FROM s) AS n_selected,
    (SELECT max(influence) FROM s) AS max_influence, (SELECT min(influence) FROM s) AS min_influence,
    round(CAST((SELECT count(*) FROM influence) AS DOUBLE) / (SELECT count(*) FROM s), 6) AS compression_ratio FROM s""")
def _(t):
    return io.selection_report(t.influence, sel.top_n(sel.rank_bands(t.influence), 10)).withColumn("compression_ratio", F.round("compression_ratio", 6))


@case("a14_flatten_result_to_row", """SELECT config_name, concat('{"n_bands":', n_bands, ',"dim":', perturbation_dim, '}') AS setup FROM results""")
def _(t):
    nested = t.results.select("config_name", F.struct("n_bands", F.col("perturbation_dim").alias("dim")).alias("setup"))
    return io.flatten_result_to_row(nested)


@case("a15_read_results_partitions", "SELECT perturbation_dim, count(*) AS n, round(max(accuracy), 6) AS best FROM results GROUP BY perturbation_dim")
def _(t):
    path = scratch(t.spark)
    io.write_table(t.results.select("perturbation_dim", "config_name", "accuracy"), path, "parquet", ["perturbation_dim"])
    return io.read_results_partitions(t.spark, path).groupBy("perturbation_dim").agg(F.count("*").alias("n"), F.round(F.max("accuracy"), 6).alias("best"))


WIDE = [f"{420 + 10 * (b % 8)}-{300 + 20 * (b // 8)}" for b in range(64)]


@case("a16_export_concat", "SELECT y, x, " + ", ".join(f'spectrum[{b + 1}] AS "{n}"' for b, n in enumerate(WIDE)) + " FROM pixels")
def _(t):
    path = scratch(t.spark)
    io.write_table(io.export_wide(t.pixels, WIDE).withColumn("config", F.lit("full")), path, "csv", ["config"])
    back = t.spark.read.option("header", True).schema("y INT, x INT, " + ", ".join(f"`{n}` DOUBLE" for n in WIDE)).csv(path)
    return back.select("y", "x", *[f"`{n}`" for n in WIDE])


@case("a17_scan_summary", """SELECT excitation, max(y) + 1 AS height, max(x) + 1 AS width, count(DISTINCT em_idx) AS n_bands, min(emission) AS em_min,
    max(emission) AS em_max, count(value) AS n_values FROM cells GROUP BY excitation""")
def _(t):
    return io.scan_summary(t.cells)
