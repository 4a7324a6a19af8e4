"""Geometry tables derived from the general test tables, in Spark and as DuckDB SQL.

Every table is whole-number arithmetic on dense keys plus a last scale and
offset in doubles, so that both engines build equal rows.  SQL has one common
table expression a fixture; with_tables() puts those that a query names before
it.  Constants are written 3e-6, which DuckDB reads as doubles.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoframe.functions import geo

IMAGES = 4


def _sparse(n: int, **values: float) -> Column:
    return F.array(*(F.lit(float(values.get(f"t{k}", 0.0))) for k in range(n)))


def _sql_list(n: int, **values: float) -> str:
    return "[" + ", ".join(f"{float(values.get(f't{k}', 0.0))!r}::DOUBLE" for k in range(n)) + "]"


#: Coefficients that are not 0, by array.
COEFFICIENTS = {
    "lnum": {"t1": 0.02, "t2": -1.0, "t3": 0.01}, "lden": {"t0": 1.0, "t3": 0.001}, "snum": {"t1": 1.0, "t2": 0.02, "t3": -0.01}, "sden": {"t0": 1.0},
    "latnum": {"t1": -1.0, "t2": 0.02, "t3": 0.01}, "latden": {"t0": 1.0, "t3": 0.001}, "lonnum": {"t1": 0.02, "t2": 1.0, "t3": 0.01}, "londen": {"t0": 1.0, "t3": 0.0005},
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _images(df: DataFrame, n: int = IMAGES) -> DataFrame:
    return df.withColumn("image_id", F.explode(F.array(*(F.lit(k) for k in range(n)))))


def sensor_models(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("image_id")
    df = read(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("image_id"))
    values = {"line_off": F.lit(75.0), "samp_off": F.lit(50.0), "lat_off": F.lit(30.0) + k % 25 * F.lit(3e-6), "lon_off": F.lit(110.0) + k % 25 * F.lit(2e-6), "h_off": F.lit(220.0), "line_scale": F.lit(75.0), "samp_scale": F.lit(50.0), "lat_scale": F.lit(0.0015), "lon_scale": F.lit(0.001), "h_scale": F.lit(50.0)}
    return df.withColumns(values | {c: _sparse(20, **v) for c, v in COEFFICIENTS.items()} | {c: F.lit(v) for c, v in geo.IDENTITY.items()})


def corrections(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("image_id"))
    return df.selectExpr("image_id", "0.1D * (image_id % 5) AS p0", "1e-4D * (image_id % 3) AS p1", "2e-4D * (image_id % 4) AS p2", "-0.2D * (image_id % 3) AS p3", "1e-4D * (image_id % 2) AS p4", "-1e-4D * (image_id % 5) AS p5")


def corrected_models(spark: SparkSession, d: str) -> DataFrame:
    """sensor_models with the affine of corrections."""
    from geoframe.operators import sensor

    plain = sensor_models(spark, d).drop(*geo.AFFINE)
    return plain.join(sensor.corrections_to_affine(corrections(spark, d)), "image_id")


def tie_points(spark: SparkSession, d: str) -> DataFrame:
    df = _images(read(spark, d, "part").select(F.col("p_partkey").cast("long").alias("p")))
    return df.selectExpr("image_id", "p AS point_id", "CAST((p * 7) % 14 + IF((p + image_id) % 5 = 0, 1, 0) AS INT) AS line", "CAST((p * 13) % 99 + IF((p + 2 * image_id) % 7 = 0, 1, 0) AS INT) AS samp")


def _cells(spark: SparkSession, d: str, n: int, **values: str) -> DataFrame:
    df = _images(read(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("o")), n)
    return df.selectExpr("image_id", "CAST(o div 100 AS INT) AS row", "CAST(o % 100 AS INT) AS col", *(f"{v} AS {k}" for k, v in values.items()))


def dem(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d, 4, value="200 + ((o * 31) % 400) / 10.0D + 0.5D * image_id")


def pixels(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d, 4, **{f"b{n}": f"CAST((o * {m} + image_id) % 1024 AS DOUBLE)" for n, m in ((1, 17), (2, 29), (3, 43))})


def residuals(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d, 2, value="IF(o % 11 = 0, NULL, ((o * 13 + image_id) % 1000) / 100.0D)")


def dem_world(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("o"))
    return df.selectExpr("'dem' AS raster_id", "CAST(o div 100 AS INT) AS row", "CAST(o % 100 AS INT) AS col", "IF(o % 97 = 0, -9999.0D, 200 + ((o * 31) % 400) / 10.0D) AS value")


def geoid(spark: SparkSession, d: str) -> DataFrame:
    """A raster of 20 columns over the area and south of it, with a row for each of nation's."""
    cells = read(spark, d, "nation").selectExpr("CAST(n_nationkey AS INT) AS n").withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(19))))
    return cells.selectExpr("'geoid' AS raster_id", "n AS row", "m AS col", "-30 + ((n * 20 + m) % 13) / 10.0D AS value")


def rasters(spark: SparkSession, d: str) -> DataFrame:
    """Geotransforms of dem_world and geoid; their heights come from their rows."""
    n, m = (df.groupBy("raster_id").agg((F.max("row") + 1).alias("height")) for df in (dem_world(spark, d), geoid(spark, d)))
    one = n.selectExpr("raster_id", "4e-5D AS a", "0D AS b", "109.998D AS c", "0D AS d", "-4e-5D AS e", "30.003D AS f", "100 AS width", "height", "-9999D AS nodata")
    two = m.selectExpr("raster_id", "5e-4D AS a", "0D AS b", "109.995D AS c", "0D AS d", "-5e-4D AS e", "30.005D AS f", "20 AS width", "height", "CAST(NULL AS DOUBLE) AS nodata")
    return one.unionByName(two)


def footprints(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("i"))
    df = df.selectExpr("CAST(i AS INT) AS image_id", "CAST(1000 * ((i * 37) % 50) + 60000 * (i div 50) AS DOUBLE) AS minx", "CAST(1000 * ((i * 53) % 50) AS DOUBLE) AS maxy", "8000 + 100 * ((i * 29) % 60) AS w", "8000 + 100 * ((i * 31) % 60) AS h", "0.5D + 0.1D * (i % 5) AS px")
    return df.selectExpr("image_id", "minx", "maxy - h AS miny", "minx + w AS maxx", "maxy", "px")


def footprint_rasters(spark: SparkSession, d: str) -> DataFrame:
    """footprints as georeferenced rasters with cells of 100 m."""
    f = footprints(spark, d)
    return f.selectExpr("image_id AS raster_id", "100D AS a", "0D AS b", "minx AS c", "0D AS d", "-100D AS e", "maxy AS f", "CAST((maxx - minx) / 100 AS INT) AS width", "CAST((maxy - miny) / 100 AS INT) AS height", "px")


def quads(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "supplier").selectExpr("CAST(s_suppkey AS INT) AS quad_id", "CAST(s_suppkey % 5 AS INT) AS i")
    return df.selectExpr("quad_id", "100D * i AS x0", "9000D AS y0", "9000D + 100 * i AS x1", "9000D - 50 * i AS y1", "9000D AS x2", "0D AS y2", "0D AS x3", "50D * i AS y3")


def patches(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("v"), "label", "embedding")
    return df.selectExpr("v AS patch_id", "CAST(label AS INT) AS image_id", "16 * (v div 25) + 7.5D AS line", "16 * (v % 25) + 7.5D AS samp", "((v * 37) % 100) / 100.0D AS conf", "200D + (v % 40) AS h", "embedding AS feature").selectExpr("*", "12245000 + 2 * samp AS x", "3503000 - 2 * line AS y")


def query_points(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "events").select(F.col("event_id").cast("long").alias("e"))
    return df.selectExpr("e AS query_id", "((e * 7) % 320) + 0.25D AS line", "((e * 11) % 400) + 0.125D AS samp")


def correspondences(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("o"))
    df = df.selectExpr("CAST(o % 5 AS INT) AS image_id", "o AS point_id", "CAST((o * 7919) % 10000 AS DOUBLE) AS l_line", "CAST((o * 104729) % 10000 AS DOUBLE) AS l_samp", "((o * 41) % 100) / 100.0D AS conf", "((o * 31) % 21 - 10) / 10.0D AS n")
    return df.selectExpr("image_id", "point_id", "l_line", "l_samp", "conf", "1.0005D * l_line + 3e-4D * l_samp + 12.5D + n + IF(point_id % 17 = 0, 500D, 0D) AS t_line", "-2e-4D * l_line + 0.9997D * l_samp - 8.25D - n AS t_samp")


def predictions(spark: SparkSession, d: str) -> DataFrame:
    return patches(spark, d).selectExpr("patch_id", "image_id", "x + ((patch_id % 7) - 3) / 2.0D AS x", "y + ((patch_id % 5) - 2) / 2.0D AS y", "h + ((patch_id % 3) - 1) * 4D AS h")


def metric_log(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "events").selectExpr("event_id AS e", "user_id", "value", "event_type")
    return df.selectExpr("CAST(user_id % 10 AS INT) AS run", "CAST(e div 200 AS INT) AS epoch", "CAST(e % 200 AS INT) AS iter", "CAST(IF(event_type = 'error' AND e % 50 = 0, double('NaN'), value) AS DOUBLE) AS loss")


TABLES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (sensor_models, corrections, corrected_models, tie_points, dem, pixels, residuals, dem_world, geoid, rasters, footprints, footprint_rasters, quads, patches, query_points, correspondences, predictions, metric_log)
}

_ARRAYS_SQL = ", ".join(f"{_sql_list(20, **v)} AS {c}" for c, v in COEFFICIENTS.items())
_MODEL_SQL = "75e0 AS line_off, 50e0 AS samp_off, 30e0 + k % 25 * 3e-6 AS lat_off, 110e0 + k % 25 * 2e-6 AS lon_off, 220e0 AS h_off, 75e0 AS line_scale, 50e0 AS samp_scale, 15e-4 AS lat_scale, 1e-3 AS lon_scale, 50e0 AS h_scale"
_CELL = "CAST(o // 100 AS INTEGER) AS row, CAST(o % 100 AS INTEGER) AS col"
_ORDERS = "(SELECT CAST(o_orderkey AS BIGINT) AS o FROM orders)"
_K = "(SELECT UNNEST(range({n})) AS k)"

SQL: dict[str, str] = {
    "sensor_models": f"SELECT CAST(k AS INTEGER) AS image_id, {_MODEL_SQL}, {_ARRAYS_SQL}, 1e0 AS a00, 0e0 AS a01, 0e0 AS a02, 0e0 AS a10, 1e0 AS a11, 0e0 AS a12 FROM (SELECT s_suppkey AS k FROM supplier)",
    "corrections": "SELECT CAST(k AS INTEGER) AS image_id, 1e-1 * (k % 5) AS p0, 1e-4 * (k % 3) AS p1, 2e-4 * (k % 4) AS p2, -2e-1 * (k % 3) AS p3, 1e-4 * (k % 2) AS p4, -1e-4 * (k % 5) AS p5 FROM (SELECT s_suppkey AS k FROM supplier)",
    "corrected_models": "SELECT m.* EXCLUDE (a00, a01, a02, a10, a11, a12), 1e0 - p2 AS a00, -p1 AS a01, -p0 AS a02, -p5 AS a10, 1e0 - p4 AS a11, -p3 AS a12 FROM sensor_models m JOIN corrections USING (image_id)",
    "tie_points": f"SELECT CAST(k AS INTEGER) AS image_id, p AS point_id, CAST((p * 7) % 14 + CASE WHEN (p + k) % 5 = 0 THEN 1 ELSE 0 END AS INTEGER) AS line, CAST((p * 13) % 99 + CASE WHEN (p + 2 * k) % 7 = 0 THEN 1 ELSE 0 END AS INTEGER) AS samp FROM (SELECT CAST(p_partkey AS BIGINT) AS p FROM part), {_K.format(n=4)}",
    "dem": f"SELECT CAST(k AS INTEGER) AS image_id, {_CELL}, 200 + ((o * 31) % 400) / 10e0 + 5e-1 * k AS value FROM {_ORDERS}, {_K.format(n=4)}",
    "pixels": f"SELECT CAST(k AS INTEGER) AS image_id, {_CELL}, CAST((o * 17 + k) % 1024 AS DOUBLE) AS b1, CAST((o * 29 + k) % 1024 AS DOUBLE) AS b2, CAST((o * 43 + k) % 1024 AS DOUBLE) AS b3 FROM {_ORDERS}, {_K.format(n=4)}",
    "residuals": f"SELECT CAST(k AS INTEGER) AS image_id, {_CELL}, CASE WHEN o % 11 = 0 THEN NULL ELSE ((o * 13 + k) % 1000) / 100e0 END AS value FROM {_ORDERS}, {_K.format(n=2)}",
    "dem_world": f"SELECT 'dem' AS raster_id, {_CELL}, CASE WHEN o % 97 = 0 THEN -9999e0 ELSE 200 + ((o * 31) % 400) / 10e0 END AS value FROM {_ORDERS}",
    "geoid": f"SELECT 'geoid' AS raster_id, CAST(n_nationkey AS INTEGER) AS row, CAST(k AS INTEGER) AS col, -30 + ((n_nationkey * 20 + k) % 13) / 10e0 AS value FROM nation, {_K.format(n=20)}",
    "rasters": "SELECT 'dem' AS raster_id, 4e-5 AS a, 0e0 AS b, 109998e-3 AS c, 0e0 AS d, -4e-5 AS e, 30003e-3 AS f, 100 AS width, max(row) + 1 AS height, -9999e0 AS nodata FROM dem_world UNION ALL SELECT 'geoid', 5e-4, 0e0, 109995e-3, 0e0, -5e-4, 30005e-3, 20, max(row) + 1, NULL FROM geoid",
    "footprints": "SELECT image_id, minx, maxy - h AS miny, minx + w AS maxx, maxy, px FROM (SELECT CAST(i AS INTEGER) AS image_id, CAST(1000 * ((i * 37) % 50) + 60000 * (i // 50) AS DOUBLE) AS minx, CAST(1000 * ((i * 53) % 50) AS DOUBLE) AS maxy, 8000 + 100 * ((i * 29) % 60) AS w, 8000 + 100 * ((i * 31) % 60) AS h, 5e-1 + 1e-1 * (i % 5) AS px FROM (SELECT CAST(s_suppkey AS BIGINT) AS i FROM supplier))",
    "footprint_rasters": "SELECT image_id AS raster_id, 100e0 AS a, 0e0 AS b, minx AS c, 0e0 AS d, -100e0 AS e, maxy AS f, CAST((maxx - minx) / 100 AS INTEGER) AS width, CAST((maxy - miny) / 100 AS INTEGER) AS height, px FROM footprints",
    "quads": "SELECT quad_id, 100e0 * i AS x0, 9000e0 AS y0, 9000e0 + 100 * i AS x1, 9000e0 - 50 * i AS y1, 9000e0 AS x2, 0e0 AS y2, 0e0 AS x3, 50e0 * i AS y3 FROM (SELECT CAST(s_suppkey AS INTEGER) AS quad_id, CAST(s_suppkey % 5 AS INTEGER) AS i FROM supplier)",
    "patches": "SELECT v AS patch_id, CAST(label AS INTEGER) AS image_id, 16 * (v // 25) + 75e-1 AS line, 16 * (v % 25) + 75e-1 AS samp, ((v * 37) % 100) / 100e0 AS conf, 200e0 + (v % 40) AS h, embedding AS feature, 12245000 + 2 * (16 * (v % 25) + 75e-1) AS x, 3503000 - 2 * (16 * (v // 25) + 75e-1) AS y FROM (SELECT CAST(vec_id AS BIGINT) AS v, label, embedding FROM embeddings)",
    "query_points": "SELECT e AS query_id, ((e * 7) % 320) + 25e-2 AS line, ((e * 11) % 400) + 125e-3 AS samp FROM (SELECT CAST(event_id AS BIGINT) AS e FROM events)",
    "correspondences": f"SELECT image_id, point_id, l_line, l_samp, conf, 10005e-4 * l_line + 3e-4 * l_samp + 125e-1 + n + CASE WHEN point_id % 17 = 0 THEN 500e0 ELSE 0e0 END AS t_line, -2e-4 * l_line + 9997e-4 * l_samp - 825e-2 - n AS t_samp FROM (SELECT CAST(o % 5 AS INTEGER) AS image_id, o AS point_id, CAST((o * 7919) % 10000 AS DOUBLE) AS l_line, CAST((o * 104729) % 10000 AS DOUBLE) AS l_samp, ((o * 41) % 100) / 100e0 AS conf, ((o * 31) % 21 - 10) / 10e0 AS n FROM {_ORDERS})",
    "predictions": "SELECT patch_id, image_id, x + ((patch_id % 7) - 3) / 2e0 AS x, y + ((patch_id % 5) - 2) / 2e0 AS y, h + ((patch_id % 3) - 1) * 4e0 AS h FROM patches",
    "metric_log": "SELECT CAST(user_id % 10 AS INTEGER) AS run, CAST(event_id // 200 AS INTEGER) AS epoch, CAST(event_id % 200 AS INTEGER) AS iter, CASE WHEN event_type = 'error' AND event_id % 50 = 0 THEN 'NaN'::DOUBLE ELSE CAST(value AS DOUBLE) END AS loss FROM events",
}


def with_tables(query: str, more: dict[str, str] | None = None) -> str:
    """query with the definitions of the tables it names, and of those that they name, before it."""
    known = SQL | (more or {})
    wanted: list[str] = []

    def need(text: str) -> None:
        for name in known:
            if name not in wanted and re.search(rf"\b{name}\b", text):
                need_inner(name)

    def need_inner(name: str) -> None:
        for other in known:
            if other != name and other not in wanted and re.search(rf"\b{other}\b", known[name]):
                need_inner(other)
        if name not in wanted:
            wanted.append(name)

    need(query)
    return "WITH " + ",\n".join(f"{n} AS ({known[n]})" for n in wanted) + "\n" + query if wanted else query
