"""Registered geometry queries, continued: what is written is read again, and the image operators not queried elsewhere."""

from __future__ import annotations

from functools import reduce
from io import BytesIO

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoframe.functions import geo
from geoframe.functions.lineage import shared_folder
from geoframe.operators import fit, metrics, raster, sensor, tiles, tiling
from geoframe.plans import jobs
from geoframe.queries.catalog import FRACTIONAL, HEIGHT, LAT_SQL, LON_SQL, PLAIN, Tables, bilinear_sql, fractional, image_sql, query, r
from geoframe.queries.catalog_more import FINITE, GRID_SQL, rect
from geoframe.sources import files


def _whole(arrays: tuple[str, ...]) -> list[str]:
    return [f"{c}[{k}] AS {c}{k}" for c in arrays for k in range(1, 21)]


def _elements(arrays: tuple[str, ...]) -> list[Column]:
    return [F.col(c)[k].alias(f"{c}{k + 1}") for c in arrays for k in range(20)]


@query("SELECT image_id, " + r(*sensor.NORMALIZERS, *geo.AFFINE, *_whole((*sensor.DIRECT, *sensor.INVERSE))) + " FROM corrected_models")
def s1_s3_model_files(t: Tables) -> DataFrame:
    folder = shared_folder(t.spark, "models")
    files.write_sensor_models(t.corrected_models, folder)
    back = files.read_sensor_models(t.spark, folder)
    return back.select("image_id", *sensor.NORMALIZERS, *geo.AFFINE, *_elements((*sensor.DIRECT, *sensor.INVERSE)))


@query("SELECT image_id, " + r(*sensor.NORMALIZERS, *_whole(sensor.DIRECT)) + " FROM sensor_models")
def s2_model_files(t: Tables) -> DataFrame:
    """The key = value layout, whose lists are in brackets. Inverse arrays, which its files do not hold, are not asked for and not fitted."""
    folder = shared_folder(t.spark, "rpb")
    values = [F.concat(F.lit(f"{key} = "), F.col(c).cast("string"), F.lit(";")) for c, key in zip(files.ORDER, files.RPB_NAMES, strict=True)]
    lists = [F.concat(F.lit(f"{key} = (\n"), F.concat_ws(",\n", F.transform(c, lambda v: v.cast("string"))), F.lit(");")) for c, key in files.RPB_ARRAYS.items()]
    text = F.concat_ws("\n", F.lit("BEGIN_GROUP = IMAGE"), *values, *lists, F.lit("END_GROUP = IMAGE"))
    files.write_texts(sensor.spread_models(t.sensor_models).select("image_id", text.alias("value")), folder)
    return files.read_sensor_models(t.spark, folder, "rpb", fitted=False).select("image_id", *sensor.NORMALIZERS, *_elements(tuple(sensor.DIRECT)))


@query("SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY point_id) - 1 AS BIGINT) AS point_id, line, samp FROM tie_points")
def s4_s5_tie_point_files(t: Tables) -> DataFrame:
    folder = shared_folder(t.spark, "ties")
    files.write_tie_points(t.tie_points, folder, ",")
    return files.read_tie_points(t.spark, folder, ",")


@query("SELECT DISTINCT 'image' || image_id AS id FROM dem")
def s6_scan_catalog(t: Tables) -> DataFrame:
    folder = shared_folder(t.spark, "catalog")
    names = t.dem.select(F.concat(F.lit("image"), F.col("image_id").cast("string")).alias("folder"), "image_id").distinct()
    names.select("folder", F.lit("x").alias("value")).repartition("folder").write.partitionBy("folder").text(folder)
    found = files.scan_catalog(t.spark, folder, "*.txt", ("part",))
    return found.select(F.regexp_extract("path", "folder=([^/]+)/", 1).alias("id")).distinct()


@query(f"SELECT run, {r('median(loss) AS median', 'max(loss) AS max')} FROM {FINITE} GROUP BY run")
def s9_append_log(t: Tables) -> DataFrame:
    folder = shared_folder(t.spark, "log")
    log = t.metric_log.filter("NOT isnan(loss)").groupBy("run").agg(F.median("loss").alias("median"), F.max("loss").alias("max"))
    metrics.append_log(log.filter("run < 5"), folder)
    metrics.append_log(log.filter("run >= 5"), folder)
    return t.spark.read.parquet(folder)


@query(GRID_SQL)
def s10_save_and_load_grids(t: Tables) -> DataFrame:
    folder = shared_folder(t.spark, "grids")
    files.save_grids(tiling.grids(rect(t), 800.0), folder)
    return files.load_grids(t.spark, folder)


@query(f"SELECT raster_id, row, col, {r('value')} FROM dem_world WHERE row >= 3 AND row < 9 AND col >= 20 AND col < 60")
def s11_write_raster_and_read_window(t: Tables) -> DataFrame:
    folder = shared_folder(t.spark, "raster")
    files.write_raster(t.dem_world, t.rasters, folder)
    return raster.read_window(t.spark.read.parquet(f"{folder}/cells"), (3, 20, 9, 60)).select("raster_id", "row", "col", "value")


STRIP = 64


@query(f"SELECT image_id || '-' || row // {STRIP} AS raster_id, CAST(row % {STRIP} AS INTEGER) AS row, col, {r('value')} FROM dem")
def s7_npy_rasters(t: Tables) -> DataFrame:
    """Strips of the height rasters as NumPy would save them, to tiles and back to cells."""
    strips = t.dem.select(F.concat_ws("-", F.col("image_id").cast("string"), F.expr(f"row div {STRIP}").cast("string")).alias("raster_id"), (F.col("row") % STRIP).alias("row"), "col", "value")

    def save(table: pa.Table) -> pa.Table:
        row, col, value = (table.column(c).to_numpy() for c in ("row", "col", "value"))
        cells = np.full((row.max() + 1, col.max() + 1), np.nan)
        cells[row, col] = value
        np.save(out := BytesIO(), cells)
        return pa.table({"raster_id": table.column("raster_id").slice(0, 1), "content": [out.getvalue()]})

    arrays = strips.groupBy("raster_id").applyInArrow(save, "raster_id string, content binary")
    cut = files.npy_tiles(arrays, 32)
    boxes = cut.groupBy("raster_id").agg(F.lit(0).alias("row0"), F.lit(0).alias("col0"), F.lit(STRIP).alias("row1"), F.max(F.col("col0") + F.col("width")).alias("col1"))
    return tiles.cells_in(cut, boxes, "raster_id", size=32).filter("value IS NOT NULL")


@query(f"SELECT raster_id, row, col, {r('value')} FROM dem_world WHERE row >= 3 AND row < 9 AND col >= 20 AND col < 60")
def s11_write_tiles_and_read_window(t: Tables) -> DataFrame:
    folder = shared_folder(t.spark, "tiles")
    files.write_tiles(tiles.from_cells(t.dem_world, "raster_id", size=32), folder)
    return tiles.window(t.spark.read.parquet(folder), (3, 20, 9, 60), "raster_id", size=32)


@query(f"SELECT image_id, point_id, {r('value')} FROM ({bilinear_sql(FRACTIONAL, 'image_id, point_id', 'dem', HEIGHT, '100')})")
def j4_sample_stored_tiles(t: Tables) -> DataFrame:
    """Points read from tiles that were stored before: only points are shuffled."""
    folder = shared_folder(t.spark, "tiles")
    files.write_tiles(tiles.from_cells(t.dem), folder, "image_id")
    points, height = fractional(t)
    return tiles.bilinear(points, t.spark.read.parquet(folder), shape=(height, 100)).select("image_id", "point_id", "value")


SIDE, BLOCK = 8, 4
CROPS = {
    "crop_boxes": "SELECT CAST(s_suppkey AS INTEGER) AS k, UNNEST([1, 2]) AS m, UNNEST([s_suppkey % 4, s_suppkey % 3 + 1]) AS r0, UNNEST([s_suppkey * 7 % 80, s_suppkey * 9 % 88]) AS c0, UNNEST([10, 6]) AS side FROM supplier",
    "layers": "SELECT row, col, layer, value FROM (SELECT p.row, p.col, UNNEST(['image1', 'image2', 'x', 'y', 'h']) AS layer, UNNEST([p.b1, q.b1, 2e0 * p.col + 25e-2 * p.row, -2e0 * p.row, d.value]) AS value FROM pixels p JOIN pixels q ON q.image_id = 1 AND q.row = p.row AND q.col = p.col JOIN dem d ON d.image_id = 0 AND d.row = p.row AND d.col = p.col WHERE p.image_id = 0)",
    "lattice": f"SELECT *, r0 + least(greatest((trow + 5e-1) * side / {SIDE} - 5e-1, 0), side - 1) AS prow, c0 + least(greatest((tcol + 5e-1) * side / {SIDE} - 5e-1, 0), side - 1) AS pcol FROM crop_boxes, (SELECT UNNEST(range({SIDE})) AS trow), (SELECT UNNEST(range({SIDE})) AS tcol)",
    "taps": "SELECT k, m, trow, tcol, least(r0 + side - 1, floor(prow) + i) AS row, least(c0 + side - 1, floor(pcol) + j) AS col, (CASE i WHEN 0 THEN 1 - prow + floor(prow) ELSE prow - floor(prow) END) * (CASE j WHEN 0 THEN 1 - pcol + floor(pcol) ELSE pcol - floor(pcol) END) AS w FROM lattice, (SELECT UNNEST([0, 1]) AS i), (SELECT UNNEST([0, 1]) AS j)",
    "smooth": "SELECT k, m, trow, tcol, layer, sum(w * value) AS value FROM taps JOIN layers USING (row, col) GROUP BY ALL",
    "nearest": f"SELECT k, m, trow, tcol, value FROM lattice l LEFT JOIN residuals v ON v.image_id = l.m - 1 AND v.row = r0 + trow * side // {SIDE} AND v.col = c0 + tcol * side // {SIDE}",
}
_BLOCK = f"CAST(trow // {BLOCK} * {SIDE // BLOCK} + tcol // {BLOCK} AS INTEGER) AS place"


@query(f"""
SELECT k, m, 'image' AS part, CAST(trow * {SIDE} + tcol AS INTEGER) AS place, {r('value')} FROM smooth WHERE layer = 'image' || m
UNION ALL SELECT k, m, layer, {_BLOCK}, {r('avg(value) AS value')} FROM smooth
  WHERE layer IN ('x', 'y', 'h') AND trow % {BLOCK} IN (1, 2) AND tcol % {BLOCK} IN (1, 2) GROUP BY ALL
UNION ALL SELECT k, m, 'residual', {_BLOCK}, {r('coalesce(avg(value), -1) AS value')} FROM nearest GROUP BY ALL
""", CROPS)
def d11_crop_samples(t: Tables) -> DataFrame:
    """Both crops of many windows of one pair: images, objects and residuals, element by element."""
    at = ["row", "col"]
    band = lambda k: t.pixels.filter(F.col("image_id") == k).select(*at, F.col("b1").alias(f"img{k + 1}"))
    residual = lambda k: t.residuals.filter(F.col("image_id") == k).select(*at, F.col("value").alias(f"res{k + 1}"))
    ground = t.dem.filter("image_id = 0").selectExpr(*at, "2D * col + 0.25D * row AS x", "-2D * row AS y", "value AS h")
    cells = band(0).join(band(1), at).join(ground, at).join(residual(0), at).join(residual(1), at).withColumn("pair_id", F.lit(0))
    crops = t.raw("supplier").selectExpr("0 AS pair_id", "CAST(s_suppkey AS INT) AS k", "CAST(s_suppkey % 4 AS INT) AS row1", "CAST(s_suppkey * 7 % 80 AS INT) AS col1", "10 AS side1", "CAST(s_suppkey % 3 + 1 AS INT) AS row2", "CAST(s_suppkey * 9 % 88 AS INT) AS col2", "6 AS side2")
    samples = jobs.crop_samples(cells, crops, SIDE, BLOCK)
    part = lambda name: samples.select("k", "m", F.lit(name).alias("part"), F.posexplode(name).alias("place", "value"))
    return reduce(DataFrame.unionByName, map(part, ("image", "x", "y", "h", "residual")))


@query("SELECT image_id, CAST(75 AS BIGINT) AS n_nodes, true AS equal FROM sensor_models")
def a12_merged_models(t: Tables) -> DataFrame:
    """Models that took their corrections into their polynomials: whether they project as the corrected ones do, to a thousandth of a cell."""
    held = (*sensor.NORMALIZERS, *sensor.DIRECT, *geo.AFFINE)
    merged = fit.merged_models(t.corrected_models, 12, 6).select("image_id", F.struct(*held).alias("__merged"))
    both = sensor.spread_models(t.corrected_models.select("image_id", *held)).join(merged.hint("merge"), "image_id")  # models meet before there are nodes
    nodes = sensor.to_image(sensor.virtual_lattice(both, 5, 3, (*held, "__merged")), line="line0", samp="samp0")
    at = sensor.to_image(nodes.drop(*held).select("*", "__merged.*"))
    off = F.greatest(F.abs(F.col("line") - F.col("line0")), F.abs(F.col("samp") - F.col("samp0")))
    return at.groupBy("image_id").agg(F.count("*").alias("n_nodes"), (F.max(off) < 1e-3).alias("equal"))


# --- from images on ----------------------------------------------------------


def _bilinear_pair(points: str, key: str) -> str:
    one = lambda cells, name: f"SELECT {key}, value AS {name} FROM ({bilinear_sql(points, key, cells, 'height', 'width')})"
    return f"SELECT * FROM ({one('bands', 'image')}) JOIN ({one('dem', 'h')}) USING ({key})"


OVER = PLAIN | {
    "grid_rows": "SELECT CAST(k AS INTEGER) AS grid_id, 12245060e0 + 40 * k AS x0, 3503738e0 AS y0, 12245100e0 + 40 * k AS x1, 3503714e0 AS y1 FROM (SELECT UNNEST(range(3)) AS k)",
    "prints": "SELECT image_id, 12245030e0 AS minx, 3503350e0 AS miny, 12245170e0 + image_id AS maxx, 3503730e0 + 4 * image_id AS maxy FROM sensor_models WHERE image_id < 4",
    "extents": "SELECT image_id, max(row) + 1 AS height, max(col) + 1 AS width FROM pixels GROUP BY image_id",
    "bands": "SELECT image_id, row, col, b1 AS value FROM pixels",
    "parts": "SELECT grid_id, image_id, greatest(x0, minx) AS x0, least(y0, maxy) AS y0, least(x1, maxx) AS x1, greatest(y1, miny) AS y1, (SELECT avg(value) FROM dem d WHERE d.image_id = p.image_id) AS h FROM grid_rows JOIN prints p ON x0 < maxx AND minx < x1 AND y1 < maxy AND miny < y0",
    "corners": f"SELECT grid_id, image_id, k, h, {LAT_SQL.format(y='y')} AS lat, {LON_SQL.format(x='x')} AS lon FROM (SELECT grid_id, image_id, h, UNNEST([0, 1, 2, 3]) AS k, UNNEST([x0, x1, x1, x0]) AS x, UNNEST([y0, y0, y1, y1]) AS y FROM parts)",
    "spots": image_sql("SELECT * FROM corners", "grid_id, image_id, k"),
    "outline": "SELECT grid_id, image_id, " + ", ".join(f"max(CASE WHEN k = {k} THEN samp END) AS x{k}, max(CASE WHEN k = {k} THEN line END) AS y{k}" for k in range(4)) + " FROM spots GROUP BY grid_id, image_id",
    "slant": "SELECT *, x1 - x2 AS dx1, x3 - x2 AS dx2, x0 - x1 + x2 - x3 AS dx3, y1 - y2 AS dy1, y3 - y2 AS dy2, y0 - y1 + y2 - y3 AS dy3 FROM outline",
    "turned": "SELECT *, (dx3 * dy2 - dx2 * dy3) / (dx1 * dy2 - dx2 * dy1) AS h6, (dx1 * dy3 - dx3 * dy1) / (dx1 * dy2 - dx2 * dy1) AS h7 FROM slant",
    "unit": "SELECT *, trow / 7e0 AS v, tcol / 7e0 AS u FROM turned, (SELECT UNNEST(range(8)) AS trow), (SELECT UNNEST(range(8)) AS tcol)",
    "sources": "SELECT grid_id, image_id, trow, tcol, height, width, ((x1 - x0 + h6 * x1) * u + (x3 - x0 + h7 * x3) * v + x0) / (h6 * u + h7 * v + 1) AS pcol, ((y1 - y0 + h6 * y1) * u + (y3 - y0 + h7 * y3) * v + y0) / (h6 * u + h7 * v + 1) AS prow FROM unit JOIN extents USING (image_id)",
    "looked": f"SELECT * FROM sources JOIN ({_bilinear_pair('SELECT * FROM sources', 'grid_id, image_id, trow, tcol')}) USING (grid_id, image_id, trow, tcol) WHERE prow BETWEEN 0 AND height - 1 AND pcol BETWEEN 0 AND width - 1",
}


def _over(t: Tables) -> dict[str, DataFrame]:
    """Three grids over the images that have pixels."""
    grids = t.spark.range(3).selectExpr("CAST(id AS INT) AS grid_id", "12245060D + 40 * id AS x0", "3503738D AS y0", "12245100D + 40 * id AS x1", "3503714D AS y1")
    grids = grids.selectExpr("*", "array(20D, (x0 + x1) / 2) AS cx", "array(12D, (y0 + y1) / 2) AS cy", "array(20D, 220D) AS ch")
    prints = t.sensor_models.filter("image_id < 4").selectExpr("image_id", "12245030D AS minx", "3503350D AS miny", "12245170D + image_id AS maxx", "3503730D + 4 * image_id AS maxy")
    return {"pixels": t.pixels.withColumnRenamed("b1", "value"), "dem": t.dem, "models": t.sensor_models, "grids": grids, "footprints": prints}


@query(f"SELECT grid_id, image_id, CAST(trow // 4 AS INTEGER) AS i, CAST(tcol // 4 AS INTEGER) AS j, {r('avg(image) AS value', 'avg(h) AS h', 'avg(prow) AS line', 'avg(pcol) AS samp')} FROM looked GROUP BY grid_id, image_id, trow // 4, tcol // 4 HAVING count(*) = 16", OVER)
def d3_image_patches(t: Tables) -> DataFrame:
    """What a grid's predictor reads of each image: its part of the image, resampled and cut."""
    return jobs.image_patches(**_over(t), shape=(8, 8), size=4)


def place_predictor(pdf: pd.DataFrame) -> pd.DataFrame:
    """Stands for trained networks: normalized ground values from the place in the grid's part."""
    return pd.DataFrame({"x": (pdf["j"] - 0.5) / 2, "y": (0.5 - pdf["i"]) / 2, "h": (pdf["height"] - 220.0) / 20.0, "conf": 0.9})


@query()
def d3_adjust_from_images(t: Tables) -> DataFrame:
    """The whole job with several grids, from pixels to the images' affine corrections."""
    adjusted = jobs.adjust_from_images(**_over(t), predictor=place_predictor, shape=(8, 8), size=4, conf_thr=0.5)
    return adjusted.select("image_id", *geo.AFFINE)


def mean_predictor(pdf: pd.DataFrame) -> pd.DataFrame:
    """Stands for trained networks in tests: normalized ground values from the place and the mean feature."""
    first = pdf["feature"].map(lambda v: v[0])
    return pd.DataFrame({"x": pdf["samp"] / 400.0 + first / 1000.0, "y": -pdf["line"] / 320.0, "h": pdf["conf"]})


NEAR = PLAIN | {
    "places": "SELECT t.image_id, point_id, CAST(line AS DOUBLE) AS line, CAST(samp AS DOUBLE) AS samp FROM tie_points t WHERE image_id > 0",
    "near": "SELECT t.*, p.conf, CAST(p.feature[1] AS DOUBLE) AS first, pow(t.line - p.line, 2) + pow(t.samp - p.samp, 2) AS d, row_number() OVER (PARTITION BY t.image_id, point_id ORDER BY pow(t.line - p.line, 2) + pow(t.samp - p.samp, 2), patch_id) AS n FROM places t JOIN patches p ON p.image_id = t.image_id AND pow(t.line - p.line, 2) + pow(t.samp - p.samp, 2) < 40000",
    "means": "SELECT image_id, point_id, line, samp, sum(conf / (d + 1e-6)) / sum(1 / (d + 1e-6)) AS conf, sum(first / (d + 1e-6)) / sum(1 / (d + 1e-6)) AS first FROM near WHERE n <= 4 GROUP BY image_id, point_id, line, samp HAVING count(*) = 4",
    "crossed": "SELECT m.*, o.image_id AS other FROM means m JOIN (SELECT DISTINCT image_id FROM patches) o ON o.image_id <> m.image_id WHERE conf > 0.3",
    "thrown": f"SELECT *, {LAT_SQL.format(y='y')} AS lat, {LON_SQL.format(x='x')} AS lon FROM (SELECT image_id, point_id, other, conf, line AS l_line, samp AS l_samp, (samp / 400e0 + first / 1000e0) * 800 + 12245000 + other AS x, (-line / 320e0) * 640 + 3503000 AS y, conf * 40 + 200 AS h FROM crossed)",
}


@query(f"SELECT image_id, point_id, other, {r('conf', 'l_line', 'l_samp', 'round(line, 2) AS t_line', 'round(samp, 2) AS t_samp')} FROM ({image_sql('SELECT * FROM thrown', 'image_id, point_id, other, conf, l_line, l_samp')})", NEAR)
def j14_element_correspondences(t: Tables) -> DataFrame:
    """Positions of each element by their nearest patches, predicted by every other element of the grid."""
    positions = t.tie_points.filter("image_id > 0").selectExpr("0 AS grid_id", "image_id", "point_id AS query_id", "CAST(line AS DOUBLE) AS line", "CAST(samp AS DOUBLE) AS samp")
    elements = t.patches.select("image_id").distinct().selectExpr("image_id", "array(800D, 12245000D + image_id) AS cx", "array(640D, 3503000D) AS cy", "array(40D, 200D) AS ch")
    corr = jobs.element_correspondences(positions, t.patches.withColumn("grid_id", F.lit(0)), elements, mean_predictor, t.sensor_models, limit=40000.0, margin=-1.0, conf_thr=0.3)
    return corr.select("image_id", F.col("query_id").alias("point_id"), "other", "conf", "l_line", "l_samp", F.round("t_line", 2).alias("t_line"), F.round("t_samp", 2).alias("t_samp"))


TARGETS = "SELECT image_id, point_id, line * 13e-1 - 2e0 AS prow, samp * 12e-1 - 5e0 AS pcol FROM tie_points"


@query(f"SELECT p.image_id, p.point_id, {r('CASE WHEN prow BETWEEN 0 AND h - 1 AND pcol BETWEEN 0 AND 99 THEN value ELSE 0 END AS value')} FROM (SELECT *, {HEIGHT} AS h FROM ({TARGETS})) p LEFT JOIN ({bilinear_sql(TARGETS, 'image_id, point_id', 'dem', HEIGHT, '100')}) v USING (image_id, point_id)")
def j17_gather(t: Tables) -> DataFrame:
    height = t.dem.agg(F.max("row") + 1).first()[0]
    targets = t.tie_points.selectExpr("image_id", "point_id", "line * 1.3D - 2 AS row", "samp * 1.2D - 5 AS col")
    return raster.gather(targets, t.dem, shape=(height, 100)).select("image_id", "point_id", "value")


@query(f"SELECT image_id, {r(*(f'(a.{c} + b.{c}) / 2 AS {c}' for c in geo.AFFINE))} FROM corrected_models a JOIN sensor_models b USING (image_id)")
def a16_average_transforms(t: Tables) -> DataFrame:
    return fit.average_transforms(t.corrected_models, t.sensor_models)
