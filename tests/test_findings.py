"""What a reviewer's findings broke: joins and lists that grow with the input in one place."""

import duckdb
import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from geoframe.operators import fit, metrics, neighbors, raster, sensor, tiles
from geoframe.plans import jobs
from geoframe.queries import catalog, catalog_files, catalog_more
from geoframe.sources import files
from tests.test_geometry import model_rows, models_df, np_project


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_round_trip_joins_no_models(spark):
    """models were sent to the driver twice, to be joined to nodes that were made of them."""
    report = sensor.round_trip(fit.inverse_models(models_df(spark, model_rows(2, 0.7)), 6, 4), 4, 4)
    assert report.filter("max_error < 0.5").count() == 2
    models = spark.range(2).select(F.col("id").cast("int").alias("image_id"), *(F.lit(1.0).alias(c) for c in (*sensor.NORMALIZERS, *fit.geo.AFFINE)), *(F.array(*[F.lit(1.0)] * 20).alias(c) for c in (*sensor.DIRECT, *sensor.INVERSE)))
    assert "Join" not in plan(sensor.round_trip(models, 4, 4))


def test_fits_make_no_rows_of_nodes(spark):
    """an image's normal equations were 1560 rows a batch, shuffled and listed again; now an image is a row."""
    models = models_df(spark, model_rows(3, 0.7))
    fitted = fit._ratios(models, 6, 4, ("lat", "lon", "h"), ("line", "samp"), sensor.DIRECT, False, 1e-6, 1000)
    assert "Generate" not in plan(fitted) and "Aggregate" not in plan(fitted)
    assert fitted.count() == 3


def test_filters_do_not_repeat_projections(spark):
    """a filter on a projected place was moved below the projection, with all of its polynomials written out for each condition."""
    models = models_df(spark, model_rows(1))
    points = spark.createDataFrame([(0, 1.0, 2.0, 220.0)], "image_id int, line double, samp double, h double")
    ground = sensor.image_to_object(points, models)
    text = plan(ground.filter("lat + lon > 0 AND lat - lon < 1000 AND lat * lon > 0"))
    assert text.count("latnum#") < 200, text.count("latnum#")


def test_boxes_end_with_their_raster(spark):
    """a box far larger than its raster was dealt to all tiles that it would touch, a trillion here."""
    dem = spark.range(40).selectExpr("CAST(id % 2 AS INT) AS image_id", "CAST(id div 4 AS INT) AS row", "CAST(id div 2 % 2 AS INT) AS col", "CAST(id AS DOUBLE) AS value")
    boxes = spark.createDataFrame([(0, 3, 0, 2**27, 2**27), (1, 5, 1, 7, 9), (7, 0, 0, 2**27, 2**27)], "image_id int, row0 int, col0 int, row1 int, col1 int")
    got = tiles.cells_in(tiles.from_cells(dem), boxes)
    want = dem.filter("image_id = 0 AND row >= 3 OR image_id = 1 AND row IN (5, 6) AND col = 1")
    assert sorted(map(tuple, got.select("image_id", "row", "col", "value").collect())) == sorted(map(tuple, want.collect()))


def test_points_are_never_broadcast(spark):
    """points made of few rows were taken for few, and sent to the driver."""
    cells = spark.range(1 << 20).selectExpr("0 AS image_id", "CAST(id div 1024 AS INT) AS row", "CAST(id % 1024 AS INT) AS col", "1D AS value")
    points = spark.createDataFrame([(0, 100.5)], "image_id int, row double").selectExpr("*", "explode(sequence(0, 999)) AS c").selectExpr("image_id", "row", "CAST(c AS DOUBLE) AS col")
    made = raster.sample_bilinear(points, cells, shape=(1024, 1024))
    assert "LeftOuter" in plan(made)
    assert made.filter("value = 1").count() == 1000


def test_large_groups_stay_where_they_are(spark):
    """rows of few groups went to one task a group, to meet a row of statistics."""
    pixels = spark.range(1000).selectExpr("CAST(id % 2 AS INT) AS image_id", "CAST(id AS DOUBLE) AS b1")
    scaled = raster.minmax_scale(pixels, ["b1"], "image_id")
    assert "strategy=broadcast" in plan(scaled)
    assert scaled.agg(F.min("b1"), F.max("b1")).first() == (0.0, 1.0)


def test_least_rows_are_sorted_alone(spark):
    """F16: all rows were sorted for the least n; now those that a bound leaves, ties and nulls included."""
    rows = spark.range(40_000).selectExpr("CAST(id % 2 AS INT) AS g", "IF(id < 6, NULL, CAST(id * 7919 % 500 AS DOUBLE)) AS v", "id")
    left = metrics._lowest_part(rows, "g", "v", 50)
    assert 100 <= left.count() < 4000
    n = Window.partitionBy("g").orderBy("v", "id")
    want = rows.withColumn("position", F.row_number().over(n) - 1).filter("position < 50").select("g", "position", "id")
    got = metrics.lowest_n_cyclic(rows, "g", ["v", "id"], 50).select("g", "position", "id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_geoid_of_the_sql_is_square(spark, tmp_path):
    """beyond its 20th row the geoid's table goes on, while the queries' SQL repeats the edge of 20 x 20 cells."""
    orders = spark.range(60_000, 60_300).select(F.col("id").alias("o_orderkey"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(25).select(F.col("id").alias("n_nationkey")).write.parquet(f"{tmp_path}/nation.parquet")
    db = duckdb.connect()
    for name in ("orders", "nation"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = catalog.QUERIES["j13_add_regridded"](spark, str(tmp_path))
    want = db.execute(catalog.SQL["j13_add_regridded"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_features_are_read_for_the_nearest_only(spark):
    """F8: every patch near a position was sorted with its features, for each position anew; now places are told apart once, and their k nearest fetch features."""
    patches = spark.range(30).selectExpr("id AS patch_id", "CAST(id AS DOUBLE) AS line", "0D AS samp", "1D AS conf", "array(CAST(id AS DOUBLE)) AS feature")
    queries = spark.range(6).selectExpr("id AS query_id", "CAST(id % 2 AS DOUBLE) AS line", "0D AS samp")
    got = neighbors.knn_idw(queries, patches, 2, 100.0, values=("conf",), arrays=("feature",))
    windows = [x for x in plan(got).splitlines() if "Window [" in x]
    assert windows and not any("feature" in x.split("], [")[0] for x in windows) and "query_id" not in "".join(windows)
    rows = {r["query_id"]: r["feature"][0] for r in got.collect()}
    assert len(rows) == 6 and rows[0] == rows[2] == rows[4] and abs(rows[1] - 1) < 1e-5


def test_patches_stay_where_they_are(spark, monkeypatch):
    """patches, with their features, went to one task a grid to meet its images, and to one an image to meet margins and models."""
    patches = spark.range(400).selectExpr("id AS patch_id", "CAST(id % 2 AS INT) AS grid_id", "CAST(id % 4 div 2 AS INT) AS image_id", "CAST(id * 7 % 150 AS DOUBLE) AS line", "CAST(id * 13 % 100 AS DOUBLE) AS samp", "1D AS conf", "220D AS h", "0D AS x", "0D AS y", "array(1D) AS feature")
    grids = spark.range(2).selectExpr("CAST(id AS INT) AS grid_id", "array(800D, 12245000D) AS cx", "array(640D, 3503000D) AS cy", "array(40D, 200D) AS ch")
    seen, fitted = [], jobs.fit.robust_affine
    monkeypatch.setattr(jobs.fit, "robust_affine", lambda corr, *a, **k: seen.append(corr) or fitted(corr, *a, **k))
    _, placed = jobs.adjust_elements(patches, grids, catalog_more.linear_predictor, models_df(spark, model_rows(2, 0.7)))
    (corr,) = seen
    assert plan(corr).count("strategy=broadcast") == 3 and "feature" not in corr.columns
    assert plan(placed).count("strategy=broadcast") == 1
    rows, inside = patches.collect(), 0
    for r in rows:
        spans = [[x[a] for x in rows if x.image_id == r.image_id] for a in ("line", "samp")]
        inside += all(min(v) + 0.1 * (max(v) - min(v)) < r[a] < max(v) - 0.1 * (max(v) - min(v)) for a, v in zip(("line", "samp"), spans, strict=True))
    assert 100 < corr.count() == inside and placed.count() == 400


def test_model_files_are_written_by_all_tasks(spark, tmp_path, monkeypatch):
    """a file a model was written by the tasks that read the table, one here, and inverse models were fitted that nobody asked for."""
    spark.range(40).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    monkeypatch.setattr(catalog_files, "shared_folder", lambda _, name: f"{tmp_path}/{name}")
    monkeypatch.setattr(files.fit, "inverse_models", lambda *_: 1 / 0)
    got = catalog.QUERIES["s2_model_files"](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(db.execute(catalog.SQL["s2_model_files"]).fetchall())
    catalog.QUERIES["s1_s3_model_files"](spark, str(tmp_path))
    for folder in ("rpb", "models"):
        names = [p.name for p in (tmp_path / folder).glob("image_id=*/part-*")]
        assert len(names) == 40 and len({name.split("-")[1] for name in names}) > 1


def _plain_ortho(model, dem, pix, resolution):
    """jobs.orthorectify() of one image, cell by cell; NaN in dem is unknown."""
    height, width = pix.shape
    corners = [np_project_place(model, (height - 1) * r, (width - 1) * s, h) for r, s, h in ((0, 0, np.nanmin(dem)), (0, 1, np.nanmin(dem)), (1, 0, np.nanmax(dem)), (1, 1, np.nanmax(dem)))]
    (lat0, lon0), (lat1, lon1) = np.min(corners, axis=0), np.max(corners, axis=0)
    dlat, dlon = resolution / 111320.0, resolution / (40075000.0 * np.cos(np.radians((lat1 + lat0) / 2)) / 360.0)

    def read(a, row, col):
        r, c, parts = int(np.floor(row)), int(np.floor(col)), []
        for i, v in ((0, 1 - (row - r)), (1, row - r)):
            for j, w in ((0, 1 - (col - c)), (1, col - c)):
                x = a[min(r + i, height - 1), min(c + j, width - 1)]
                parts += [v * w * x] if v * w and not np.isnan(x) else []
        return sum(parts) if parts else None

    out = {}
    for trow in range(int(np.ceil((lat1 - lat0) / dlat))):
        for tcol in range(int(np.ceil((lon1 - lon0) / dlon))):
            lat, lon = lat1 - trow * dlat, lon0 + tcol * dlon
            row, col = (height - 1) * (lat1 - lat) / (lat1 - lat0), (width - 1) * (lon - lon0) / (lon1 - lon0)
            h = read(dem, row, col) if row <= height - 1 and col <= width - 1 else np.nanmin(dem)
            out[trow, tcol] = (lat, lon, 0)
            if h is not None:
                plh = [(v - model[f"{n}_off"]) / model[f"{n}_scale"] for n, v in (("lat", lat), ("lon", lon), ("h", h))]
                raw = [np_project(model, f"{u[0]}num", f"{u[0]}den", *plh) * model[f"{u}_scale"] + model[f"{u}_off"] for u in ("line", "samp")]
                y, x = np.linalg.solve([[model["a00"], model["a01"]], [model["a10"], model["a11"]]], [raw[0] - model["a02"], raw[1] - model["a12"]])
                out[trow, tcol] = (lat, lon, int(read(pix, y, x)) if 0 <= y <= height - 1 and 0 <= x <= width - 1 else 0)
    return out


def np_project_place(model, line, samp, h):
    """The ground under a place of an image whose inverse arrays are linear."""
    at = [model["a00"] * line + model["a01"] * samp + model["a02"], model["a10"] * line + model["a11"] * samp + model["a12"], h]
    l, p, h = ((v - model[f"{n}_off"]) / model[f"{n}_scale"] for n, v in zip(("line", "samp", "h"), at, strict=True))  # noqa: E741
    return [np_project(model, f"{n}num", f"{n}den", p, l, h) * model[f"{n}_scale"] + model[f"{n}_off"] for n in ("lat", "lon")]


def test_cells_off_the_image_are_not_shuffled(spark, monkeypatch):
    """all cells of the box of a strip that lies askew were shuffled, to meet its heights and again its cells, though most lie beyond it."""
    models = model_rows(2, 0.3)
    for m in models:  # a strip that goes eight tenths of a line to the side with each line
        m["latnum"][1], m["lonnum"][1], m["lonnum"][2], m["snum"][2] = -1.0, 0.8, 1.0, 0.8
    rng = np.random.default_rng(5)
    shapes = {0: (300, 140), 1: (260, 1)}  # three by two tiles, and one column
    dem, pix = ({k: rng.uniform(low, low + 60, shape) for k, shape in shapes.items()} for low in (200, 5))
    dem[0][rng.random(shapes[0]) < 0.1] = np.nan  # unknown
    dem[0][40:60, 20:50] = np.nan
    dem[0][128:257, 128:] = np.nan  # a tile that is missing, with its halo
    rows = lambda tables, holes: [(k, r, c, None if np.isnan(v) else float(v)) for k, a in tables.items() for (r, c), v in np.ndenumerate(a) if not (holes and k == 0 and (c >= 128 and 128 <= r < 257 or r % 50 == 7))]
    dem[0][7::50] = np.nan  # lines that are left out
    schema = "image_id int, row int, col int, value double"
    seen, gathered = [], jobs.raster.gather
    monkeypatch.setattr(jobs.raster, "gather", lambda targets, *a, **k: seen.append(targets) or gathered(targets, *a, **k))
    for at_once in (1 << 16, 100):
        monkeypatch.setattr(jobs, "_AT_ONCE", at_once, raising=False)
        made = jobs.orthorectify(spark.createDataFrame(rows(pix, False), schema), spark.createDataFrame(rows(dem, True), schema), models_df(spark, models), 9.0)
        got = {k: {} for k in shapes}
        for r in made.collect():
            assert (r.row, r.col) not in got[r.image_id]
            got[r.image_id][r.row, r.col] = (r.lat, r.lon, r.value)
        for k in shapes:
            want = _plain_ortho(models[k], dem[k], pix[k], 9.0)
            assert sorted(got[k]) == sorted(want)
            for at, (lat, lon, value) in want.items():
                assert abs(got[k][at][0] - lat) < 1e-9 and abs(got[k][at][1] - lon) < 1e-9 and got[k][at][2] == value, (k, at)
        assert 500 < sum(v[2] > 0 for v in got[0].values())
        targets = seen[-1].count()
        assert targets < 0.6 * sum(map(len, got.values())), (targets, [len(v) for v in got.values()])
