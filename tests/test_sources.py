import numpy as np
import pytest
from pyspark.sql import functions as F

from geoframe.functions import geo
from geoframe.operators import fit, raster, sensor, tiles
from geoframe.sources import files
from tests.test_geometry import cells, model_rows, models_df


def test_model_files_round_trip(spark, tmp_path):
    fitted = fit.inverse_models(models_df(spark, model_rows(3, 0.7)), 8, 5)
    models = spark.createDataFrame(fitted.collect(), fitted.schema)  # fitted once: sums in another order give other, equally good, coefficients
    files.write_sensor_models(models, str(tmp_path / "m"))
    back = files.read_sensor_models(spark, str(tmp_path / "m"))
    got = {r.image_id: r for r in back.collect()}
    assert len(got) == 3
    for r in models.collect():
        other = got[r.image_id]
        for c in (*sensor.NORMALIZERS, *geo.AFFINE):
            assert other[c] == pytest.approx(r[c], abs=1e-12)
        for c in (*sensor.DIRECT, *sensor.INVERSE):
            assert other[c] == pytest.approx(r[c], abs=1e-15)
    texts = [r.value for r in spark.read.text(str(tmp_path / "m"), wholetext=True).collect()]
    assert sum(files.CORRECTION in t for t in texts) == 2  # the identity is not written


def test_models_without_inverse_are_fitted(spark, tmp_path):
    m = model_rows(1)[0]
    lines = [f"{label}: {m[c]!r} {unit}" for label, c, unit in zip(files.LABELS, files.ORDER, files.UNITS)]
    for label, c in zip(files.ARRAY_LABELS[:4], sensor.DIRECT):
        lines += [f"{label}_{k + 1}: {v!r}" for k, v in enumerate(m[c])]
    (tmp_path / "a.rpc").write_text("\r\n".join(lines))
    got = files.read_sensor_models(spark, str(tmp_path))
    assert sensor.round_trip(got, 5, 5, 3).first()["max_error"] < 0.05


def test_rpb_layout(spark, tmp_path):
    m = model_rows(1)[0]
    body = "".join(f"\t{n} = {m[c]!r};\n" for n, c in zip(files.RPB_NAMES, files.ORDER))
    body += "".join(f"\t{n} = (\n" + ",\n".join(f"\t\t{v!r}" for v in m[c]) + ");\n" for c, n in files.RPB_ARRAYS.items())
    (tmp_path / "a.rpb").write_text("BEGIN_GROUP = IMAGE\n" + body + "END_GROUP = IMAGE\n")
    r = files.read_sensor_models(spark, str(tmp_path), "rpb").first()
    assert [r[c] for c in files.ORDER] == [m[c] for c in files.ORDER]
    assert all(r[c] == m[c] for c in sensor.DIRECT) and len(r.latnum) == 20


def test_tie_point_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/b.txt").write_text("3 4\n")
    (tmp_path / "t/a.txt").write_text("1 2\n10  20\n")
    got = sorted(map(tuple, files.read_tie_points(spark, str(tmp_path / "t")).collect()))
    assert got == [(0, 0, 1, 2), (0, 1, 10, 20), (1, 0, 3, 4)]
    (tmp_path / "c").mkdir()
    (tmp_path / "c/a.txt").write_text("1,2\nhead\n3,4,5\n6, 7\n")
    commas = files.read_tie_points(spark, str(tmp_path / "c"), ",")
    assert sorted(map(tuple, commas.collect())) == [(0, 0, 1, 2), (0, 3, 6, 7)]
    files.write_tie_points(commas, str(tmp_path / "out"), " ")
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["1 2", "6 7"]
    files.write_tie_points(commas, str(tmp_path / "out"), " ", "append")
    assert spark.read.text(str(tmp_path / "out")).count() == 4
    scenes = spark.createDataFrame([(0,), (1,)], "image_id int")
    with pytest.raises(Exception, match="image without tie points: 1"):
        files.validate_tie_points(commas, scenes).count()
    assert files.validate_tie_points(commas, scenes.filter("image_id = 0")).count() == 2


def test_catalog(spark, tmp_path):
    for n in ("x_rpc_PAN.txt", "x_MSS.txt", "y_rpc_PAN.dat"):
        (tmp_path / n).write_text("1")
    got = files.scan_catalog(spark, str(tmp_path), "*.txt", ("rpc", "PAN")).collect()
    assert [(r.name, r.id, r.length) for r in got] == [("x_rpc_PAN.txt", "x_rpc_PAN", 1)]


def _stored(spark, cut, folder):
    files.write_tiles(cut, folder)
    return spark.read.parquet(folder)


def test_npy_rasters_and_stored_tiles(spark, tmp_path):
    a = np.arange(70.0).reshape(7, 10)
    a[3, 4] = np.nan
    np.save(tmp_path / "h.npy", a)
    np.save(tmp_path / "turned.npy", np.asfortranarray(a.astype(np.float32)))
    cut = files.ingest_npy_rasters(spark, str(tmp_path), 4)
    assert cut.count() == 12
    for size, window in ((4, cut), (4, _stored(spark, cut, str(tmp_path / "tiles")))):
        got = tiles.window(window, (0, 0, 7, 10), "raster_id", size=size)
        assert got.count() == 140
        for r in got.collect():
            assert r.value is None if np.isnan(a[r.row, r.col]) else r.value == a[r.row, r.col]
    meta = spark.createDataFrame([("h", 1.0)], "raster_id string, a double")
    files.write_raster(got.filter("raster_id = 'h'"), meta, str(tmp_path / "out"))
    stored = spark.read.parquet(str(tmp_path / "out/cells"))
    assert stored.count() == 70 and raster.read_window(stored, (2, 3, 4, 6)).count() == 6


def test_grids_and_pairs(spark, tmp_path):
    grids = spark.createDataFrame([(0, [1.0, 2.0])], "grid_id int, cx array<double>")
    files.save_grids(grids, str(tmp_path / "g"))
    assert files.load_grids(spark, str(tmp_path / "g")).collect() == grids.collect()
    pairs = spark.createDataFrame([("train", 1), ("train", 2), ("test", 3)], "split string, pair_id int")
    pairs.write.partitionBy("split").parquet(str(tmp_path / "p"))
    assert files.read_pairs(spark, str(tmp_path / "p"), "train").count() == 2
    assert files.read_pairs(spark, str(tmp_path / "p"), "train", spark.createDataFrame([(2,), (3,)], "pair_id int")).count() == 1


def test_logs_append(spark, tmp_path):
    from geoframe.operators import metrics

    row = spark.createDataFrame([(1, 0.5)], "num_blocks int, median double")
    for _ in range(2):
        metrics.append_log(row, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_scenes_with_missing_parts(spark):
    a = np.zeros((3, 4))
    folder = lambda df, n: df.withColumn("folder", F.lit(n))
    both = folder(cells(spark, a), "b").unionByName(folder(cells(spark, a), "a"))
    models = spark.createDataFrame([("a",), ("b",), ("c",)], "folder string")
    tie = spark.createDataFrame([("b", 1)], "folder string, point_id int")
    got = files.assemble_scenes(both, both, models, tie, 2).orderBy("image_id").collect()
    assert [(r.folder, r.height, r.width, r.n_tie) for r in got] == [("a", 2, 2, 0), ("b", 2, 2, 1)]
