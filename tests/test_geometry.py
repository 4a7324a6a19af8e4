"""Operators that SQL cannot say, properties and edge cases, against NumPy."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoframe.functions import geo
from geoframe.operators import fit, metrics, neighbors, overlap, raster, sensor, tiling
from geoframe.plans import jobs


def model_rows(n=2, shift=0.0):
    """Models with mild random distortions; the inverse arrays are placeholders."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(n):
        arrays = {c: [0.0] * 20 for c in (*sensor.DIRECT, *sensor.INVERSE)}
        arrays["lnum"][2], arrays["lnum"][1], arrays["lnum"][3] = -1.0, 0.02, 0.01
        arrays["snum"][1], arrays["snum"][2], arrays["snum"][3] = 1.0, 0.02, -0.01
        for c in ("lden", "sden", "latden", "londen"):
            arrays[c][0] = 1.0
        for c in ("lnum", "snum"):
            for j in range(4, 11):
                arrays[c][j] = float(rng.normal() * 1e-4)
        norm = {"line_off": 75.0, "samp_off": 50.0, "lat_off": 30.0, "lon_off": 110.0, "h_off": 220.0, "line_scale": 75.0, "samp_scale": 50.0, "lat_scale": 0.0015, "lon_scale": 0.001, "h_scale": 50.0}
        affine = geo.IDENTITY | {"a02": shift * k, "a01": 0.001 * k * bool(shift)}
        rows.append({"image_id": k, **norm, **arrays, **affine})
    return rows


def models_df(spark, rows):
    fields = ", ".join(["image_id int", *(f"{c} double" for c in sensor.NORMALIZERS), *(f"{c} array<double>" for c in (*sensor.DIRECT, *sensor.INVERSE)), *(f"{c} double" for c in geo.AFFINE)])
    names = [x.split()[0] for x in fields.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rows], fields)


def np_project(m, num, den, p, l, h):
    t = np.array([p**a * l**b * h**c for a, b, c in sensor.POWERS])
    return np.dot(m[num], t) / np.dot(m[den], t)


def test_object_to_image_is_the_formula(spark):
    rows = model_rows(2, 0.7)
    points = [(k, j, 30.0 + 0.0003 * j, 110.0 - 0.0002 * j, 210.0 + j) for k in range(2) for j in range(4)]
    df = spark.createDataFrame(points, "image_id int, j int, lat double, lon double, h double")
    got = {(r.image_id, r.j): (r.line, r.samp) for r in sensor.object_to_image(df, models_df(spark, rows)).collect()}
    for k, j, lat, lon, h in points:
        m = rows[k]
        p, l, q = (lat - 30) / 0.0015, (lon - 110) / 0.001, (h - 220) / 50
        raw = np.array([np_project(m, "lnum", "lden", p, l, q) * 75 + 75, np_project(m, "snum", "sden", p, l, q) * 50 + 50])
        a = np.array([[m["a00"], m["a01"]], [m["a10"], m["a11"]]])
        want = np.linalg.solve(a, raw - [m["a02"], m["a12"]])
        assert got[k, j] == pytest.approx(tuple(want), abs=1e-9)


def test_inverse_models_undo_direct_ones(spark):
    models = fit.inverse_models(models_df(spark, model_rows(2, 0.7)), 10, 6)
    report = sensor.round_trip(models, 6, 6, 3).collect()
    assert len(report) == 2 and all(r.max_error < 0.05 and r.n_over == 0 for r in report)


def test_uncertainty_equals_finite_differences(spark):
    models = models_df(spark, model_rows(1))
    x, y = (geo.MERCATOR_RADIUS * math.radians(110.0002), geo.MERCATOR_RADIUS * math.log(math.tan(math.pi / 4 + math.radians(30.0003) / 2)))
    eps = (0.5, 0.5, 0.5)
    moves = [(0, 0, 0)] + [tuple(s * eps[a] * (k == a) for k in range(3)) for a in range(3) for s in (1, -1)]
    pts = spark.createDataFrame([(0, n, x + m[0], y + m[1], 225.0 + m[2], 0.5, 0.7, 2.0) for n, m in enumerate(moves)], "image_id int, n int, x double, y double, h double, sx double, sy double, sh double")
    got = {r.n: r for r in sensor.propagate_uncertainty(pts, models).collect()}
    plain = {r.n: r for r in sensor.mercator_to_image(pts, models).collect()}
    assert got[0].line == pytest.approx(plain[0].line)
    for axis, var in (("line", got[0].var_line), ("samp", got[0].var_samp)):
        slopes = [(plain[1 + 2 * a][axis] - plain[2 + 2 * a][axis]) / (2 * eps[a]) for a in range(3)]
        assert var == pytest.approx(sum((s * d) ** 2 for s, d in zip(slopes, (0.5, 0.7, 2.0))), rel=1e-4)


def test_mercator_round_trip(spark):
    df = spark.createDataFrame([(lat, lon) for lat in (-70.0, 0.0, 45.5) for lon in (-179.0, 0.0, 12.25)], "lat double, lon double")
    for r in geo.from_mercator(geo.to_mercator(df).withColumnsRenamed({"lat": "lat0", "lon": "lon0"})).collect():
        assert (r.lat, r.lon) == pytest.approx((r.lat0, r.lon0), abs=1e-9)


def cells(spark, a, key="image_id", k=0):
    rows = [(k, r, c, None if np.isnan(a[r, c]) else float(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1])]
    return spark.createDataFrame(rows, f"{key} int, row int, col int, value double")


def grid_of(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.row, r.col] = np.nan if r.value is None else r.value
    return out


def test_gaussian_decimate(spark):
    a = np.random.default_rng(1).normal(size=(12, 8))
    reach = 4
    w = np.exp(-0.5 * np.arange(-reach, reach + 1) ** 2.0)
    w /= w.sum()
    wide = np.pad(a, reach, mode="symmetric")
    rows = sum(w[k] * wide[k : k + 12, :] for k in range(9))
    want = sum(w[k] * rows[:, k : k + 8] for k in range(9))[::2, ::2]
    assert np.allclose(grid_of(raster.gaussian_decimate(cells(spark, a), 2, (12, 8)), (6, 4)), want)


def test_resize_by_three_reads_middle_cells(spark):
    a = np.arange(54, dtype=float).reshape(6, 9)
    assert np.allclose(grid_of(raster.resize(cells(spark, a), 3, "bilinear", (6, 9)), (2, 3)), a[1::3, 1::3])


def test_nan_blocks_and_partial_blocks(spark):
    a = np.array([[1.0, np.nan, 5.0], [3.0, np.nan, 7.0], [np.nan, np.nan, 9.0]])
    assert {(r.row, r.col): r.value for r in raster.block_nan(cells(spark, a), 2).collect()} == {(0, 0): 2.0}
    padded = {(r.row, r.col): r.value for r in raster.block_nan_padded(cells(spark, a), 2).collect()}
    assert padded == {(0, 0): 2.0, (0, 1): 6.0, (1, 0): -1.0, (1, 1): 9.0}
    assert raster.block_mean(cells(spark, a[:1]), 2).count() == 0


def test_bilinear_edges_and_fill(spark):
    a = np.array([[0.0, 10.0], [20.0, 30.0]])
    pts = spark.createDataFrame([(0, 1, -0.5, 0.5), (0, 2, 0.5, 0.5), (0, 3, 5.0, 5.0), (0, 4, 1.0, 1.0)], "image_id int, p int, row double, col double")
    clamped = {r.p: r.value for r in raster.sample_bilinear(pts, cells(spark, a), shape=(2, 2)).collect()}
    assert clamped == pytest.approx({1: 5.0, 2: 15.0, 3: 30.0, 4: 30.0})
    filled = {r.p: r.value for r in raster.gather(pts, cells(spark, a), shape=(2, 2)).collect()}
    assert filled == pytest.approx({1: 0.0, 2: 15.0, 3: 0.0, 4: 30.0})


def test_cell_just_outside_counts_as_zero(spark):
    meta = spark.createDataFrame([("d", 1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 4, 4, None)], "raster_id string, a double, b double, c double, d double, e double, f double, width int, height int, nodata double")
    pts = spark.createDataFrame([("d", -0.5, 0.5), ("d", -1.5, -1.5), ("d", 3.9, -3.9)], "raster_id string, x double, y double")
    assert [(r.row, r.col) for r in raster.world_to_cell(pts, meta).orderBy("x").collect()] == [(1, -1), (0, 0), (3, 3)]
    assert raster.inside_raster(raster.world_to_cell(pts, meta), meta).count() == 2


def test_all_nodata_raster(spark):
    meta = spark.createDataFrame([("d", 1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 2, 2, -9.0)], "raster_id string, a double, b double, c double, d double, e double, f double, width int, height int, nodata double")
    dem = spark.createDataFrame([("d", r, c, -9.0) for r in range(2) for c in range(2)], "raster_id string, row int, col int, value double")
    assert raster.sample_nearest(spark.createDataFrame([("d", 0.5, -0.5)], "raster_id string, x double, y double"), dem, meta).count() == 0
    assert raster.stats(raster.mask_nodata(dem, meta), "raster_id").first()["mean"] is None


def boxes(spark, rows):
    return spark.createDataFrame(rows, "image_id int, minx double, miny double, maxx double, maxy double")


def test_touching_boxes(spark):
    df = boxes(spark, [(0, 0.0, 0.0, 10.0, 10.0), (1, 10.0, 0.0, 20.0, 10.0), (2, 9.0, 9.0, 12.0, 12.0)])
    assert {(r.i, r.j) for r in overlap.pairs(df, 0.0, 5.0).collect()} == {(0, 2), (1, 2)}
    grids = spark.createDataFrame([(7, 20.0, 10.0, 30.0, 0.0)], "grid_id int, x0 double, y0 double, x1 double, y1 double")
    assert [(r.image_id, r.x0, r.x1) for r in overlap.grid_image(grids, df, 5.0).collect()] == [(1, 20.0, 20.0)]
    assert overlap.pairs(df.limit(1), 0.0).count() == 0


def test_pairs_and_triples_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(k, *(lambda x, y: (x, y, x + float(rng.uniform(1, 9)), y + float(rng.uniform(1, 9))))(*map(float, rng.uniform(-20, 20, 2)))) for k in range(60)]
    df = boxes(spark, rows)

    def common(*ks):
        return min(rows[k][3] for k in ks) - max(rows[k][1] for k in ks), min(rows[k][4] for k in ks) - max(rows[k][2] for k in ks)

    two = {(i, j) for i in range(60) for j in range(i + 1, 60) if min(common(i, j)) >= 1}
    three = {(i, j, k) for i, j in two for k in range(j + 1, 60) if min(common(i, j, k)) >= 1}
    assert {(r.i, r.j) for r in overlap.pairs(df, 1.0, 4.0).collect()} == two
    assert {(r.i, r.j, r.k) for r in overlap.triples(df, 1.0, 4.0).collect()} == three


def test_common_polygon_order_and_empty(spark):
    fields = "quad_id int, " + ", ".join(f"{a}{k} double" for k in range(4) for a in "xy")
    square = lambda k, x, y, s: (k, x, y + s, x + s, y + s, x + s, y, x, y)
    two = spark.createDataFrame([square(0, 0.0, 0.0, 4.0), square(1, 2.0, 1.0, 4.0)], fields)
    got = [(r.x, r.y) for r in overlap.common_polygon(two).orderBy("angle").collect()]
    assert got == [(2.0, 1.0), (4.0, 1.0), (4.0, 4.0), (2.0, 4.0)]
    apart = spark.createDataFrame([square(0, 0.0, 0.0, 1.0), square(1, 5.0, 5.0, 1.0)], fields)
    assert overlap.common_polygon(apart).count() == 0
    assert overlap.common_polygon(two.filter("quad_id = 0")).count() == 4


def test_robust_affine_finds_the_map(spark):
    rng = np.random.default_rng(2)
    true = np.array([[1.001, 0.002, 5.0], [-0.001, 0.998, -7.0]])
    rows = []
    for k in range(2):
        for _ in range(300):
            p = rng.uniform(0, 1000, 2)
            q = true @ [*p, 1] + rng.normal(0, 0.2, 2) + (rng.uniform(-300, 300, 2) if rng.random() < 0.2 else 0)
            rows.append((k, *map(float, p), *map(float, q), 0.9))
    df = spark.createDataFrame(rows, "image_id int, l_line double, l_samp double, t_line double, t_samp double, conf double")
    for r in fit.robust_affine(df).collect():
        assert np.allclose([[r.a00, r.a01], [r.a10, r.a11]], true[:, :2], atol=1e-3) and np.allclose([r.a02, r.a12], true[:, 2], atol=0.5)
        assert r.n_inliers <= r.n_valid < r.n_total == 300


def test_rigid_fit(spark):
    rng = np.random.default_rng(2)
    c, s = math.cos(0.3), math.sin(0.3)
    p = rng.uniform(0, 100, (60, 2))
    q = p @ np.array([[c, -s], [s, c]]).T + [3, -4]
    q[:12] += rng.uniform(50, 90, (12, 2))
    df = spark.createDataFrame([(0, *map(float, a), *map(float, b)) for a, b in zip(p, q)], "image_id int, l_line double, l_samp double, t_line double, t_samp double")
    r = fit.ransac_rigid(df, thr=1.0).first()
    assert (r.a00, r.a01, r.a02, r.a12, r.n_inliers) == pytest.approx((c, -s, 3.0, -4.0, 48), abs=1e-6)


def test_affine_lsq_equals_numpy_and_degenerate_groups(spark):
    rng = np.random.default_rng(2)
    p, q = rng.normal(size=(40, 2)), rng.normal(size=(40, 2))
    rows = [(0, *map(float, a), *map(float, b)) for a, b in zip(p, q)] + [(1, 1.0, 1.0, 2.0, 2.0)] * 2 + [(2, float(k), float(k), 1.0, 1.0) for k in range(9)]
    df = spark.createDataFrame(rows, "image_id int, l_line double, l_samp double, t_line double, t_samp double")
    got = fit.affine_lsq(df).collect()
    want = np.linalg.lstsq(np.column_stack([p, np.ones(40)]), q, rcond=None)[0].T
    assert [r.image_id for r in got] == [0]
    assert np.allclose([[got[0][f"a{i}{j}"] for j in range(3)] for i in range(2)], want)


def test_centred_transforms_have_no_mean_motion(spark):
    rows = [(k, 1 + 0.01 * k, 0.002 * k, 1.0 * k, -0.001 * k, 1 - 0.005 * k, -2.0 * k) for k in range(4)]
    df = spark.createDataFrame(rows, "image_id int, a00 double, a01 double, a02 double, a10 double, a11 double, a12 double")
    mean = fit.mean_transform(fit.centre_transforms(df)).first()
    assert [mean[c] for c in geo.AFFINE] == pytest.approx([1, 0, 0, 0, 1, 0], abs=1e-9)


def test_quantile_map_follows_the_quantiles(spark):
    values = np.sort(np.random.default_rng(1).normal(size=2000))
    df = spark.createDataFrame([(0, float(v)) for v in values], "grid_id int, h double")
    coefs = fit.quantile_map(df, ["h"], bins=200, deg=15).first()["ch"]
    inner = np.linspace(0.2, 0.8, 9)
    assert np.allclose(np.polyval(coefs, (2 * inner - 1) * 199 / 239), np.quantile(values, inner), atol=0.1)


def test_knn_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    p, q = rng.uniform(-60, 60, (300, 2)), rng.uniform(-60, 60, (80, 2))
    patches = spark.createDataFrame([(k, *map(float, x), float(k)) for k, x in enumerate(p)], "patch_id int, line double, samp double, conf double")
    queries = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(q)], "query_id int, line double, samp double")
    got = {r.query_id: r.conf for r in neighbors.knn_idw(queries, patches, values=("conf",)).collect()}
    want = {}
    for k, x in enumerate(q):
        d = ((p - x) ** 2).sum(axis=1)
        near = np.argsort(d)[:4]
        if d[near[-1]] < 256:
            w = 1 / (d[near] + 1e-6)
            want[k] = float((w * near).sum() / w.sum())
    assert got == pytest.approx(want)


def test_far_negatives_are_far_or_the_last_draw(spark):
    a = spark.range(50).selectExpr("id AS a_id", "CAST(id AS DOUBLE) AS x", "0D AS y")
    b = spark.range(40).selectExpr("id AS b_id", "CAST(id * 10 AS DOUBLE) AS x", "0D AS y")
    got = neighbors.far_negatives(a, b, 100.0).collect()
    assert len(got) == 50 and sum(r.distance >= 100 for r in got) > 40
    assert all(r.distance == pytest.approx(abs(r.a_id - 10 * r.b_id)) for r in got)
    assert neighbors.far_negatives(a, b.filter("false")).count() == 0


@pytest.mark.parametrize("values", [[], [1.0], [2.0, 1.0], [3.0] * 9, [1e300, -1e300, 0.0], [1.0, 2.0] * 50, [float(k // 7) for k in range(500)], [math.exp(k * 37 % 101) for k in range(101)]])
@pytest.mark.parametrize("accuracy", [4, 100_000])
def test_middle_values_are_exact_however_rough_the_bounds(spark, values, accuracy):
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    want = (statistics.median_low(values), statistics.median_high(values)) if values else (None, None)
    assert metrics.middle_values(df, "v", accuracy) == want


@pytest.mark.parametrize("n", [3, 24, 25, 2000])
def test_drawn_hypotheses_have_distinct_points(spark, n):
    points = spark.range(n).selectExpr("'a' AS image_id", "id + 0.5D AS l_line", "id * 2D AS l_samp", "id - 1D AS t_line", "id + 3D AS t_samp")
    drawn = fit._drawn(points, "image_id", 3, 50, 0).collect()
    assert sorted(r["hyp"] for r in drawn) == list(range(50))
    assert all(len({r[f"l_line{k}"] for k in range(3)}) == 3 for r in drawn)
    assert n < 2000 or len({r["l_line0"] for r in drawn}) > 40


def test_running_number(spark):
    got = neighbors.running_number(spark.range(1000), "id", "n").collect()
    assert sorted(r.n for r in got) == list(range(1000))


def test_pca_equals_numpy(spark):
    x = np.random.default_rng(4).normal(size=(60, 5)) @ np.diag([3, 2, 1, 0.5, 0.1])
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "patch_id int, feature array<double>")
    got = np.array([r.pca for r in neighbors.feature_pca(df, 2).orderBy("patch_id").collect()])
    c = x - x.mean(axis=0)
    want = c @ np.linalg.svd(c, full_matrices=False)[2][:2].T
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-8)


def images(spark, n=3):
    return spark.createDataFrame([(k, 200 + 30 * k, 260 + 10 * k) for k in range(n)], "image_id int, height int, width int")


def test_random_tables_keep_their_rules(spark):
    crops = tiling.overlapping_crops(images(spark).withColumnRenamed("image_id", "pair_id"), 20, 60).join(images(spark).withColumnRenamed("image_id", "pair_id"), "pair_id").collect()
    assert len(crops) == 60
    for r in crops:
        for m in (1, 2):
            row, col, side = r[f"row{m}"], r[f"col{m}"], r[f"side{m}"]
            assert 60 <= side <= min(r.height, r.width) and 0 <= row <= r.height - side and 0 <= col <= r.width - side
            assert row <= r.overlap_row and r.overlap_row + r.overlap <= row + side and col <= r.overlap_col and r.overlap_col + r.overlap <= col + side
        assert math.ceil(min(r.side1, r.side2) / 2) <= r.overlap <= min(r.side1, r.side2)
    windows = tiling.crop_windows(images(spark), 64).join(images(spark), "image_id").collect()
    assert all(0 <= r.row <= r.height - 64 and 0 <= r.col <= r.width - 64 for r in windows)
    assert sum(r.random for r in windows) == sum(not r.random for r in windows)
    points = tiling.mirrored_points(images(spark), 40).join(images(spark), "image_id").collect()
    assert len(points) == 120 and all(0 <= r.line <= r.height - 1 and 0 <= r.samp <= r.width - 1 for r in points)
    for r in tiling.rotated_squares(images(spark), 100).join(images(spark), "image_id").collect():
        assert abs(r.angle) <= 5
        for k in range(4):
            assert 0 <= r[f"x{k}"] <= r.width - 1 and 0 <= r[f"y{k}"] <= r.height - 1
        assert math.dist((r.x0, r.y0), (r.x1, r.y1)) == pytest.approx(100)
        assert (r.a02, r.a12) == pytest.approx((r.y0, r.x0))


def test_view_windows_provider(spark):
    own = tiling.view_windows(images(spark), 1, lambda df, k: df.selectExpr("image_id", f"{k} AS row0"))
    assert {r.row0 for r in own.collect()} == {1}


def test_cyclic_sample(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 2.0), ("b", 5.0)], "g string, v double")
    got = {(r.g, r.position): r.v for r in metrics.lowest_n_cyclic(df, "g", ["v"], 5).collect()}
    assert [got["a", k] for k in range(5)] == [1.0, 2.0, 3.0, 1.0, 2.0] and [got["b", k] for k in range(5)] == [5.0] * 5


def test_quad_resample_of_perspective_quads(spark):
    q = np.array([[1.0, 1.0], [8.0, 2.0], [7.0, 7.0], [2.0, 6.0]])
    df = spark.createDataFrame([(0, 0, *map(float, q.ravel()))], "quad_id int, image_id int, x0 double, y0 double, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double")
    pts = {(r.trow, r.tcol): (r.x, r.y) for r in raster.quad_points(df, (5, 5)).collect()}
    for corner, (r, c) in zip(q, ((0, 0), (0, 4), (4, 4), (4, 0))):
        assert pts[r, c] == pytest.approx(tuple(corner))
    a = np.add.outer(10.0 * np.arange(9), np.arange(10.0))
    got = raster.resample_quad(cells(spark, a), df, (5, 5), (9, 10)).collect()
    assert len(got) == 25 and all(r.value == pytest.approx(10 * r.row + r.col) for r in got)


def test_ortho_image_of_a_plain_image(spark):
    models = fit.inverse_models(models_df(spark, model_rows(1)), 10, 6)
    dem = cells(spark, np.full((150, 100), 220.0))
    pix = cells(spark, np.add.outer(np.arange(150.0), np.zeros(100)))
    got = jobs.orthorectify(pix, dem, models, 8.0).collect()
    inside = [r for r in got if r.value > 0]
    assert len(inside) > 0.5 * len(got)
    top, low = [r.value for r in inside if r.row == min(x.row for x in inside)], [r.value for r in inside if r.row == max(x.row for x in inside)]
    assert np.mean(top) < np.mean(low)


def test_adjusting_moves_models_onto_predictions(spark):
    models = fit.inverse_models(models_df(spark, model_rows(2)), 10, 6)
    rng = np.random.default_rng(1)
    pts = spark.createDataFrame([(0, k, n, float(rng.uniform(5, 145)), float(rng.uniform(5, 95)), 220.0, 0.9) for k in range(2) for n in range(60)], "grid_id int, image_id int, patch_id int, line double, samp double, h double, conf double")
    moved = sensor.image_to_mercator(pts.withColumnsRenamed({"line": "line0", "samp": "samp0"}).withColumns({"line": F.col("line0") + 3.0, "samp": F.col("samp0") - 2.0}), models)
    truth = moved.select("grid_id", "image_id", "patch_id", F.col("line0").alias("line"), F.col("samp0").alias("samp"), "h", "conf", "x", "y")
    corr = jobs._as_correspondences(truth, models)
    adjusted = jobs._update_affine(models, fit.robust_affine(corr))
    for r in adjusted.collect():
        assert (r.a00, r.a11, r.a02, r.a12) == pytest.approx((1, 1, 3.0, -2.0), abs=0.05)


def test_stateless_operators_run_on_streams(spark, tmp_path):
    spark.range(10).selectExpr("0 AS image_id", "CAST(id AS DOUBLE) AS line", "CAST(id AS DOUBLE) AS samp", "220D AS h", "id / 10D AS conf").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("image_id int, line double, samp double, h double, conf double").parquet(str(tmp_path / "in"))
    models = models_df(spark, model_rows(1))
    out = geo.to_mercator(sensor.image_to_object(fit.keep_confident(stream, 0.35), models))
    run = out.writeStream.format("memory").queryName("ground").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert spark.table("ground").count() == 6
