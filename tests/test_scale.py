"""Tiles, scans by ranges, overlaps of boxes of any size and crops, against NumPy and plain loops."""

import random
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geoframe.functions import ordered
from geoframe.operators import fit, metrics, overlap, raster, tiles
from geoframe.plans import jobs
from tests.test_geometry import cells


def plain_bilinear(a, row, col, fill=None):
    h, w = a.shape
    if fill is not None and not (0 <= row <= h - 1 and 0 <= col <= w - 1):
        return fill
    r, c = int(np.floor(row)), int(np.floor(col))
    total, known = 0.0, False
    for i, wr in ((0, 1 - (row - r)), (1, row - r)):
        for j, wc in ((0, 1 - (col - c)), (1, col - c)):
            v = a[min(max(r + i, 0), h - 1), min(max(c + j, 0), w - 1)]
            if wr * wc and not np.isnan(v):
                total, known = total + wr * wc * v, True
    return total if known else None


def raster_with_gaps(spark, shape, seed, image=0):
    """A raster whose unknown cells are missing rows or nulls."""
    rng = np.random.default_rng(seed)
    a = rng.normal(size=shape)
    a[rng.random(shape) < 0.2] = np.nan
    rows = [(image, r, c, None if np.isnan(a[r, c]) else float(a[r, c])) for r in range(shape[0]) for c in range(shape[1]) if not np.isnan(a[r, c]) or (r + c) % 2]
    return a, spark.createDataFrame(rows, "image_id int, row int, col int, value double")


@pytest.mark.parametrize("shape", [(23, 17), (8, 8), (1, 9), (30, 5)])
def test_tiles_hold_the_raster(spark, shape):
    a, df = raster_with_gaps(spark, shape, shape[0])
    cut = tiles.from_cells(df, size=8)
    for t in cut.collect():
        assert len(t["value"]) == t["height"] * t["width"] <= 81
        block = np.array([np.nan if v is None else v for v in t["value"]]).reshape(t["height"], t["width"])
        own = a[t["row0"] : t["row0"] + t["height"], t["col0"] : t["col0"] + t["width"]]
        assert np.array_equal(block, own, equal_nan=True)
    rng = np.random.default_rng(1)
    at = [(0, k, float(r), float(c)) for k, (r, c) in enumerate(zip(rng.uniform(-3, shape[0] + 3, 200), rng.uniform(-3, shape[1] + 3, 200)))]
    at += [(0, 900 + k, float(r), float(c)) for k, (r, c) in enumerate([(0, 0), (shape[0] - 1, shape[1] - 1), (min(7, shape[0] - 1), min(8, shape[1] - 1)), (-0.5, 0)])]
    points = spark.createDataFrame(at, "image_id int, p int, row double, col double")
    for fill in (None, 7.0):
        got = {r.p: r.value for r in tiles.bilinear(points, cut, fill=fill, shape=shape, size=8).collect()}
        for _, p, row, col in at:
            want = plain_bilinear(a, row, col, fill)
            assert (p not in got or got[p] is None) if want is None else got[p] == pytest.approx(want)
    whole = points.withColumns({"row": F.floor("row").cast("int"), "col": F.floor("col").cast("int")})
    kept = {r.p: r.value for r in tiles.nearest(whole, cut, keep=True, size=8).collect()}
    assert len(kept) == len(at)
    for _, p, row, col in at:
        r, c = int(np.floor(row)), int(np.floor(col))
        inside = 0 <= r < shape[0] and 0 <= c < shape[1] and not np.isnan(a[r, c])
        assert kept[p] == (a[r, c] if inside else None)


def test_cells_of_boxes(spark):
    a, df = raster_with_gaps(spark, (40, 33), 3)
    cut = tiles.from_cells(df, size=8)
    boxes = [(0, 3, 2, 5, 4), (1, 0, 0, 40, 33), (2, 7, 7, 9, 9), (3, -5, -5, 3, 3), (4, 50, 0, 60, 5), (5, 5, 5, 5, 9)]
    df = spark.createDataFrame([(0, *b) for b in boxes], "image_id int, box int, row0 int, col0 int, row1 int, col1 int")
    got = {(r.box, r.row, r.col): r.value for r in tiles.cells_in(cut, df, size=8).collect()}
    for k, r0, c0, r1, c1 in boxes:
        for r in range(max(r0, 0), min(r1, 40)):
            for c in range(max(c0, 0), min(c1, 33)):
                assert got.get((k, r, c)) == (None if np.isnan(a[r, c]) else a[r, c])
    assert all(dict((b[0], b) for b in boxes)[k][1] <= r < dict((b[0], b) for b in boxes)[k][3] for k, r, _ in got)


def test_several_values_and_a_point_table_with_the_tiles_names(spark):
    df = spark.createDataFrame([(0, r, c, float(r), float(c)) for r in range(9) for c in range(9)], "image_id int, row int, col int, value double, tr double")
    points = spark.createDataFrame([(0, 1.5, 2.25, 5, 6)], "image_id int, row double, col double, width int, height int")
    got = tiles.bilinear(points, tiles.from_cells(df, values=("value",), size=4), size=4).first()
    assert (got["value"], got["width"], got["height"]) == (1.5, 5, 6)


# --- scans -----------------------------------------------------------------------


def long_log(n=4000):
    rng = np.random.default_rng(2)
    rows = [(0, k, float(100 / (1 + k // 50) + rng.random())) for k in range(n)] + [(1, k, float(rng.random())) for k in range(30)] + [(None, 5, 1.0), (2, 0, 3.0)]
    order = rng.permutation(len(rows))
    return [rows[k] for k in order]


def test_a_long_run_is_scanned_in_many_tasks(spark):
    rows = long_log()
    df = spark.createDataFrame(rows, "run int, iter int, loss double")
    ranged = ordered.in_ranges(df, ["run"], ["iter"])
    assert ranged.filter("run = 0").select(ordered.PART).distinct().count() > 2
    got = {(r.run, r.iter): r for r in metrics.best_so_far(df, patience=7, factor=1.5).collect()}
    assert len(got) == len(rows)
    for run in (0, 1, 2, None):
        own = sorted((k, v) for r, k, v in rows if r == run)
        best, last, stop, seen = np.inf, 0, None, []
        for n, (k, loss) in enumerate(own, 1):
            if loss < best:
                best, last = loss, n
            stale = n - last
            bad = stale > 0 and loss > 1.5 * best
            if stop is None and (stale >= 7 or bad):
                stop = n
            seen.append((k, n, best, stale, bad))
        for k, n, best, stale, bad in seen:
            r = got[run, k]
            assert (r.n, r.best, r.no_update, r.diverged, r.stop_at) == (n, best, stale, bad, stop)


def test_ranks_and_times(spark):
    rows = long_log(500)
    df = spark.createDataFrame(rows, "run int, iter int, loss double")
    got = {(r.run, r.iter): r["rank"] for r in metrics.rank_by(df, "run", ["loss", "iter"]).collect()}
    for run in (0, 1, 2, None):
        own = sorted((v, k) for r, k, v in rows if r == run)
        assert [got[run, k] for _, k in own] == list(range(1, len(own) + 1))
    done = {(r.run, r.iter): (r.done, r.elapsed) for r in metrics.eta(df.withColumn("seconds", F.col("iter") * 2.0), 1000).collect()}
    assert done[0, 0] == (1, 0.0) and done[0, 499] == (500, 998.0) and done[None, 5] == (1, 0.0)


def test_exact_quantiles_of_a_hot_group(spark):
    rng = np.random.default_rng(4)
    values = {"hot": np.round(rng.exponential(size=5000), 2), "same": np.full(400, 3.0), "one": np.array([5.0]), "few": np.array([1.0, 2.0, 4.0]), None: rng.normal(size=50)}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [("hot", None), ("none", None)]
    random.Random(1).shuffle(rows)
    shares = [0.0, 0.02, 0.25, 1 / 3, 0.5, 0.98, 1.0]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r.g, r.k): r.value for r in ordered.quantiles(df, ["g"], "v", shares).collect()}
    assert {g for g, _ in got} == set(values)
    for g, vs in values.items():
        for k, s in enumerate(shares):
            assert got[g, k] == pytest.approx(np.quantile(vs, s), abs=1e-12)


# --- overlaps --------------------------------------------------------------------


def test_boxes_of_any_size(spark):
    rng = random.Random(6)
    boxes = []
    for k in range(150):
        size = 10 ** rng.uniform(2, 7)
        x, y = rng.uniform(-2e6, 2e6), rng.uniform(-2e6, 2e6)
        boxes.append((k, x, y, x + size, y + size * rng.uniform(0.5, 2)))
    boxes += [(200, 0.0, 0.0, 20000.0, 20000.0), (201, 20000.0, 0.0, 40000.0, 20000.0), (202, 5.0, 5.0, 5.0, 5.0)]
    df = spark.createDataFrame(boxes, "image_id int, minx double, miny double, maxx double, maxy double")
    want = set()
    for (i, *a), (j, *b) in combinations(boxes, 2):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        if w >= 500 and h >= 500:
            want.add((i, j))
    got = [(r.i, r.j) for r in overlap.pairs(df, 500.0, 1000.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    side = overlap._levelled(overlap._side(df, "i", "image_id"), "i", 1000.0)
    rows = overlap._celled(side, "i", 1000.0).groupBy("i").count().agg(F.max("count")).first()[0]
    assert rows <= 4
    touching = {(r.grid_id, r.image_id) for r in overlap.grid_image(spark.createDataFrame([(0, 0.0, 20000.0, 20000.0, 0.0)], "grid_id int, x0 double, y0 double, x1 double, y1 double"), df.filter("image_id >= 200")).collect()}
    assert touching == {(0, 200), (0, 201), (0, 202)}


# --- refusals ----------------------------------------------------------------------


def test_a_point_off_the_raster_fails_the_job(spark):
    dem = cells(spark, np.zeros((3, 3)))
    ties = spark.createDataFrame([(0, 1, 1), (0, 2, 9)], "image_id int, line int, samp int")
    assert raster.lookup(ties, dem).count() == 1
    with pytest.raises(Exception, match="no cell at 0, 2, 9"):
        raster.lookup(ties, dem, strict=True).count()
    assert raster.lookup(ties.filter("samp < 3"), dem, strict=True).count() == 1


def test_an_unknown_coordinate_system_is_refused(spark):
    meta = spark.createDataFrame([("a", 1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 2, 2, None, "EPSG:4326"), ("b", 1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 2, 2, None, "EPSG:9999")], "raster_id string, a double, b double, c double, d double, e double, f double, width int, height int, nodata double, crs string")
    one = lambda name: spark.createDataFrame([(name, r, c, 1.0) for r in range(2) for c in range(2)], "raster_id string, row int, col int, value double")
    with pytest.raises(Exception, match="EPSG:9999"):
        raster.add_regridded(one("a"), one("b"), meta, "b").collect()


# --- crops and adjustment ------------------------------------------------------------


@pytest.mark.parametrize(("size", "ratio"), [(12, 4), (9, 3), (10, 4)])
def test_crops_are_what_numpy_makes(spark, size, ratio):
    rng = np.random.default_rng(size)
    layers = {k: rng.normal(size=(30, 26)) for k in ("img1", "img2", "x", "y", "h", "res1", "res2")}
    for k in ("res1", "res2"):
        layers[k][rng.random((30, 26)) < 0.6] = np.nan
    rows = [(3, r, c, *(float(a[r, c]) for a in layers.values())) for r in range(30) for c in range(26)]
    df = spark.createDataFrame(rows, "pair_id int, row int, col int, " + ", ".join(f"{k} double" for k in layers))
    boxes = [(0, 2, 3, 20, 5, 1, 9), (1, 0, 0, 26, 10, 6, 20)]
    crops = spark.createDataFrame([(3, *b) for b in boxes], "pair_id int, k int, row1 int, col1 int, side1 int, row2 int, col2 int, side2 int")
    got = {(r.k, r.m): r for r in jobs.crop_samples(df, crops, size, ratio).collect()}
    assert len(got) == 4
    for k, *b in boxes:
        for m in (1, 2):
            r0, c0, side = b[3 * m - 3 : 3 * m]
            part = {n: a[r0 : r0 + side, c0 : c0 + side] for n, a in layers.items()}
            at = np.clip((np.arange(size) + 0.5) * side / size - 0.5, 0, side - 1)
            smooth = lambda a: np.array([[plain_bilinear(a, r, c) for c in at] for r in at])  # noqa: B023, E731
            near = np.minimum(np.arange(size) * side // size, side - 1)
            row = got[k, m]
            np.testing.assert_allclose(row.image, smooth(part[f"img{m}"]).ravel())
            middle, whole = [(ratio - 1) // 2, ratio // 2], size // ratio
            for n in ("x", "y", "h"):
                big = smooth(part[n])
                want = [np.mean([big[i * ratio + a, j * ratio + c] for a in middle for c in middle]) for i in range(whole) for j in range(whole)]
                np.testing.assert_allclose(row[n], want)
            small, blocks = part[f"res{m}"][np.ix_(near, near)], -(-size // ratio)
            want = [small[i * ratio : (i + 1) * ratio, j * ratio : (j + 1) * ratio] for i in range(blocks) for j in range(blocks)]
            np.testing.assert_allclose(row.residual, [-1 if np.isnan(x).all() else np.nanmean(x) for x in want])


def test_correspondences_between_elements(spark):
    from tests.test_geometry import model_rows, models_df

    rng = np.random.default_rng(8)
    patches = pd.DataFrame({"grid_id": 0, "image_id": np.repeat([0, 1], 60), "patch_id": np.arange(120), "line": rng.uniform(0, 60, 120), "samp": rng.uniform(0, 60, 120), "conf": rng.uniform(0.4, 1, 120)})
    patches["feature"] = [list(map(float, rng.normal(size=3))) for _ in range(120)]
    places = pd.DataFrame({"grid_id": 0, "image_id": np.repeat([0, 1], 40), "query_id": np.tile(np.arange(40), 2), "line": rng.uniform(-5, 65, 80), "samp": rng.uniform(-5, 65, 80)})
    elements = spark.createDataFrame([(k, [10.0, 12245000.0 + k], [10.0, 3503000.0], [5.0, 200.0]) for k in (0, 1)], "image_id int, cx array<double>, cy array<double>, ch array<double>")
    seen = lambda pdf: pd.DataFrame({"x": pdf["feature"].map(lambda v: v[0]), "y": pdf["feature"].map(lambda v: v[2]), "h": pdf["conf"]})
    got = jobs.element_correspondences(spark.createDataFrame(places), spark.createDataFrame(patches), elements, seen, models_df(spark, model_rows(2)), margin=0.1, conf_thr=0.6)
    rows = {(r.image_id, r.query_id, r.other): r for r in got.collect()}
    want = 0
    for p in places.itertuples():
        own = patches[patches.image_id == p.image_id]
        d = (own.line - p.line) ** 2 + (own.samp - p.samp) ** 2
        best = d.nsmallest(4)
        low, high = own[["line", "samp"]].min(), own[["line", "samp"]].max()
        inside = all(low[c] + 0.1 * (high[c] - low[c]) <= getattr(p, c) <= high[c] - 0.1 * (high[c] - low[c]) for c in ("line", "samp"))
        w = 1 / (best + 1e-6)
        conf = (w * own.conf[best.index]).sum() / w.sum()
        if best.max() < 64 and inside and conf > 0.6:
            want += 1
            r = rows[p.image_id, p.query_id, 1 - p.image_id]
            f = [(w * own.feature[best.index].map(lambda v, k=k: v[k])).sum() / w.sum() for k in range(3)]
            assert r.conf == pytest.approx(conf) and r.x == pytest.approx(10 * f[0] + 12245001 - p.image_id) and r.y == pytest.approx(10 * f[2] + 3503000)
    assert len(rows) == want > 10


def outlier_points(spark, n=20000):
    """Correspondences of two images, two fifths of them far off in any direction."""
    c = spark.range(n).selectExpr("CAST(id % 2 AS INT) AS image_id", "CAST((id * 7919) % 10000 AS DOUBLE) AS l_line", "CAST((id * 104729) % 9973 AS DOUBLE) AS l_samp", "1D AS conf", "((id * 41) % 21 - 10) / 10.0D AS e", "IF((id * 48271) % 100 < 40, (xxhash64(id) % 4001) / 10, 0) AS off")
    return c.selectExpr("image_id", "l_line", "l_samp", "conf", "1.0005D * l_line + 3e-4D * l_samp + 12.5D + e + off AS t_line", "-2e-4D * l_line + 0.9997D * l_samp - 8D - e + off / 2 AS t_samp")


def test_votes_in_rounds_find_the_same_inliers(spark, monkeypatch):
    df, kept = outlier_points(spark), []
    real = fit._survivors
    monkeypatch.setattr(fit, "_survivors", lambda *a: kept.append(real(*a)) or kept[-1])
    got = {r.image_id: r for r in fit.ransac_rigid(df, thr=6.0, hypotheses=150).collect()}
    left = [k.count() for k in kept]
    monkeypatch.setattr(fit, "ROUNDS", (1.0,))
    want = {r.image_id: r for r in fit.ransac_rigid(df, thr=6.0, hypotheses=150).collect()}
    assert left[1] <= left[0] < 300 and left[1] < 200
    for k in want:
        assert got[k].n_inliers == pytest.approx(want[k].n_inliers, rel=2e-3)
        assert got[k].a02 == pytest.approx(want[k].a02, abs=0.05)


def test_merged_models_project_as_before(spark):
    from geoframe.functions import geo
    from geoframe.operators import sensor
    from tests.test_geometry import model_rows, models_df

    models = models_df(spark, model_rows(2, 0.7))
    merged = fit.merged_models(models, 12, 6)
    assert merged.select(*geo.AFFINE).distinct().collect() == [tuple(geo.IDENTITY[c] for c in geo.AFFINE)]
    nodes = sensor.object_to_image(sensor.object_to_image(sensor.virtual_lattice(models, 5, 3), models, line="l0", samp="s0"), merged)
    worst = nodes.agg(F.max(F.greatest(F.abs(F.col("line") - F.col("l0")), F.abs(F.col("samp") - F.col("s0"))))).first()[0]
    assert worst < 1e-3
    assert sensor.round_trip(merged, 5, 5).agg(F.max("max_error")).first()[0] < 0.05
