"""Fits per image: trims, affine least squares, robust fits, quantile maps and inverse models.

Correspondences hold image_id, l_line, l_samp (where a point is) and t_line,
t_samp (where it belongs), with conf.  Least squares are sums of products by
group; hypotheses are drawn by hashes, so that runs agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoframe.functions import geo, ordered
from geoframe.functions.lineage import by_group, by_written_group, checkpointed
from geoframe.operators import sensor

L = ("l_line", "l_samp")
T = ("t_line", "t_samp")


def keep_confident(df: DataFrame, thr: float = 0.7) -> DataFrame:
    return df.filter(F.col("conf") > thr)


def _with(df: DataFrame, by: str, *aggregates: Column) -> DataFrame:
    return by_group(df, df.groupBy(by).agg(*aggregates), by)


def _shift_distance(df: DataFrame, by: str) -> DataFrame:
    """Adds d: distance of target and local position after their means are matched."""
    j = _with(df, by, *(F.avg(F.col(t) - F.col(s)).alias(f"__m{k}") for k, (s, t) in enumerate(zip(L, T, strict=True))))
    d = F.sqrt(sum((F.pow(F.col(t) - F.col(s) - F.col(f"__m{k}"), 2) for k, (s, t) in enumerate(zip(L, T, strict=True))), F.lit(0.0)))
    return j.withColumn("d", d).drop("__m0", "__m1")


def trim_residuals(df: DataFrame, by: str = "image_id", std: str = "pop") -> DataFrame:
    """Rows whose residual after mean alignment is under mean + deviation."""
    spread = F.stddev_pop("d") if std == "pop" else F.stddev_samp("d")
    j = _with(_shift_distance(df, by), by, F.avg("d").alias("__m"), spread.alias("__s"))
    return j.filter("d < __m + __s").select(*df.columns)


def _moments(s: tuple, t: tuple) -> list[Column]:
    a, b = s
    return [
        F.var_pop(a).alias("saa"), F.var_pop(b).alias("sbb"), F.covar_pop(a, b).alias("sab"), F.avg(a).alias("ma"), F.avg(b).alias("mb"),
        *(x for k, c in enumerate(t) for x in (F.covar_pop(a, c).alias(f"sa{k}"), F.covar_pop(b, c).alias(f"sb{k}"), F.avg(c).alias(f"m{k}"))),
    ]


def affine_lsq(corr: DataFrame, by: str = "image_id") -> DataFrame:
    """The affine that takes local to target positions with least squares; no row for fewer than three points or points on a line."""
    c = F.col
    m = corr.groupBy(by).agg(*_moments(L, T), F.count("*").alias("n_points"))
    det = c("saa") * c("sbb") - c("sab") * c("sab")
    m = m.withColumn("__det", det).filter("n_points >= 3 AND __det > 1e-12 * saa * sbb")
    out = {}
    for k in range(2):
        out[f"a{k}0"] = (c(f"sa{k}") * c("sbb") - c(f"sb{k}") * c("sab")) / c("__det")
        out[f"a{k}1"] = (c(f"sb{k}") * c("saa") - c(f"sa{k}") * c("sab")) / c("__det")
    m = m.withColumns(out)
    return m.select(by, *(x for k in range(2) for x in (c(f"a{k}0"), c(f"a{k}1"), (c(f"m{k}") - c(f"a{k}0") * c("ma") - c(f"a{k}1") * c("mb")).alias(f"a{k}2"))), "n_points")


def _drawn(corr: DataFrame, by: str, size: int, hypotheses: int, seed: int) -> DataFrame:
    """by, hyp and `size` distinct points for each hypothesis: those of least hash of (point, hypothesis).

    Each point picks by hash the few hypotheses that it stands for, so that some 8 x size
    points stand for each and drawing does not multiply the table; the points of a
    small group stand for all.
    """
    corr = corr.select(by, *L, *T).distinct()
    n = corr.groupBy(by).agg(F.count("*").alias("__n"))
    keyed = by_group(corr.withColumn("__h", F.xxhash64(*L, *T)), n, by)
    expected = F.lit(8.0 * size * hypotheses) / F.col("__n")
    picks = F.floor(expected + F.xxhash64("__h", F.lit(seed)) / F.lit(2.0**64) + 0.5).cast("int")
    picked = F.array_distinct(F.transform(F.sequence(F.lit(1), picks), lambda t: F.pmod(F.xxhash64("__h", t, F.lit(seed)), F.lit(hypotheses)).cast("int")))
    stands_for = F.when(F.col("__n") <= 8 * size, F.sequence(F.lit(0), F.lit(hypotheses - 1))).when(picks > 0, picked)
    points = keyed.select(by, *L, *T, "__h", F.explode(stands_for).alias("hyp")).withColumn("r", F.xxhash64("__h", "hyp", F.lit(seed)))
    first = points.withColumn("__k", F.row_number().over(Window.partitionBy(by, "hyp").orderBy("r", *L, *T))).filter(F.col("__k") <= size)
    rows = first.groupBy(by, "hyp").agg(*(F.max(F.when(F.col("__k") == k + 1, F.col(c))).alias(f"{c}{k}") for k in range(size) for c in (*L, *T)), F.count("*").alias("__n"))
    return rows.filter(F.col("__n") == size).drop("__n")


def _exact_affine(h: DataFrame) -> DataFrame:
    """The affine through three correspondences."""
    c = F.col
    u = [(c(f"l_line{k}") - c("l_line0"), c(f"l_samp{k}") - c("l_samp0")) for k in (1, 2)]
    det = u[0][0] * u[1][1] - u[0][1] * u[1][0]
    h = h.withColumn("__det", det).filter("abs(__det) > 1e-9")
    for k, t in enumerate(T):
        v = [c(f"{t}{j}") - c(f"{t}0") for j in (1, 2)]
        h = h.withColumns({f"a{k}0": (v[0] * u[1][1] - v[1] * u[0][1]) / c("__det"), f"a{k}1": (u[0][0] * v[1] - u[1][0] * v[0]) / c("__det")})
        h = h.withColumn(f"a{k}2", c(f"{t}0") - c(f"a{k}0") * c("l_line0") - c(f"a{k}1") * c("l_samp0"))
    return h


def _miss() -> Column:
    a, b = geo.apply_affine(F.col("l_line"), F.col("l_samp"))
    return F.sqrt(F.pow(a - F.col("t_line"), 2) + F.pow(b - F.col("t_samp"), 2))


#: Shares of the points that the rounds of a vote read, the chance that a round drops a map wrongly, and the chance that none of the maps that are kept is free of outliers.
ROUNDS, DOUBT, MISSED = (1 / 64, 1 / 8, 1.0), 1e-9, 1e-6


def _survivors(votes: DataFrame, by: str, size: int) -> DataFrame:
    """Maps (by, hyp) that may still win, by votes on a part of the points.

    A map is dropped whose share of votes is, by Hoeffding's bound, below that of the
    best one; so is one whose number comes after as many as are needed for one of them
    to be drawn from inliers alone, of which there are at least the best one's share.
    """
    c = F.col
    reach = F.sqrt(F.log(F.lit(2 / DOUBT)) / (2 * c("n")))
    bounds = votes.select(by, "hyp", (c("votes") / c("n") - reach).alias("low"), (c("votes") / c("n") + reach).alias("high"))
    best = bounds.groupBy(by).agg(F.max("low").alias("best"))
    clean = F.pow(F.greatest("best", F.lit(0.0)), size)
    needed = F.when(clean >= 1, 1.0).when(clean > 0, F.log(F.lit(MISSED)) / F.log(1 - clean)).otherwise(F.lit(float("inf")))
    return bounds.join(best, by).filter((c("high") >= c("best")) & ((c("hyp") < needed) | (c("low") == c("best")))).select(by, "hyp")


def _vote(corr: DataFrame, maps: DataFrame, by: str, thr: Column, size: int = 3) -> DataFrame:
    """The map of each group with the most points under thr (the first of equal ones); maps are drawn from `size` points each.

    Points are read in rounds, each a larger share of them by hash; what a round leaves
    of the maps goes on, and the last round reads every point, so that few of some
    hundred maps meet all points.  Votes are summed before they are shuffled.
    """
    left = checkpointed(maps.select(by, "hyp", *geo.AFFINE))
    place = F.pmod(F.xxhash64(*L, *T), F.lit(1 << 20)) / F.lit(float(1 << 20))
    for share in ROUNDS:
        seen = corr if share == 1 else corr.filter(place < share)
        votes = by_written_group(seen, left, by).groupBy(by, "hyp").agg(F.count_if(_miss() < thr).alias("votes"), F.count("*").alias("n"))
        if share < 1:  # a group that has no point in this part keeps its maps
            dropped = votes.select(by, "hyp").join(_survivors(votes, by, size), [by, "hyp"], "left_anti")
            left = checkpointed(left.join(dropped, [by, "hyp"], "left_anti"))
    best = votes.groupBy(by).agg(F.min(F.struct((-F.col("votes")).alias("v"), "hyp")).alias("b"))
    return left.join(best.select(by, F.col("b.hyp").alias("hyp")), [by, "hyp"])


def robust_affine(corr: DataFrame, by: str = "image_id", conf_thr: float = 0.7, slack: float = 5.0, hypotheses: int = 200, seed: int = 0) -> DataFrame:
    """Affine per image: confident points, trim, the hypothesis with most inliers, then least squares on them; with counts.

    The points are read some ten times, so their columns are written to the checkpoint folder first.
    """
    corr = checkpointed(corr.select(by, *L, *T, "conf"))
    total = corr.groupBy(by).agg(F.count("*").alias("n_total"))
    valid = _shift_distance(trim_residuals(keep_confident(corr, conf_thr), by), by)
    limit = checkpointed(valid.groupBy(by).agg((F.avg("d") + slack).alias("__thr"), F.count("*").alias("n_valid")))
    points = by_written_group(valid.select(by, *L, *T), limit, by)
    maps = _exact_affine(_drawn(points.select(by, *L, *T), by, 3, hypotheses, seed))
    best = _vote(points, maps, by, F.col("__thr"))
    inliers = by_group(points, best, by).filter(_miss() < F.col("__thr")).select(by, *L, *T)
    fitted = affine_lsq(inliers, by).withColumnRenamed("n_points", "n_inliers")
    return fitted.join(limit.select(by, "n_valid"), by).join(total, by)


def rigid_lsq(corr: DataFrame, by: str) -> DataFrame:
    """Rotation and shift with least squares (two dimensions: the angle is an arctangent of sums)."""
    c = F.col
    m = corr.groupBy(by).agg(*_moments(L, T))
    angle = F.atan2(c("sa1") - c("sb0"), c("sa0") + c("sb1"))
    m = m.withColumns({"a00": F.cos(angle), "a01": -F.sin(angle), "a10": F.sin(angle), "a11": F.cos(angle)})
    return m.withColumns({"a02": c("m0") - c("a00") * c("ma") - c("a01") * c("mb"), "a12": c("m1") - c("a10") * c("ma") - c("a11") * c("mb")}).select(by, *geo.AFFINE)


def ransac_rigid(corr: DataFrame, by: str = "image_id", thr: float = 10.0, hypotheses: int = 100, refit: bool = True, seed: int = 0) -> DataFrame:
    """Rotation and shift per image: three-point hypotheses, votes under thr, and a refit on the inliers."""
    drawn = _drawn(corr, by, 3, hypotheses, seed)
    long = drawn.select(by, "hyp", F.explode(F.array(*(F.struct(*(F.col(f"{c}{k}").alias(c) for c in (*L, *T))) for k in range(3)))).alias("p")).select(F.struct(by, "hyp").alias("g"), "p.*")
    maps = rigid_lsq(long, "g").select(f"g.{by}", "g.hyp", *geo.AFFINE)
    best = checkpointed(_vote(corr, maps, by, F.lit(float(thr))))
    inliers = by_written_group(corr, best, by).filter(_miss() < thr)
    counts = inliers.groupBy(by).agg(F.count("*").alias("n_inliers"))
    final = rigid_lsq(inliers.select(by, *L, *T), by) if refit else best.select(by, *geo.AFFINE)
    return final.join(counts, by)


def quantiles(df: DataFrame, cols: list[str], by: str, bins: int = 1000) -> DataFrame:
    """Arrays of `bins` evenly spaced quantiles per group; a large group is ranked in many tasks."""
    steps, out = [k / (bins - 1) for k in range(bins)], None
    for name in cols:
        found = ordered.quantiles(df, [by], name, steps).groupBy(by).agg(F.sort_array(F.collect_list(F.struct("k", "value"))).alias("__q"))
        found = found.select(by, F.transform("__q", lambda q: q["value"]).alias(name))
        out = found if out is None else ordered.same(out, found, [by])
    return out


def quantile_map(df: DataFrame, cols: list[str], by: str = "grid_id", bins: int = 1000, deg: int = 20) -> DataFrame:
    """Per group and column a polynomial from [-1, 1] to the quantiles, which are reflected by a tenth at both ends first.

    Only the quantiles, `bins` numbers a group, go to Python for the fit.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        out = {by: pdf[by]}
        for c in cols:
            curves = []
            for q in pdf[c]:
                q = np.asarray(q, float)
                k = bins // 10
                longer = np.concatenate([2 * q[0] - q[1 : k + 1][::-1], q, 2 * q[-1] - q[-k - 1 : -1][::-1]])
                curves.append(np.polyfit(np.linspace(-1, 1, len(longer)), longer, deg).tolist())
            out[f"c{c}"] = curves
        return pd.DataFrame(out)

    wide = quantiles(df, cols, by, bins)
    return wide.mapInPandas(lambda parts: map(fit, parts), f"{by} {dict(df.dtypes)[by]}, " + ", ".join(f"c{c} array<double>" for c in cols))


def _terms(p: np.ndarray, l: np.ndarray, h: np.ndarray) -> np.ndarray:  # noqa: E741
    """The 20 terms of every node, in rows."""
    powers = [[np.ones_like(x), x, x * x, x * x * x] for x in (p, l, h)]
    return np.stack([powers[0][a] * powers[1][b] * powers[2][c] for a, b, c in sensor.POWERS], axis=1)


def _normal_matrices(t: np.ndarray, y: np.ndarray) -> np.ndarray:
    """39 x 40: the normal equations of y = t a / (t b) with b's first coefficient 1, and their right side."""
    a = np.hstack([t, -y[:, None] * t[:, 1:]])
    return a.T @ np.hstack([a, y[:, None]])


def _solved(blocks: np.ndarray, ridge: float, steps: int) -> np.ndarray:
    """Each block's solution by repeated ridge regression, until it moves no more; many blocks at a time."""
    a, b = blocks[:, :, :39], blocks[:, :, 39:]
    inverse, x = np.linalg.inv(a + ridge * np.eye(39)), np.zeros((len(blocks), 39, 1))
    left = np.arange(len(blocks))
    for _ in range(steps):
        new = inverse @ (b + ridge * x[left])
        moved = np.abs(new - x[left]).max(axis=(1, 2)) >= 1e-10
        x[left] = new
        if not moved.all():
            left, inverse, b = left[moved], inverse[moved], b[moved]
            if not len(left):
                break
    return x[:, :, 0]


#: Images that are solved together.
_TOGETHER = 64


def _nodes(model: dict, xy: int, z: int) -> dict[str, np.ndarray]:
    """The nodes of sensor.virtual_lattice() and their places by the direct model and the correction, in units of the normalizers."""
    axes = []
    for name, n in (("lat", xy), ("lon", xy), ("h", z)):
        off, scale = model[f"{name}_off"], model[f"{name}_scale"]
        axes.append((off - scale + np.arange(n) * (2.0 * scale / max(n - 1, 1)) - off) / scale)
    lat, lon, h = (x.ravel() for x in np.meshgrid(*axes, indexing="ij"))
    t = _terms(lat, lon, h)
    raw = {u: (t @ model[f"{u[0]}num"]) / (t @ model[f"{u[0]}den"]) * model[f"{u}_scale"] + model[f"{u}_off"] for u in ("line", "samp")}
    a = [model[c] for c in geo.AFFINE]
    det, dl, ds = a[0] * a[4] - a[1] * a[3], raw["line"] - a[2], raw["samp"] - a[5]
    place = {"line": (a[4] * dl - a[1] * ds) / det, "samp": (a[0] * ds - a[3] * dl) / det}
    return {"lat": lat, "lon": lon, "h": h} | {u: (v - model[f"{u}_off"]) / model[f"{u}_scale"] for u, v in place.items()}


def _ratios(models: DataFrame, xy: int, z: int, inputs: tuple, outputs: tuple, names: tuple, inside: bool, ridge: float, steps: int) -> DataFrame:
    """Per image two ratios of 20-term polynomials of the inputs that give the outputs at the nodes (of the image, if inside), as arrays called names (numerator and denominator of each).

    Models are dealt by image to tasks; an image's nodes are made where its normal
    equations (two blocks of 39 unknowns) are summed, and are never rows.
    """

    def solved(images: list, blocks: list) -> pd.DataFrame:
        x = _solved(np.concatenate(blocks), ridge, steps).reshape(len(images), 2, 39)
        columns = [c for k in range(2) for c in (x[:, k, :20], np.hstack([np.ones((len(x), 1)), x[:, k, 20:]]))]
        return pd.DataFrame({"image_id": images} | {n: c.tolist() for n, c in zip(names, columns, strict=True)})

    def solve(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            images, blocks = [], []
            for model in pdf.to_dict("records"):
                nodes = _nodes(model, xy, z)
                if inside:
                    kept = (np.abs(nodes["line"]) <= 1) & (np.abs(nodes["samp"]) <= 1)
                    nodes = {c: v[kept] for c, v in nodes.items()}
                t = _terms(*(nodes[c] for c in inputs))
                images.append(model["image_id"])
                blocks.append(np.stack([_normal_matrices(t, nodes[c]) for c in outputs]))
                if len(images) >= _TOGETHER:
                    yield solved(images, blocks)
                    images, blocks = [], []
            if images:
                yield solved(images, blocks)

    rows = sensor.spread_models(models.select("image_id", *sensor.NORMALIZERS, *sensor.DIRECT, *geo.AFFINE))
    return rows.mapInPandas(solve, "image_id int, " + ", ".join(f"{c} array<double>" for c in names))


def inverse_models(models: DataFrame, xy: int = 30, z: int = 20, ridge: float = 1.0, steps: int = 1000) -> DataFrame:
    """models with latnum, latden, lonnum and londen fitted to the direct model, per image, over the nodes of a lattice that lie in the image."""
    plain = models.withColumns({c: F.lit(v) for c, v in geo.IDENTITY.items()})
    fitted = _ratios(plain, xy, z, ("samp", "line", "h"), ("lat", "lon"), sensor.INVERSE, True, ridge, steps)
    return _refitted(models, fitted, sensor.INVERSE)


def _refitted(models: DataFrame, fitted: DataFrame, names: tuple) -> DataFrame:
    """models with the arrays of fitted, which is written down: its rows are far larger than Spark reckons, and are to meet their models by image."""
    return models.drop(*names).join(checkpointed(fitted).hint("merge"), "image_id").select(*models.columns)


def merged_models(models: DataFrame, xy: int = 30, z: int = 20, ridge: float = 1e-6, steps: int = 1000) -> DataFrame:
    """models whose affine corrections are taken into their polynomials: direct ones fitted to the corrected projection over a lattice, inverse ones to these, and no correction left."""
    fitted = _ratios(models, xy, z, ("lat", "lon", "h"), ("line", "samp"), sensor.DIRECT, False, ridge, steps)
    direct = _refitted(models, fitted, sensor.DIRECT).withColumns({c: F.lit(v) for c, v in geo.IDENTITY.items()})
    return inverse_models(checkpointed(direct.select(*models.columns)), xy, z)


def affine_regularity(corr: DataFrame, by: str = "image_id") -> DataFrame:
    """Mean distance of the fitted affine's image of local positions from the positions themselves, over the points that a fit keeps (conf > 0.5, sample deviation)."""
    kept = trim_residuals(corr.filter("conf > 0.5"), by, "samp")
    j = kept.join(affine_lsq(kept, by), by)
    a, b = geo.apply_affine(F.col("l_line"), F.col("l_samp"))
    return j.groupBy(by).agg(F.avg(F.sqrt(F.pow(a - F.col("l_line"), 2) + F.pow(b - F.col("l_samp"), 2))).alias("regularity"))


def mean_transform(transforms: DataFrame) -> DataFrame:
    return transforms.agg(*(F.avg(c).alias(c) for c in geo.AFFINE))


def centre_transforms(transforms: DataFrame, on: str = "image_id") -> DataFrame:
    """Every map after the inverse of the mean map, so that together they move nothing."""
    key = F.lit(1)
    undo = geo.invert_affine(mean_transform(transforms)).select(key.alias("__k"), *(F.col(c).alias(f"m{c[1:]}") for c in geo.AFFINE))
    j = transforms.withColumn("__k", key).join(undo, "__k")
    c = F.col
    return j.select(
        on, *(x for k in range(2) for x in (
            (c(f"a{k}0") * c("m00") + c(f"a{k}1") * c("m10")).alias(f"a{k}0"), (c(f"a{k}0") * c("m01") + c(f"a{k}1") * c("m11")).alias(f"a{k}1"),
            (c(f"a{k}0") * c("m02") + c(f"a{k}1") * c("m12") + c(f"a{k}2")).alias(f"a{k}2"))),
    )


def average_transforms(first: DataFrame, second: DataFrame, on: str = "image_id") -> DataFrame:
    """The elementwise mean of two maps of each image."""
    return first.select(on, *geo.AFFINE).unionByName(second.select(on, *geo.AFFINE)).groupBy(on).agg(*(F.avg(c).alias(c) for c in geo.AFFINE))


def budget_sample(df: DataFrame, by: str, budget: int, seed: int = 0, key: str = "patch_id") -> DataFrame:
    """Of each batch the same share of rows, at most `budget` in all: those least by an md5 of key and seed. A batch may be of any size."""
    counts = df.groupBy(by).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n")).first()[0]
    share = min(budget / total, 1.0) if total else 1.0
    drawn = df.withColumn("__draw", F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))))
    ranked = ordered.numbered(ordered.in_ranges(drawn, [by], ["__draw", key]), [by], ["__draw", key], "__k")
    return ordered.same(ranked, counts, [by]).filter(F.col("__k") <= F.floor(F.lit(share) * F.col("__n"))).select(*df.columns)
