"""Rational-polynomial camera models on point tables.

A model is a row: ten normalizers, eight arrays of 20 coefficients (direct lnum,
lden, snum, sden; inverse latnum, latden, lonnum, londen) and an affine
correction of (line, samp).  Models join by image_id; one row an image, so Spark
broadcasts them where they are small, by its own size check.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoframe.functions import geo
from geoframe.functions.lineage import partitions
from geoframe.operators import raster

NORMALIZERS = tuple(f"{a}_{b}" for b in ("off", "scale") for a in ("line", "samp", "lat", "lon", "h"))
DIRECT, INVERSE = ("lnum", "lden", "snum", "sden"), ("latnum", "latden", "lonnum", "londen")
MODEL = (*NORMALIZERS, *DIRECT, *INVERSE, *geo.AFFINE)
#: The powers of P, L and H in each of the 20 terms, in the order of the coefficients.
POWERS = (
    (0, 0, 0), (0, 1, 0), (1, 0, 0), (0, 0, 1), (1, 1, 0), (0, 1, 1), (1, 0, 1), (0, 2, 0), (2, 0, 0), (0, 0, 2),
    (1, 1, 1), (0, 3, 0), (2, 1, 0), (0, 1, 2), (1, 2, 0), (3, 0, 0), (1, 0, 2), (0, 2, 1), (2, 0, 1), (0, 0, 3),
)


def basis(p: Column, l: Column, h: Column) -> list[Column]:  # noqa: E741
    """The 20 terms."""
    out = []
    for powers in POWERS:
        factors = [x for x, n in zip((p, l, h), powers, strict=True) for _ in range(n)]
        term = F.lit(1.0)
        for k, factor in enumerate(factors):
            term = factor if k == 0 else term * factor
        out.append(term)
    return out


def _slopes(p: Column, l: Column, h: Column, axis: int) -> list[Column]:  # noqa: E741
    """The terms' derivatives by P (0), L (1) or H (2)."""
    out = []
    for powers in POWERS:
        n = list(powers)
        times, n[axis] = n[axis], max(n[axis] - 1, 0)
        term = F.lit(float(times))
        for x, k in zip((p, l, h), n, strict=True):
            for _ in range(k if times else 0):
                term = term * x
        out.append(term)
    return out


def weighted(coefs: str, terms: list[Column]) -> Column:
    total = F.lit(0.0)
    for k, term in enumerate(terms):
        total = total + F.col(coefs)[k] * term
    return total


def with_model(points: DataFrame, models: DataFrame, columns: tuple = MODEL) -> DataFrame:
    """Points with their image's model columns."""
    return points.join(models.select("image_id", *columns), "image_id")


def _normal(value: Column, name: str) -> Column:
    return (value - F.col(f"{name}_off")) / F.col(f"{name}_scale")


def _real(value: Column, name: str) -> Column:
    return value * F.col(f"{name}_scale") + F.col(f"{name}_off")


def _project(df: DataFrame, outputs: dict[str, tuple[str, str, str]], p: Column, l: Column, h: Column) -> DataFrame:  # noqa: E741
    """Ratios of polynomials; P, L and H become columns first, so that their expressions are not repeated in every term.

    The results pass through a list of one: filters on them would otherwise be moved below
    this step, each with the polynomials written out in it again.
    """
    with_plh = df.withColumns({"__p": p, "__l": l, "__h": h})
    terms = basis(F.col("__p"), F.col("__l"), F.col("__h"))
    values = F.struct(*(_real(weighted(num, terms) / weighted(den, terms), unit).alias(name) for name, (num, den, unit) in outputs.items()))
    done = with_plh.withColumn("__at", F.explode(F.array(values)))
    return done.withColumns({name: F.col(f"__at.{name}") for name in outputs}).drop("__p", "__l", "__h", "__at")


def object_to_image(points: DataFrame, models: DataFrame, lat: str = "lat", lon: str = "lon", h: str = "h", line: str = "line", samp: str = "samp") -> DataFrame:
    """Adds line and samp: the direct model, then the inverse of the affine correction."""
    df = to_image(with_model(points, models, (*NORMALIZERS, *DIRECT, *geo.AFFINE)), lat, lon, h, line, samp)
    return df.drop(*NORMALIZERS, *DIRECT, *geo.AFFINE)


def to_image(df: DataFrame, lat: str = "lat", lon: str = "lon", h: str = "h", line: str = "line", samp: str = "samp") -> DataFrame:
    """object_to_image() of points that hold their model's columns."""
    df = _project(df, {"__line": ("lnum", "lden", "line"), "__samp": ("snum", "sden", "samp")}, _normal(F.col(lat), "lat"), _normal(F.col(lon), "lon"), _normal(F.col(h), "h"))
    a, b = geo.apply_inverse_affine(F.col("__line"), F.col("__samp"))
    return df.withColumns({line: a, samp: b}).drop("__line", "__samp")


def image_places(model: dict, lat: np.ndarray, lon: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """to_image() in arrays, within a task: line and samp by one model. The same steps in the same order, so that the results are the same doubles; finite heights only."""
    plh = [(v - model[f"{name}_off"]) / model[f"{name}_scale"] for name, v in (("lat", lat), ("lon", lon), ("h", h))]
    terms: dict[int, np.ndarray] = {}

    def term(k: int) -> np.ndarray:
        if k not in terms:
            made = np.ones_like(plh[0])
            for x in (x for x, n in zip(plh, POWERS[k], strict=True) for _ in range(n)):
                made = made * x
            terms[k] = made
        return terms[k]

    def total(coefs: list) -> np.ndarray:
        made = np.zeros_like(plh[0])
        for k, c in enumerate(coefs):
            if c != 0:
                made = made + c * term(k)
        return made

    raw = {u: total(model[f"{u[0]}num"]) / total(model[f"{u[0]}den"]) * model[f"{u}_scale"] + model[f"{u}_off"] for u in ("line", "samp")}
    a = [model[c] for c in geo.AFFINE]
    det, dl, ds = a[0] * a[4] - a[1] * a[3], raw["line"] - a[2], raw["samp"] - a[5]
    return (a[4] * dl - a[1] * ds) / det, (a[0] * ds - a[3] * dl) / det


def image_to_object(points: DataFrame, models: DataFrame, line: str = "line", samp: str = "samp", h: str = "h", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Adds lat and lon: the affine correction first, then the inverse model."""
    df = to_object(with_model(points, models, (*NORMALIZERS, *INVERSE, *geo.AFFINE)), line, samp, h, lat, lon)
    return df.drop(*NORMALIZERS, *INVERSE, *geo.AFFINE)


def to_object(df: DataFrame, line: str = "line", samp: str = "samp", h: str = "h", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """image_to_object() of points that hold their model's columns."""
    a, b = geo.apply_affine(F.col(line), F.col(samp))
    df = df.withColumns({"__line": a, "__samp": b})
    df = _project(df, {lat: ("latnum", "latden", "lat"), lon: ("lonnum", "londen", "lon")}, _normal(F.col("__samp"), "samp"), _normal(F.col("__line"), "line"), _normal(F.col(h), "h"))
    return df.drop("__line", "__samp")


def mercator_to_image(points: DataFrame, models: DataFrame) -> DataFrame:
    """x, y, h to line and samp."""
    return object_to_image(geo.from_mercator(points), models).drop("lat", "lon")


def image_to_mercator(points: DataFrame, models: DataFrame) -> DataFrame:
    """line, samp, h to x and y."""
    return geo.to_mercator(image_to_object(points, models)).drop("lat", "lon")


def corrections_to_affine(df: DataFrame) -> DataFrame:
    """p0..p5 (offsets in line and samp, linear in both) to the affine that takes them off."""
    p = [F.col(f"p{k}") for k in range(6)]
    one = F.lit(1.0)
    return df.withColumns({"a00": one - p[2], "a01": -p[1], "a02": -p[0], "a10": -p[5], "a11": one - p[4], "a12": -p[3]}).drop(*(f"p{k}" for k in range(6)))


def affine_to_corrections(df: DataFrame) -> DataFrame:
    """The inverse of corrections_to_affine()."""
    a = {c: F.col(c) for c in geo.AFFINE}
    one = F.lit(1.0)
    return df.withColumns({"p0": -a["a02"], "p1": -a["a01"], "p2": one - a["a00"], "p3": -a["a12"], "p4": one - a["a11"], "p5": -a["a10"]}).drop(*geo.AFFINE)


def propagate_uncertainty(points: DataFrame, models: DataFrame) -> DataFrame:
    """x, y, h with deviations sx, sy, sh -> line, samp and their variances, to first order, by exact derivatives."""
    df = with_model(geo.from_mercator(points), models, (*NORMALIZERS, *DIRECT, *geo.AFFINE))
    df = df.withColumns({"__p": _normal(F.col("lat"), "lat"), "__l": _normal(F.col("lon"), "lon"), "__h": _normal(F.col("h"), "h")})
    plh = [F.col(c) for c in ("__p", "__l", "__h")]
    terms, slopes = basis(*plh), [_slopes(*plh, axis) for axis in range(3)]
    df = df.withColumns({f"__{c}": weighted(c, terms) for c in DIRECT} | {f"__{c}{axis}": weighted(c, slopes[axis]) for c in DIRECT for axis in range(3)})
    c = F.col
    # lat and lon by y and x, in units of the normalizers
    by_y = F.degrees(F.lit(1.0) / F.cosh(c("y") / F.lit(geo.MERCATOR_RADIUS))) / F.lit(geo.MERCATOR_RADIUS) / c("lat_scale")
    by_x = F.degrees(F.lit(1.0 / geo.MERCATOR_RADIUS)) / c("lon_scale")
    chain = {0: (by_y, "sy"), 1: (by_x, "sx"), 2: (F.lit(1.0) / c("h_scale"), "sh")}

    def raw(num: str, den: str, unit: str, axis: int) -> Column:
        return c(f"{unit}_scale") * (c(f"__{num}{axis}") * c(f"__{den}") - c(f"__{num}") * c(f"__{den}{axis}")) / (c(f"__{den}") * c(f"__{den}"))

    df = df.withColumns({f"__jl{k}": raw("lnum", "lden", "line", k) * chain[k][0] for k in range(3)} | {f"__js{k}": raw("snum", "sden", "samp", k) * chain[k][0] for k in range(3)})
    det = c("a00") * c("a11") - c("a01") * c("a10")
    line, samp = geo.apply_inverse_affine(_real(c("__lnum") / c("__lden"), "line"), _real(c("__snum") / c("__sden"), "samp"))
    var_line = sum((F.pow((c("a11") * c(f"__jl{k}") - c("a01") * c(f"__js{k}")) / det * c(chain[k][1]), 2) for k in range(3)), F.lit(0.0))
    var_samp = sum((F.pow((c("a00") * c(f"__js{k}") - c("a10") * c(f"__jl{k}")) / det * c(chain[k][1]), 2) for k in range(3)), F.lit(0.0))
    return df.select(*points.columns, line.alias("line"), samp.alias("samp"), var_line.alias("var_line"), var_samp.alias("var_samp"))


def rescale_models(models: DataFrame, factor: float, decimals: int | None = None) -> DataFrame:
    """Line and sample offsets and scales for an image `factor` times smaller."""
    value = lambda c: F.col(c) / F.lit(float(factor)) if decimals is None else F.round(F.col(c) / F.lit(float(factor)), decimals)
    return models.withColumns({c: value(c) for c in ("line_off", "samp_off", "line_scale", "samp_scale")})


def inside_image_range(df: DataFrame, models: DataFrame) -> DataFrame:
    """Points whose line and samp lie within their model's offset plus or minus scale."""
    joined = with_model(df, models, ("line_off", "samp_off", "line_scale", "samp_scale"))
    inside = F.lit(True)
    for c in ("line", "samp"):
        inside &= F.col(c).between(F.col(f"{c}_off") - F.col(f"{c}_scale"), F.col(f"{c}_off") + F.col(f"{c}_scale"))
    return joined.filter(inside).select(*df.columns)


def spread_models(models: DataFrame) -> DataFrame:
    """Models dealt by image to as many tasks as a shuffle has: each row is small, but much is made of it."""
    return models.repartition(partitions(models.sparkSession), "image_id")


def virtual_lattice(models: DataFrame, xy: int = 30, z: int = 20, keep: tuple = ()) -> DataFrame:
    """A lattice of lat, lon and h over each model's offset plus or minus scale; keep: columns of the model that its nodes hold."""
    node = lambda name, k, n: F.col(f"{name}_off") - F.col(f"{name}_scale") + F.col(k) * (F.lit(2.0) * F.col(f"{name}_scale") / F.lit(float(max(n - 1, 1))))
    needed = dict.fromkeys((*keep, *(f"{a}_{b}" for a in ("lat", "lon", "h") for b in ("off", "scale"))))
    df = models.select("image_id", *needed)
    for name, n in (("i", xy), ("j", xy), ("k", z)):
        df = df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return df.select("image_id", "i", "j", "k", node("lat", "i", xy).alias("lat"), node("lon", "j", xy).alias("lon"), node("h", "k", z).alias("h"), *keep)


def round_trip(models: DataFrame, lines: int, samps: int, heights: int = 3, limit: float = 1.0) -> DataFrame:
    """Image to ground to image on a lattice: mean and largest error of each model, and how many points exceed limit pixels.

    A model's nodes are made where the model is and hold its columns, so that models are not joined.
    """
    spread = lambda name, k, n: F.col(f"{name}_off") + F.col(f"{name}_scale") * (F.col(k) * F.lit(2.0 / max(n - 1, 1)) - F.lit(1.0))
    df = spread_models(models.select("image_id", *MODEL))
    for name, n in (("i", lines), ("j", samps), ("k", heights)):
        df = df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    nodes = df.withColumns({"line": spread("line", "i", lines), "samp": spread("samp", "j", samps), "h": spread("h", "k", heights)})
    back = to_image(to_object(nodes), line="line2", samp="samp2")
    error = F.sqrt(F.pow(F.col("line2") - F.col("line"), 2) + F.pow(F.col("samp2") - F.col("samp"), 2))
    return back.withColumn("error", error).groupBy("image_id").agg(F.avg("error").alias("mean_error"), F.max("error").alias("max_error"), F.count_if(F.col("error") > limit).alias("n_over"))


def heights_by_iteration(points: DataFrame, models: DataFrame, dem: DataFrame, rasters: DataFrame, rounds: int = 3) -> DataFrame:
    """Height of each image point: project with the present height, read the raster there, and again; starts at the raster's mean valid value.

    points has image_id, raster_id, line and samp; rasters are in geographic coordinates.
    """
    start = raster.stats(raster.mask_nodata(dem, rasters), "raster_id").select("raster_id", F.col("mean").alias("h"))
    now = points.join(start, "raster_id")
    for _ in range(rounds):
        placed = image_to_object(now, models).withColumns({"x": F.col("lon"), "y": F.col("lat")})
        read = raster.sample_nearest(placed, dem, rasters, keep=True)
        now = read.withColumn("h", F.coalesce("value", "h")).select(*points.columns, "h")
    return now


def xy_to_image(points: DataFrame, models: DataFrame, dem: DataFrame, footprints: DataFrame, iterations: int = 1) -> DataFrame:
    """x, y to line, samp of each image: the height is read (bilinearly) at a first guess by the image's box, then, with more iterations, at the result.

    footprints: image_id, minx, maxx, miny, maxy, width, height.
    """
    c = F.col
    j = points.join(footprints, "image_id")
    now = j.withColumns({
        "row": (c("maxy") - c("y")) / (c("maxy") - c("miny")) * c("height"), "col": (c("x") - c("minx")) / (c("maxx") - c("minx")) * c("width"),
    }).select(*points.columns, "row", "col", "height", "width")
    for _ in range(iterations):
        read = raster.sample_bilinear(now, dem)
        placed = mercator_to_image(read.withColumnRenamed("value", "h"), models)
        last = placed.select(*points.columns, "h", "line", "samp", "height", "width")
        now = last.drop("h").withColumnsRenamed({"line": "row", "samp": "col"})
    return last.select(*points.columns, "h", "line", "samp")
