"""Coordinates: Web Mercator, distances, polynomials and 2x3 affine maps, all as Column expressions.

An affine map has columns a00, a01, a02, a10, a11, a12 and takes (line, samp) to
(a00 line + a01 samp + a02, a10 line + a11 samp + a12).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MERCATOR_RADIUS, EARTH_RADIUS = 6378137.0, 6371000.0
AFFINE = ("a00", "a01", "a02", "a10", "a11", "a12")
IDENTITY = {"a00": 1.0, "a01": 0.0, "a02": 0.0, "a10": 0.0, "a11": 1.0, "a12": 0.0}


def mercator_x(lon: Column) -> Column:
    return F.lit(MERCATOR_RADIUS) * F.radians(lon)


def mercator_y(lat: Column) -> Column:
    return F.lit(MERCATOR_RADIUS) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def mercator_lon(x: Column) -> Column:
    return F.degrees(x / F.lit(MERCATOR_RADIUS))


def mercator_lat(y: Column) -> Column:
    return F.degrees(F.lit(2.0) * F.atan(F.exp(y / F.lit(MERCATOR_RADIUS))) - F.lit(math.pi / 2))


def to_mercator(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Adds x and y in metres."""
    return df.withColumns({"x": mercator_x(F.col(lon)), "y": mercator_y(F.col(lat))})


def from_mercator(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Adds lat and lon in degrees."""
    return df.withColumns({"lat": mercator_lat(F.col(y)), "lon": mercator_lon(F.col(x))})


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    dlat, dlon = F.radians(lat2) - F.radians(lat1), F.radians(lon2) - F.radians(lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(EARTH_RADIUS) * F.lit(2.0) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def apply_polynomial(x: Column, coefs: Column) -> Column:
    """Polynomial with the highest degree first, by Horner's rule."""
    return F.aggregate(coefs, F.lit(0.0), lambda acc, c: acc * x + c)


def warp_by_poly(df: DataFrame, grids: DataFrame, by: str = "grid_id") -> DataFrame:
    """Normalized x, y, h to ground units by each grid's three polynomials cx, cy, ch."""
    joined = df.join(grids.select(by, "cx", "cy", "ch"), by)
    return joined.withColumns({c: apply_polynomial(F.col(c), F.col(f"c{c}")) for c in "xyh"}).drop("cx", "cy", "ch")


def warp_by_extend(df: DataFrame, extends: DataFrame, by: str) -> DataFrame:
    """x, y, h scaled by e6, e7 and into [e8, e9], then x, y through the affine e0..e5."""
    e = [F.col(f"e{k}") for k in range(10)]
    joined = df.join(extends, by)
    joined = joined.withColumns({"x": F.col("x") * e[6], "y": F.col("y") * e[7], "h": (F.col("h") + 1) * (e[9] - e[8]) / 2 + e[8]})
    moved = joined.withColumns({"x": e[0] * F.col("x") + e[1] * F.col("y") + e[2], "y": e[3] * F.col("x") + e[4] * F.col("y") + e[5]})
    return moved.drop(*(f"e{k}" for k in range(10)))


def apply_affine(line: Column, samp: Column, prefix: str = "") -> tuple[Column, Column]:
    a = [F.col(prefix + c) for c in AFFINE]
    return a[0] * line + a[1] * samp + a[2], a[3] * line + a[4] * samp + a[5]


def apply_inverse_affine(line: Column, samp: Column, prefix: str = "") -> tuple[Column, Column]:
    a = [F.col(prefix + c) for c in AFFINE]
    det = a[0] * a[4] - a[1] * a[3]
    dl, ds = line - a[2], samp - a[5]
    return (a[4] * dl - a[1] * ds) / det, (a[0] * ds - a[3] * dl) / det


def invert_affine(df: DataFrame) -> DataFrame:
    """Replaces every map by its inverse."""
    a = {c: F.col(c) for c in AFFINE}
    det = a["a00"] * a["a11"] - a["a01"] * a["a10"]
    return df.withColumns({
        "a00": a["a11"] / det, "a01": -a["a01"] / det, "a02": (a["a01"] * a["a12"] - a["a11"] * a["a02"]) / det,
        "a10": -a["a10"] / det, "a11": a["a00"] / det, "a12": (a["a10"] * a["a02"] - a["a00"] * a["a12"]) / det,
    })


def compose_affine(earlier: DataFrame, later: DataFrame, on: str = "image_id") -> DataFrame:
    """on and the map that applies earlier, then later."""
    b = later.select(on, *(F.col(c).alias(f"b{c[1:]}") for c in AFFINE))
    j = earlier.select(on, *AFFINE).join(b, on)
    c = F.col
    return j.select(
        on, (c("b00") * c("a00") + c("b01") * c("a10")).alias("a00"), (c("b00") * c("a01") + c("b01") * c("a11")).alias("a01"), (c("b00") * c("a02") + c("b01") * c("a12") + c("b02")).alias("a02"),
        (c("b10") * c("a00") + c("b11") * c("a10")).alias("a10"), (c("b10") * c("a01") + c("b11") * c("a11")).alias("a11"), (c("b10") * c("a02") + c("b11") * c("a12") + c("b12")).alias("a12"),
    )


def transform_error(true: DataFrame, predicted: DataFrame, on: str = "image_id") -> DataFrame:
    """Rotation (degrees, not wrapped) and translation by which two maps differ."""
    j = true.select(on, *AFFINE).join(predicted.select(on, *(F.col(c).alias(f"p{c[1:]}") for c in AFFINE)), on)
    turn = F.degrees(F.abs(F.atan2(F.col("a10"), F.col("a00")) - F.atan2(F.col("p10"), F.col("p00"))))
    move = F.sqrt(F.pow(F.col("a02") - F.col("p02"), 2) + F.pow(F.col("a12") - F.col("p12"), 2))
    return j.select(on, turn.alias("rotation_deg"), move.alias("translation"))


def centre_objects(df: DataFrame, by: str) -> DataFrame:
    """x and y about the middle of their range within by; h stays."""
    w = Window.partitionBy(by)
    return df.withColumns({c: F.col(c) - (F.max(c).over(w) + F.min(c).over(w)) / 2 for c in ("x", "y")})
