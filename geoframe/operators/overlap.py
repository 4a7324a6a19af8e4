"""Footprints: overlaps of boxes, common areas, and sets of pairs.

Boxes are minx, miny, maxx, maxy with y upwards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = ("minx", "miny", "maxx", "maxy")


def bbox_from_transform(rasters: DataFrame) -> DataFrame:
    """Adds the box of each raster from its geotransform, width and height."""
    c = F.col
    return rasters.withColumns({
        "minx": c("c"), "maxy": c("f"), "maxx": c("c") + c("width") * c("a") + c("height") * c("b"), "miny": c("f") + c("width") * c("d") + c("height") * c("e"),
    })


def exclude_self(a: str = "i", b: str = "j") -> Column:
    return F.col(a) != F.col(b)


def unordered_distinct(df: DataFrame, cols: list[str]) -> DataFrame:
    """Each set of values once, sorted over cols."""
    own = df.withColumn("__s", F.sort_array(F.array(*cols)))
    return own.withColumns({c: F.col("__s")[k] for k, c in enumerate(cols)}).drop("__s").dropDuplicates(cols)


def _side(boxes: DataFrame, name: str, key: str) -> DataFrame:
    return boxes.select(F.col(key).alias(name), *(F.col(c).alias(f"{name}_{c}") for c in BOX), *([F.col("px").alias(f"{name}_px")] if "px" in boxes.columns else []))


def _levelled(df: DataFrame, name: str, cell: float) -> DataFrame:
    """Adds the box's own level: cells of cell * 2**level are at least as large as it, so that it touches four at most."""
    side = F.greatest(F.col(f"{name}_maxx") - F.col(f"{name}_minx"), F.col(f"{name}_maxy") - F.col(f"{name}_miny"))
    return df.withColumn(f"{name}_level", F.greatest(F.ceil(F.log2(side / cell)), F.lit(0)).cast("int"))


def _celled(df: DataFrame, name: str, cell: float, levels: list[int] | None = None) -> DataFrame:
    """A row for every cell that the box touches: of its own level, or of those of levels that are coarser."""
    own = F.col(f"{name}_level")
    at = F.array(own) if levels is None else F.filter(F.array(*map(F.lit, levels)), lambda v: v > own)
    size = F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("level"))
    span = lambda low, high: F.sequence(F.floor(F.col(f"{name}_{low}") / size), F.floor(F.col(f"{name}_{high}") / size))
    df = df.withColumn("level", F.explode(at))
    return df.withColumn("cx", F.explode(span("minx", "maxx"))).withColumn("cy", F.explode(span("miny", "maxy")))


def _meeting(a: DataFrame, b: DataFrame, names: tuple[str, str], cell: float) -> DataFrame:
    """Pairs of boxes that touch, once each, with minx .. maxy of what they share.

    Boxes of any size: each goes to the at most four cells of its own size that it
    touches, and to those of every coarser size that occurs.  Two boxes meet at the
    level of the larger one, where only one of them is from a finer level; a pair
    counts in the one cell that holds the lower left corner of what it shares.
    """
    (i, j), c = names, F.col
    a, b = _levelled(a, i, cell), _levelled(b, j, cell)
    found = a.select(c(f"{i}_level").alias("level")).unionByName(b.select(c(f"{j}_level").alias("level"))).distinct()
    levels = sorted(r["level"] for r in found.collect())  # powers of two between the smallest and the largest box
    on = ["level", "cx", "cy"]
    both = _celled(a, i, cell).join(_celled(b, j, cell), on)
    both = both.unionByName(_celled(a, i, cell).join(_celled(b, j, cell, levels), on)).unionByName(_celled(a, i, cell, levels).join(_celled(b, j, cell), on))
    shared = {"minx": F.greatest(f"{i}_minx", f"{j}_minx"), "miny": F.greatest(f"{i}_miny", f"{j}_miny"), "maxx": F.least(f"{i}_maxx", f"{j}_maxx"), "maxy": F.least(f"{i}_maxy", f"{j}_maxy")}
    size = F.lit(float(cell)) * F.pow(F.lit(2.0), c("level"))
    own = (c("cx") == F.floor(c("minx") / size)) & (c("cy") == F.floor(c("miny") / size))
    return both.withColumns(shared).filter((c("minx") <= c("maxx")) & (c("miny") <= c("maxy")) & own).drop(*on, f"{i}_level", f"{j}_level")


def pairs(footprints: DataFrame, min_size: float = 5000.0, cell: float = 20000.0, key: str = "image_id") -> DataFrame:
    """Overlapping pairs i < j at least min_size wide and tall; boxes that only touch do not overlap. cell: the size of small boxes."""
    j = _meeting(_side(footprints, "i", key), _side(footprints, "j", key), ("i", "j"), cell).filter("i < j")
    width, height = F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")
    found = j.filter((width > 0) & (height > 0) & (width >= min_size) & (height >= min_size)).withColumns({"width": width, "height": height})
    if "px" in footprints.columns:
        found = found.withColumns({"width_px": (width / F.abs("i_px")).cast("int"), "height_px": (height / F.abs("i_px")).cast("int")})
    return found.select("i", "j", *BOX, "width", "height", *(["width_px", "height_px"] if "px" in footprints.columns else []))


def triples(footprints: DataFrame, min_size: float = 1000.0, cell: float = 20000.0, key: str = "image_id") -> DataFrame:
    """Triples i < j < k that share at least min_size both ways; built from pairs, then the third side."""
    two = pairs(footprints.drop("px"), min_size, cell, key).select("i", "j", *BOX)
    third = two.select(F.col("i"), F.col("j").alias("k"))
    last = two.select(F.col("i").alias("j"), F.col("j").alias("k"))
    boxes = footprints.select(F.col(key).alias("k"), *(F.col(c).alias(f"k_{c}") for c in BOX))
    j = two.join(third, "i").filter("j < k").join(last, ["j", "k"], "left_semi").join(boxes, "k").withColumns({
        "minx": F.greatest("minx", "k_minx"), "miny": F.greatest("miny", "k_miny"), "maxx": F.least("maxx", "k_maxx"), "maxy": F.least("maxy", "k_maxy"),
    })
    width, height = F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")
    return j.withColumns({"width": width, "height": height}).filter((F.col("width") >= min_size) & (F.col("height") >= min_size) & (F.col("width") > 0) & (F.col("height") > 0)).select("i", "j", "k", *BOX, "width", "height")


def grid_image(grids: DataFrame, footprints: DataFrame, cell: float = 20000.0) -> DataFrame:
    """Images over each grid (x0, y0 top left, x1, y1 bottom right), touching ones too, with the intersection's corners."""
    g = grids.select(F.col("grid_id").alias("g"), F.col("x0").alias("g_minx"), F.col("y1").alias("g_miny"), F.col("x1").alias("g_maxx"), F.col("y0").alias("g_maxy"))
    j = _meeting(g, _side(footprints, "f", "image_id"), ("g", "f"), cell)
    return j.select(F.col("g").alias("grid_id"), F.col("f").alias("image_id"), F.col("minx").alias("x0"), F.col("maxy").alias("y0"), F.col("maxx").alias("x1"), F.col("miny").alias("y1"))


def common_rectangle(corners: DataFrame) -> DataFrame:
    """The upright rectangle inside all images: corners has image_id, tlx, tly, trx, try, blx, bly, brx, bry."""
    inner = corners.select(F.greatest("tlx", "blx").alias("l"), F.least("trx", "brx").alias("r"), F.least("tly", "try").alias("t"), F.greatest("bly", "bry").alias("b"))
    return inner.agg(F.max("l").alias("left"), F.min("r").alias("right"), F.min("t").alias("top"), F.max("b").alias("bottom"))


Point = tuple[float, float]


def clip_convex(polygon: list[Point], by: list[Point]) -> list[Point]:
    """The part of a convex polygon inside another, whose corners may run either way round."""
    turn = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(by, by[1:] + by[:1], strict=True))
    for (ax, ay), (bx, by_) in zip(by, by[1:] + by[:1], strict=True):
        length = math.hypot(bx - ax, by_ - ay)
        if not length:
            continue
        # distances from the edge's line, positive inside; what is within a rounding error of it counts as on it
        depth = [math.copysign(1.0, turn) * ((bx - ax) * (y - ay) - (by_ - ay) * (x - ax)) / length for x, y in polygon]
        depth = [0.0 if abs(d) < 1e-9 * length else d for d in depth]
        kept: list[Point] = []
        for (p, d), (q, e) in zip(zip(polygon, depth, strict=True), zip(polygon[1:] + polygon[:1], depth[1:] + depth[:1], strict=True), strict=True):
            if d >= 0:
                kept.append(p)
            if d * e < 0:
                kept.append((p[0] + (q[0] - p[0]) * d / (d - e), p[1] + (q[1] - p[1]) * d / (d - e)))
        polygon = kept
    return polygon


def common_polygon(quads: DataFrame, by: str | None = None) -> DataFrame:
    """Vertices of the intersection of convex quads, in order of angle about their centre; fewer than three: none.

    quads: corners x0, y0 .. x3, y3 in order.  Clipping is associative: every
    partition clips its own quads to one polygon a group, and those meet.
    """
    key = by or "__g"
    source = quads.select(*([by] if by else [F.lit(1).alias("__g")]), *(F.col(f"{a}{k}").cast("double").alias(f"{a}{k}") for k in range(4) for a in "xy"))
    schema = f"{key} {dict(source.dtypes)[key]}, xs array<double>, ys array<double>"

    def fold(held: dict, group: object, polygon: list[Point]) -> None:
        held[group] = clip_convex(held[group], polygon) if group in held else polygon

    def table(held: dict) -> pd.DataFrame:
        lists = [pd.Series([[p[k] for p in v] for v in held.values()], dtype=object) for k in range(2)]
        return pd.DataFrame({key: list(held), "xs": lists[0], "ys": lists[1]})

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in parts:
            for row in pdf.itertuples(index=False):
                fold(held, row[0], [(row[1 + 2 * k], row[2 + 2 * k]) for k in range(4)])
        yield table(held)

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        held: dict = {}
        for group, xs, ys in zip(pdf[key], pdf["xs"], pdf["ys"], strict=True):
            fold(held, group, list(zip(xs, ys, strict=True)))
        return table(held)

    polygons = source.mapInPandas(partial, schema).groupBy(key).applyInPandas(whole, schema)
    spots = polygons.select(key, F.explode(F.arrays_zip("xs", "ys")).alias("p")).select(key, F.round("p.xs", 6).alias("x"), F.round("p.ys", 6).alias("y")).distinct()
    centre = spots.groupBy(key).agg(F.avg("x").alias("__x"), F.avg("y").alias("__y"), F.count("*").alias("__n")).filter("__n >= 3")
    angle = F.atan2(F.col("y") - F.col("__y"), F.col("x") - F.col("__x"))
    return spots.join(centre, key).select(*([by] if by else []), "x", "y", angle.alias("angle"))


def complete_groups(tie: DataFrame, n_images: int) -> DataFrame:
    """Tie points that are marked in every image."""
    whole = tie.groupBy("point_id").agg(F.countDistinct("image_id").alias("__n")).filter(F.col("__n") == n_images)
    return tie.join(whole, "point_id", "left_semi")
