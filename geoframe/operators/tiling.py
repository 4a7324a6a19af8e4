"""Tables made by rule: grids, windows, coordinates, crops and parameter sweeps.

Pseudo-random values are hashes of the row's keys and a seed, so that runs agree.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoframe.functions.draws import uniform
from geoframe.functions.lineage import by_group


def _count(n: Column) -> Column:
    """0 .. n - 1, none for n < 1."""
    return F.filter(F.sequence(F.lit(0), F.greatest(n.cast("int"), F.lit(1)) - 1), lambda k: k < n)


def grids(rect: DataFrame, size: float, limit: int | None = None) -> DataFrame:
    """Squares of side `size` from the top left of left, right, top, bottom, numbered down the columns; with the map to [-1, 1] widened by a tenth."""
    c = F.col
    df = rect.withColumns({"__cols": F.floor((c("right") - c("left")) / size), "__rows": F.floor((c("top") - c("bottom")) / size)})
    df = df.withColumn("i", F.explode(_count(c("__cols")))).withColumn("j", F.explode(_count(c("__rows"))))
    df = df.select((c("i") * c("__rows") + c("j")).cast("int").alias("grid_id"), (c("left") + c("i") * F.lit(float(size))).alias("x0"), (c("top") - c("j") * F.lit(float(size))).alias("y0"))
    df = df.withColumns({"x1": c("x0") + F.lit(float(size)), "y1": c("y0") - F.lit(float(size))})
    return df if limit is None else df.filter(c("grid_id") < limit)


def with_linear_maps(df: DataFrame) -> DataFrame:
    """Adds cx and cy: degree-one maps from [-1, 1] to each grid's extent, widened by a fifth."""
    c = F.col
    return df.withColumns({f"c{a}": F.array(F.lit(0.6) * F.abs(c(f"{a}1") - c(f"{a}0")), (c(f"{a}0") + c(f"{a}1")) / 2) for a in "xy"})


def crop_windows(images: DataFrame, crop: int, step: int | None = None, random_ratio: float = 1.0, seed: int = 0) -> DataFrame:
    """Crop positions of each image (image_id, height, width): a regular raster snapped to the far edges, mirrored in turn, and random ones.

    Columns: window_id, row, col, flip_cols (odd row number), flip_rows (odd counter), random.
    """
    c = F.col
    s = F.lit(step) if step else F.greatest(F.floor(F.sqrt((c("height") - crop) * (c("width") - crop) / 150.0)), F.lit(1))
    df = images.select("image_id", "height", "width").withColumn("s", s)
    steps = lambda n: F.greatest(F.ceil((n - crop) / c("s")), F.lit(0))
    df = df.withColumns({"nr": steps(c("height")), "nc": steps(c("width"))}).withColumn("r", F.explode(_count(c("nr")))).withColumn("q", F.explode(_count(c("nc"))))
    last_row, last_col = c("r") == c("nr") - 1, c("q") == c("nc") - 1
    row = F.when(last_row, c("height") - crop).otherwise(c("r") * c("s"))
    col = F.when(last_col & ~last_row, c("width") - crop).otherwise(c("q") * c("s"))
    regular = df.select("image_id", "height", "width", (c("r") * c("nc") + c("q")).cast("int").alias("window_id"), row.cast("int").alias("row"), col.cast("int").alias("col"), (c("r") % 2 == 1).alias("flip_cols"), ((c("r") * (c("nc") - 1) + c("q")) % 2 == 1).alias("flip_rows"), F.lit(False).alias("random"), "nr", "nc")
    n = F.floor(c("nr") * c("nc") * F.lit(float(random_ratio)))
    per_image = regular.filter("window_id = 0").select("image_id", "height", "width", (c("nr") * c("nc")).alias("base"), n.alias("n")).withColumn("k", F.explode(_count(c("n"))))
    draw = lambda name, extent: F.floor(uniform("image_id", "k", F.lit(name), F.lit(seed)) * (c(extent) - crop + 1)).cast("int")
    extra = per_image.select("image_id", (c("base") + c("k")).cast("int").alias("window_id"), draw("row", "height").alias("row"), draw("col", "width").alias("col"), F.lit(False).alias("flip_cols"), F.lit(False).alias("flip_rows"), F.lit(True).alias("random"))
    return regular.drop("nr", "nc", "height", "width").unionByName(extra)


def coordinates(images: DataFrame, n: int = 0) -> DataFrame:
    """Every cell (row, col) of each image; with n, the mean coordinate of whole n x n blocks."""
    c = F.col
    if not n:
        return images.withColumn("row", F.explode(_count(c("height")))).withColumn("col", F.explode(_count(c("width")))).select("image_id", "row", "col")
    blocks = images.withColumn("i", F.explode(_count(F.floor(c("height") / n)))).withColumn("j", F.explode(_count(F.floor(c("width") / n))))
    return blocks.select("image_id", "i", "j", (c("i") * n + (n - 1) / 2).alias("row"), (c("j") * n + (n - 1) / 2).alias("col"))


def blocks(images: DataFrame, size: int) -> DataFrame:
    """Block tiles of each image, cut at its edges."""
    c = F.col
    df = images.withColumn("tr", F.explode(_count(F.ceil(c("height") / size)))).withColumn("tc", F.explode(_count(F.ceil(c("width") / size))))
    return df.select("image_id", "tr", "tc", (c("tr") * size).alias("row0"), (c("tc") * size).alias("col0"), F.least((c("tr") + 1) * size, c("height")).alias("row1"), F.least((c("tc") + 1) * size, c("width")).alias("col1"))


def overlapping_crops(pairs: DataFrame, k: int, min_side: int, seed: int = 0, max_side: int | None = None) -> DataFrame:
    """k pairs of square crops of each pair_id (height, width), whose common part has a side of at least half the smaller one; all inside the image."""
    c = F.col
    draw = lambda name, low, high: (low + F.floor(uniform("pair_id", "k", F.lit(name), F.lit(seed)) * (high - low + 1))).cast("int")
    most = F.least(c("height"), c("width"), *([F.lit(max_side)] if max_side else []))
    df = pairs.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("most", most)
    df = df.withColumns({f"side{m}": draw(f"side{m}", F.lit(min_side), c("most")) for m in (1, 2)})
    df = df.withColumn("small", F.least("side1", "side2")).withColumn("overlap", draw("overlap", F.ceil(c("small") / 2), c("small")))
    for axis, extent in (("row", "height"), ("col", "width")):
        # the common square first, then each crop around it
        df = df.withColumn(f"o{axis}", draw(f"o{axis}", F.lit(0), c(extent) - c("overlap")))
        for m in (1, 2):
            low = F.greatest(c(f"o{axis}") + c("overlap") - c(f"side{m}"), F.lit(0))
            high = F.least(c(f"o{axis}"), c(extent) - c(f"side{m}"))
            df = df.withColumn(f"{axis}{m}", draw(f"{axis}{m}", low, high))
    return df.select("pair_id", "k", *(f"{x}{m}" for m in (1, 2) for x in ("row", "col", "side")), F.col("orow").alias("overlap_row"), F.col("ocol").alias("overlap_col"), "overlap")


def mirrored_points(images: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n points of each image (image_id, height, width): a quarter random, the others their mirrors about the centre lines."""
    c = F.col
    df = images.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n // 4 - 1))))
    df = df.withColumns({"line": uniform("image_id", "k", F.lit("line"), F.lit(seed)) * (c("height") - 1), "samp": uniform("image_id", "k", F.lit("samp"), F.lit(seed)) * (c("width") - 1)})
    flips = F.explode(F.array(*(F.struct(F.lit(m).alias("mirror"), F.lit(bool(m & 1)).alias("fl"), F.lit(bool(m & 2)).alias("fs")) for m in range(4))))
    df = df.withColumn("m", flips)
    return df.select("image_id", (c("k") * 4 + c("m.mirror")).alias("query_id"), F.when(c("m.fl"), c("height") - 1 - c("line")).otherwise(c("line")).alias("line"), F.when(c("m.fs"), c("width") - 1 - c("samp")).otherwise(c("samp")).alias("samp"))


def rotated_squares(images: DataFrame, size: int, max_angle: float = 5.0, margin: int = 0, seed: int = 0) -> DataFrame:
    """A square of each image (image_id, height, width) turned by up to max_angle degrees: corners x0, y0 .. x3, y3 (tl, tr, br, bl) and the affine from square to image positions."""
    c = F.col
    reach = size * (math.cos(math.radians(max_angle)) + math.sin(math.radians(max_angle))) / 2 + margin
    df = images.withColumn("angle", F.radians((uniform("image_id", F.lit("angle"), F.lit(seed)) * 2 - 1) * max_angle))
    centre = lambda name, extent: F.lit(reach) + uniform("image_id", F.lit(name), F.lit(seed)) * (c(extent) - 1 - 2 * reach)
    df = df.withColumns({"cy": centre("row", "height"), "cx": centre("col", "width"), "co": F.cos("angle"), "si": F.sin("angle")})
    half, out = size / 2, {}
    for k, (u, v) in enumerate(((-half, -half), (half, -half), (half, half), (-half, half))):
        out |= {f"x{k}": c("cx") + u * c("co") - v * c("si"), f"y{k}": c("cy") + u * c("si") + v * c("co")}
    back = {"a00": c("co"), "a01": c("si"), "a10": -c("si"), "a11": c("co"), "a02": c("cy") - half * c("co") - half * c("si"), "a12": c("cx") + half * c("si") - half * c("co")}
    return df.withColumns(out | back).select("image_id", F.degrees("angle").alias("angle"), *out, *back)


def view_windows(images: DataFrame, k: int, provider: Callable[[DataFrame, int], DataFrame] | None = None, size: int = 300) -> DataFrame:
    """The k-th viewing window of each image (image_id, height, width); a provider(images, k) may replace the rule."""
    if provider:
        return provider(images, k)
    at = lambda extent: F.when(F.col(extent) > size, F.pmod(F.lit(k * 100), F.greatest(F.col(extent) - size, F.lit(1)))).otherwise(F.lit(0)).cast("int")
    df = images.withColumns({"row0": at("height"), "col0": at("width")})
    return df.select("image_id", "row0", "col0", F.least(F.col("row0") + size, F.col("height")).cast("int").alias("row1"), F.least(F.col("col0") + size, F.col("width")).cast("int").alias("col1"))


def sweep(spark: SparkSession, **params: list) -> DataFrame:
    """A row for every combination of parameters."""
    names = list(params)
    df = spark.range(1).select(*(F.array(*(F.lit(v) for v in params[n])).alias(n) for n in names))
    for n in names:
        df = df.withColumn(n, F.explode(n))
    return df


def drop_margin(df: DataFrame, extents: DataFrame, frac: float = 0.1, by: str = "image_id") -> DataFrame:
    """Points strictly inside the middle of their image's range of line and samp (line0, line1, samp0, samp1)."""
    j = by_group(df, extents, by)
    inside = F.lit(True)
    for a in ("line", "samp"):
        low, high = F.col(f"{a}0"), F.col(f"{a}1")
        inside &= (F.col(a) > low + frac * (high - low)) & (F.col(a) < high - frac * (high - low))
    return j.filter(inside).select(*df.columns)


def inside_grid(df: DataFrame, grids_: DataFrame, by: str = "grid_id") -> DataFrame:
    """Points in their grid's extent, borders included."""
    j = df.join(grids_.select(by, "x0", "y0", "x1", "y1"), by)
    return j.filter("x BETWEEN x0 AND x1 AND y BETWEEN y1 AND y0").select(*df.columns)


def in_both_crops(cells: DataFrame, crops: DataFrame) -> DataFrame:
    """Cells of a pair in both crops (row1, col1, side1, row2, col2, side2) whose residuals are known."""
    j = cells.join(crops, "pair_id")
    inside = F.lit(True)
    for m in (1, 2):
        for a in ("row", "col"):
            inside &= (F.col(a) >= F.col(f"{a}{m}")) & (F.col(a) < F.col(f"{a}{m}") + F.col(f"side{m}"))
    known = F.nanvl("res1", F.lit(None)).isNotNull() & F.nanvl("res2", F.lit(None)).isNotNull()
    return j.filter(inside & known)
