"""Rasters in cell form: a row per cell with raster_id or image_id, row, col and values.

rasters holds a row per raster: raster_id, the geotransform a..f
(x = a col + b row + c, y = d col + e row + f), width, height, nodata.
Cell tables that are stored carry tr and tc (row and col div TILE), which are
written as partitions, so that a window reads its tiles only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoframe.functions import geo, ordered
from geoframe.functions.lineage import by_group
from geoframe.operators import tiles as tiled

TILE = 256
GEOTRANSFORM = ("a", "b", "c", "d", "e", "f")


def floor_div(value: Column, by: int | Column) -> Column:
    """Whole quotient of non-negative whole numbers."""
    return F.floor(value / by).cast("int")


def with_tiles(cells: DataFrame, size: int = TILE) -> DataFrame:
    return cells.withColumns({"tr": floor_div(F.col("row"), size), "tc": floor_div(F.col("col"), size)})


def read_window(cells: DataFrame, box: tuple[int, int, int, int]) -> DataFrame:
    """Cells with row0 <= row < row1 and col0 <= col < col1; prunes tiles where the table has tr and tc."""
    row0, col0, row1, col1 = box
    inside = (F.col("row") >= row0) & (F.col("row") < row1) & (F.col("col") >= col0) & (F.col("col") < col1)
    if {"tr", "tc"} <= set(cells.columns):
        inside &= F.col("tr").between(row0 // TILE, (row1 - 1) // TILE) & F.col("tc").between(col0 // TILE, (col1 - 1) // TILE)
    return cells.filter(inside)


def world_to_cell(points: DataFrame, rasters: DataFrame, whole: bool = True) -> DataFrame:
    """Adds row and col of (x, y); whole cells are cut towards zero, so that -0.x is cell 0."""
    j = points.join(rasters.select("raster_id", *GEOTRANSFORM), "raster_id")
    c = F.col
    det = c("a") * c("e") - c("b") * c("d")
    dx, dy = c("x") - c("c"), c("y") - c("f")
    col, row = (c("e") * dx - c("b") * dy) / det, (c("a") * dy - c("d") * dx) / det
    cast = (lambda v: v.cast("int")) if whole else (lambda v: v)
    return j.withColumns({"row": cast(row), "col": cast(col)}).select(*(x for x in points.columns if x not in ("row", "col")), "row", "col")


def cell_to_world(cells: DataFrame, rasters: DataFrame, centre: float = 0.5) -> DataFrame:
    """Adds x and y of each cell's centre."""
    j = cells.join(rasters.select("raster_id", *GEOTRANSFORM), "raster_id")
    c = F.col
    col, row = c("col") + centre, c("row") + centre
    return j.withColumns({"x": c("a") * col + c("b") * row + c("c"), "y": c("d") * col + c("e") * row + c("f")}).drop(*GEOTRANSFORM)


def panchromatic(pixels: DataFrame, bands: tuple = ("b1", "b2", "b3"), whole: bool = False) -> DataFrame:
    """Mean of the bands; whole numbers are cut like a cast to the source type."""
    mean = sum((F.col(b) for b in bands[1:]), F.col(bands[0])) / F.lit(float(len(bands)))
    return pixels.withColumn("pan", F.floor(mean).cast("double") if whole else mean).drop(*bands)


def _with_stats(df: DataFrame, by: str | None, aggregates: list[Column]) -> DataFrame:
    """Rows with statistics of their group; aggregated first, then joined (one row a group)."""
    if by is None:
        df, by = df.withColumn("__all", F.lit(1)), "__all"
    return by_group(df, df.groupBy(by).agg(*aggregates), by).drop("__all")


def scale_by_band_max(pixels: DataFrame, bands: tuple = ("b1", "b2", "b3"), by: str = "image_id") -> DataFrame:
    """255 v / largest of the band."""
    j = _with_stats(pixels, by, [F.max(b).alias(f"__{b}") for b in bands])
    return j.withColumns({b: F.lit(255.0) * F.col(b) / F.col(f"__{b}") for b in bands}).select(*pixels.columns)


def percent_stretch_u8(pixels: DataFrame, bands: tuple = ("b1", "b2", "b3"), lo: float = 2, hi: float = 98, nodata: float | None = None, by: str = "image_id") -> DataFrame:
    """Bands between their percentiles to 0..255, cut to whole numbers; nodata is 0, a band without spread 127."""
    value = {b: F.when(F.col(b) != nodata, F.col(b)) if nodata is not None else F.col(b) for b in bands}
    long_ = pixels.select(by, F.explode(F.array(*(F.struct(F.lit(b).alias("band"), value[b].cast("double").alias("v")) for b in bands))).alias("x")).select(by, "x.*")
    found = ordered.quantiles(long_, [by, "band"], "v", [lo / 100, hi / 100])
    limit = lambda b, k: F.max(F.when((F.col("band") == b) & (F.col("k") == k), F.col("value")))
    limits = found.groupBy(by).agg(*(limit(b, k).alias(f"__{b}{k}") for b in bands for k in (0, 1)))
    j, out = pixels.join(limits, by, "left"), {}
    for b in bands:
        low, high = F.col(f"__{b}0"), F.col(f"__{b}1")
        clipped = F.least(F.greatest(value[b], low), high)
        scaled = F.when(low == high, F.lit(127)).otherwise(F.floor(F.try_divide(clipped - low, high - low) * 255.0).cast("int"))
        out[b] = F.when(value[b].isNull(), F.lit(0)).otherwise(scaled)
    return j.withColumns(out).select(*pixels.columns)


def minmax_scale(df: DataFrame, cols: list[str], by: str | None = None) -> DataFrame:
    """(v - min) / (max - min), over all the columns together."""
    j = _with_stats(df, by, [F.least(*(F.min(c) for c in cols)).alias("__low") if len(cols) > 1 else F.min(cols[0]).alias("__low"), F.greatest(*(F.max(c) for c in cols)).alias("__high") if len(cols) > 1 else F.max(cols[0]).alias("__high")])
    return j.withColumns({c: F.try_divide(F.col(c) - F.col("__low"), F.col("__high") - F.col("__low")) for c in cols}).select(*df.columns)


#: Channel means and deviations that image encoders expect.
CHANNEL_MEAN, CHANNEL_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def normalize_channels(pixels: DataFrame, bands: tuple = ("b1", "b2", "b3"), mean: tuple = CHANNEL_MEAN, std: tuple = CHANNEL_STD) -> DataFrame:
    return pixels.withColumns({b: (F.col(b) / 255.0 - m) / s for b, m, s in zip(bands, mean, std, strict=True)})


def mask_nodata(cells: DataFrame, rasters: DataFrame, value: str = "value") -> DataFrame:
    """Nodata cells get a null value; a raster whose nodata is null has none."""
    j = cells.join(rasters.select("raster_id", "nodata"), "raster_id")
    return j.withColumn(value, F.when(F.col("nodata").isNull() | (F.col(value) != F.col("nodata")), F.col(value))).select(*cells.columns)


def inside_raster(df: DataFrame, rasters: DataFrame) -> DataFrame:
    """Rows whose cell is inside their raster."""
    j = df.join(rasters.select("raster_id", "width", "height"), "raster_id")
    return j.filter("row >= 0 AND row < height AND col >= 0 AND col < width").select(*df.columns)


def lookup(points: DataFrame, cells: DataFrame, by: str = "image_id", value: str = "value", name: str = "value", strict: bool = False) -> DataFrame:
    """Value of the cell at (line, samp); points off the raster are left out, or, if strict, fail the job."""
    read = cells.select(by, F.col("row").alias("line"), F.col("col").alias("samp"), F.col(value).alias(name))
    if not strict:
        return points.join(read, [by, "line", "samp"])
    j = points.join(read.withColumn("__there", F.lit(True)), [by, "line", "samp"], "left")
    place = F.concat_ws(", ", *(F.col(c).cast("string") for c in (by, "line", "samp")))
    return j.filter(F.coalesce(F.col("__there"), F.raise_error(F.concat(F.lit("no cell at "), place)).cast("boolean"))).drop("__there")


def sample_nearest(points: DataFrame, cells: DataFrame, rasters: DataFrame, keep: bool = False) -> DataFrame:
    """Adds the valid value of the cell under (x, y); points off the raster or on nodata are left out, or kept with null."""
    placed = world_to_cell(points, rasters)
    read = tiled.nearest(placed if keep else inside_raster(placed, rasters), tiled.from_cells(mask_nodata(cells, rasters), "raster_id"), "raster_id", keep=keep)
    return read.select(*points.columns, "value")


def sample_bilinear(points: DataFrame, cells: DataFrame, by: str = "image_id", fill: float | None = None, value: str = "value", shape: tuple[int, int] | None = None) -> DataFrame:
    """Adds the value at fractional (row, col), which are in cell centres; see tiles.bilinear."""
    return tiled.bilinear(points, tiled.from_cells(cells, by, (value,)), by, (value,), fill, shape)


def sample_align_corners(points: DataFrame, cells: DataFrame, shape: tuple[int, int], by: str = "image_id", value: str = "value") -> DataFrame:
    """Value at (row, col) of a grid as tall and wide as the raster, mapped so that first and last positions are cell centres."""
    h, w = shape
    placed = points.withColumns({"__row": F.col("row"), "__col": F.col("col"), "row": F.col("row") * F.lit((h - 1) / h), "col": F.col("col") * F.lit((w - 1) / w)})
    read = sample_bilinear(placed, cells, by, None, value, shape)
    return read.withColumns({"row": F.col("__row"), "col": F.col("__col")}).select(*points.columns, value)


def gather(targets: DataFrame, cells: DataFrame, by: str = "image_id", value: str = "value", shape: tuple[int, int] | None = None) -> DataFrame:
    """Bilinear value of each target at fractional (row, col); 0 off the raster."""
    return sample_bilinear(targets, cells, by, 0.0, value, shape)


#: The coordinate systems that rasters may be in. A raster without crs is in geographic coordinates.
GEOGRAPHIC, MERCATOR = "EPSG:4326", "EPSG:3857"


def converted(points: DataFrame, source: Column, target: Column) -> DataFrame:
    """x, y of each point from one coordinate system to the other; an unknown system is an error."""
    source, target = (F.coalesce(v, F.lit(GEOGRAPHIC)) for v in (source, target))
    known = source.isin(GEOGRAPHIC, MERCATOR) & target.isin(GEOGRAPHIC, MERCATOR)
    x, y = F.col("x"), F.col("y")
    to_metres, to_degrees = (source == GEOGRAPHIC) & (target == MERCATOR), (source == MERCATOR) & (target == GEOGRAPHIC)
    refuse = F.raise_error(F.concat(F.lit("no conversion between "), source, F.lit(" and "), target)).cast("double")
    return points.withColumns({
        "x": F.when(~known, refuse).when(to_metres, geo.mercator_x(x)).when(to_degrees, geo.mercator_lon(x)).otherwise(x),
        "y": F.when(to_metres, geo.mercator_y(y)).when(to_degrees, geo.mercator_lat(y)).otherwise(y),
    })


def add_regridded(dem: DataFrame, other: DataFrame, rasters: DataFrame, other_id: str) -> DataFrame:
    """dem plus another raster read bilinearly at each valid cell's centre; nodata stays.

    rasters may have a column crs: a raster in another coordinate system than the
    cell's own is read at the converted place.
    """
    systems = rasters if "crs" in rasters.columns else rasters.withColumn("crs", F.lit(GEOGRAPHIC))
    info = systems.filter(F.col("raster_id") == other_id)
    at = cell_to_world(dem, rasters).withColumns({"__id": F.col("raster_id"), "__row": F.col("row"), "__col": F.col("col"), "__value": F.col("value")})
    at = at.join(systems.select("raster_id", F.col("crs").alias("__from")), "raster_id").withColumn("raster_id", F.lit(other_id)).drop("value", "row", "col")
    at = at.join(info.select("raster_id", "height", "width", F.col("crs").alias("__to")), "raster_id")
    placed = world_to_cell(converted(at, F.col("__from"), F.col("__to")), info, whole=False).withColumns({"row": F.col("row") - 0.5, "col": F.col("col") - 0.5})
    # every cell is read, those off the raster at its edge; a cell without a value has null
    clamped = placed.withColumns({x: F.least(F.greatest(x, F.lit(0.0)), (F.col(n) - 1).cast("double")) for x, n in (("row", "height"), ("col", "width"))})
    read = tiled.bilinear(clamped, tiled.from_cells(other, "raster_id"), "raster_id", fill=0.0)
    moved = read.withColumnsRenamed({"value": "__add"}).withColumns({"raster_id": F.col("__id"), "row": F.col("__row"), "col": F.col("__col"), "value": F.col("__value")})
    known = mask_nodata(moved.withColumn("__known", F.col("value")), rasters, "__known")
    summed = F.when(F.col("__known").isNotNull(), F.col("value") + F.coalesce("__add", F.lit(0.0))).otherwise(F.col("value"))
    return known.withColumn("value", summed).select(*dem.columns)


def whole_multiples(boxes: DataFrame, multiple: int = 16) -> DataFrame:
    """Boxes row0, col0, row1, col1 cut to a multiple of rows and columns about their middle."""
    for x in ("row", "col"):
        low, extent = F.col(f"{x}0"), F.col(f"{x}1") - F.col(f"{x}0")
        whole = F.floor(extent / multiple) * multiple
        start = (low + F.floor((extent - whole) / 2)).cast("int")
        boxes = boxes.withColumns({f"{x}0": start, f"{x}1": (start + whole).cast("int")})
    return boxes


def crop(cells: DataFrame, boxes: DataFrame, multiple: int = 16, by: str = "image_id") -> DataFrame:
    """Cells within each image's box (row0, col0, row1, col1), cut to a multiple of 16 rows and columns about its middle; renumbered from 0."""
    c = F.col
    box = whole_multiples(boxes, multiple).select(by, *(c(f"{x}{k}").alias(f"__{x}{k}") for x in ("row", "col") for k in (0, 1)))
    inside = [(c(x) >= c(f"__{x}0")) & (c(x) < c(f"__{x}1")) for x in ("row", "col")]
    return cells.join(box, by).filter(inside[0] & inside[1]).withColumns({x: c(x) - c(f"__{x}0") for x in ("row", "col")}).select(*cells.columns)


def crop_tiles(tiles: DataFrame, boxes: DataFrame, multiple: int = 16, by: str = "image_id", values: tuple = ("value",)) -> DataFrame:
    """crop() of tiles: only those that the boxes touch are read."""
    box = whole_multiples(boxes.select(by, "row0", "col0", "row1", "col1"), multiple).withColumns({"__row": F.col("row0"), "__col": F.col("col0")})
    read = tiled.cells_in(tiles, box, by, values)
    return read.withColumns({"row": F.col("row") - F.col("__row"), "col": F.col("col") - F.col("__col")}).select(by, "row", "col", *values)


def homography(quads: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """Eight coefficients h0..h7 that take target (u, v) in the unit square to source (x, y), in closed form.

    quads: quad_id and corners tl, tr, br, bl as x0, y0 .. x3, y3.
    """
    c = F.col
    dx1, dx2, dx3 = c("x1") - c("x2"), c("x3") - c("x2"), c("x0") - c("x1") + c("x2") - c("x3")
    dy1, dy2, dy3 = c("y1") - c("y2"), c("y3") - c("y2"), c("y0") - c("y1") + c("y2") - c("y3")
    det = dx1 * dy2 - dx2 * dy1
    df = quads.withColumns({"h6": (dx3 * dy2 - dx2 * dy3) / det, "h7": (dx1 * dy3 - dx3 * dy1) / det})
    return df.withColumns({
        "h0": c("x1") - c("x0") + c("h6") * c("x1"), "h1": c("x3") - c("x0") + c("h7") * c("x3"), "h2": c("x0") * F.lit(1.0),
        "h3": c("y1") - c("y0") + c("h6") * c("y1"), "h4": c("y3") - c("y0") + c("h7") * c("y3"), "h5": c("y0") * F.lit(1.0),
    })


def quad_points(quads: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """A row per target cell (trow, tcol) of each quad with its source position x, y; corners meet corners."""
    h, w = shape
    c = F.col
    keys = [x for x in quads.columns if x not in {f"{a}{k}" for a in "xy" for k in range(4)}]
    df = homography(quads, shape).withColumn("trow", F.explode(F.sequence(F.lit(0), F.lit(h - 1)))).withColumn("tcol", F.explode(F.sequence(F.lit(0), F.lit(w - 1))))
    df = df.withColumns({"u": c("tcol") / F.lit(float(max(w - 1, 1))), "v": c("trow") / F.lit(float(max(h - 1, 1)))})
    z = c("h6") * c("u") + c("h7") * c("v") + 1
    return df.select(*keys, "trow", "tcol", ((c("h0") * c("u") + c("h1") * c("v") + c("h2")) / z).alias("x"), ((c("h3") * c("u") + c("h4") * c("v") + c("h5")) / z).alias("y"))


def resample_quad(cells: DataFrame, quads: DataFrame, shape: tuple[int, int], source_shape: tuple[int, int], by: str = "image_id", value: str = "value") -> DataFrame:
    """Each quad of its image resampled to shape, bilinear with repeated edge; also the source row and col of each target cell."""
    at = quad_points(quads, shape).withColumnsRenamed({"x": "col", "y": "row"})
    return sample_bilinear(at, cells, by, None, value, source_shape)


def block_mean(cells: DataFrame, n: int, by: str = "image_id", value: str = "value") -> DataFrame:
    """Mean of n x n blocks; partial blocks are left out."""
    return _blocks(cells, n, by).agg(F.avg(value).alias(value), F.count("*").alias("__n")).filter(F.col("__n") == n * n).drop("__n")


def _blocks(cells: DataFrame, n: int, by: str):  # noqa: ANN202
    return cells.groupBy(by, floor_div(F.col("row"), n).alias("row"), floor_div(F.col("col"), n).alias("col"))


def block_nan(cells: DataFrame, k: int, how: str = "mean", by: str = "image_id", value: str = "value") -> DataFrame:
    """Mean or median of the known values of whole k x k blocks."""
    known = F.nanvl(F.col(value).cast("double"), F.lit(None))
    agg = F.avg(known) if how == "mean" else F.median(known)
    return _blocks(cells, k, by).agg(agg.alias(value), F.count("*").alias("__n")).filter(F.col("__n") == k * k).drop("__n")


def block_nan_padded(cells: DataFrame, k: int, fill: float = -1.0, by: str = "image_id", value: str = "value") -> DataFrame:
    """Mean of the known values of k x k blocks, partial ones included; fill where none is known."""
    known = F.nanvl(F.col(value).cast("double"), F.lit(None))
    return _blocks(cells, k, by).agg(F.coalesce(F.avg(known), F.lit(fill)).alias(value))


def block_centre(cells: DataFrame, ds: int, by: str = "image_id", value: str = "value") -> DataFrame:
    """Value at the centre of whole ds x ds blocks: the middle cell, or the mean of the four around it."""
    middle = {(ds - 1) // 2, ds // 2}
    n = len(middle) ** 2
    own = cells.filter((F.col("row") % ds).isin(middle) & (F.col("col") % ds).isin(middle))
    full = _blocks(cells, ds, by).agg(F.count("*").alias("__n")).filter(F.col("__n") == ds * ds).drop("__n")
    return _blocks(own, ds, by).agg((F.sum(value) / n).alias(value)).join(full, [by, "row", "col"], "left_semi")


def decimate(cells: DataFrame, f: int) -> DataFrame:
    """Every f-th row and column."""
    own = cells.filter((F.col("row") % f == 0) & (F.col("col") % f == 0))
    return own.withColumns({"row": floor_div(F.col("row"), f), "col": floor_div(F.col("col"), f)})


def _cubic(t: float, a: float = -0.75) -> float:
    t = abs(t)
    return ((a + 2) * t - (a + 3)) * t * t + 1 if t <= 1 else (((t - 5) * t + 8) * t - 4) * a if t < 2 else 0.0


def _axis_taps(name: str, n: int, offsets: list[tuple[int, float]], f: int, border: str) -> Column:
    """For target position t: source positions floor(centre) + offset with weights, kept inside by the border rule."""
    base = F.floor((F.col(f"t{name}") + 0.5) * f - 0.5).cast("int")
    taps = []
    for k, w in offsets:
        p = base + k
        p = F.least(F.greatest(p, F.lit(0)), F.lit(n - 1)) if border == "edge" else F.when(p < 0, -p - 1).when(p >= n, 2 * n - 1 - p).otherwise(p)
        taps.append(F.struct(p.alias(name), F.lit(float(w)).alias("w")))
    return F.array(*taps)


def _separable(cells: DataFrame, shape: tuple[int, int], f: int, weights: list[tuple[int, float]], border: str, by: str, value: str) -> DataFrame:
    """One axis after the other: taps joined to cells, weighted sums by target."""
    now = cells.select(by, "row", "col", F.col(value).alias("__v"))
    for axis, other, n in (("row", "col", shape[0]), ("col", "row", shape[1])):
        target = now.sparkSession.range(n // f).select(F.col("id").cast("int").alias(f"t{axis}"))
        taps = target.withColumn("__t", F.explode(_axis_taps(axis, n, weights, f, border))).select(f"t{axis}", F.col(f"__t.{axis}").alias(axis), F.col("__t.w").alias("__w"))
        sums = now.join(taps, axis).groupBy(by, f"t{axis}", other).agg(F.sum(F.col("__w") * F.col("__v")).alias("__v"))
        now = sums.withColumnRenamed(f"t{axis}", axis)
    return now.select(by, "row", "col", F.col("__v").alias(value))


def resize(cells: DataFrame, f: int, method: str, shape: tuple[int, int], by: str = "image_id", value: str = "value") -> DataFrame:
    """To shape // f with half-pixel centres, bilinear or bicubic; the edge is repeated. shape: a multiple of f."""
    at = 0.5 * f - 0.5
    frac = at - math.floor(at)
    offsets = [(0, 1 - frac), (1, frac)] if method == "bilinear" else [(k, _cubic(k - frac)) for k in range(-1, 3)]
    return _separable(cells, shape, f, [x for x in offsets if x[1]], "edge", by, value)


def gaussian_decimate(cells: DataFrame, f: int, shape: tuple[int, int], by: str = "image_id", value: str = "value") -> DataFrame:
    """Blur with sigma f/2 (borders reflected, edge cells twice), then every f-th row and column."""
    sigma = 0.5 * f
    reach = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    # position t f, while _axis_taps starts at floor((t + 0.5) f - 0.5) = t f + floor(0.5 f - 0.5)
    shift = math.floor(0.5 * f - 0.5)
    return _separable(cells, shape, f, [(k - shift, x / sum(w)) for k, x in zip(range(-reach, reach + 1), w, strict=True)], "reflect", by, value)


def local_mean(cells: DataFrame, n: int, by: str = "image_id", value: str = "value") -> DataFrame:
    """Mean of n x n blocks, cut to whole numbers."""
    return block_mean(cells, n, by, value).withColumn(value, F.floor(value).cast("int"))


def stats(cells: DataFrame, by: str, value: str = "value") -> DataFrame:
    """Mean, least and largest known value."""
    return cells.groupBy(by).agg(F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))


def numbered_rows(df: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))
