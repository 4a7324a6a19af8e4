"""Rasters as tiles: a row per tile, its cells in arrays.

Columns: the raster's key, tr and tc (the tile's number), row0 and col0 (its first
cell), height, width, and an array a value, row by row; unknown cells are null.  A
tile also holds the first HALO rows and columns of the tiles below and to its right,
so that a point finds all four cells around it in one tile.  A point so costs one
lookup by tile and four array reads, and neither it nor the raster is ever
multiplied; stored tiles need no shuffle to be made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoframe.functions.lineage import partitions

SIZE, HALO = 128, 1


def tile_of(at: Column, size: int = SIZE) -> Column:
    return F.floor(at / size).cast("int")


def from_cells(cells: DataFrame, by: str = "image_id", values: tuple = ("value",), size: int = SIZE, halo: int = HALO) -> DataFrame:
    """Cells (by, row, col and values) to tiles. A tile ends with its last cell; cells in between that are missing are null.

    Tiles are dealt to as many tasks as a shuffle has, whatever the size of their compressed
    cells: those of an even raster shrink to a hundredth, and some merged tasks would hold all of it.
    """
    c = F.col

    def homes(name: str) -> Column:
        own = tile_of(c(name), size)
        return F.when((c(name) % size < halo) & (own > 0), F.array(own - 1, own)).otherwise(F.array(own))

    rows = cells.select(by, "row", "col", *values).withColumn("tr", F.explode(homes("row"))).withColumn("tc", F.explode(homes("col")))
    rows = rows.repartition(partitions(cells.sparkSession), by, "tr", "tc")
    grouped = rows.groupBy(by, "tr", "tc").agg(F.sort_array(F.collect_list(F.struct("row", "col", *values))).alias("__cells"), F.max("row").alias("__row1"), F.max("col").alias("__col1"))
    sized = grouped.withColumns({"row0": c("tr") * size, "col0": c("tc") * size})
    sized = sized.withColumns({"height": c("__row1") - c("row0") + 1, "width": c("__col1") - c("col0") + 1})
    place = lambda e: (e["row"] - c("row0")) * c("width") + e["col"] - c("col0")
    count, held = c("height") * c("width"), c("__cells")
    kinds = dict(cells.dtypes)

    def array(value: str) -> Column:
        missing = lambda n: F.array_repeat(F.lit(None).cast(kinds[value]), n.cast("int"))
        spaced = F.transform(held, lambda e, i: F.concat(F.array(e[value]), missing(F.coalesce(place(F.get(held, i + 1)), count) - place(e) - 1)))
        return F.when(F.size(held) == count, F.transform(held, lambda e: e[value])).otherwise(F.concat(missing(place(held[0])), F.flatten(spaced)))

    return sized.select(by, "tr", "tc", "row0", "col0", "height", "width", *(array(v).alias(v) for v in values))


def _named(tiles: DataFrame, by: str, values: tuple) -> DataFrame:
    """Tiles with columns whose names no table of points has: __tile_row0 and so on."""
    return tiles.select(by, *(F.col(x).alias(f"__tile_{x}") for x in ("tr", "tc", "row0", "col0", "height", "width", *values)))


def _beside(points: DataFrame, tiles: DataFrame, by: str, values: tuple, row: Column, col: Column, size: int) -> DataFrame:
    """Points with the tile that holds the cell (row, col), or with nulls.

    Always a left join: Spark may send small tiles to all tasks, but never points, whose
    number it underrates where they are made of few rows.
    """
    return points.withColumns({"__tile_tr": tile_of(row, size), "__tile_tc": tile_of(col, size)}).join(_named(tiles, by, values), [by, "__tile_tr", "__tile_tc"], "left")


def _cell(value: str, row: Column, col: Column) -> Column:
    """The value of a cell, or null if the tile does not hold it."""
    r, c, width = row - F.col("__tile_row0"), col - F.col("__tile_col0"), F.col("__tile_width")
    inside = (r >= 0) & (r < F.col("__tile_height")) & (c >= 0) & (c < width)
    return F.when(inside, F.get(F.col(f"__tile_{value}"), (r * width + c).cast("int")))


def nearest(points: DataFrame, tiles: DataFrame, by: str = "image_id", values: tuple = ("value",), keep: bool = False, size: int = SIZE) -> DataFrame:
    """Adds the values of the cell at whole (row, col); points of which all values are unknown are left out, or kept with nulls."""
    j = _beside(points, tiles, by, values, F.col("row"), F.col("col"), size)
    read = j.select(*(F.col(x) for x in points.columns if x not in values), *(_cell(v, F.col("row"), F.col("col")).alias(v) for v in values))
    return read if keep else read.filter(F.coalesce(*values).isNotNull())


def bilinear(points: DataFrame, tiles: DataFrame, by: str = "image_id", values: tuple = ("value",), fill: float | None = None, shape: tuple[int, int] | None = None, size: int = SIZE) -> DataFrame:
    """Adds the values at fractional (row, col), which are in cell centres.

    The raster's height and width are columns of points, or one shape for all.  Its
    edge is repeated outwards; with fill, points off the raster get fill instead.
    Unknown cells add nothing; points all of whose cells are unknown are left out, or,
    with fill, get null.
    """
    height, width = (F.lit(n) for n in shape) if shape else (F.col("height"), F.col("width"))
    clamp = lambda v, n: F.least(F.greatest(v, F.lit(0)), n - 1).cast("int")
    r, c = F.floor("row"), F.floor("col")
    placed = points.withColumns({"__r0": clamp(r, height), "__r1": clamp(r + 1, height), "__c0": clamp(c, width), "__c1": clamp(c + 1, width)})
    j = _beside(placed, tiles, by, values, F.col("__r0"), F.col("__c0"), size)
    dr, dc = F.col("row") - r, F.col("col") - c  # reckoned after the join: shuffled, they would take as much as the place itself
    weights = [(1 - dr) * (1 - dc), (1 - dr) * dc, dr * (1 - dc), dr * dc]
    at = [(F.col(a), F.col(b)) for a in ("__r0", "__r1") for b in ("__c0", "__c1")]
    # the four parts are columns of their own, so that they are read once and not again in every expression after
    parts = {f"__part{k}_{v}": F.when(w != 0, w * _cell(v, *at[k])) for v in values for k, w in enumerate(weights)}
    kept = [F.col(x) for x in points.columns if x not in values]
    read = j.select(*kept, *(p.alias(name) for name, p in parts.items()))

    def total(value: str) -> Column:
        own = [F.col(f"__part{k}_{value}") for k in range(4)]
        return F.when(F.coalesce(*own).isNotNull(), sum((F.coalesce(p, F.lit(0.0)) for p in own[1:]), F.coalesce(own[0], F.lit(0.0))))

    found = read.select(*kept, *(total(v).alias(v) for v in values))
    if fill is None:
        return found.filter(F.coalesce(*values).isNotNull())
    inside = (F.col("row") >= 0) & (F.col("row") <= height - 1) & (F.col("col") >= 0) & (F.col("col") <= width - 1)
    return found.withColumns({v: F.when(inside, F.col(v)).otherwise(F.lit(float(fill))) for v in values})


def beside_lines(lines: DataFrame, tiles: DataFrame, by: str = "image_id", value: str = "value", size: int = SIZE) -> DataFrame:
    """Lines at a fractional row of a raster (columns height and width hold its extent) to a row a tile that they pass.

    Adds first (the tile's first column), and upper and lower: the tile's cells, its halo
    too, in the two rows that bilinear() reads, or null where it has none.  Lines meet
    tiles instead of points, and the tiles' arrays go no further.  Dealt to as many tasks as
    a shuffle has, by tile.
    """
    c = F.col
    clamp = lambda v: F.least(F.greatest(v, F.lit(0)), c("height") - 1).cast("int")
    across = lines.withColumns({"__r0": clamp(F.floor("row")), "__r1": clamp(F.floor("row") + 1)})
    across = across.withColumn("__tile_tr", tile_of(c("__r0"), size)).withColumn("__tile_tc", F.explode(F.sequence(F.lit(0), tile_of(c("width") - 1, size))))
    key = [by, "__tile_tr", "__tile_tc"]
    j = across.repartition(partitions(lines.sparkSession), *key).join(_named(tiles, by, (value,)), key, "left")
    at = {name: c(r) - c("__tile_row0") for name, r in (("upper", "__r0"), ("lower", "__r1"))}
    cut = {name: F.when((r >= 0) & (r < c("__tile_height")), F.slice(f"__tile_{value}", (r * c("__tile_width") + 1).cast("int"), c("__tile_width"))) for name, r in at.items()}
    return j.select(*lines.columns, (c("__tile_tc") * size).cast("int").alias("first"), *(x.alias(name) for name, x in cut.items()))


def cells_in(tiles: DataFrame, boxes: DataFrame, by: str = "image_id", values: tuple = ("value",), size: int = SIZE) -> DataFrame:
    """Cells with row0 <= row < row1 and col0 <= col < col1 of each raster's box, read from the tiles that the boxes touch. boxes may have more columns."""
    c = F.col
    more = [x for x in boxes.columns if x not in (by, "row0", "col0", "row1", "col1")]
    # boxes are cut to the tiles that their raster has: one may reach far beyond it, or have no raster at all
    extents = tiles.groupBy(by).agg(*(f(t).alias(f"__{k}_{t}") for t in ("tr", "tc") for k, f in (("low", F.min), ("high", F.max))))
    asked = boxes.filter("row0 < row1 AND col0 < col1 AND row1 > 0 AND col1 > 0").join(extents, by)
    for a, t in (("row", "tr"), ("col", "tc")):
        first, last = F.greatest(tile_of(c(f"{a}0"), size), c(f"__low_{t}")), F.least(tile_of(c(f"{a}1") - 1, size), c(f"__high_{t}"))
        asked = asked.filter(first <= last).withColumn(f"__tile_{t}", F.explode(F.sequence(first, last)))
    asked = asked.withColumnsRenamed({f"{a}{k}": f"__{a}_{k}" for a in ("row", "col") for k in (0, 1)})
    j = asked.join(_named(tiles, by, values), [by, "__tile_tr", "__tile_tc"])
    for a, extent in (("row", "height"), ("col", "width")):  # the tile's own cells, without its halo
        low = F.greatest(c(f"__tile_{a}0"), c(f"__{a}_0"))
        high = F.least(c(f"__tile_{a}0") + F.least(c(f"__tile_{extent}"), F.lit(size)), c(f"__{a}_1"))
        j = j.withColumns({f"__{a}low": low, f"__{a}high": high - 1}).filter(c(f"__{a}low") <= c(f"__{a}high"))
    lines = j.withColumn("row", F.explode(F.sequence("__rowlow", "__rowhigh")))
    # a line's cells are cut out of the arrays first, so that single cells do not carry a tile
    first = ((c("row") - c("__tile_row0")) * c("__tile_width") + c("__collow") - c("__tile_col0") + 1).cast("int")
    count = (c("__colhigh") - c("__collow") + 1).cast("int")
    cut = lines.select(by, *more, "row", "__collow", *(F.slice(f"__tile_{v}", first, count).alias(f"__{v}") for v in values))
    cells = cut.select(by, *more, "row", "__collow", F.posexplode(F.arrays_zip(*(F.col(f"__{v}") for v in values))).alias("__k", "__x"))
    return cells.select(by, *more, c("row").cast("int").alias("row"), (c("__collow") + c("__k")).cast("int").alias("col"), *(c("__x")[f"__{v}"].alias(v) for v in values))


def window(tiles: DataFrame, box: tuple[int, int, int, int], by: str = "image_id", values: tuple = ("value",), size: int = SIZE) -> DataFrame:
    """Cells of one box (row0, col0, row1, col1) of every raster; stored tiles are pruned by tr and tc."""
    row0, col0, row1, col1 = box
    near = tiles.filter(F.col("tr").between(row0 // size, (row1 - 1) // size) & F.col("tc").between(col0 // size, (col1 - 1) // size))
    whole = near.withColumns({"__row0": F.lit(row0), "__col0": F.lit(col0), "__row1": F.lit(row1), "__col1": F.lit(col1)})
    boxes = whole.select(by, F.col("__row0").alias("row0"), F.col("__col0").alias("col0"), F.col("__row1").alias("row1"), F.col("__col1").alias("col1")).distinct()
    return cells_in(near, boxes, by, values, size)

