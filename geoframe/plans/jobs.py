"""Jobs: the operators chained into what a user runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoframe.functions import geo
from geoframe.functions.lineage import by_group, by_written_group, checkpointed, sent_if_few
from geoframe.operators import fit, metrics, neighbors, overlap, raster, sensor, tiles, tiling

Predictor = Callable[[pd.DataFrame], pd.DataFrame]


def tie_point_distances(tie: DataFrame, dem: DataFrame, models: DataFrame) -> DataFrame:
    """Ground distances between each tie point's positions from every two images."""
    return metrics.pair_distances(sensor.image_to_object(raster.lookup(tie, dem, name="h"), models))


def check_error(tie: DataFrame, dem: DataFrame, models: DataFrame) -> DataFrame:
    """Accuracy of the models: a row of median, mean, largest, least distance and shares under 0.5, 1 and 3 m."""
    return metrics.summary(tie_point_distances(tie, dem, models))


def transfer_tie_points(tie: DataFrame, dem: DataFrame, models: DataFrame, src: int, dst: int) -> DataFrame:
    """Tie points of image src at their place in image dst, cut to whole cells."""
    ground = sensor.image_to_object(raster.lookup(tie.filter(F.col("image_id") == src), dem, name="h"), models).select("point_id", F.lit(dst).alias("image_id"), "lat", "lon", "h")
    moved = sensor.object_to_image(ground, models)
    return moved.select("image_id", "point_id", F.col("line").cast("int").alias("line"), F.col("samp").cast("int").alias("samp"))


def build_patches(windows: DataFrame, dem: DataFrame, models: DataFrame, conf: DataFrame, crop: int, size: int = 16, thr: float = 0.7, budget: int | None = None, seed: int = 0) -> DataFrame:
    """Patches of size x size cells of each window: centre, mean height, confidence (above thr) and ground position.

    windows: image_id, window_id, row, col.  conf: image_id, window_id, i, j, conf.
    """
    c, n = F.col, crop // size
    grid = windows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    sure = fit.keep_confident(grid.join(conf, ["image_id", "window_id", "i", "j"]), thr)
    cells = sure.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    key = ["image_id", "window_id", "i", "j"]
    at = cells.select(*key, "conf", (c("row") + c("i") * size + c("a")).alias("row"), (c("col") + c("j") * size + c("b")).alias("col"))
    means = at.join(dem.select("image_id", "row", "col", "value"), ["image_id", "row", "col"]).groupBy(*key, "conf").agg(F.avg("row").alias("line"), F.avg("col").alias("samp"), F.avg("value").alias("h"), F.count("*").alias("__n"))
    patches = means.filter(F.col("__n") == size * size).drop("__n")
    if budget is not None:
        patches = fit.budget_sample(patches.withColumn("patch_id", F.struct(*key)), "image_id", budget, seed).drop("patch_id")
    return sensor.image_to_mercator(patches, models)


def predict_ground(patches: DataFrame, grids: DataFrame, predictor: Predictor, by: str = "grid_id") -> DataFrame:
    """Ground x, y, h of each patch: the predictor gives normalized values (columns x, y, h, and conf if patches have none) for pandas batches, the grid's polynomials take them to the ground."""
    plain = patches.drop("x", "y", "h")
    given = ("x", "y", "h") if "conf" in plain.columns else ("x", "y", "h", "conf")
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema), *(f"{k} double" for k in given)])

    def predict(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            made = predictor(pdf)
            yield pdf.assign(**{k: made[k] for k in given})

    return geo.warp_by_poly(plain.mapInPandas(predict, fields), grids, by)


def _models_of(models: DataFrame, patches: DataFrame) -> DataFrame:
    """The models of the images that have patches: where they are few, patches stay where they are, and no task gets all those of an image."""
    return sent_if_few(checkpointed(models.join(patches.select("image_id").distinct(), "image_id", "left_semi")))


def _as_correspondences(predicted: DataFrame, models: DataFrame) -> DataFrame:
    """Patches with predicted ground positions to pairs of where they are and where the model puts the prediction, without features."""
    local = predicted.drop("feature").withColumnsRenamed({"line": "l_line", "samp": "l_samp"})
    return sensor.mercator_to_image(local, models).withColumnsRenamed({"line": "t_line", "samp": "t_samp"})


def _update_affine(models: DataFrame, fitted: DataFrame) -> DataFrame:
    """models whose affine correction comes after the fitted map; models without a fit stay."""
    done = geo.compose_affine(fitted, models).select("image_id", *(F.col(c).alias(f"n{c}") for c in geo.AFFINE))
    j = models.join(done, "image_id", "left")
    return j.withColumns({c: F.coalesce(f"n{c}", c) for c in geo.AFFINE}).select(*models.columns)


def adjust_images(patches: DataFrame, grids: DataFrame, predictor: Predictor, models: DataFrame, **options: object) -> DataFrame:
    """models with their affine corrections refitted to the grids' predictions of all images."""
    return _update_affine(models, fit.robust_affine(_as_correspondences(predict_ground(patches, grids, predictor), _models_of(models, patches)), **options))


def cross_element_pairs(patches: DataFrame, grids: DataFrame, predictor: Predictor, placed: DataFrame | None = None) -> DataFrame:
    """Patches (or those placed alone) of every image of a grid with the predictions of every other image of that grid (columns other, x, y, h)."""
    images = patches.select("grid_id", F.col("image_id").alias("other")).distinct()
    crossed = by_group(patches if placed is None else placed, images, "grid_id").filter(overlap.exclude_self("image_id", "other"))
    return predict_ground(crossed, grids, predictor)


def element_correspondences(positions: DataFrame, patches: DataFrame, elements: DataFrame, predictor: Predictor, models: DataFrame, k: int = 4, limit: float = 64.0, margin: float = 0.1, conf_thr: float = 0.5) -> DataFrame:
    """Where every other element of a grid puts an element's positions, as correspondences (other, l_line, l_samp, t_line, t_samp, conf).

    A position's feature and conf are inverse-distance means of the k nearest patches
    of its own element; positions with fewer within limit are left out, as are those in
    the margin of the element and those whose conf is at most conf_thr.  The other
    element's predictor and polynomials (elements: image_id, cx, cy, ch) take it to the
    ground, the element's own model back into its image.

    positions: grid_id, image_id, query_id, line, samp.  patches: grid_id, image_id,
    patch_id, line, samp, conf, feature.
    """
    own = ("grid_id", "image_id")
    means = neighbors.knn_idw(positions, patches, k, limit, values=("conf",), arrays=("feature",), by=own)
    extents = patches.groupBy("image_id").agg(*(f(a).alias(f"{a}{k}") for a in ("line", "samp") for k, f in enumerate((F.min, F.max))))
    placed = tiling.drop_margin(positions.join(means, [*own, "query_id"]), extents, margin).filter(F.col("conf") > conf_thr)
    others = patches.select("grid_id", F.col("image_id").alias("other")).distinct()
    crossed = by_group(placed, others, "grid_id").filter(overlap.exclude_self("image_id", "other"))
    predicted = predict_ground(crossed, elements.withColumnRenamed("image_id", "other"), predictor, "other")
    return _as_correspondences(predicted, _models_of(models, patches))


def adjust_elements(patches: DataFrame, grids: DataFrame, predictor: Predictor, models: DataFrame, margin: float = 0.1, conf_thr: float = 0.5, seed: int = 0, positions: DataFrame | None = None, elements: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Images fitted to each other's predictions, together kept in place: the models, and the patches with x, y made anew.

    With positions (and the elements' polynomials) the correspondences come from
    element_correspondences(), else from the patches themselves.
    """
    if positions is not None:
        corr = element_correspondences(positions, patches, elements, predictor, models, margin=margin, conf_thr=conf_thr)
    else:
        extents = patches.groupBy("image_id").agg(*(f(a).alias(f"{a}{k}") for a in ("line", "samp") for k, f in enumerate((F.min, F.max))))
        pairs = cross_element_pairs(patches, grids, predictor, tiling.drop_margin(patches, extents, margin))
        corr = _as_correspondences(pairs, _models_of(models, patches))
    maps = fit.centre_transforms(fit.robust_affine(corr, "image_id", conf_thr, 0.0, seed=seed))
    adjusted = _update_affine(models, maps)
    return adjusted, sensor.image_to_mercator(patches.drop("x", "y"), _models_of(adjusted, patches))


def image_patches(pixels: DataFrame, dem: DataFrame, models: DataFrame, grids: DataFrame, footprints: DataFrame, shape: tuple[int, int], size: int = 16, value: str = "value") -> DataFrame:
    """Patches of the part of each image that a grid covers: grid_id, image_id, i, j, and the means of value, h, line and samp over size x size cells.

    The part's corners are placed in the image (at the mean height), the quad between
    them is resampled to shape, images and heights alike, and cut into patches, whose
    line and samp are those of the original image.

    grids: grid_id, x0, y0, x1, y1.  footprints: image_id and box.
    """
    c, key = F.col, ["grid_id", "image_id"]
    over = overlap.grid_image(grids, footprints).filter((c("x0") < c("x1")) & (c("y1") < c("y0")))
    level = dem.groupBy("image_id").agg(F.avg("value").alias("h"))
    corner = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), c(x).alias("x"), c(y).alias("y")) for k, (x, y) in enumerate((("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))))))
    placed = sensor.mercator_to_image(over.join(level, "image_id").select(*key, "h", corner.alias("p")).select(*key, "h", "p.*"), models)
    quads = placed.groupBy(*key).agg(*(F.max(F.when(c("k") == k, c(source))).alias(f"{a}{k}") for k in range(4) for a, source in (("x", "samp"), ("y", "line"))))
    extent = pixels.groupBy("image_id").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))
    cells = raster.quad_points(quads.join(extent, "image_id"), shape).withColumnsRenamed({"x": "col", "y": "row"})
    both = pixels.select("image_id", "row", "col", c(value).cast("double").alias("image")).join(dem.select("image_id", "row", "col", c("value").alias("h")), ["image_id", "row", "col"])
    read = tiles.bilinear(cells, tiles.from_cells(both, values=("image", "h")), values=("image", "h"))
    inside = (c("row") >= 0) & (c("row") <= c("height") - 1) & (c("col") >= 0) & (c("col") <= c("width") - 1)
    block = {n: F.floor(c(t) / size).cast("int") for n, t in (("i", "trow"), ("j", "tcol"))}
    means = read.filter(inside).withColumns(block).groupBy(*key, "i", "j").agg(F.avg("image").alias(value), F.avg("h").alias("h"), F.avg("row").alias("line"), F.avg("col").alias("samp"), F.count("*").alias("__n"))
    return means.filter(c("__n") == size * size).drop("__n")


def adjust_from_images(pixels: DataFrame, dem: DataFrame, models: DataFrame, grids: DataFrame, footprints: DataFrame, predictor: Predictor, shape: tuple[int, int], size: int = 16, value: str = "value", **options: object) -> DataFrame:
    """The whole adjustment: grids over images, their parts resampled and cut into patches, the grids' predictions, and a robust fit of each image.

    predictor gives x, y, h and conf for image_patches(); grids has its polynomials too.
    """
    patches = checkpointed(image_patches(pixels, dem, models, grids, footprints, shape, size, value).withColumnRenamed("h", "height"))
    return adjust_images(patches, grids, predictor, models, **options)


#: Cells of an ortho image that a task places at a time.
_AT_ONCE = 1 << 16


def _places_in_image(batches: Iterator[pa.RecordBatch], size: int = tiles.SIZE) -> Iterator[pa.RecordBatch]:
    """Lines of an ortho image (tiles.beside_lines(), with box and model) to where their cells are seen.

    A cell within the image is a row with its place (seen); the others between them are a
    row a run, tcol to last, so that what is shuffled grows with the image and not with its
    box.  A run's place says nothing, and spreads runs over the image's tiles.
    """
    for batch in batches:
        column = {name: batch.column(name) for name in batch.schema.names}
        images, trow, rows, first = (column[name].to_numpy(zero_copy_only=False) for name in ("image_id", "trow", "row", "first"))
        held = []
        for name in ("upper", "lower"):
            flat, counts = column[name].flatten(), pc.fill_null(pc.list_value_length(column[name]), 0).to_numpy(zero_copy_only=False)
            # one more cell, unknown, stands for all that the tile does not hold
            values = np.append(pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False).astype(np.float64), 0.0)
            held.append((values, np.append(flat.is_valid().to_numpy(zero_copy_only=False), False), np.cumsum(counts) - counts, counts))
        for image in np.unique(images):
            own = np.flatnonzero(images == image)
            model = {name: v[int(own[0])].as_py() for name, v in column.items() if name not in ("upper", "lower")}
            lat0, lat1, lon0, lon1, dlat, dlon, height, width, cols = (model[x] for x in ("lat0", "lat1", "lon0", "lon1", "dlat", "dlon", "height", "width", "cols"))
            low = np.nan if model["low"] is None else model["low"]
            step = (width - 1) * dlon / (lon1 - lon0)
            # cells by line and tile; some more on both sides, as the exact ones are told by their column below
            start = np.zeros(len(own), np.int64) if step == 0 else np.maximum(np.floor(first[own] / step).astype(np.int64) - 2, 0)
            end = np.full(len(own), cols) if step == 0 else np.where(first[own] + size >= width, cols, np.minimum(np.ceil((first[own] + size) / step).astype(np.int64) + 2, cols))
            spans = [(k, a, min(a + _AT_ONCE, b)) for k, s, b in zip(own, start.tolist(), end.tolist(), strict=True) for a in range(s, b, _AT_ONCE)]
            while spans:
                n = 1 + int(np.searchsorted(np.cumsum([b - a for _, a, b in spans[1 : _AT_ONCE]]), _AT_ONCE - (spans[0][2] - spans[0][1]), "right"))
                part, spans = spans[:n], spans[n:]
                lengths = np.array([b - a for _, a, b in part])
                line = np.repeat(np.array([k for k, _, _ in part]), lengths)
                tcol = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths - np.array([a for _, a, _ in part]), lengths)
                lon = lon0 + tcol * dlon
                col = (width - 1) * (lon - lon0) / (lon1 - lon0)
                c = np.floor(col)
                c0, c1 = (np.clip(x, 0, width - 1).astype(np.int64) for x in (c, c + 1))
                mine = c0 // size * size == first[line]
                line, tcol, lon, col, c, c0, c1 = (x[mine] for x in (line, tcol, lon, col, c, c0, c1))
                lat, row = lat1 - trow[line] * dlat, rows[line]
                dr, dc = row - np.floor(row), col - c
                h, known = np.zeros(len(line)), np.zeros(len(line), bool)
                for (values, valid, offset, count), across in zip(held, ((1 - dr), dr), strict=True):
                    for at, w in ((c0, across * (1 - dc)), (c1, across * dc)):
                        place = np.where(at - first[line] < count[line], offset[line] + at - first[line], len(values) - 1)
                        there = valid[place] & (w != 0)
                        h = h + np.where(there, w * values[place], 0.0)
                        known |= there
                h = np.where((row <= height - 1) & (col <= width - 1), np.where(known, h, np.nan), low)
                known = np.isfinite(h)
                with np.errstate(all="ignore"):
                    y, x = sensor.image_places(model, lat, lon, np.where(known, h, 0.0))
                seen = known & (y >= 0) & (y <= height - 1) & (x >= 0) & (x <= width - 1)
                # rows: each cell that is seen, and each run of others within a line
                if not len(line):
                    continue
                begins = np.flatnonzero(seen | np.append(True, seen[:-1] | (line[1:] != line[:-1])))
                ends, shown = np.append(begins[1:], len(line)) - 1, seen[begins]
                place = (np.where(shown, y[begins], np.clip(row[begins], 0, height - 1)), np.where(shown, x[begins], 0.0))
                ints = (trow[line[begins]], tcol[begins], tcol[ends])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(begins), image), column["image_id"].type), *(pa.array(v, pa.int32()) for v in ints), *(pa.array(v, pa.float64()) for v in place), pa.array(shown)],
                    names=["image_id", "trow", "tcol", "last", "row", "col", "seen"],
                )


def orthorectify(pixels: DataFrame, dem: DataFrame, models: DataFrame, resolution: float = 0.5, value: str = "value") -> DataFrame:
    """Cells (row, col) of a north-up raster of each image: image_id, lat, lon, value (cut to whole numbers; 0 off the image).

    The raster may be far larger than the image, if that lies askew.  Its lines meet
    the heights' tiles, its cells are made and placed there, and only those within the image
    are shuffled, to read it; the others stay runs until the end.
    """
    c = F.col
    shape = pixels.groupBy("image_id").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))
    low = dem.groupBy("image_id").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    info = shape.join(low, "image_id")
    corner = F.explode(F.array(*(F.struct(((c("height") - 1) * r).alias("line"), ((c("width") - 1) * s).alias("samp"), c(h).alias("h")) for r, s, h in ((0, 0, "low"), (0, 1, "low"), (1, 0, "high"), (1, 1, "high")))))
    ground = sensor.image_to_object(info.select("image_id", corner.alias("p")).select("image_id", "p.*"), models)
    box = ground.groupBy("image_id").agg(F.min("lat").alias("lat0"), F.max("lat").alias("lat1"), F.min("lon").alias("lon0"), F.max("lon").alias("lon1"))
    box = box.join(info, "image_id").withColumns({"dlat": F.lit(resolution / 111320.0), "dlon": F.lit(resolution) / (F.lit(40075000.0) * F.cos(F.radians((c("lat1") + c("lat0")) / 2)) / 360.0)})
    box = box.withColumns({"rows": F.ceil((c("lat1") - c("lat0")) / c("dlat")).cast("int"), "cols": F.ceil((c("lon1") - c("lon0")) / c("dlon")).cast("int")})
    direct = models.select("image_id", *sensor.NORMALIZERS, *sensor.DIRECT, *geo.AFFINE)
    box = checkpointed(box.filter("rows > 0 AND cols > 0").join(direct, "image_id"))
    lines = box.withColumn("trow", F.explode(F.sequence(F.lit(0), c("rows") - 1)))
    lines = lines.withColumn("row", (c("height") - 1) * (c("lat1") - (c("lat1") - c("trow") * c("dlat"))) / (c("lat1") - c("lat0")))
    pieces = tiles.beside_lines(lines.select("image_id", "trow", "row", "height", "width"), tiles.from_cells(dem)).drop("height", "width")
    kind = dict(box.dtypes)["image_id"]
    placed = by_written_group(pieces, box, "image_id").mapInArrow(_places_in_image, f"image_id {kind}, trow int, tcol int, last int, row double, col double, seen boolean")
    extent = box.select("image_id", "height", "width")
    read = raster.gather(by_written_group(placed, extent, "image_id"), pixels.select("image_id", "row", "col", F.col(value).alias("value")))
    ends = by_written_group(read.select("image_id", "trow", "tcol", "last", F.when(c("seen"), c("value").cast("int")).otherwise(F.lit(0)).alias("value")), box.select("image_id", "lat1", "lon0", "dlat", "dlon"), "image_id")
    cells = ends.withColumn("tcol", F.explode(F.sequence("tcol", "last")))
    return cells.select("image_id", c("trow").alias("row"), c("tcol").alias("col"), (c("lat1") - c("trow") * c("dlat")).alias("lat"), (c("lon0") + c("tcol") * c("dlon")).alias("lon"), "value")


def prepare_heights(points: DataFrame, dem: DataFrame, geoid: DataFrame, rasters: DataFrame, models: DataFrame, geoid_id: str, rounds: int = 3) -> DataFrame:
    """Heights of image points (image_id, raster_id, line, samp) from a height raster corrected by the geoid."""
    return sensor.heights_by_iteration(points, models, raster.add_regridded(dem, geoid, rasters, geoid_id), rasters, rounds)


def crop_common_area(scenes: DataFrame, image_dem: DataFrame, dem: DataFrame, rasters: DataFrame, models: DataFrame, raster_id: str) -> DataFrame:
    """Of each image (image_id, height, width) the box of cells over the ground that all images share: row0, col0, row1, col1 (ends excluded)."""
    c = F.col
    corner = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), ((c("height") - 1) * r).cast("int").alias("line"), ((c("width") - 1) * s).cast("int").alias("samp")) for k, (r, s) in enumerate(((0, 0), (0, 1), (1, 1), (1, 0))))))
    at = sensor.image_to_mercator(raster.lookup(scenes.select("image_id", corner.alias("p")).select("image_id", "p.*"), image_dem, name="h"), models)
    quads = at.groupBy(F.col("image_id").alias("quad_id")).agg(*(F.max(F.when(c("k") == k, c(a))).alias(f"{a}{k}") for k in range(4) for a in "xy"))
    area = geo.from_mercator(overlap.common_polygon(quads)).select("lat", "lon", F.lit(raster_id).alias("raster_id"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    vertices = raster.sample_nearest(area, dem, rasters).select("lat", "lon", F.col("value").alias("h"), F.lit(1).alias("__k"))
    placed = sensor.object_to_image(scenes.withColumn("__k", F.lit(1)).join(vertices, "__k").drop("__k"), models)
    low = lambda v: F.greatest(F.min(v), F.lit(0.0)).cast("int")
    high = lambda v, n: F.least(F.max(v), F.max(n) - 1).cast("int")
    return placed.groupBy("image_id").agg(low("line").alias("row0"), low("samp").alias("col0"), high("line", "height").alias("row1"), high("samp", "width").alias("col1"))


def find_study_areas(rasters: DataFrame, min_pair: float = 5000.0, min_triple: float = 1000.0, cell: float = 20000.0) -> DataFrame:
    """Windows (row0, col0, row1, col1 and geotransform) of each raster on every pair and triple that overlaps enough."""
    c = F.col
    boxes = overlap.bbox_from_transform(rasters).withColumnRenamed("raster_id", "image_id")
    two = overlap.pairs(boxes, min_pair, cell).select(F.array("i", "j").alias("members"), *overlap.BOX)
    three = overlap.triples(boxes, min_triple, cell).select(F.array("i", "j", "k").alias("members"), *overlap.BOX)
    areas = two.unionByName(three).withColumn("raster_id", F.explode("members")).join(rasters, "raster_id")
    span = {"row0": F.round((c("maxy") - c("f")) / c("e")), "col0": F.round((c("minx") - c("c")) / c("a")), "row1": F.round((c("miny") - c("f")) / c("e")), "col1": F.round((c("maxx") - c("c")) / c("a"))}
    df = areas.withColumns({k: v.cast("int") for k, v in span.items()})
    return df.select("members", "raster_id", *span, (c("c") + c("col0") * c("a")).alias("c"), (c("f") + c("row0") * c("e")).alias("f"), "a", "e")


def downsample_raster(cells: DataFrame, factor: int, method: str, shape: tuple[int, int], by: str = "image_id", value: str = "value") -> DataFrame:
    """Cells by one of nearest, bilinear, bicubic, mean, gaussian."""
    ways = {
        "nearest": lambda: raster.decimate(cells.select(by, "row", "col", value), factor), "bilinear": lambda: raster.resize(cells, factor, "bilinear", shape, by, value),
        "bicubic": lambda: raster.resize(cells, factor, "bicubic", shape, by, value), "mean": lambda: raster.local_mean(cells, factor, by, value), "gaussian": lambda: raster.gaussian_decimate(cells, factor, shape, by, value),
    }
    if method not in ways:
        raise ValueError(f"method is one of {', '.join(ways)}")
    return ways[method]()


def downsample_dataset(pixels: DataFrame, dem: DataFrame, residuals: DataFrame, models: DataFrame, method: str, factor: int, shape: tuple[int, int], value: str = "value") -> dict[str, DataFrame]:
    """Image, heights, residuals and models of images `factor` times smaller."""
    return {
        "pixels": downsample_raster(pixels, factor, method, shape, value=value), "dem": raster.resize(dem, factor, "bilinear", shape),
        "residuals": raster.block_nan(residuals, factor), "models": sensor.rescale_models(models, factor),
    }


def build_training_pairs(cells: DataFrame, pairs: DataFrame, k: int, min_side: int, size: int = 1024, ratio: int = 16, n: int = 10000, seed: int = 0) -> DataFrame:
    """For each pair and crop number the n best matched cells, in feature cells of both crops (line1, samp1, line2, samp2); crop_samples() gives the crops themselves.

    cells: pair_id, row, col, res1, res2.  pairs: pair_id, height, width.
    """
    c = F.col
    crops = tiling.overlapping_crops(pairs, k, min_side, seed)
    both = tiling.in_both_crops(cells, crops).withColumn("residual", F.least("res1", "res2")).withColumn("sample", F.struct("pair_id", "k"))
    best = metrics.lowest_n_cyclic(both, "sample", ["residual", "row", "col"], n)
    feature = lambda a, m: F.least(F.greatest((c(a) - c(f"{a}{m}")) * (F.lit(float(size)) / c(f"side{m}")) / ratio, F.lit(0.0)), F.lit((size - 1) / ratio))
    return best.select("pair_id", "k", "position", "row", "col", "residual", *(feature(a, m).alias(f"{name}{m}") for m in (1, 2) for a, name in (("row", "line"), ("col", "samp"))))


def crop_samples(cells: DataFrame, crops: DataFrame, size: int = 1024, ratio: int = 16) -> DataFrame:
    """Both crops of each pair, resized to size x size: a row per pair_id, k and m (1 or 2) with arrays row by row.

    image: size x size values, bilinear; x, y, h: ground positions at the centres of
    ratio x ratio blocks of the resized crop; residual: nearest cells averaged over
    blocks, -1 where none is known.

    cells: pair_id, row, col, img1, img2, x, y, h, res1, res2.  crops: pair_id, k and
    rowm, colm, sidem of both crops, as overlapping_crops() gives them.
    """
    c, layers = F.col, ("img1", "img2", "x", "y", "h", "res1", "res2")
    raster_tiles = checkpointed(tiles.from_cells(cells.select("pair_id", "row", "col", *(F.nanvl(c(v).cast("double"), F.lit(None)).alias(v) for v in layers)), "pair_id", layers))
    target = lambda a: F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias(a)
    out = None
    for m in (1, 2):
        box = crops.select("pair_id", "k", *(c(f"{x}{m}").alias(f"{x}0") for x in ("row", "col")), c(f"side{m}").alias("side"))
        lattice = box.select("*", target("trow")).select("*", target("tcol"))
        scale = c("side") / F.lit(float(size))
        inside = lambda v: F.least(F.greatest(v, F.lit(0.0)), c("side") - F.lit(1.0))
        smooth = {a: c(f"{a}0") + inside((c(f"t{a}") + 0.5) * scale - 0.5) for a in ("row", "col")}
        placed = lattice.withColumns(smooth | {"height": c("row0") + c("side"), "width": c("col0") + c("side")})
        read = tiles.bilinear(placed, raster_tiles, "pair_id", (f"img{m}", "x", "y", "h"), fill=0.0)
        nearest = {a: (c(f"{a}0") + F.least(F.floor(c(f"t{a}") * scale), c("side") - 1)).cast("int") for a in ("row", "col")}
        whole = tiles.nearest(read.withColumns(nearest), raster_tiles, "pair_id", (f"res{m}",), keep=True)
        own = whole.select("pair_id", "k", F.lit(m).alias("m"), "trow", "tcol", c(f"img{m}").alias("image"), "x", "y", "h", c(f"res{m}").alias("residual"))
        out = own if out is None else out.unionByName(own)
    cell = checkpointed(out)
    key = ["pair_id", "k", "m"]
    # arrays are put together line by line, then the lines
    line = cell.groupBy(*key, "trow").agg(F.sort_array(F.collect_list(F.struct("tcol", "image"))).alias("__line"))
    lines = line.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("trow", F.transform("__line", lambda v: v["image"]).alias("v")))).alias("__lines"))
    images = lines.select(*key, F.flatten(F.transform("__lines", lambda v: v["v"])).alias("image"))
    block = {f"b{a}": F.floor(c(f"t{a}") / ratio).cast("int") for a in ("row", "col")}
    middle = [(ratio - 1) // 2, ratio // 2]
    centre = (c("trow") % ratio).isin(middle) & (c("tcol") % ratio).isin(middle)
    known = {v: F.avg(F.when(centre, c(v))).alias(v) for v in ("x", "y", "h")}
    blocks = cell.withColumns(block).groupBy(*key, "brow", "bcol").agg(*known.values(), F.coalesce(F.avg("residual"), F.lit(-1.0)).alias("residual"))
    gathered = blocks.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("brow", "bcol", "x", "y", "h", "residual"))).alias("__blocks"))
    complete = F.filter("__blocks", lambda b: (b["brow"] < size // ratio) & (b["bcol"] < size // ratio))
    objects = gathered.withColumn("__whole", complete).select(*key, *(F.col(f"__whole.{v}").alias(v) for v in ("x", "y", "h")), F.col("__blocks.residual").alias("residual"))
    return images.join(objects, key)


def create_grids(corners: DataFrame, size: float, patches: DataFrame | None = None, limit: int | None = None, bins: int = 1000, deg: int = 20) -> DataFrame:
    """Grids over the rectangle that all images share, with linear maps for x and y and, from patches (grid_id, h), the height map ch."""
    made = tiling.with_linear_maps(tiling.grids(overlap.common_rectangle(corners), size, limit))
    if patches is None:
        return made
    return made.join(fit.quantile_map(patches, ["h"], "grid_id", bins, deg), "grid_id")
