"""Reading and writing: camera models, tie points, rasters, grids and training pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from io import BytesIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoframe.functions import geo
from geoframe.functions.lineage import checkpointed, partitions
from geoframe.operators import fit, raster, sensor
from geoframe.operators import tiles as tiled

NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
#: The normalizers in file order, their units, and the names of the other layout.
ORDER = ("line_off", "samp_off", "lat_off", "lon_off", "h_off", "line_scale", "samp_scale", "lat_scale", "lon_scale", "h_scale")
UNITS = ("pixels", "pixels", "degrees", "degrees", "meters", "pixels", "pixels", "degrees", "degrees", "meters")
LABELS = ("LINE_OFF", "SAMP_OFF", "LAT_OFF", "LONG_OFF", "HEIGHT_OFF", "LINE_SCALE", "SAMP_SCALE", "LAT_SCALE", "LONG_SCALE", "HEIGHT_SCALE")
RPB_NAMES = ("lineOffset", "sampOffset", "latOffset", "longOffset", "heightOffset", "lineScale", "sampScale", "latScale", "longScale", "heightScale")
ARRAYS = (*sensor.DIRECT, *sensor.INVERSE)
ARRAY_LABELS = ("LINE_NUM_COEFF", "LINE_DEN_COEFF", "SAMP_NUM_COEFF", "SAMP_DEN_COEFF", "LAT_NUM_COEFF", "LAT_DEN_COEFF", "LONG_NUM_COEFF", "LONG_DEN_COEFF")
RPB_ARRAYS = {"lnum": "lineNumCoef", "lden": "lineDenCoef", "snum": "sampNumCoef", "sden": "sampDenCoef"}
CORRECTION = "RFM_CORRECTION_PARAMETERS"
CORRECTION_LABELS = ("CL0", "CLS", "CLL", "CS0", "CSS", "CSL")


def file_stem(path: Column) -> Column:
    """File name without folders and without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def scan_catalog(spark: SparkSession, path: str, glob: str = "*", contains: tuple = ()) -> DataFrame:
    """Files whose name matches glob and holds all of contains: path, name, id (name before the extension), length. No content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "length")
    files = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("id", file_stem(F.col("path")))
    for part in contains:
        files = files.filter(F.contains(F.col("name"), F.lit(part)))
    return files


def _whole_texts(spark: SparkSession, path: str) -> DataFrame:
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r", "").alias("text"))
    return texts.withColumn("name", file_stem(F.col("path")))


def _numbered(df: DataFrame) -> DataFrame:
    """image_id from the folder (image_id=...), as this module writes them, or else by sorted file name, from 0; a row per image."""
    folder = F.expr(r"try_cast(regexp_extract(path, '/image_id=([0-9]+)/', 1) AS INT)")
    nth = F.row_number().over(Window.orderBy("name", "path")) - 1  # of the names alone: the texts stay where they are
    numbers = df.select("path", "name").distinct().select("path", F.coalesce(folder, nth).cast("int").alias("image_id"))
    return df.join(numbers.hint("merge"), "path")


def read_sensor_models(spark: SparkSession, path: str, layout: str = "keyed", fitted: bool = True) -> DataFrame:
    """Camera models from text files, by sorted name; inverse arrays that a file lacks are fitted, or null if not fitted, for readers of direct ones alone.

    Files are read once: what they hold is written down before it is numbered and looked at.
    """
    texts = _whole_texts(spark, path)
    if layout == "rpb":
        one = lambda key: F.regexp_extract("text", rf"\b{key}\s*=\s*({NUMBER})", 1).cast("double")
        block = lambda key: F.transform(F.regexp_extract_all(F.regexp_extract("text", rf"{key}\s*=\s*\(([^)]*)\)", 1), F.lit(f"({NUMBER})"), F.lit(1)), lambda x: x.cast("double"))
        df = texts.select("path", "name", *(one(k).alias(n) for n, k in zip(ORDER, RPB_NAMES, strict=True)), *(block(k).alias(n) for n, k in RPB_ARRAYS.items()))
        df = df.withColumns({c: F.lit(None).cast("array<double>") for c in sensor.INVERSE} | {c: F.lit(v) for c, v in geo.IDENTITY.items()})
    else:
        parts = texts.withColumn("body", F.split("text", CORRECTION)[0]).withColumn("tail", F.get(F.split("text", CORRECTION), F.lit(1)))
        numbers = lambda c: F.transform(F.filter(F.split(c, "\n"), lambda l: F.rlike(l, F.lit(r"^\s*\S+\s+[-+.\d]"))), lambda l: F.regexp_extract(l, rf"^\s*\S+\s+({NUMBER})", 1).cast("double"))
        df = parts.withColumn("v", numbers("body")).withColumn("p", numbers("tail"))
        array = lambda k: F.slice("v", 11 + 20 * k, 20)
        df = df.select("path", "name", *(F.col("v")[k].alias(n) for k, n in enumerate(ORDER)), *((array(k) if k < 4 else F.when(F.size("v") >= 170, array(k))).alias(n) for k, n in enumerate(ARRAYS)), *(F.coalesce(F.get("p", F.lit(k)), F.lit(0.0)).alias(f"p{k}") for k in range(6)))
        df = sensor.corrections_to_affine(df)
    df = checkpointed(df.coalesce(partitions(spark)))  # small files make very many tasks, which every later step would repeat
    df = _numbered(df).select("image_id", *df.columns[1:])
    if not fitted:
        return df
    missing = df.filter("latnum IS NULL")
    return df if missing.isEmpty() else df.filter("latnum IS NOT NULL").unionByName(fit.inverse_models(missing))


def _keyed_text() -> Column:
    fmt = lambda c: F.format_string("%.17e", c)
    lines = [F.concat(F.lit(f"{label}: "), fmt(F.col(c)), F.lit(f" {unit}")) for label, c, unit in zip(LABELS, ORDER, UNITS, strict=True)]
    for label, c in zip(ARRAY_LABELS, ARRAYS, strict=True):
        lines += [F.concat(F.lit(f"{label}_{k + 1}: "), fmt(F.col(c)[k])) for k in range(20)]
    corrected = F.concat_ws("\n", F.lit(CORRECTION), *(F.concat(F.lit(f"{label}: "), fmt(F.col(f"p{k}"))) for k, label in enumerate(CORRECTION_LABELS)))
    still = F.lit(True)
    for k in range(6):
        still &= F.col(f"p{k}") == 0
    return F.concat_ws("\n", *lines, F.when(~still, corrected))


def write_sensor_models(models: DataFrame, path: str) -> None:
    """One keyed text file a model, in a folder for its image; the correction block only where there is a correction."""
    write_texts(sensor.affine_to_corrections(sensor.spread_models(models)).select("image_id", _keyed_text().alias("value")), path)


def write_texts(texts: DataFrame, path: str) -> None:
    """A text file a row (image_id, value), in a folder for its image. A file takes as long as a thousand rows: the rows are to be dealt to all tasks."""
    texts.write.mode("overwrite").partitionBy("image_id").option("lineSep", "\n").text(path)


def read_tie_points(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    """image_id (by sorted file name), point_id (line number), line, samp. Lines without exactly two whole numbers are skipped for ",", an error otherwise."""
    lines = _numbered(_whole_texts(spark, path)).select("image_id", "name", F.posexplode(F.split(F.regexp_replace("text", r"\n+$", ""), "\n")).alias("point_id", "value"))
    parts = lines.withColumn("v", F.split(F.trim("value"), r"\s+" if sep == " " else sep)).filter("trim(value) != ''")
    if sep != " ":
        parts = parts.filter("size(v) = 2 AND try_cast(trim(v[0]) AS INT) IS NOT NULL AND try_cast(trim(v[1]) AS INT) IS NOT NULL")
    value = lambda k: F.trim(F.col("v")[k]).cast("int")
    return parts.select("image_id", F.col("point_id").cast("long"), value(0).alias("line"), value(1).alias("samp"))


def write_tie_points(tie: DataFrame, path: str, sep: str = ",", mode: str = "overwrite") -> None:
    """`line sep samp` lines, cut to whole numbers, in order of point_id, in a folder for each image."""
    text = F.concat_ws(sep, F.col("line").cast("int").cast("string"), F.col("samp").cast("int").cast("string"))
    rows = tie.select("image_id", "point_id", text.alias("value")).repartition("image_id").sortWithinPartitions("image_id", "point_id")
    rows.select("image_id", "value").write.mode(mode).partitionBy("image_id").text(path)


def npy_tiles(files: DataFrame, size: int = tiled.SIZE, halo: int = tiled.HALO) -> DataFrame:
    """Saved NumPy arrays (raster_id, content) to tiles; see operators.tiles. NaN becomes null.

    The content is read in place, a row of tiles at a time.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                raw = content.as_buffer()
                head = BytesIO(raw.slice(0, min(raw.size, 1 << 16)).to_pybytes())
                read = {1: np.lib.format.read_array_header_1_0, 2: np.lib.format.read_array_header_2_0}
                shape, by_column, kind = read[np.lib.format.read_magic(head)[0]](head)
                a = np.frombuffer(raw, kind, math.prod(shape), head.tell()).reshape(shape, order="F" if by_column else "C")
                for r in range(0, a.shape[0], size):
                    blocks = [a[r : r + size + halo, c : c + size + halo].astype(np.float64) for c in range(0, a.shape[1], size)]
                    numbers = [(r // size, k, r, k * size, *x.shape) for k, x in enumerate(blocks)]
                    columns = [pa.array(x, pa.int32()) for x in zip(*numbers, strict=True)]
                    values = pa.array([x.ravel() for x in blocks], pa.list_(pa.float64()))
                    flat = values.flatten()
                    known = pa.ListArray.from_arrays(values.offsets, pc.if_else(pc.is_nan(flat), None, flat))
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(blocks)), *columns, known], names=["raster_id", "tr", "tc", "row0", "col0", "height", "width", "value"])

    return files.select("raster_id", "content").mapInArrow(cut, "raster_id string, tr int, tc int, row0 int, col0 int, height int, width int, value array<double>")


def ingest_npy_rasters(spark: SparkSession, path: str, size: int = tiled.SIZE) -> DataFrame:
    """Arrays saved by NumPy (*.npy, named by raster) to tiles."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)
    return npy_tiles(files.select(file_stem(F.col("path")).alias("raster_id"), "content"), size)


def write_tiles(tiles: DataFrame, path: str, by: str = "raster_id") -> None:
    """Tiles as Parquet, by raster and row of tiles."""
    tiles.repartition(partitions(tiles.sparkSession), by, "tr").sortWithinPartitions(by, "tr", "tc").write.mode("overwrite").partitionBy(by, "tr").parquet(path)


def assemble_scenes(images: DataFrame, dem: DataFrame, models: DataFrame, tie: DataFrame, size_limit: int = 0) -> DataFrame:
    """A row per folder that has image cells, heights and a model, with its id by sorted folder, its size and number of tie points (they are optional).

    images, dem: folder, row, col; models: folder; tie: folder, point_id.
    """
    own = images.filter((F.col("row") < size_limit) & (F.col("col") < size_limit)) if size_limit else images
    size = own.groupBy("folder").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))
    points = tie.groupBy("folder").agg(F.count("*").alias("n_tie"))
    df = size.join(dem.select("folder").distinct(), "folder", "left_semi").join(models.select("folder"), "folder", "left_semi").join(points, "folder", "left")
    number = (F.row_number().over(Window.orderBy("folder")) - 1).cast("int")
    return df.select(number.alias("image_id"), "folder", "height", "width", F.coalesce("n_tie", F.lit(0)).alias("n_tie"))


def validate_tie_points(tie: DataFrame, scenes: DataFrame) -> DataFrame:
    """The tie points of the scenes; an image without any fails the job that reads them, with its id."""
    j = scenes.select("image_id").distinct().join(tie.withColumn("__there", F.lit(True)), "image_id", "left")
    refusal = F.raise_error(F.concat(F.lit("image without tie points: "), F.col("image_id").cast("string"))).cast("boolean")
    return j.filter(F.coalesce(F.col("__there"), refusal)).select(*tie.columns)


def save_grids(grids: DataFrame, path: str) -> None:
    grids.write.mode("overwrite").parquet(path)


def load_grids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_raster(cells: DataFrame, raster_meta: DataFrame, path: str) -> None:
    """Cells as Parquet by raster and tile row under path/cells, their geotransforms under path/rasters."""
    raster.with_tiles(cells).repartition(partitions(cells.sparkSession), "raster_id", "tr").sortWithinPartitions("raster_id", "tr", "row", "col").write.mode("overwrite").partitionBy("raster_id", "tr").parquet(f"{path}/cells")
    raster_meta.write.mode("overwrite").parquet(f"{path}/rasters")


def read_pairs(spark: SparkSession, path: str, split: str, ids: DataFrame | None = None) -> DataFrame:
    """Training pairs of a split (a partition of the table), those of ids (pair_id) only where given."""
    pairs = spark.read.parquet(path).filter(F.col("split") == split)
    return pairs if ids is None else pairs.join(ids, "pair_id", "left_semi")
