"""What the operators here share: checkpoints, Arrow text buffers and text blocks.

A *block* is one row that holds some tens of documents as one compressed byte
string.  Operators that look up many keys of a text at once (n-grams, window
hashes) send one packed array per block and bucket through the shuffle instead
of one row per position.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 8 << 20
FILTER_WORDS = 1 << 18
BLOCK_SCHEMA = "block long, ids array<long>, flags binary, sizes binary, body binary"


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; only on a local master, where none is set, a temporary one takes its place."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """df as a table in the shared folder, and a function that deletes the table once nothing reads it any more."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)

    def delete() -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return spark.read.schema(df.schema).parquet(folder), delete


def checkpointed(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_unused_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of tables that are kept elsewhere by now: it does when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def renamed(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """docs with its columns called c0, c1, ... in their order, and what `names` are called now: no column of the user's can clash with an operator's own, and names may hold any sign."""
    return docs.toDF(*(f"c{k}" for k in range(len(docs.columns)))), [f"c{docs.columns.index(n)}" for n in names]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_remainder(id_col: str, by: int) -> Column:
    """crc32 of the id as text, modulo by; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % by


def _filter_bits(id_: Column) -> tuple[Column, Column]:
    """The word of a Bloom filter that an id (null too) falls on, and its three bits there."""
    key = F.xxhash64(id_.cast("long"))
    one = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(key, k).bitwiseAND(F.lit(63)).cast("int"))
    return F.pmod(key, F.lit(FILTER_WORDS)), one(20).bitwiseOR(one(30)).bitwiseOR(one(40))


def id_filter(ids: DataFrame) -> DataFrame:
    """A Bloom filter of the column id, as rows (word, bits): at most FILTER_WORDS, which any task can hold. With more ids it only lets more others pass."""
    word, bits = _filter_bits(F.col("id"))
    return checkpointed(ids.select(word.alias("__word"), bits.alias("bits")).groupBy("__word").agg(F.bit_or("bits").alias("__bits")))


def perhaps(rows: DataFrame, id_col: str, bloom: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows whose id may be in the filter, all that are among them; left_anti: the others. No row is shuffled."""
    word, bits = _filter_bits(F.col(id_col))
    return rows.join(F.broadcast(bloom), (word == F.col("__word")) & (F.col("__bits").bitwiseAND(bits) == bits), how)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string or binary column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def text_blocks(docs: DataFrame, id_col: str, text_col: str, flag: Column | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents gathered into blocks, in place (no shuffle), kept in the checkpoint folder.

    A block ends with the document that takes it to block_bytes, so that its size
    is bounded by block_bytes and the longest document.  Block numbers are those
    of the written rows and do not change when a task is run again later.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (F.lit(0) if flag is None else flag).cast("byte").alias("flag"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("flags", pa.binary()), ("sizes", pa.binary()), ("body", pa.binary())])
        base, made, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def row() -> pa.RecordBatch:
            ids = [x for part in held for x in part[0]]
            flags, sizes, body = (b"".join(part[k] for part in held) for k in (1, 2, 3))
            small = zstandard.ZstdCompressor(level=3).compress(body)
            return pa.RecordBatch.from_arrays([pa.array([base + made]), pa.array([ids], pa.list_(pa.int64())), pa.array([flags], pa.binary()), pa.array([sizes], pa.binary()), pa.array([small], pa.binary())], schema=schema)

        for batch in batches:
            raw, at = buffers(batch.column(1))
            ids, flags = batch.column(0).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint8)
            first = 0
            while first < len(ids):
                last = int(np.searchsorted(at, at[first] + max(1, block_bytes - size), "left"))
                last = min(max(last, first + 1), len(ids))
                held.append((ids[first:last], flags[first:last].tobytes(), np.diff(at[first : last + 1]).tobytes(), raw[at[first] : at[last]].tobytes()))
                size += int(at[last] - at[first])
                first = last
                if size >= block_bytes:
                    yield row()
                    made, held, size = made + 1, [], 0
        if held:
            yield row()

    return checkpointed(rows.mapInArrow(gather, BLOCK_SCHEMA))


def unpack_block(row: dict) -> tuple[list, np.ndarray, np.ndarray, bytes]:
    """Ids, flags, offsets and the bytes of a block."""
    import zstandard

    sizes = np.frombuffer(row["sizes"], np.int64)
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    body = zstandard.ZstdDecompressor().decompress(row["body"]) if offsets[-1] else b""
    return row["ids"], np.frombuffer(row["flags"], np.uint8), offsets, body


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words, for dealing keys to buckets."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


def dealt(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys: an order that puts them by bucket (stable), and the n + 1 bucket ends."""
    bucket = (mixed(keys) % np.uint64(n)).astype(np.uint16 if n < 65536 else np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed byte string: first all lowest bytes of an array, then all next ones, which compresses better."""
    import zstandard

    head = np.array([len(arrays), *(len(a) for a in arrays)], np.int64).tobytes()
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b"" for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def unpacked(data: bytes, *kinds: type) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw[:8], np.int64)[0])
    sizes = np.frombuffer(raw[8 : 8 + 8 * n], np.int64)
    out, at = [], 8 + 8 * n
    for kind, size in zip(kinds, sizes.tolist(), strict=True):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(size))
        at += size * width
    return out


def delta(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as differences, which compress better; undone by cumsum."""
    return np.diff(keys, prepend=np.uint64(0)) if len(keys) else keys


REQUEST_SCHEMA = "bucket long, block long, data binary"
REPLY_SCHEMA = "block long, bucket long, data binary"


def replied(keys: np.ndarray, replies: list[tuple[int, bytes]], kind: type, n: int) -> np.ndarray:
    """The replies to a block's sorted keys, dealt to n buckets, in the order of keys."""
    order, ends = dealt(keys, n)
    out = np.zeros(len(keys), kind)
    for b, data in replies:
        out[order[ends[b] : ends[b + 1]]] = unpacked(data, kind)[0]
    return out
