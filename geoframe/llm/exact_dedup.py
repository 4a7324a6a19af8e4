"""Exact deduplication against an index of the digests seen so far.

The index is a minimal perfect hash per bucket of digests: levels of bit arrays
send every indexed digest to a slot of its own, and the slot holds the full
digest, the winner's id and the number of rows.  A lookup compares the whole
digest in the slot, so that a digest that was never indexed is told apart for
certain; those digests are grouped among themselves.

Defined results: a null text counts as the empty text.  Of rows with equal text
the largest id stays (a null id is below any other); of repeated rows with the
same id and text exactly one is kept.  A very long text is read once, by Spark's
own SHA-256, and travels only where whole documents are returned.  An empty table
gives an empty result.  Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoframe.llm._shared import mixed, partitions, renamed

INDEX_SCHEMA = "bucket long, sizes binary, bits binary, digests binary, winners binary, known binary, counts binary"


def text_digest(text_col: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))


def distinct_digests(rows: DataFrame, buckets: int) -> DataFrame:
    """(digest, id) rows -> a row per digest: winner, count and bucket. Aggregated before the shuffle."""
    grouped = rows.groupBy("digest").agg(F.max("id").alias("winner"), F.count("*").alias("count"))
    return grouped.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)))


def _places(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where a level of `size` bits sends keys of one or more 64-bit words. Each level reads another word, so that keys part at some level if they differ anywhere."""
    return (mixed(words[:, level % words.shape[1]] + np.uint64(level)) % np.uint64(size)).astype(np.int64)


def _levels(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the levels, their bits, and each key's slot: a minimal perfect hash of distinct keys (rows of 64-bit words)."""
    keys = keys[:, None] if keys.ndim == 1 else keys
    slot, rest, sizes, bits, used = np.zeros(len(keys), np.int64), np.arange(len(keys)), [], [], 0
    while len(rest):
        size = max(64, 2 * len(rest))
        at = _places(keys[rest], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        done = alone[at]
        slot[rest[done]] = used + np.cumsum(alone)[at[done]] - 1
        used += int(alone.sum())
        sizes.append(size)
        bits.append(alone)
        rest = rest[~done]
    return np.array(sizes, np.int64), np.concatenate(bits) if bits else np.zeros(0, bool), slot


def _slots(keys: np.ndarray, sizes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The slot of each key, or -1 where no level has its bit."""
    keys = keys[:, None] if keys.ndim == 1 else keys
    out, open_, first, rank = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0, np.cumsum(bits) - 1
    for level, size in enumerate(sizes.tolist()):
        at = first + _places(keys[open_], level, size)
        hit = bits[at]
        out[open_[hit]] = rank[at[hit]]
        open_, first = open_[~hit], first + size
    return out


def _keys(digests: np.ndarray) -> np.ndarray:
    """The four 64-bit words of each digest."""
    return np.ascontiguousarray(digests).view(np.uint64).reshape(-1, 4)


def _digests(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _winners(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The winners' ids, 0 where there is none, and whether there is one."""
    ids = table.column("winner")
    return ids.fill_null(0).to_numpy().astype(np.int64), ids.is_valid().to_numpy().astype(bool)


def build_index(distinct: DataFrame) -> DataFrame:
    """distinct_digests() -> a row per bucket with the hash function and the slots."""

    def build(table: pa.Table) -> pa.Table:
        digests = _digests(table.column("digest"))
        sizes, bits, slot = _levels(_keys(digests))
        order = np.argsort(slot)
        winner, known = (x[order] for x in _winners(table))
        return pa.table({
            "bucket": pa.array([table.column("bucket")[0].as_py()], pa.int64()), "sizes": [sizes.tobytes()], "bits": [np.packbits(bits).tobytes()],
            "digests": [digests[order].tobytes()], "winners": [winner.tobytes()], "known": [known.tobytes()],
            "counts": [table.column("count").to_numpy()[order].astype(np.int64).tobytes()],
        })

    return distinct.groupBy("bucket").applyInArrow(build, INDEX_SCHEMA)


def resolve(new: DataFrame, index: DataFrame) -> DataFrame:
    """Winner and count of every digest of the index or of new (from distinct_digests())."""

    def look(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        digests = _digests(mine.column("digest"))
        (winner, known), count = _winners(mine), mine.column("count").to_numpy().astype(np.int64)
        if theirs.num_rows:
            row = theirs.to_pylist()[0]
            sizes, held = np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
            bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=int(sizes.sum())).astype(bool)
            best, number = (np.frombuffer(row[c], np.int64).copy() for c in ("winners", "counts"))
            sure = np.frombuffer(row["known"], bool).copy()
            slot = _slots(_keys(digests), sizes, bits)
            member = slot >= 0
            member[member] = (held[slot[member]] == digests[member]).all(axis=1)
            own = slot[member]
            better = known[member] & (~sure[own] | (winner[member] > best[own]))
            best[own] = np.where(better, winner[member], best[own])
            sure[own] |= known[member]
            number[own] += count[member]
            digests = np.concatenate([held, digests[~member]])
            winner, known, count = (np.concatenate([x, y[~member]]) for x, y in ((best, winner), (sure, known), (number, count)))
        return pa.table({"digest": pa.array([d.tobytes() for d in digests], pa.binary()), "winner": pa.array(winner, mask=~known), "count": count})

    return new.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(look, "digest binary, winner long, count long")


def resolved_digests(docs: DataFrame, history: Column, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """digest, winner, count over all of docs: rows where history is true make the index, the others are looked up."""
    buckets = buckets or 4 * partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_digest(text_col).alias("digest"), F.coalesce(history, F.lit(False)).alias("old"))
    index = build_index(distinct_digests(rows.filter("old"), buckets))
    return resolve(distinct_digests(rows.filter("NOT old"), buckets), index)


def older_half(docs: DataFrame, id_col: str = "doc_id") -> Column:
    """Rows up to the middle of the id range, as the history of the rest."""
    low, high = docs.agg(F.min(id_col), F.max(id_col)).first()
    return F.lit(False) if low is None else F.col(id_col) <= F.lit((low + high) // 2)


def exact_duplicates(docs: DataFrame, history: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, keep_id, group_size, kept, text_sha256.

    Repeated (text, id) rows are numbered before the join on the text, by a shuffle
    that spreads a common text over its ids; after the join no step needs a text's
    rows together, so that a skewed join can be split.
    """
    found = resolved_digests(docs, older_half(docs, id_col) if history is None else history, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("own"), F.col(id_col).cast("long").alias("id"), text_digest(text_col).alias("digest"))
    nth = F.row_number().over(Window.partitionBy("digest", "id").orderBy("id"))
    joined = rows.withColumn("nth", nth).join(found, "digest")
    return joined.select(
        F.col("own").alias(id_col), F.col("winner").alias("keep_id"), F.col("count").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("winner")) & (F.col("nth") == 1)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, history: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each text, all columns as they were."""
    found = resolved_digests(docs, older_half(docs, id_col) if history is None else history, id_col, text_col)
    winners = found.select(F.col("digest").alias("__digest"), "winner")
    own, (at, text) = renamed(docs, id_col, text_col)
    rows = own.withColumn("digest", text_digest(text)).withColumn("id", F.col(at).cast("long"))
    nth = F.row_number().over(Window.partitionBy("digest", "id").orderBy("digest", "id"))
    won = (F.col("digest") == F.col("__digest")) & F.col("id").eqNullSafe(F.col("winner"))
    kept = rows.join(winners, won, "left_semi").withColumn("nth", nth).filter("nth = 1")
    return kept.select(*own.columns).toDF(*docs.columns)
