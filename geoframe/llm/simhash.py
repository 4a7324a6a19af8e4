"""SimHash near-duplicates by pigeonhole blocks.

Two 64-bit fingerprints that differ in at most d bits agree on at least b - d of
any b blocks of bits.  Every distinct fingerprint is dealt to one bucket for each
choice of b - d blocks, buckets are verified by Hamming distance, and each bucket
gives back a spanning forest of its links, never all pairs.  Components of these
links are the groups.

Work is on distinct fingerprints: equal ones (exact copies, texts without words)
meet in one row before anything is compared.

Defined results: a null text counts as empty; a text without words has
fingerprint zero, which links like any other; a text of fewer words than a
shingle is one shingle.  Rows with equal ids are separate documents of one
component if their texts are; where one document of a group is kept, all rows
with its id are.  A null id takes part but is never a component_id, unless its
component has no other id (then that is null).  A very long text is hashed
in pieces, so that it takes no more memory than its bytes and some MB; an empty table gives an empty
result.  Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoframe.llm._shared import checkpointed, drop_unused_shuffles, renamed, written

SHINGLE_WORDS, MAX_BITS, BLOCKS, PIECE, SLICE = 3, 3, 6, 1 << 18, 1 << 16
_SPACE = re.compile(rb"[ \t-\r]")


def _hashes(text: bytes, words: int) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles, those of some PIECE bytes of it at a time."""
    import xxhash

    digest, held, first, whole = xxhash.xxh64_intdigest, [], 0, True
    while first < len(text):
        cut = _SPACE.search(text, first + PIECE)
        last = cut.start() if cut else len(text)
        held += text[first:last].lower().split()
        first = last
        if len(held) > words or (not whole and len(held) >= words):
            yield np.array([digest(s, 42) for s in map(b" ".join, zip(*(held[k:] for k in range(words)), strict=False))], "<u8")
            held, whole = held[len(held) - words + 1 :], False
    if whole and held:
        yield np.array([digest(b" ".join(held), 42)], "<u8")


def _fingerprints(texts: list[bytes], words: int) -> np.ndarray:
    """Fingerprints of texts; bits are counted for SLICE shingles at a time, whatever texts they are of."""
    counts, sizes = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    held: list[tuple[int, np.ndarray]] = []

    def count() -> None:
        if held:
            bits = np.unpackbits(np.concatenate([h for _, h in held]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            n = np.array([len(h) for _, h in held])
            np.add.at(counts, [i for i, _ in held], np.add.reduceat(bits, np.cumsum(n) - n, axis=0, dtype=np.int64))
            held.clear()

    waiting = 0
    for i, text in enumerate(texts):
        for h in _hashes(text, words):
            held.append((i, h))
            sizes[i] += len(h)
            waiting += len(h)
            if waiting >= SLICE:
                count()
                waiting = 0
    count()
    return np.packbits((2 * counts > sizes[:, None]).astype(np.uint8), axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """id and fp (the fingerprint's 64 bits as a signed long) of every row."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, parts, size, first = batch.column(1), [], 0, 0
            for last in range(1, len(texts) + 1):  # some MB of text at a time
                size += len(texts[last - 1].as_py())
                if size >= 1 << 20 or last == len(texts):
                    parts.append(_fingerprints(texts[first:last].to_pylist(), words))
                    first, size = last, 0
            fp = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(compute, "id long, fp long")


def _masks(blocks: int, differing: int) -> list[int]:
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
    return [sum(parts[k] for k in chosen) for chosen in combinations(range(blocks), blocks - differing)]


def _finer(masks: list[int], blocks: int, differing: int) -> list[list[int]]:
    """For each choice of blocks of the free bits, the mask of it under each of masks; as signed numbers."""
    rows: list[list[int]] = []
    for mask in masks:
        free = [k for k in range(64) if not mask >> k & 1]
        parts = [sum(1 << b for b in free[len(free) * k // blocks : len(free) * (k + 1) // blocks]) for k in range(blocks)]
        ways = [sum(parts[k] for k in chosen) for chosen in combinations(range(blocks), blocks - differing)]
        rows.append([m - (1 << 64) if m >> 63 else m for m in ways])
    return [list(x) for x in zip(*rows, strict=True)]


def _forest(values: np.ndarray, differing: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints: each start takes all unseen rows near it, in turn."""
    unseen, out = values, []
    while len(unseen):
        front, unseen = [unseen[0]], unseen[1:]
        while front and len(unseen):
            at = front.pop()
            near = np.bitwise_count(unseen ^ at) <= differing
            found = unseen[near]
            out += [(int(at), int(x)) for x in found]
            front += list(found)
            unseen = unseen[~near]
    return out


def links(distinct: DataFrame, differing: int = MAX_BITS, blocks: int = BLOCKS, most: int = 4096) -> DataFrame:
    """Links (a, b) among the distinct values of fp, enough to connect each group of near fingerprints.

    A bucket of more than `most` values is split by the same rule over the bits that
    it does not fix.  What then shares a bucket differs in a quarter of the bits
    only, so that no bucket has more than 2**16 values, however many rows there are.
    """
    masks = _masks(blocks, differing)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*(F.struct(F.lit(k).alias("way"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for k, m in enumerate(signed)))
    dealt = distinct.select("fp", F.explode(keys).alias("key")).select("fp", "key.*")
    hot = dealt.groupBy("way", "part").count().filter(F.col("count") > most).select("way", "part")
    calm = dealt.join(hot, ["way", "part"], "left_anti").groupBy("way", "part").agg(F.collect_list("fp").alias("fps"))
    fine = F.explode(F.array(*(F.struct(F.lit(k).alias("then"), F.col("fp").bitwiseAND(F.element_at(F.array(*map(F.lit, row)), F.col("way") + 1)).alias("rest")) for k, row in enumerate(_finer(masks, blocks, differing)))))
    split = dealt.join(hot, ["way", "part"], "left_semi").select("way", "part", "fp", fine.alias("key")).select("way", "part", "fp", "key.*")
    buckets = calm.select("fps").unionByName(split.groupBy("way", "part", "then", "rest").agg(F.collect_list("fp").alias("fps")).select("fps")).filter("size(fps) > 1")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for fps in batch.column(0):
                found += _forest(fps.values.to_numpy().view(np.uint64), differing)
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return buckets.select("fps").mapInArrow(verify, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> node, label for every node that is not its component's least.

    Alternating stars: each node's links are moved to the least node it knows of,
    which ends in stars around each component's least node after few rounds.
    A round deals links by node twice and once more to drop repeats, with no joins
    between; the driver has to keep an account of every task of every such step.
    Each round is written to the shared folder, where only the last one stays; the
    rounds end when nothing moved.
    """

    def one_way(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()

    def seen(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    least = F.min("b").over(Window.partitionBy("a"))
    now, delete = written(one_way(edges))
    state = seen(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumn("m", F.least("a", least))
        large = both.select(F.greatest("a", "b").alias("a"), F.col("m").alias("b")).withColumn("m", least)
        small = large.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        now, used = written(small)
        delete()
        delete = used
        drop_unused_shuffles(now.sparkSession)
        before, state = state, seen(now)
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, differing: int = MAX_BITS) -> DataFrame:
    """A row per document: id, fingerprint (16 hex digits), component_id."""
    prints = checkpointed(fingerprints(docs, id_col, text_col, words))
    nodes = prints.groupBy("fp").agg(F.min("id").alias("least"))
    labels = components(links(nodes.select("fp"), differing))
    named = nodes.join(labels, nodes.fp == labels.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = named.join(least, "label").select("fp", "component_id")
    return prints.join(classes, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, differing: int = MAX_BITS) -> DataFrame:
    """docs with one document of each group: the one whose id is the component_id."""
    found = near_duplicates(docs, id_col, text_col, words, differing)
    winners = found.filter(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("id")).distinct()
    own, (at,) = renamed(docs, id_col)
    return own.join(winners, F.col(at).eqNullSafe(F.col("id")), "left_semi").toDF(*docs.columns)
