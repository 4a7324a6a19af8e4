"""Ranked lexical search over per-term geometric blocks.

Documents are gathered, in place, into shards.  In a shard the posting list of each
term is clustered by the similarity of its documents, so that a block holds
documents with like vectors; a block's summary is the largest weight of each term
among its documents.  The product of an item's vector with a summary is then an
upper bound of the score of every document in the block, and a block is skipped
only when that bound is below the score that an item's last ranked document has
already.  So the ranking is exact, whatever is skipped.

That score starts from a first pass, in which every shard scores each item's most
promising blocks only; it rises as a task goes through its shards.  A list that many
documents share is part of every shard, so no task holds it whole.

A summary's coordinates are the terms that some item asks for together with the
list's own term: any other adds nothing to a bound.  Items are taken in batches of at
most BATCH_TERMS terms, each of which reads the documents once; only a batch's
terms are sent to the tasks.

Scores are 64-bit integers; the weight of a document's length is computed without
a bound on its size.

Defined results: a null text has no terms; such a document counts nowhere and is
never ranked, like one without a term of the item.  Rows of one doc_id are ranked
as separate documents; a null doc_id comes after all others of the same score.  Rows
of one item_id, or with none, are separate items, each with ranks from 1.  A very
long text is cut into terms some MB at a time.  Without documents, or items, the
result is empty.  Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoframe.llm._shared import checkpointed, packed, unpacked

TOP, BATCH_TERMS, SHARD_CELLS, SHARD_DOCS, BLOCK_DOCS, SKETCH, SEED_BLOCKS, PIECE_BYTES = 20, 1 << 14, 1 << 25, 8192, 128, 64, 2, 4 << 20
#: Bytes of terms: digits, letters (A-Z as a-z) and all bytes of other characters; the rest become blanks.
_TERM = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def term_counts(text: bytes) -> Counter:
    """Occurrences of each term."""
    out, first = Counter(), 0
    body = text.translate(_TERM)
    while first < len(body):
        last = body.find(b" ", min(first + PIECE_BYTES, len(body)))
        last = len(body) if last < 0 else last
        out.update(body[first:last].split())
        first = last
    return out


def length_weight(n: int, docs: int, total: int) -> int:
    return 100 - 25 + (25 * n * docs) // total


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def term_weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def parsed_items(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """row (a number of its own), item, terms and counts of every item that has a term."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [term_counts(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(c) for c in found], pa.list_(pa.binary())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))], names=["item", "terms", "counts"])

    rows = items.select(F.col(item_col).cast("long").alias("item"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    parsed = rows.mapInArrow(parse, "item long, terms array<binary>, counts array<long>").filter("size(terms) > 0")
    return checkpointed(parsed.withColumn("row", F.monotonically_increasing_id()))


def item_batches(parsed: DataFrame, most: int = BATCH_TERMS) -> Iterator[list[tuple[int, dict[bytes, int]]]]:
    """Items by row in batches of at most `most` terms; one of more than half of that is a batch of its own. Spark sums the sizes before any batch is fetched."""
    size, long_ = F.size("terms"), F.size("terms") > most // 2
    n = max(1, -(-(parsed.filter(~long_).agg(F.sum(size)).first()[0] or 0) // (most // 2)))
    while True:
        dealt = parsed.withColumn("batch", F.when(long_, -1 - F.col("row")).otherwise(F.pmod(F.xxhash64("row"), F.lit(n))))
        sizes = dealt.groupBy("batch").agg(F.sum(size).alias("size"))
        if not sizes.filter("batch >= 0").filter(F.col("size") > most).limit(1).count():
            break
        n *= 2
    for r in sizes.select("batch").toLocalIterator():
        got = dealt.filter(F.col("batch") == r["batch"]).select("row", "terms", "counts").collect()
        yield sorted((x["row"], dict(zip(map(bytes, x["terms"]), x["counts"], strict=True))) for x in got)


def forward(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """id, n (all terms) and the vocabulary's terms with their counts, of every document that has a term at all."""
    place = {t: k for k, t in enumerate(vocabulary)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, own = [], []
            for text in batch.column(1):
                found = term_counts(text.as_py())
                n.append(found.total())
                own.append(packed(*np.array(sorted((place[t], c) for t, c in found.items() if t in place), np.uint32).reshape(-1, 2).T))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(own, pa.binary())], names=["id", "n", "own"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return checkpointed(rows.mapInArrow(count, "id long, n long, own binary").filter("n > 0"))


def document_frequencies(found: DataFrame, terms: int) -> np.ndarray:
    """How many documents hold each term of the vocabulary; tasks send one row a term at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            for own in batch.column(0):
                total[unpacked(own.as_py(), np.uint32, np.uint32)[0]] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "docs"])

    df = np.zeros(terms, np.int64)
    for r in found.select("own").mapInArrow(count, "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs")).toLocalIterator():
        df[r["term"]] = r["docs"]
    return df


class Asked:
    """A batch's items as vectors over its vocabulary."""

    def __init__(self, batch: list[tuple[int, dict[bytes, int]]]):
        self.vocabulary = sorted({t for _, terms in batch for t in terms})
        place = {t: k for k, t in enumerate(self.vocabulary)}
        self.rows = [row for row, _ in batch]
        self.terms = [np.array(sorted(place[t] for t in terms), np.int64) for _, terms in batch]
        self.counts = [np.array([terms[self.vocabulary[k]] for k in own], np.int64) for (_, terms), own in zip(batch, self.terms, strict=True)]
        self.together: list[np.ndarray] = []  # of each term: those that an item has with it
        by_term: list[list[int]] = [[] for _ in self.vocabulary]
        for k, own in enumerate(self.terms):
            for t in own:
                by_term[t].append(k)
        self.together = [np.unique(np.concatenate([self.terms[k] for k in who])) for who in by_term]

    def weigh(self, docs: int, total: int, df: np.ndarray) -> None:
        self.docs, self.total = docs, total
        self.weights = np.array([term_weight(docs, int(x)) for x in df], np.int64)
        self.vectors = [n * self.weights[own] for n, own in zip(self.counts, self.terms, strict=True)]


def geometric_blocks(own: np.ndarray, sketches: np.ndarray, seed: int) -> list[np.ndarray]:
    """The documents of a posting list in blocks: each goes to the nearest of some documents of the list, drawn by the seed."""
    if len(own) <= BLOCK_DOCS:
        return [own]
    centres = np.random.default_rng(seed).choice(own, -(-len(own) // BLOCK_DOCS), replace=False)
    nearest = np.argmax(sketches[own] @ sketches[centres].T, axis=1)
    order = np.argsort(nearest, kind="stable")
    return np.split(own[order], np.flatnonzero(np.diff(nearest[order])) + 1)


def _sketches(dense: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Document vectors folded to SKETCH coordinates of random sign, of length 1."""
    rng = np.random.default_rng(11)
    fold, sign = rng.integers(0, SKETCH, dense.shape[1]), rng.choice([-1.0, 1.0], dense.shape[1])
    out = np.zeros((len(dense), SKETCH), np.float32)
    for k in range(SKETCH):
        at = np.flatnonzero(fold == k)
        out[:, k] = dense[:, at] @ (sign[at] * weights[at]).astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class Shard:
    """Impacts of some documents, posting lists in blocks, and the blocks' summaries."""

    def __init__(self, ids: pa.Array, dense: np.ndarray, blocks: list[list[np.ndarray]], summaries: list[np.ndarray]):
        self.ids, self.dense, self.blocks, self.summaries = ids, dense, blocks, summaries

    @classmethod
    def build(cls, ids: pa.Array, dense: np.ndarray, asked: Asked) -> Shard:
        sketches, blocks, summaries = _sketches(dense, asked.weights), [], []
        holds = np.ascontiguousarray((dense > 0).T)
        for t, together in enumerate(asked.together):
            own = geometric_blocks(np.flatnonzero(holds[t]), sketches, t) if holds[t].any() else []
            wide = 8 * len(together) > dense.shape[1]
            blocks.append(own)
            summaries.append(np.array([dense[b].max(axis=0)[together] if wide else dense[np.ix_(b, together)].max(axis=0) for b in own], np.uint32).reshape(len(own), len(together)))
        return cls(ids, dense, blocks, summaries)

    def pack(self) -> bytes:
        docs, terms = np.nonzero(self.dense)
        per_list, per_block = [len(x) for x in self.blocks], [len(b) for x in self.blocks for b in x]
        members = np.concatenate([b for x in self.blocks for b in x] or [np.zeros(0, np.int64)])
        highest = np.concatenate([x.ravel() for x in self.summaries])
        at = np.flatnonzero(highest)
        numbers = [np.array(x, np.uint32) for x in (docs, terms, per_list, per_block, members)]
        return packed(*numbers, self.dense[docs, terms], np.diff(at, prepend=0).astype(np.uint32), highest[at])

    @classmethod
    def unpack(cls, ids: pa.Array, data: bytes, asked: Asked) -> Shard:
        docs, terms, per_list, per_block, members, impact, at, highest = unpacked(data, *[np.uint32] * 8)
        dense = np.zeros((len(ids), len(asked.vocabulary)), np.uint32)
        dense[docs, terms] = impact
        cells = [int(n) * len(x) for n, x in zip(per_list, asked.together, strict=True)]
        flat = np.zeros(sum(cells), np.uint32)
        flat[np.cumsum(at.astype(np.int64))] = highest
        parts = np.split(members.astype(np.int64), np.cumsum(per_block)[:-1]) if len(per_block) else []
        firsts, edges = np.cumsum(per_list) - per_list, np.cumsum(cells) - cells
        blocks = [parts[int(f) : int(f) + int(n)] for f, n in zip(firsts, per_list, strict=True)]
        summaries = [flat[e : e + c].reshape(int(n), -1) if n else np.zeros((0, len(x)), np.uint32) for e, c, n, x in zip(edges, cells, per_list, asked.together, strict=True)]
        return cls(ids, dense, blocks, summaries)

    def bounds(self, asked: Asked, k: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Upper bounds of item k's scores in the blocks of its terms, and which blocks these are."""
        own, q, bounds, which = asked.terms[k], asked.vectors[k], [], []
        for t in own.tolist():
            if len(self.blocks[t]):
                bounds.append(self.summaries[t][:, np.searchsorted(asked.together[t], own)].astype(np.int64) @ q)
                which += [(t, b) for b in range(len(self.blocks[t]))]
        return np.concatenate(bounds) if bounds else np.zeros(0, np.int64), which

    def search(self, asked: Asked, k: int, best: Best, most_blocks: int | None = None) -> int:
        """Adds the shard's documents to item k's best; gives the number of blocks that were scored."""
        bounds, which = self.bounds(asked, k)
        order = np.argsort(-bounds, kind="stable")[:most_blocks]
        seen, done, step = np.zeros(len(self.ids), bool), 0, SEED_BLOCKS
        while done < len(order):
            now = order[done : done + step]
            now = now[bounds[now] >= best.least[k]]
            if not len(now):
                break
            docs = np.unique(np.concatenate([self.blocks[t][b] for t, b in (which[x] for x in now)]))
            docs = docs[~seen[docs]]
            seen[docs] = True
            best.add(k, self.ids, docs, self.dense[np.ix_(docs, asked.terms[k])].astype(np.int64) @ asked.vectors[k])
            done, step = done + len(now), 2 * step
        return done


class Best:
    """The best documents of each item so far; `least` is the score below which none can still be ranked."""

    def __init__(self, least: np.ndarray, top: int):
        self.least, self.top = least.copy(), top
        self.scores = [np.zeros(0, np.int64)] * len(least)
        self.ids = [np.zeros(0, np.int64)] * len(least)
        self.none = [np.zeros(0, bool)] * len(least)

    def add(self, k: int, ids: pa.Array, docs: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= self.least[k]
        if not good.any():
            return
        taken = ids.take(pa.array(docs[good]))
        score = np.concatenate([self.scores[k], scores[good]])
        own = np.concatenate([self.ids[k], taken.fill_null(0).to_numpy(zero_copy_only=False)])
        none = np.concatenate([self.none[k], taken.is_null().to_numpy(zero_copy_only=False)])
        order = np.lexsort((own, none, -score))[: self.top]
        self.scores[k], self.ids[k], self.none[k] = score[order], own[order], none[order]
        if len(order) == self.top:
            self.least[k] = max(self.least[k], int(score[order[-1]]))

    def batch(self, rows: list[int]) -> pa.RecordBatch:
        of = np.repeat(np.array(rows, np.int64), [len(x) for x in self.scores])
        flat = [np.concatenate(x) if x else np.zeros(0) for x in (self.ids, self.none, self.scores)]
        return pa.RecordBatch.from_arrays([pa.array(of), pa.array(flat[0], pa.int64(), mask=flat[1].astype(bool)), pa.array(flat[2], pa.int64())], names=["row", "id", "score"])


def build_index(found: DataFrame, asked: Asked) -> DataFrame:
    """forward() -> a row per shard: ids, and the packed Shard."""
    width = len(asked.vocabulary)
    most = max(1, min(SHARD_DOCS, SHARD_CELLS // width))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, terms, counts, lengths = [], [], [], []

        def row() -> pa.RecordBatch:
            dense = np.zeros((len(ids), width), np.uint32)
            for k, (own, tf, n) in enumerate(zip(terms, counts, lengths, strict=True)):
                dense[k, own] = impacts(tf.astype(np.int64), np.int64(length_weight(n, asked.docs, asked.total)))
            shard = Shard.build(pa.array(ids, pa.int64()), dense, asked)
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([shard.pack()], pa.binary())], names=["ids", "shard"])

        for batch in batches:
            for i, n, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, tf = unpacked(own, np.uint32, np.uint32)
                if len(at):
                    for held, x in ((ids, i), (terms, at), (counts, tf), (lengths, n)):
                        held.append(x)
                if len(ids) >= most:
                    yield row()
                    ids, terms, counts, lengths = [], [], [], []
        if ids:
            yield row()

    return checkpointed(found.mapInArrow(build, "ids array<long>, shard binary"))


def search(index: DataFrame, asked: Asked, least: np.ndarray, top: int, most_blocks: int | None = None) -> DataFrame:
    """row, id and score of each task's best documents."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(least, top)
        for batch in batches:
            for ids, data in zip(batch.column(0), batch.column(1), strict=True):
                shard = Shard.unpack(ids.values, data.as_py(), asked)
                for k in range(len(asked.rows)):
                    shard.search(asked, k, best, most_blocks)
        yield best.batch(asked.rows)

    return index.mapInArrow(look, "row long, id long, score long")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def ranked_documents(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of each item's best documents."""
    parsed = parsed_items(items, item_col, item_text_col)
    results = []
    for batch in item_batches(parsed):
        asked = Asked(batch)
        found = forward(docs, asked.vocabulary, id_col, text_col)
        number, total = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not number:
            break
        asked.weigh(number, total, document_frequencies(found, len(asked.vocabulary)))
        index = build_index(found, asked)
        least = np.ones(len(batch), np.int64)
        at = {row: k for k, row in enumerate(asked.rows)}
        for r in _ranked(search(index, asked, least, top, SEED_BLOCKS), top).filter(F.col("rank") == top).select("row", "score").collect():
            least[at[r["row"]]] = r["score"]
        results.append(_ranked(search(index, asked, least, top), top))
    empty = parsed.sparkSession.createDataFrame([], "row long, id long, score long, rank int")
    every = empty
    for r in results:
        every = every.unionByName(r)
    named = every.join(parsed.select("row", F.col("item").alias("__item")), "row")
    return named.select(F.col("__item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
