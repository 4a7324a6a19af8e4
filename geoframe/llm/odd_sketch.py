"""MinHash near-duplicates, verified by odd sketches.

A text's set of five-word shingles gives BANDS * ROWS MinHash samples.  Bands of
ROWS samples propose pairs: two sets of Jaccard similarity 0.85 share a band but
for (1 - 0.85**6)**32, less than 3 in ten million (other similarities: see Rule).  All samples of a set are
folded into an odd sketch: each flips one bit of SKETCH_BITS, so that samples two
sets have in common cancel in the XOR of their sketches, and its population count
tells the number of samples that differ.  A candidate of estimated similarity
below 0.70 is dropped; that is five standard deviations under 0.85.
Every other one is compared on the two texts' full sets of words, without hashes.

Work is on distinct sets.  Candidates come in two rounds, so that a group of
copies never makes all its pairs:

1. Rows of all bands are put in one order, dealt by range, and each is paired with
   the one before it.  This joins most sets of a group.
2. Of every band whose sets are not all joined by then, the sets that are in
   different components are compared by their sketches.  A band of many sets is cut
   into chunks, and each pair of chunks is a row of its own: no task holds more than
   two chunks, and no candidate is left out.  The texts of sets that have a candidate
   go to the same rows, where the candidates are compared, nearest sketches first,
   each in the first band that the two share; only links that join components come out.

Defined results: a null text counts as empty; a text without words has an empty
set and is linked with nothing, so that its component is its own id; fewer words
than a shingle are one shingle.  Rows of one id are separate documents.  A null id
takes part but is a component_id only where its component has no other id; its row
counts as kept then.  A very long text is read whole, in some 150 bytes of memory
for each of its words.  Equal texts meet in one set before anything is compared.
An empty table gives an empty result.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoframe.llm._shared import checkpointed, drop_unused_shuffles, id_filter, mixed, partitions, perhaps
from geoframe.llm.quality import text_slices, word_hashes, word_spans
from geoframe.llm.simhash import components

SHINGLE_WORDS, BANDS, ROWS, SKETCH_BITS, CHUNK = 5, 32, 6, 512, 512
SKETCH_WORDS = SKETCH_BITS // 64
Fingerprint = Callable[[list[bytes]], np.ndarray]
_FOLD = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.random.default_rng(13).integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)


@dataclass(frozen=True)
class Rule:
    """Sets are linked at a similarity of `percent`; bands and rows propose pairs, an estimate below `least` drops them."""

    percent: int = 85
    bands: int = BANDS
    rows: int = ROWS
    least: float = 0.70

    @property
    def most_bits(self) -> int:
        return differing_bits(self.least, self.bands * self.rows)


RULE = Rule()


def shingles(raw: np.ndarray, offsets: np.ndarray, words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of concatenated lower-case texts, in the texts' order, and their number in each; fewer words than a shingle are one."""
    starts, ends = word_spans(raw, offsets)
    hashes = word_hashes(raw, starts, ends)
    first = np.searchsorted(starts, offsets)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    run, out, of = hashes, [], []
    with np.errstate(over="ignore"):
        for n in range(1, words + 1):
            run = hashes if n == 1 else run[:-1] * _FOLD + hashes[n - 1 :]
            size = np.diff(first)
            at = first[:-1][size == n] if n < words else np.flatnonzero(owner[: len(run)] == owner[n - 1 :])
            out.append(run[at] + np.uint64(n))
            of.append(owner[at])
            if len(run) < 2:
                break
    values, of = np.concatenate(out), np.concatenate(of)
    return mixed(values)[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(offsets) - 1)


def differing_bits(similarity: float, drawn: int = BANDS * ROWS) -> int:
    """Bits in which the sketches of two sets of this similarity are expected to differ."""
    return round(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * drawn * (1 - similarity))))


def samples(hashes: np.ndarray, sizes: np.ndarray, drawn: int = BANDS * ROWS) -> np.ndarray:
    """MinHash samples of every set that is not empty."""
    begin = (np.cumsum(sizes) - sizes)[sizes > 0]
    out = np.empty((len(begin), drawn), np.uint64)
    with np.errstate(over="ignore"):
        for k, factor in enumerate(_FACTORS[:drawn]):
            out[:, k] = np.minimum.reduceat(hashes * factor, begin) if len(begin) else 0
    return out


def band_keys(drawn: np.ndarray, rows: int = ROWS) -> np.ndarray:
    keys = np.tile(np.arange(drawn.shape[1] // rows, dtype=np.uint64), (len(drawn), 1))
    with np.errstate(over="ignore"):
        for r in range(rows):
            keys = mixed(keys * _FOLD + drawn[:, r::rows])
    return keys


def odd_sketches(drawn: np.ndarray) -> np.ndarray:
    """The parity of the number of samples that fall on each bit, as SKETCH_WORDS words."""
    with np.errstate(over="ignore"):
        bit = (mixed(drawn * _FOLD + np.arange(drawn.shape[1], dtype=np.uint64)) % np.uint64(SKETCH_BITS)).astype(np.int64)
    at = bit + SKETCH_BITS * np.arange(len(drawn))[:, None]
    odd = np.bincount(at.ravel(), minlength=SKETCH_BITS * len(drawn)).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<u8").reshape(len(drawn), SKETCH_WORDS)


def _lowered(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    body = raw.tobytes().lower()
    return np.frombuffer(body, np.uint8), [body[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _sets(hashes: np.ndarray, sizes: np.ndarray) -> tuple[list[bytes | None], np.ndarray]:
    """A 128-bit digest of each set, none of an empty one, and the sets' sizes."""
    import xxhash

    distinct = [np.unique(x) for x in np.split(hashes, np.cumsum(sizes)[:-1])]
    return [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in distinct], np.array([len(x) for x in distinct], np.int64)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _prints(rows: DataFrame, rule: Rule, more: Fingerprint | None) -> DataFrame:
    """id, node (the set's digest), n, bands and sketch of every document, and fp if more makes it of the lower-case text."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, raw, at in text_slices(batch, 1):
                raw, texts = _lowered(raw, at)
                hashes, sizes = shingles(raw, at, SHINGLE_WORDS)
                nodes, n = _sets(hashes, sizes)
                drawn = samples(hashes, sizes, rule.bands * rule.rows)
                bands, sketches = (np.zeros((len(n), width), np.uint64) for width in (rule.bands, SKETCH_WORDS))
                bands[sizes > 0], sketches[sizes > 0] = band_keys(drawn, rule.rows), odd_sketches(drawn)
                columns = [pa.array(list(x.view(np.int64)), pa.list_(pa.int64())) for x in (bands, sketches)]
                if more:
                    columns.append(pa.array(more(texts).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], pa.array(nodes, pa.binary()), pa.array(n), *columns], names=names)

    schema = "id long, node binary, n long, bands array<long>, sketch array<long>" + ", fp long" * bool(more)
    names = [field.split()[0] for field in schema.split(", ")]
    return rows.mapInArrow(compute, schema)


def _neighbours(nodes: DataFrame) -> DataFrame:
    """key, nid and the nid before (null at first) of the bands that more than one set has. A range's first and last band may have one alone."""
    rows = nodes.select(F.explode("bands").alias("key"), "nid")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, opening = np.zeros((3, 0), np.int64), True  # rows of the last band, with the nid before (or -1)

        def out(x: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1]), pa.array(x[2], mask=x[2] < 0)], names=["key", "nid", "before"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.array([batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.full(batch.num_rows, -1)])
            both = np.concatenate([held, new], axis=1)
            same = both[0, 1:] == both[0, :-1]
            fresh = np.flatnonzero(same) + 1
            fresh = fresh[fresh >= held.shape[1]]
            both[2, fresh] = both[1, fresh - 1]
            shared = np.append(same, False) | np.insert(same, 0, False)
            shared[: held.shape[1]] = True
            last = both[0] == both[0, -1]
            if opening:
                shared |= both[0] == both[0, 0]
                opening = bool(last.all())
            keep = both[:, shared & ~last]
            yield out(keep)
            tail = both[:, last]
            yield out(tail[:, :-1])  # what is known of them does not change any more
            held = tail[:, -1:]
        yield out(held)

    order = [F.col("key"), F.xxhash64("key", "nid"), F.col("nid")]
    return rows.repartitionByRange(partitions(nodes.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(pair, "key long, nid long, before long")


def _possible(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of a and b elements can be similar enough."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _hopeful(pairs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) whose sizes and odd sketches allow the similarity."""
    side = lambda k: nodes.select(F.col("nid").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"sketch_{k}"))
    bits = sum((F.bit_count(F.col("sketch_a")[k].bitwiseXOR(F.col("sketch_b")[k])) for k in range(1, SKETCH_WORDS)), F.bit_count(F.col("sketch_a")[0].bitwiseXOR(F.col("sketch_b")[0])))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.filter(_possible(F.col("n_a"), F.col("n_b"), rule.percent)).filter(bits <= rule.most_bits).select("a", "b")


def _word_texts(docs: DataFrame, nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """nid and the words of one text of each asked node, lower-case, one space between. Texts of other nodes are passed over before the shuffle."""
    wanted = checkpointed(nodes.join(asked, "nid", "left_semi").select("nid", "node", "least"))
    ids = wanted.select(F.col("least").alias("id")).distinct()
    rows = perhaps(docs, "id", id_filter(ids)).join(ids.toDF("__id"), F.col("id").eqNullSafe(F.col("__id")), "left_semi")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, at in text_slices(batch, 1):
                raw, texts = _lowered(raw, at)
                nodes, _ = _sets(*shingles(raw, at, SHINGLE_WORDS))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array([b" ".join(t.split()) for t in texts], pa.binary())], names=["node", "words"])

    found = rows.select("id", "text").mapInArrow(compute, "node binary, words binary").groupBy("node").agg(F.first("words").alias("words"))
    return found.join(wanted.select("node", "nid"), "node").select("nid", "words")


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The shingle set of each text, as sorted numbers that stand for the same words in all of them."""
    code: dict[bytes, int] = {}
    ids = [np.array([code.setdefault(w, len(code)) for w in text.split()], np.int64) for text in texts]
    long_ = [k for k, own in enumerate(ids) if len(own) >= SHINGLE_WORDS]
    runs = [ids[k] for k in long_]
    for n in range(1, SHINGLE_WORDS if long_ else 1):  # runs of n + 1 words get numbers of their own
        runs = [run[:-1] * len(code) + ids[k][n:] for run, k in zip(runs, long_, strict=True)]
        runs = np.split(np.unique(np.concatenate(runs), return_inverse=True)[1], np.cumsum([len(r) for r in runs])[:-1])
    out = [np.array([-1 - k]) for k in range(len(texts))]  # a shorter text is a shingle like no other: of equal ones only one is here
    for k, run in zip(long_, runs, strict=True):
        out[k] = np.unique(run)
    return out


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(pairs: DataFrame, words: DataFrame, rule: Rule) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    side = lambda k: words.select(F.col("nid").alias(k), F.col("words").alias(f"words_{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "words_a", "words_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(*shingle_sets([x.as_py(), y.as_py()]), rule.percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(check, "a long, b long")


class _Sets:
    """The sets of a band, or of two chunks of one, as columns."""

    def __init__(self, rule: Rule, key: int, i: int, j: int, sets: pa.ListScalar):
        column = lambda name: sets.values.field(name).to_numpy(zero_copy_only=False)
        table = lambda name, width: sets.values.field(name).flatten().to_numpy().reshape(-1, width)
        self.rule, self.key, self.nid, self.label, self.n = rule, key, column("nid"), column("label"), column("n")
        self.sketch, self.bands = table("sketch", SKETCH_WORDS).view(np.uint64), table("bands", rule.bands)
        self.after = np.arange(len(self.nid)) if i == j else column("own")  # a set meets those with a larger number

    def hopeful(self) -> np.ndarray:
        """Pairs in different components whose sizes and sketches allow the similarity and that have no earlier band in common; nearest sketches first."""
        most, percent, found = self.rule.most_bits, self.rule.percent, [np.zeros((0, 3), np.int64)]
        for k in range(len(self.nid)):
            near = np.flatnonzero((self.after > self.after[k]) & (self.label != self.label[k]) & (100 * np.minimum(self.n, self.n[k]) >= percent * np.maximum(self.n, self.n[k])))
            bits = np.bitwise_count(self.sketch[near] ^ self.sketch[k]).sum(axis=1, dtype=np.int64)
            near, bits = near[bits <= most], bits[bits <= most]
            first = self.bands[k][(self.bands[near] == self.bands[k]).argmax(axis=1)] == self.key
            found.append(np.stack([np.full(first.sum(), k), near[first], bits[first]], axis=1))
        pairs = np.concatenate(found)
        return pairs[np.argsort(pairs[:, 2], kind="stable"), :2]

    def links(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Links among hopeful pairs that connect components; each is checked on the full sets."""
        sets, joined = shingle_sets(words), {}

        def top(x: int) -> int:
            while x in joined:
                x = joined[x]
            return x

        out = []
        for k, j in self.hopeful().tolist():
            a, b = top(int(self.label[k])), top(int(self.label[j]))
            if a != b and similar(sets[k], sets[j], self.rule.percent):
                joined[max(a, b)] = min(a, b)
                out.append((int(self.nid[k]), int(self.nid[j])))
        return out


def _across(shared: DataFrame, named: DataFrame, nodes: DataFrame, word_texts: Callable[[DataFrame], DataFrame], rule: Rule) -> DataFrame:
    """Links (a, b) between different components of sets that share a band, enough to connect all that are similar."""
    rows = shared.select("key", "nid").join(named, "nid")
    open_ = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).filter("low != high")
    chunks = F.ceil(F.col("size") / CHUNK)
    own = rows.join(open_.select("key", chunks.alias("chunks")), "key").withColumn("own", F.pmod(F.xxhash64("nid"), "chunks"))
    dealt = own.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "nid", "label", "own").join(nodes.select("nid", "n", "sketch", "bands"), "nid")
    columns = ["nid", "label", "own", "n", "sketch", "bands"]
    group = lambda df, *more: df.groupBy("key", "i", "j").agg(F.collect_list(F.struct(*columns, *more)).alias("sets"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, i, j, sets in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), strict=True):
                found = sets.values.take(pa.array(np.unique(_Sets(rule, key, i, j, sets).hopeful())))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), x, np.int64)) for x in (key, i, j)] + [found.field(c) for c in columns], names=["key", "i", "j", *columns])

    # whole rows, which only lack their words then: nothing has to be joined to them again
    asked = checkpointed(group(dealt).filter("size(sets) > 1").mapInArrow(ask, "key long, i long, j long, nid long, label long, own long, n long, sketch array<long>, bands array<long>"))
    drop_unused_shuffles(nodes.sparkSession)
    words = word_texts(asked.select("nid").distinct())
    full = asked.join(words, "nid")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, i, j, sets in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), strict=True):
                pairs = np.array(_Sets(rule, key, i, j, sets).links(sets.values.field("words").to_pylist()), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return group(full, "words").mapInArrow(confirm, "a long, b long")


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = RULE, more: Fingerprint | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, node, n, nid, least, and fp if more is given) of every document, nid null for an empty set, and links (a, b) between nids that connect each group: from every node of a group of the first round to its least, and those of the second."""
    rows = _texts(docs, id_col, text_col)
    prints = checkpointed(_prints(rows, rule, more))
    grouped = prints.filter("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = checkpointed(grouped.withColumn("nid", F.monotonically_increasing_id()))
    shared = checkpointed(_neighbours(nodes))
    drop_unused_shuffles(docs.sparkSession)  # here and below: else the files of all steps stay until the driver happens to collect its garbage
    word_texts = lambda asked: _word_texts(rows, nodes, asked)
    chained = shared.filter("before IS NOT NULL").select(F.least("nid", "before").alias("a"), F.greatest("nid", "before").alias("b")).distinct()
    hopeful = checkpointed(_hopeful(chained, nodes, rule))
    drop_unused_shuffles(docs.sparkSession)
    asked = hopeful.select(F.col("a").alias("nid")).unionByName(hopeful.select(F.col("b").alias("nid"))).distinct()
    first = checkpointed(_confirmed(hopeful, word_texts(asked), rule))
    drop_unused_shuffles(docs.sparkSession)
    joined = components(first)
    named = nodes.select("nid").join(joined.withColumnRenamed("node", "nid"), "nid", "left").select("nid", F.coalesce("label", "nid").alias("label"))
    second = checkpointed(_across(shared, named, nodes, word_texts, rule))
    drop_unused_shuffles(docs.sparkSession)
    found = prints.drop("bands", "sketch").join(nodes.select("node", "nid", "least"), "node", "left")
    return found, joined.toDF("a", "b").unionByName(second)  # the stars of the first round are not linked up anew


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, n_shingles, component_id, kept."""
    found, links = similar_sets(docs, id_col, text_col)
    labels = components(links).withColumnRenamed("node", "nid")
    named = found.filter("nid IS NOT NULL").select("nid", "least").distinct().join(labels, "nid", "left").select("nid", "least", F.coalesce("label", "nid").alias("label"))
    classes = named.join(named.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("nid", "component_id")
    rows = found.join(classes, "nid", "left").withColumn("component_id", F.when(F.col("nid").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
