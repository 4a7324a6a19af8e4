"""Language-model scores by context-tree weighting over bytes.

Every byte is eight binary decisions.  Each decision has a tree of contexts: the
0 to DEPTH bytes before it.  A node of the tree has a Krichevsky-Trofimov
estimate from its counts, and its weighted probability is

    Pw(node) = KT(node) / 2 + product of Pw(children) / 2      (KT at full depth)

A decision is predicted by the mixture that this recursion implies: from the
deepest context up, each node mixes its own estimate with the prediction from
below, by the weight KT / (2 Pw).  All depths take part.

What is scored are the lower-cased (A-Z) bytes as they stand, layout included, and
an end.  The text's UTF-8 bytes stand between bytes 0xFF, which UTF-8 never uses;
the closing one is predicted too, so that probabilities of all texts add up to at
most 1.  Counts come from the documents outside the held-out fold and are then
fixed.

On the cluster: blocks of documents send their distinct (context, byte) strings
with training counts to buckets.  A bucket holds whole subtrees: all strings that
share their UNIT nearest context bytes, or more of them where a context is common.
Which contexts are split is read off a bounded sample of strings (at most SAMPLE,
from blocks and places spread evenly; it decides where work is done, not what
comes out), at most SPLITS contexts in all.  Buckets report the nodes above their
subtrees, which Spark sums by node: at most 65,280 and 255 for each split context,
however many the buckets are, which are weighted on the driver and broadcast; then buckets reply a log-probability for each string of each block, as a
double.  Word counts for the base score go the same way.

Contexts are at most 6 bytes deep: with the predicted byte they fill a 64-bit key
but for the bit that marks training.

Defined results: a null text counts as empty (its end is still predicted);
repeated rows get equal scores; a null id has remainder 0; without training
documents every decision has probability 1/2 and base counts are 0; a very long
text is a block of its own, whose strings are made SLICE bytes at a time; an empty
table gives an empty result.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoframe.llm import _shared as S
from geoframe.llm.quality import word_hashes, word_spans

DEPTH, UNIT, HELD_OUT, BLOCK_BYTES, SLICE = 6, 2, 1, 16 << 20, 2 << 20
SAMPLE, SPLITS, MERGED, HELD = 1 << 20, 1 << 12, 1 << 22, 1 << 21
EDGE = 255
LOG2 = float(np.log(2.0))
END_WORD = np.uint64(2**64 - 1)
TOP_SCHEMA = "unit int, node long, n0 long, n1 long, below double"
SCHEMA = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, scored_bytes long, bits_per_byte double"
_TABLE = 1 << 16
_HALVES = np.concatenate([[0.0], np.cumsum(np.log(np.arange(_TABLE) + 0.5))])
_WHOLES = np.concatenate([[0.0], np.cumsum(np.log(np.arange(_TABLE) + 1.0))])


def _lgamma(z: np.ndarray) -> np.ndarray:
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    halves = lambda n: np.where(n <= _TABLE, _HALVES[np.minimum(n, _TABLE)], _lgamma(np.maximum(n, 1) + 0.5) - 0.5 * np.log(np.pi))
    total = n0 + n1
    return halves(n0) + halves(n1) - np.where(total <= _TABLE, _WHOLES[np.minimum(total, _TABLE)], _lgamma(total + 1.0))


def _weigh(kt: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log Pw of nodes, and the weight of their own estimate."""
    own = kt - LOG2
    whole = np.logaddexp(own, below - LOG2)
    return whole, np.exp(own - whole)


class ContextTree:
    """Depths `unit` to `depth` over sorted distinct keys (nearest context byte first, predicted byte last) with counts.

    The eight bits of a byte have trees of their own, which are made one at a time.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, unit: int = UNIT):
        self.depth, self.unit = depth, unit
        sub, n = keys, counts.astype(np.int64)
        self.levels: dict[int, tuple[np.ndarray, np.ndarray]] = {depth: (sub, n)}
        self.above: dict[int, np.ndarray] = {}  # from the keys of a depth to those of the depth above
        for d in range(depth - 1, unit - 1, -1):
            shorter = (sub >> np.uint64(16) << np.uint64(8)) | (sub & np.uint64(255))
            sub, above = np.unique(shorter, return_inverse=True)
            n = np.bincount(above, n, len(sub)).astype(np.int64)
            self.levels[d], self.above[d + 1] = (sub, n), above.astype(np.int32)

    def _tree(self, j: int) -> dict[int, dict]:
        """The nodes that decide bit j, by depth."""
        tree: dict[int, dict] = {}
        for d in range(self.depth, self.unit - 1, -1):
            node = self._nodes(*self.levels[d], j)
            kt = log_kt(node["n0"], node["n1"])
            if d == self.depth:
                node["log"], node["own"] = kt, np.ones(len(kt))
            else:
                parent = node["of"][self.above[d + 1][tree[d + 1]["first"]]]
                node["log"], node["own"] = _weigh(kt, np.bincount(parent, tree[d + 1]["log"], len(kt)))
            tree[d] = node
        return tree

    @staticmethod
    def _nodes(sub: np.ndarray, n: np.ndarray, j: int) -> dict:
        name = sub >> np.uint64(8 - j)
        fresh = np.concatenate([[True], name[1:] != name[:-1]])
        first = np.flatnonzero(fresh)
        one = ((sub >> np.uint64(7 - j)) & np.uint64(1)).astype(np.int64)
        n1 = np.add.reduceat(n * one, first)
        return {"of": np.cumsum(fresh, dtype=np.int32) - np.int32(1), "first": first, "n1": n1, "n0": np.add.reduceat(n, first) - n1}

    def top(self) -> tuple[np.ndarray, ...]:
        """For the nodes of depth unit - 1: node (context bytes, bit prefix), n0, n1 and the sum of log Pw of the children here."""
        out = []
        for j in range(8):
            node = self._tree(j)[self.unit]
            sub = self.levels[self.unit][0][node["first"]]
            out.append((node_names(sub, self.unit, self.unit - 1, j), node["n0"], node["n1"], node["log"]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def log_probability(self, keys: np.ndarray, top: TopLevels) -> np.ndarray:
        """Natural log-probability of each key's predicted byte in its context."""
        total = np.zeros(len(keys))
        for j in range(8):
            tree, row, p = self._tree(j), np.arange(len(keys), dtype=np.int32), None
            for d in range(self.depth, self.unit - 1, -1):
                node = tree[d]
                at = node["of"][row]
                kt = ((node["n1"] + 0.5) / (node["n0"] + node["n1"] + 1.0))[at]
                own = node["own"][at]
                p = kt if p is None else own * kt + (1 - own) * p
                row = self.above[d][row] if d in self.above else row
            p = top.mix(p, keys, self.depth, self.unit, j)
            one = ((keys >> np.uint64(7 - j)) & np.uint64(1)) == 1
            total += np.log(np.where(one, p, 1 - p))
        return total


def node_names(keys: np.ndarray, depth: int, d: int, j: int) -> np.ndarray:
    """Of keys with `depth` context bytes, the node at depth d that decides bit j: context bytes, then a one and the bits before."""
    context = (keys >> np.uint64(8 * (depth - d + 1))) << np.uint64(8)
    return (context | np.uint64(1 << j) | ((keys & np.uint64(255)) >> np.uint64(8 - j))).astype(np.int64)


class TopLevels:
    """The depths above the buckets' subtrees: 0 and 1 (255 and 65,280 nodes at most) whole, deeper ones for split contexts (255 nodes each)."""

    def __init__(self, node: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray, unit: np.ndarray | None = None):
        unit = np.full(len(node), UNIT) if unit is None else unit
        self.deeper: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        sums = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0))  # what split contexts pass up: node, n0, n1, log Pw
        for level in range(int(unit.max(initial=UNIT)), UNIT - 1, -1):
            mine = unit == level
            names, at = np.unique(np.concatenate([node[mine], sums[0]]), return_inverse=True)
            a, b, s = (np.bincount(at, np.concatenate([x[mine], y]), len(names)) for x, y in zip((n0, n1, below), sums[1:], strict=True))
            if level == UNIT:
                break
            log, own = _weigh(log_kt(a.astype(np.int64), b.astype(np.int64)), s)
            self.deeper[level - 1] = names, own, (b + 0.5) / (a + b + 1)
            sums = ((names >> 16 << 8) | (names & 255), a, b, log)
        grid = lambda x: np.bincount(names, x, 65536).reshape(256, 256)
        a, b, s = grid(a), grid(b), grid(s)
        log1, self.own1 = _weigh(log_kt(a.astype(np.int64), b.astype(np.int64)), s)
        self.kt1 = (b + 0.5) / (a + b + 1)
        a0, b0 = a.sum(axis=0), b.sum(axis=0)
        _, self.own0 = _weigh(log_kt(a0.astype(np.int64), b0.astype(np.int64)), log1.sum(axis=0))
        self.kt0 = (b0 + 0.5) / (a0 + b0 + 1)

    def mix(self, p: np.ndarray, keys: np.ndarray, depth: int, unit: int, j: int) -> np.ndarray:
        """p, predicted from depth `unit` on for bit j of the keys' bytes, mixed with the estimates of all depths above."""
        for d in range(unit - 1, UNIT - 1, -1):
            names, own, kt = self.deeper[d]
            at = np.searchsorted(names, node_names(keys, depth, d, j))
            p = own[at] * kt[at] + (1 - own[at]) * p
        nearest, prefix = np.divmod(node_names(keys, depth, 1, j), 256)
        own = self.own1[nearest, prefix]
        p = own * self.kt1[nearest, prefix] + (1 - own) * p
        return self.own0[prefix] * self.kt0[prefix] + (1 - self.own0[prefix]) * p


def gram_slices(body: bytes, offsets: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A key per byte of every text and one for its end (the depth bytes before, nearest first, then the byte), with its text's number, SLICE bytes at a time."""
    edge, ends = bytes([EDGE]) * depth, offsets.tolist()
    raw = np.frombuffer(edge + b"".join(body[a:b] + bytes([EDGE]) + edge for a, b in zip(ends[:-1], ends[1:], strict=True)), np.uint8)
    first = offsets[:-1] + np.arange(len(ends) - 1) * (depth + 1) + depth  # where each text's keys begin
    last = first + np.diff(offsets)
    for a in range(depth, len(raw) - depth, SLICE):
        b = min(a + SLICE, len(raw) - depth)
        keys = raw[a:b].astype(np.uint64)
        for k in range(1, depth + 1):
            keys |= raw[a - k : b - k].astype(np.uint64) << np.uint64(8 * (depth + 1 - k))
        low, high = int(np.searchsorted(first, a, "right")) - 1, int(np.searchsorted(first, b))
        edges = np.clip(first[low:high], a, b)
        of = np.repeat(np.arange(low, high, dtype=np.int32), np.diff(np.append(edges, b)))
        scored = np.arange(a, b) <= last[of]
        yield keys[scored], of[scored]


def gram_keys(body: bytes, offsets: np.ndarray, depth: int) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *(keys for keys, _ in gram_slices(body, offsets, depth))])


def _counted(keys: np.ndarray, training: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs in training."""
    keys, training = (x[np.argsort(keys)] for x in (keys, training)) if keys.size and keys.max() >> np.uint64(63) else (keys, training)
    if keys.size and not keys.max() >> np.uint64(63):
        tagged = (keys << np.uint64(1)) | training.astype(np.uint64)
        tagged.sort()
        keys, training = tagged >> np.uint64(1), (tagged & np.uint64(1)).astype(np.uint32)
    fresh = np.concatenate([[True], keys[1:] != keys[:-1]]) if keys.size else np.zeros(0, bool)
    first = np.flatnonzero(fresh)
    return keys[first], np.add.reduceat(training, first, dtype=np.int64).astype(np.uint32) if keys.size else np.zeros(0, np.uint32)


def _words(body: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a block and the number of words of each text."""
    raw = np.frombuffer(body, np.uint8)
    starts, ends = word_spans(raw, offsets)
    parts, first = [], 0
    while first < len(starts):  # about a MB at a time
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + (1 << 20), "right")))
        a, b = starts[first], ends[last - 1]
        parts.append(word_hashes(raw[a:b], starts[first:last] - a, ends[first:last] - a))
        first = last
    hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return np.minimum(hashes, END_WORD - np.uint64(1)), np.diff(np.searchsorted(starts, offsets))


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct keys; a plain sort is several times faster than one that keeps track of places."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of some sorted lists of distinct keys with counts, and the sums of their counts."""
    if len(parts) == 1:
        return parts[0]
    keys = _distinct(np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in parts)]))
    total = np.zeros(len(keys), np.int64)
    for k, n in parts:
        total[np.searchsorted(keys, k)] += n
    return keys, total


def _gram_counts(body: bytes, offsets: np.ndarray, flags: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of a block and how often each occurs in training, slice by slice."""
    keys, counts = _summed([_counted(own, flags[of]) for own, of in gram_slices(body, offsets, depth)])
    return keys, counts.astype(np.uint32)


class Units:
    """Which bucket a key belongs to.

    Words have the first `buckets` buckets.  Then come, for each number of context
    bytes that a bucket's subtrees share, ranges of contexts that hold equal shares of
    the sample; a node above them is in few buckets.
    """

    def __init__(self, sample: np.ndarray, buckets: int, depth: int):
        self.buckets, self.depth, self.split, self.bounds, self.first = buckets, depth, {}, {}, [buckets]
        room, whole = SPLITS, max(len(sample), 1)
        for d in range(UNIT, depth + 1):
            contexts = np.sort(sample >> np.uint64(8 * (depth + 1 - d)))
            names, counts = np.unique(contexts, return_counts=True)
            hot = np.flatnonzero(counts * 2 * buckets > max(whole, 2 * buckets * 64)) if d < depth else counts[:0]
            hot = hot[np.argsort(-counts[hot], kind="stable")[:room]]
            room -= len(hot)
            own = contexts[~np.isin(contexts, names[hot])]
            n = max(1, -(-len(own) * buckets // whole))
            self.bounds[d] = np.unique(own[np.arange(1, n) * len(own) // n]) if len(own) else own
            self.first.append(self.first[-1] + len(self.bounds[d]) + 1)
            if not len(hot):
                break
            self.split[d] = np.sort(names[hot])
            sample = sample[np.isin(sample >> np.uint64(8 * (depth + 1 - d)), self.split[d])]

    def parts(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For sorted keys: each bucket that has some, and which."""
        rest = np.arange(len(keys))
        for d, bounds in self.bounds.items():
            contexts = keys[rest] >> np.uint64(8 * (self.depth + 1 - d))
            deeper = np.isin(contexts, self.split[d]) if d in self.split else np.zeros(len(rest), bool)
            own, contexts = rest[~deeper], contexts[~deeper]
            ends = np.concatenate([[0], np.searchsorted(contexts, bounds), [len(own)]])
            for k in np.flatnonzero(np.diff(ends)).tolist():
                yield self.first[d - UNIT] + k, own[ends[k] : ends[k + 1]]
            rest = rest[deeper]

    def word_parts(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order, ends = S.dealt(words, self.buckets)
        for b in np.flatnonzero(np.diff(ends)).tolist():
            yield b, order[ends[b] : ends[b + 1]]

    def unit(self, bucket: int) -> int:
        """How many context bytes the keys of a bucket's subtrees share at least."""
        return int(np.searchsorted(self.first, bucket, "right")) - 1 + UNIT


def _sampled(blocks: DataFrame, depth: int) -> np.ndarray:
    """At most SAMPLE keys, from places spread evenly over evenly chosen blocks."""
    every = -(-blocks.count() * 4096 // SAMPLE)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, _, offsets, body = S.unpack_block(row)
                out = []
                for keys, _ in gram_slices(body.lower(), offsets, depth):
                    out.append(keys[:: -(-(len(body) + len(offsets)) // 4000)])
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(out).tobytes() if out else b""], pa.binary())], names=["keys"])

    chosen = blocks.filter(F.pmod(F.xxhash64("block"), F.lit(max(every, 1))) == 0)
    return np.frombuffer(b"".join(bytes(r["keys"]) for r in chosen.mapInArrow(some, "keys binary").toLocalIterator()), np.uint64)


def _requests(blocks: DataFrame, units: Units) -> DataFrame:
    """Distinct words and context strings with their training counts, by bucket."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, flags, offsets, body = S.unpack_block(row)
                body, out = body.lower(), []
                hashes, per_text = _words(body, offsets)
                words, counts = _counted(np.append(hashes, END_WORD), np.append(np.repeat(flags, per_text), 0))
                counts[-1] = flags.sum(dtype=np.uint32)
                keys, grams = _gram_counts(body, offsets, flags, units.depth)
                for parts, k, v in ((units.word_parts(words), words, counts), (units.parts(keys), keys, grams)):
                    out += [(b, S.packed(S.delta(k[at]), v[at])) for b, at in parts]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int64()), pa.array([row["block"]] * len(out), pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["bucket", "block", "data"])

    asked = blocks.mapInArrow(emit, S.REQUEST_SCHEMA)
    return S.checkpointed(asked.repartition(S.partitions(blocks.sparkSession), "bucket").sortWithinPartitions("bucket"))


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """A table for each bucket of a partition of _requests(), which holds whole buckets one after the other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        buckets = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(buckets[1:] != buckets[:-1]) + 1).tolist(), len(buckets)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and a < b and held[-1].column(0)[0].as_py() != buckets[a]:
                yield pa.Table.from_batches(held)
                held = []
            held += [batch.slice(a, b - a)] if a < b else []
    if held:
        yield pa.Table.from_batches(held)


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a bucket and their counts over all blocks, merged some blocks at a time."""
    held, size, merged = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0, 0
    for x in table.column("data").to_pylist():
        own, n = S.unpacked(x, np.uint64, np.uint32)
        held.append((np.cumsum(own, dtype=np.uint64), n.astype(np.int64)))
        size += len(own)
        if size >= max(MERGED, merged):
            held, size = [_summed(held)], 0
            merged = len(held[0][0])
    return _summed(held)


def _fit(requests: DataFrame, units: Units) -> tuple[TopLevels, int, int]:
    """The top depths, the number of training tokens and of distinct ones."""

    def summarize(table: pa.Table) -> pa.RecordBatch:
        keys, counts = _merged(table)
        bucket = table.column("bucket")[0].as_py()
        if bucket < units.buckets:
            unit, rows = 0, [np.array([x]) for x in (-1, counts.sum(), (counts > 0).sum(), 0.0)]
        else:
            unit = units.unit(bucket)
            node, n0, n1, below = ContextTree(keys, counts, units.depth, unit).top()
            names, at = np.unique(node, return_inverse=True)
            rows = [names, *(np.bincount(at, x, len(names)) for x in (n0, n1, below))]
        names = [x.split()[0] for x in TOP_SCHEMA.split(", ")]
        columns = [pa.array(x.astype(t)) for x, t in zip(rows, ("i8", "i8", "i8", "f8"), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows[0]), unit, np.int32)), *columns], names=names)

    tops = requests.mapInArrow(lambda batches: map(summarize, _by_bucket(batches)), TOP_SCHEMA)
    # summed before it reaches the driver; in decimals, which come out alike in any order
    below = F.sum(F.col("below").cast("decimal(38,18)")).cast("double").alias("below")
    summed = tops.groupBy("unit", "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), below).toArrow()
    unit, node, n0, n1, below = (summed.column(c).to_numpy() for c in ("unit", "node", "n0", "n1", "below"))
    words, deep = unit == 0, unit != 0
    top = TopLevels(node[deep], n0[deep].astype(np.float64), n1[deep].astype(np.float64), below[deep], unit[deep])
    return top, int(n0[words].sum()), int(n1[words].sum())


def text_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """A row per document: held_out, n_tokens, n_known, train_tokens, base_score, score, scored_bytes, bits_per_byte."""
    if not UNIT <= depth <= 6:
        raise ValueError("depth is 2 to 6: a context and its byte fit into 64 bits with a mark")
    spark = docs.sparkSession
    blocks = S.text_blocks(docs, id_col, text_col, (S.id_remainder(id_col, 5) != HELD_OUT).cast("byte"), BLOCK_BYTES)
    units = Units(_sampled(blocks, depth), 2 * S.partitions(spark), depth)
    requests = _requests(blocks, units)
    top, tokens, distinct = _fit(requests, units)
    S.drop_unused_shuffles(spark)  # the requests' own, now that the checkpoint is what is read
    shared = spark.sparkContext.broadcast(top)

    def answer(table: pa.Table) -> Iterator[pa.RecordBatch]:
        keys, counts = _merged(table)
        bucket = table.column("bucket")[0].as_py()
        values = counts if bucket < units.buckets else ContextTree(keys, counts, depth, units.unit(bucket)).log_probability(keys, shared.value)
        for block, data in zip(table.column("block").to_pylist(), table.column("data").to_pylist(), strict=True):
            own = np.cumsum(S.unpacked(data, np.uint64, np.uint32)[0], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([bucket]), pa.array([S.packed(values[np.searchsorted(keys, own)])], pa.binary())], names=["block", "bucket", "data"])

    def score(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        replies = dict(zip(theirs.column("bucket").to_pylist(), theirs.column("data").to_pylist(), strict=True))
        out = []
        for row in mine.to_pylist():
            ids, flags, offsets, body = S.unpack_block(row)
            body = body.lower()
            hashes, per_text = _words(body, offsets)
            words, where = np.unique(np.append(hashes, END_WORD), return_inverse=True)
            known = _replied(len(words), units.word_parts(words), replies, np.int64).astype(np.float64)
            base = np.log10((known + 0.5) / (tokens + 0.5 * (distinct + 1)))
            ends = np.concatenate([[0], np.cumsum(per_text)])
            total = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x[where[:-1]])])[ends]) + x[where[-1]]  # noqa: E731, B023
            n_known, base_score = total((known > 0).astype(np.float64)), total(base)
            del hashes, where, words, known, base
            orders, grams = _orders_and_grams(body, offsets, depth)
            log = _replied(len(grams), units.parts(grams), replies, np.float64)
            natural = np.zeros(len(ids))
            for order, (keys, of) in zip(orders, gram_slices(body, offsets, depth), strict=True):
                own, times = _runs(keys[order])
                per_byte = np.empty(len(keys))
                per_byte[order] = np.repeat(log[np.searchsorted(grams, own)], times)
                first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else of
                natural[of[first]] += np.add.reduceat(per_byte, first) if len(of) else 0.0
            del orders, log
            sizes = np.diff(offsets)
            out.append(pa.table({
                "id": pa.array(ids, pa.int64()), "held_out": flags == 0, "n_tokens": per_text + 1, "n_known": n_known.round().astype(np.int64), "train_tokens": np.full(len(ids), tokens),
                "base_score": base_score, "score": natural / np.log(10.0), "scored_bytes": sizes, "bits_per_byte": -natural / LOG2 / np.maximum(sizes, 1),
            }))
        return pa.concat_tables(out)

    replies = requests.mapInArrow(lambda batches: (b for t in _by_bucket(batches) for b in answer(t)), S.REPLY_SCHEMA)
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(score, SCHEMA).withColumnRenamed("id", id_col)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of sorted keys, and how often each occurs."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def _orders_and_grams(body: bytes, offsets: np.ndarray, depth: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each slice the order that sorts its keys, and the sorted distinct keys of all slices, merged some slices at a time."""
    orders, held, size = [], [np.zeros(0, np.uint64)], 0
    for keys, _ in gram_slices(body, offsets, depth):
        order = np.argsort(keys).astype(np.int32)
        orders.append(order)
        held.append(_runs(keys[order])[0])
        size += len(held[-1])
        if size >= max(HELD, len(held[0])):
            held, size = [_distinct(np.concatenate(held))], 0
    return orders, _distinct(np.concatenate(held)) if len(held) > 1 else held[0]


def _replied(n: int, parts: Iterable[tuple[int, np.ndarray]], replies: dict[int, bytes], kind: type) -> np.ndarray:
    """The values that buckets sent for a block's n sorted keys, in their order."""
    out = np.zeros(n, kind)
    for bucket, at in parts:
        out[at] = S.unpacked(replies[bucket], kind)[0]
    return out
