"""Alignment of two tokenizers over a corpus, counted through minimal perfect hashing.

A text is encoded by a byte-level BPE (A) and a SentencePiece model (B).  Byte
offsets where tokens of both end cut it into groups, and all tokens of A and B that
share a group are linked.  How many documents hold a pair of ids linked is counted
over the corpus:

1. Documents are encoded once, into blocks of token ids.  Each block is aligned and
   sends its distinct pairs, and how many of its documents hold them, to buckets of A
   ids.
2. The distinct pairs of a bucket get a minimal perfect hash, whose slots hold the
   pairs themselves; each block's numbers become a dense vector by slot, and the
   vectors are summed in a tree of FAN to one.
3. A second pass aligns the blocks again and looks their pairs up: the slot's pair is
   compared, and its count and whether it is its A id's highest come back.

There are at most 50,257 x 32,000 pairs, whatever the corpus; a bucket holds the
pairs of some A ids, 32,000 each at most.  A block's pairs travel as one packed array
per bucket, so that a pair that every document holds is one number per block.

Defined results: texts that are null, empty, or that B's normaliser changes have no
tokens: zeros and an empty groups_sha256.  Rows of one id, or with none, are
separate documents.  A very long text is encoded in pieces of some PIECE characters,
cut before a single blank (check_models() proves that no piece of B holds one inside;
A's pattern says it of A), and aligned some SLICE groups at a time, in some 60 bytes
of memory for each of its tokens; a piece without such a blank is encoded whole, and
the distinct pairs of its largest group are held at once.  An empty table gives an
empty result.  Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoframe.llm._shared import BLOCK_BYTES, checkpointed, delta, mixed, packed, partitions, unpacked
from geoframe.llm.exact_dedup import _levels, _slots

BYTE_BPE, PIECE_BPE, FAN, PIECE, SLICE, LARGE, BLOCKS_A_PART = "byte_bpe_50k", "piece_bpe_32k.model", 64, 1 << 20, 1 << 19, 1 << 12, 1024
RESULT = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
#: A blank between two characters that are none.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Decimal digits of each id, right-justified, and which of them are written.
_DIGITS = np.stack([(np.arange(65536) // 10 ** (4 - d) % 10 + 48) for d in range(5)], axis=1).astype(np.uint8)
_WRITTEN = np.stack([np.arange(65536) >= 10 ** (4 - d) if d < 4 else np.ones(65536, bool) for d in range(5)], axis=1)
_loaded: dict[str, tuple] = {}


class Spelling:
    """The bytes of each id of a vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.raw = np.frombuffer(b"".join(tokens), np.uint8)

    def written(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, one after the other."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.raw[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Models:
    """Both tokenizers, and the bytes of each token."""

    def __init__(self, byte_bpe: str, piece_bpe: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(f"{byte_bpe}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(byte_bpe, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.exact = Tokenizer.from_file(public_tokenizers.path(f"{byte_bpe}.json"))
        self.exact.encode_special_tokens = True
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(piece_bpe))
        name = self.pieces.id_to_piece
        own = [bytes([int(name(i)[3:5], 16)]) if self.pieces.is_byte(i) else name(i).replace("▁", " ").encode() for i in range(len(self.pieces))]
        by_id = {i: b for b, i in ranks.items()}
        self.a, self.b = Spelling([by_id.get(i, b"") for i in range(max(by_id) + 1)]), Spelling(own)
        self.size_b = len(own)

    def encode_a(self, text: str) -> list[int]:
        try:
            return self.fast.encode_ordinary(text)
        except BaseException as error:  # a very long run overflows the pattern's stack, which is not an Exception
            if isinstance(error, (KeyboardInterrupt, SystemExit, GeneratorExit, MemoryError)):
                raise
            return self.exact.encode(text, add_special_tokens=False).ids


def models(byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> Models:
    key = f"{byte_bpe} {piece_bpe}"
    if key not in _loaded:
        _loaded[key] = (Models(byte_bpe, piece_bpe),)
    return _loaded[key][0]


def check_models(m: Models) -> None:
    """Texts may be cut before a single blank only if no piece of B has a blank after another character."""
    if any(b" " in piece.lstrip(b" ") for piece in m.b.tokens):
        raise ValueError("a piece of the second tokenizer holds a blank inside: texts cannot be cut at blanks")


def _pieces(text: str) -> list[str]:
    """A long text in parts that both tokenizers encode as they do the whole; the blank between two is left out of both."""
    parts, first = [], 0
    while len(text) - first > PIECE:
        found = _CUT.search(text, first + PIECE)
        if not found:
            break
        parts.append(text[first : found.start()])
        first = found.end()
    return [*parts, text[first:]]


def encoded(texts: list[str], m: Models) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of A and B of all texts and their numbers by text; none where the bytes of either differ from a blank and the text."""
    parts = [_pieces(t) for t in texts]
    of = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
    flat = list(chain.from_iterable(parts))
    lists_a, lists_b = [m.encode_a(" " + p) for p in flat], m.pieces.encode(flat, num_threads=1) if flat else []
    want = "".join(" " + p for p in flat).encode()
    sizes = np.array([len(p.encode()) + 1 for p in flat], np.int64)
    out, good = [], np.array([bool(t) for t in texts])
    for lists, spelling in ((lists_a, m.a), (lists_b, m.b)):
        n = np.array([len(x) for x in lists], np.int64)
        ids = np.fromiter(chain.from_iterable(lists), np.uint16, int(n.sum()))
        out.append((ids, n))
        ends = np.cumsum(n)
        written, edges = spelling.written(ids), np.concatenate([[0], np.cumsum(spelling.sizes[ids])])
        lengths = edges[ends] - edges[ends - n]
        same = lengths == sizes
        if not (same.all() and written.tobytes() == want):
            at, begin = edges[ends - n], np.cumsum(sizes) - sizes
            same &= np.array([written[a : a + k].tobytes() == want[b : b + k] for a, b, k in zip(at.tolist(), begin.tolist(), sizes.tolist(), strict=True)], bool)
            good[of[~same]] = False
    kept = []
    for ids, n in out:
        kept += [ids[np.repeat(good[of], n)], np.bincount(of, weights=n, minlength=len(texts)).astype(np.int64) * good]
    return kept[0], kept[2], kept[1], kept[3]


def token_blocks(docs: DataFrame, id_col: str, text_col: str, names: tuple[str, str], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents gathered into blocks of token ids, in place (no shuffle), kept in the checkpoint folder: block, ids, and numbers and ids of A and B."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("tokens", pa.binary())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        m, made, size = models(*names), TaskContext.get().partitionId() << 32, 0
        held: list[tuple] = []  # ids of documents, and encoded() of them

        def row() -> pa.RecordBatch:
            parts = [np.concatenate([h[1][k] for h in held]) for k in range(4)]
            tokens = zstandard.ZstdCompressor(level=9).compress(parts[0].tobytes() + parts[1].tobytes())
            return pa.RecordBatch.from_arrays([pa.array([made]), pa.array([[i for h in held for i in h[0]]], pa.list_(pa.int64())), pa.array([packed(parts[2], parts[3])]), pa.array([tokens])], schema=schema)

        def flush(ids: list, texts: list[str]) -> None:
            if ids:
                held.append((ids, encoded(texts, m)))

        for batch in batches:
            ids, texts, waiting = [], [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                ids.append(i)
                texts.append(text)
                waiting += len(text)
                if waiting >= PIECE:
                    flush(ids, texts)
                    size, ids, texts, waiting = size + waiting, [], [], 0
                    if size >= block_bytes:
                        yield row()
                        made, size, held = made + 1, 0, []
            flush(ids, texts)
            size += waiting
        if held:
            yield row()

    return checkpointed(rows.mapInArrow(gather, "block long, ids array<long>, sizes binary, tokens binary"))


class Aligned:
    """A block's documents aligned: groups of tokens, and the pairs they link."""

    def __init__(self, row: dict, m: Models):
        import zstandard

        self.ids, self.m = row["ids"], m
        self.n_a, self.n_b = unpacked(row["sizes"], np.int64, np.int64)
        tokens = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["tokens"]), np.uint16)
        self.a, self.b = tokens[: self.n_a.sum()], tokens[self.n_a.sum() :]
        ends_a, ends_b = np.cumsum(m.a.sizes[self.a]), np.cumsum(m.b.sizes[self.b])
        last = []
        for own, other in ((ends_a, ends_b), (ends_b, ends_a)):
            mark = np.zeros(int(own[-1]) + 1 if len(own) else 1, bool)
            mark[other] = True
            last.append(mark[own])
        self.last_a, self.last_b = last  # tokens that end a group
        ends = np.flatnonzero(self.last_a) + 1, np.flatnonzero(self.last_b) + 1
        self.size_a, self.size_b = (np.diff(e, prepend=0) for e in ends)
        self.first_a, self.first_b = (e - n for e, n in zip(ends, (self.size_a, self.size_b), strict=True))
        self.doc = np.repeat(np.arange(len(self.ids)), self.n_a)[self.first_a]  # of each group

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, pair and number of links of each distinct pair of a document, in order."""
        found, bits = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 31
        links = self.size_a * self.size_b
        for first in range(0, len(self.doc), SLICE):
            some = np.arange(first, min(first + SLICE, len(self.doc)))
            small, large = some[links[some] <= LARGE], some[links[some] > LARGE]
            which = np.repeat(small, links[small])
            nth = np.arange(len(which)) - np.repeat(np.cumsum(links[small]) - links[small], links[small])
            a, b = self.first_a[which] + nth // self.size_b[which], self.first_b[which] + nth % self.size_b[which]
            found.append(np.unique(self.doc[which] << bits | (self.a[a].astype(np.int64) * self.m.size_b + self.b[b]), return_counts=True))
            for g in large.tolist():
                (x, n), (y, k) = (np.unique(t[f : f + s], return_counts=True) for t, f, s in ((self.a, self.first_a[g], self.size_a[g]), (self.b, self.first_b[g], self.size_b[g])))
                found.append(((self.doc[g] << bits | (x.astype(np.int64)[:, None] * self.m.size_b + y)).ravel(), (n[:, None] * k).ravel()))
        keys, times = _sorted_counts(*(np.concatenate(x) for x in zip(*found, strict=True)))
        return keys >> bits, keys & ((1 << bits) - 1), times

    def digests(self) -> list[str]:
        """SHA-256 of each document's groups as text, written some tokens at a time."""
        group_a, group_b = (np.cumsum(last) - last for last in (self.last_a, self.last_b))
        n = len(self.a) + len(self.b)
        ids, ends = np.empty(n, np.uint16), np.empty(n, np.uint8)
        at_a = np.arange(len(self.a)) + self.first_b[group_a]
        at_b = np.arange(len(self.b)) + self.first_a[group_b] + self.size_a[group_b]
        ids[at_a], ids[at_b] = self.a, self.b
        ends[at_a], ends[at_b] = np.where(self.last_a, ord("|"), ord(",")), np.where(self.last_b, ord(";"), ord(","))
        sizes = self.n_a + self.n_b
        edges = np.cumsum(sizes)
        ends[edges[sizes > 0] - 1] = 0  # nothing after a document's last
        hashes, doc = [hashlib.sha256() if k else None for k in sizes], np.repeat(np.arange(len(sizes)), sizes)
        for first in range(0, n, SLICE):
            own, end = ids[first : first + SLICE], ends[first : first + SLICE]
            shown = np.concatenate([_WRITTEN[own], (end > 0)[:, None]], axis=1)
            text = np.concatenate([_DIGITS[own], end[:, None]], axis=1)[shown].tobytes()
            upto = np.cumsum(shown.sum(axis=1))
            here = doc[first : first + SLICE]
            last = np.append(np.flatnonzero(np.diff(here)), len(here) - 1)
            begin = 0
            for d, stop in zip(here[last].tolist(), upto[last].tolist(), strict=True):
                hashes[d].update(text[begin:stop])
                begin = stop
        return [h.hexdigest() if h else "" for h in hashes]

    def rows(self, keys: np.ndarray, counts: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
        """The documents with their numbers; keys, counts, best: of the block's pairs, sorted."""
        total = lambda doc, values: np.add.reduceat(np.append(values, 0), np.searchsorted(doc, np.arange(len(self.ids)))) * np.isin(np.arange(len(self.ids)), doc)
        doc, pair, times = self.pairs()
        at = np.searchsorted(keys, pair)
        links = self.size_a * self.size_b
        numbers = [self.n_a, self.n_b, total(self.doc, np.ones(len(self.doc), np.int64)), total(self.doc, links), total(doc, times * best[at]), total(doc, times * counts[at])]
        names = [x.split()[0] for x in RESULT.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(self.ids, pa.int64()), *(pa.array(x.astype(np.int64)) for x in numbers), pa.array(self.digests(), pa.string())], names=names)


def _sorted_counts(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _requests(blocks: DataFrame, buckets: int, names: tuple[str, str]) -> DataFrame:
    """bucket, block, keys and counts: each block's pairs by bucket of their A id."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = models(*names)
        for batch in batches:
            for row in batch.to_pylist():
                keys, counts = np.unique(Aligned(row, m).pairs()[1], return_counts=True)
                bucket = (mixed(keys // m.size_b) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                full, first = np.unique(bucket[order], return_index=True)
                own = np.split(order, first[1:])[: len(full)]
                made = [pa.array(full), pa.array(np.full(len(full), row["block"]))]
                made += [pa.array([packed(delta(keys[x].astype(np.uint64))) for x in own], pa.binary()), pa.array([packed(counts[x]) for x in own], pa.binary())]
                yield pa.RecordBatch.from_arrays(made, names=["bucket", "block", "keys", "counts"])

    return checkpointed(blocks.mapInArrow(ask, "bucket long, block long, keys binary, counts binary"))


def _unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64)[0]).astype(np.int64)


def _in_tree(rows: DataFrame, width: int, reduce: Callable[[list[bytes]], bytes]) -> DataFrame:
    """(bucket, fold, data), with folds below width, to one row a bucket: up to FAN folds become one, again and again."""

    def merge(table: pa.Table) -> pa.Table:
        row = table.slice(0, 1)
        return pa.table({"bucket": row.column("bucket"), "fold": row.column("fold"), "data": pa.array([reduce(table.column("data").to_pylist())], pa.binary())})

    while True:
        width = -(-width // FAN)
        rows = rows.withColumn("fold", F.pmod("fold", F.lit(width))).select("bucket", "fold", "data").groupBy("bucket", "fold").applyInArrow(merge, "bucket long, fold long, data binary")
        if width == 1:
            return rows.select("bucket", "data")


def _hashed(distinct: DataFrame) -> DataFrame:
    """(bucket, data of distinct keys) -> sizes and bits of its minimal perfect hash and the keys by slot."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, data in zip(batch.column(0), batch.column(1), strict=True):
                keys = _unpacked_keys(data.as_py())
                sizes, bits, slot = _levels(keys.astype(np.uint64))
                held = np.empty_like(keys)
                held[slot] = keys
                yield pa.RecordBatch.from_arrays([pa.array([bucket.as_py()]), pa.array([packed(sizes, np.packbits(bits), held)], pa.binary())], names=["bucket", "hash"])

    return checkpointed(distinct.select("bucket", "data").mapInArrow(build, "bucket long, hash binary"))


class Slots:
    """A bucket's hash function and the pairs in its slots."""

    def __init__(self, data: bytes):
        self.sizes, bits, self.keys = unpacked(data, np.int64, np.uint8, np.int64)
        self.bits = np.unpackbits(bits, count=int(self.sizes.sum())).astype(bool)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot, or -1 where the slot holds another pair."""
        at = _slots(keys.astype(np.uint64), self.sizes, self.bits)
        return np.where((at >= 0) & (self.keys[at] == keys), at, -1) if len(self.keys) else np.full(len(keys), -1)


def _folded(requests: DataFrame, tables: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Requests with a fold below width, and the tables once for each fold."""
    fold = F.pmod(F.xxhash64("block"), F.lit(width))
    return requests.withColumn("fold", fold), tables.withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))))


def _dense_counts(requests: DataFrame, tables: DataFrame, width: int) -> DataFrame:
    """(bucket, data): documents that hold the pair of each slot, summed in a tree."""

    def dense(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        names = {"bucket": pa.int64(), "fold": pa.int64(), "data": pa.binary()}
        if not mine.num_rows:
            return pa.table({k: pa.array([], t) for k, t in names.items()})
        slots = Slots(theirs.column("hash")[0].as_py())
        total = np.zeros(len(slots.keys), np.int64)
        for keys, counts in zip(mine.column("keys").to_pylist(), mine.column("counts").to_pylist(), strict=True):
            total[slots.of(_unpacked_keys(keys))] += unpacked(counts, np.int64)[0]
        return pa.table({"bucket": mine.column("bucket").slice(0, 1), "fold": mine.column("fold").slice(0, 1), "data": pa.array([packed(total)], pa.binary())})

    asked, copies = _folded(requests, tables, width)
    first = asked.groupBy("bucket", "fold").cogroup(copies.groupBy("bucket", "fold")).applyInArrow(dense, "bucket long, fold long, data binary")
    return _in_tree(first, width, lambda parts: packed(sum(unpacked(p, np.int64)[0] for p in parts)))


def _replies(requests: DataFrame, tables: DataFrame, parts: int, size_b: int) -> DataFrame:
    """block and the counts of its pairs: keys, counts and whether each is its A id's highest."""

    def look(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        out = {"block": mine.column("block"), "data": pa.array([], pa.binary())}
        if mine.num_rows:
            slots, total = Slots(theirs.column("hash")[0].as_py()), unpacked(theirs.column("data")[0].as_py(), np.int64)[0]
            a = slots.keys // size_b
            order = np.argsort(a, kind="stable")
            first = np.flatnonzero(np.diff(a[order], prepend=-1))
            highest = np.empty_like(total)
            highest[order] = np.repeat(np.maximum.reduceat(total[order], first), np.diff(np.append(first, len(a))))
            best, data = (total == highest).astype(np.uint8), []
            for keys in mine.column("keys").to_pylist():
                keys = _unpacked_keys(keys)
                at = slots.of(keys)
                data.append(packed(delta(keys.astype(np.uint64)), np.where(at < 0, 0, total[at]), np.where(at < 0, 0, best[at]).astype(np.uint8)))
            out["data"] = pa.array(data, pa.binary())
        return pa.table(out)

    asked, copies = _folded(requests, tables, parts)
    return asked.select("bucket", "fold", "block", "keys").groupBy("bucket", "fold").cogroup(copies.groupBy("bucket", "fold")).applyInArrow(look, "block long, data binary")


def pair_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, str] = (BYTE_BPE, PIECE_BPE)) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Blocks of the documents, their requests, (bucket, hash, data) with the pairs' counts by slot, and the number of blocks."""
    check_models(models(*names))
    blocks = token_blocks(docs, id_col, text_col, names)
    number = max(1, blocks.count())
    requests = _requests(blocks, partitions(docs.sparkSession), names)
    keys = requests.select("bucket", F.pmod(F.xxhash64("block"), F.lit(number)).alias("fold"), F.col("keys").alias("data"))

    def union(parts: list[bytes]) -> bytes:
        return packed(delta(np.unique(np.concatenate([_unpacked_keys(p) for p in parts])).astype(np.uint64)))

    tables = _hashed(_in_tree(keys, number, union))
    counts = _dense_counts(requests, tables, -(-number // FAN))
    return blocks, requests, tables.join(counts, "bucket"), number


def aligned_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, str] = (BYTE_BPE, PIECE_BPE)) -> DataFrame:
    """A row per document: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    blocks, requests, counted, number = pair_counts(docs, id_col, text_col, names)
    replies = _replies(requests, checkpointed(counted), -(-number // BLOCKS_A_PART), models(*names).size_b)

    def finish(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        found = []
        parts = [unpacked(d, np.uint64, np.int64, np.uint8) for d in theirs.column("data").to_pylist()]
        keys, counts, best = (np.concatenate([p[k] if k else np.cumsum(p[k]).astype(np.int64) for p in parts]) if parts else np.zeros(0, np.int64) for k in range(3))
        order = np.argsort(keys)
        for row in mine.to_pylist():
            found.append(Aligned(row, models(*names)).rows(keys[order], counts[order], best[order].astype(np.int64)))
        return pa.Table.from_batches(found)

    done = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(finish, RESULT)
    return done.withColumnRenamed("id", id_col)


def corpus_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, str] = (BYTE_BPE, PIECE_BPE)) -> DataFrame:
    """a, b and n_docs of every pair of ids that some document holds linked."""
    size_b = models(*names).size_b

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashed, data in zip(batch.column(0), batch.column(1), strict=True):
                keys = Slots(hashed.as_py()).keys
                yield pa.RecordBatch.from_arrays([pa.array(keys // size_b), pa.array(keys % size_b), pa.array(unpacked(data.as_py(), np.int64)[0])], names=["a", "b", "n_docs"])

    return pair_counts(docs, id_col, text_col, names)[2].select("hash", "data").mapInArrow(spell, "a long, b long, n_docs long")
