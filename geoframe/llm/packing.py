"""Packing documents into training sequences: vector bin packing by dot product.

Every piece has a vector of tokens, segments (one) and loss-bearing tokens, and a
sequence has a limit on each.  A sequence takes, again and again, the waiting
piece that fits and has the largest dot product with the room that is left, all
in shares of the limits.  When none fits, a piece is cut to what fits.  A
sequence that a limit other than tokens closes, and the last ones of a partition,
are cut back to a power of two, so that no sequence needs padding.

Each partition packs for itself in one pass, holding a bounded pool of pieces;
nothing is shuffled.  Sequence numbers are unique over partitions.

Defined results: a null text counts as empty and gives the end id alone; rows
with equal ids are packed as separate documents; of pieces with equal products the
one that is first in the pool is taken; a very long text is tokenized whole (its
memory was not measured) and cut into pieces; other columns are not looked at; an
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENS, SEGMENTS, END_ID, POOL = 2048, 64, 1, 256
SPECIAL = {"<|endoftext|>": 50256}
SCHEMA = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
_loaded: dict[str, tuple] = {}


def tokenizer(name: str) -> tuple:
    """(encode, fallback) for a byte-level BPE file: the ids of its `tokenizers` file, computed from the same ranks by tiktoken, several times faster."""
    if name not in _loaded:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        exact = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
        _loaded[name] = (lambda text: fast.encode_to_numpy(text, allowed_special="all"), lambda text: np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32))
    return _loaded[name]


def token_ids(text: str, name: str) -> np.ndarray:
    encode, fallback = tokenizer(name)
    try:
        return np.asarray(encode(text), np.uint32)
    except BaseException as error:  # a very long run overflows the pattern's stack, which is not an Exception
        if isinstance(error, (KeyboardInterrupt, SystemExit, GeneratorExit, MemoryError)):
            raise
        return fallback(text)


class _Pool:
    """Pieces that wait, and the sequences made of them."""

    def __init__(self, tokens: int, segments: int, loss: int, first_sequence: int):
        self.limits = np.array([tokens, segments, loss], np.float64)
        self.pieces: list[tuple] = []  # (doc, start, ids, prompt, doc_tokens)
        self.vectors = np.zeros((0, 3))
        self.sequence, self.rows = first_sequence, []

    @staticmethod
    def _loss(start: int, length: int, prompt: int) -> int:
        return max(0, start + length - max(prompt, start))

    def _vector(self, piece: tuple) -> list[float]:
        return [len(piece[2]), 1, self._loss(piece[1], len(piece[2]), piece[3])]

    def _fits(self, piece: tuple, tokens: float, loss: float) -> int:
        """How many of the piece's first tokens fit."""
        return int(min(len(piece[2]), tokens, max(piece[3] - piece[1], 0) + loss))

    def add(self, doc: object, ids: np.ndarray, prompt: int) -> None:
        at, fresh = 0, []
        while at < len(ids):
            piece = (doc, at, ids[at:], prompt, len(ids))
            n = self._fits(piece, self.limits[0], self.limits[2])
            piece = (doc, at, ids[at : at + n], prompt, len(ids))
            if n == self.limits[0]:
                self._emit([piece])
            else:
                fresh.append(piece)
            at += n
        self._put(fresh)

    def _put(self, pieces: list[tuple]) -> None:
        if pieces:
            self.pieces += pieces
            self.vectors = np.concatenate([self.vectors, np.array([self._vector(p) for p in pieces], np.float64)])

    def _take(self, k: int) -> tuple:
        """Removes piece k; the last one takes its place."""
        piece, last = self.pieces[k], self.pieces.pop()
        if k < len(self.pieces):
            self.pieces[k] = last
            self.vectors[k] = self.vectors[-1]
        self.vectors = self.vectors[:-1]
        return piece

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, prompt, doc_tokens in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), doc_tokens, self.sequence, offset, self._loss(start, len(ids), prompt)))
            offset += len(ids)
        self.sequence += 1

    def close_one(self) -> None:
        """Fill one sequence from the pool."""
        room, chosen = self.limits.copy(), []
        while self.pieces and room[1] >= 1 and room[0] >= 1:
            score = (self.vectors / self.limits) @ (room / self.limits)
            score[(self.vectors > room).any(axis=1)] = -1
            k = int(np.argmax(score))
            if score[k] >= 0:
                piece = self._take(k)
            else:
                k = int(np.argmax(np.minimum(self.vectors[:, 0], room[0]) - np.maximum(self.vectors[:, 2] - room[2], 0)))
                n = self._fits(self.pieces[k], room[0], room[2])
                if n < 1:
                    break
                doc, start, ids, prompt, total = self._take(k)
                piece = (doc, start, ids[:n], prompt, total)
                self._put([(doc, start + n, ids[n:], prompt, total)] if n < len(ids) else [])
            chosen.append(piece)
            room -= self._vector(piece)
        held = int(self.limits[0] - room[0])
        if room[0] >= 1:
            spare = held - (1 << (held.bit_length() - 1))
            while spare:
                doc, start, ids, prompt, total = chosen.pop()
                n = max(0, len(ids) - spare)
                spare -= len(ids) - n
                self._put([(doc, start + n, ids[n:], prompt, total)])
                if n:
                    chosen.append((doc, start, ids[:n], prompt, total))
        self._emit(chosen)

    def close(self, left: int) -> None:
        while len(self.pieces) > left:
            self.close_one()

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [[]] * 8
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in SCHEMA.split(", ")])


def packed_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None, name: str = "byte_bpe_50k", tokens: int = TOKENS, segments: int = SEGMENTS, loss_tokens: int | None = None) -> DataFrame:
    """A row per piece. Tokens of prompt_col, where given, go before the text's and bear no loss; all others do."""
    loss = tokens if loss_tokens is None else loss_tokens
    if min(tokens, segments, loss) < 1:
        raise ValueError("each limit of a sequence is at least 1")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = _Pool(tokens, segments, loss, TaskContext.get().partitionId() << 36)
        for batch in batches:
            ids, prompts, texts = batch.columns
            for k in range(batch.num_rows):
                body = np.append(token_ids(texts[k].as_py(), name), np.uint32(END_ID))
                prompt = token_ids(prompts[k].as_py(), name) if prompt_col else body[:0]
                pool.add(ids[k].as_py(), np.concatenate([prompt, body]), len(prompt))
                if len(pool.pieces) >= 2 * POOL:
                    pool.close(POOL)
                if len(pool.rows) >= 10_000:
                    yield pool.batch()
        pool.close(0)
        yield pool.batch()

    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c else F.lit("")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text(prompt_col).alias("prompt"), text(text_col).alias("text"))
    return rows.mapInArrow(pack, SCHEMA).withColumnRenamed("id", id_col)
