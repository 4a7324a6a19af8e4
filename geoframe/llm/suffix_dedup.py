"""Removal of every byte that lies in a repeated string of LENGTH bytes.

Suffixes are not sorted here (see README for the figures): equal strings are found
by counting hashes of content-defined samples, in two rounds.

1. Sample.  Of the LENGTH/2-byte strings that begin in a window, the one with the
   least hash (the last of equal ones) is the window's anchor.  It depends on the
   window's bytes only, so equal windows have equal anchors at equal places.
   About two positions in a hundred are anchors.
2. First round.  Anchors are grouped by the string at the anchor, and within a
   string by their whole context, that is all bytes that a window of this anchor
   can hold (cut at the document's ends).  An anchor whose string occurs once has no
   repeated window.  One whose string never occurs with another context has only
   repeated windows.  That settles the inside of copies and all unique text.
3. Second round.  The windows of the anchors that are left (around the edges of
   repeated passages) are grouped themselves, together with their anchor's string.

Every block of documents sends its distinct keys once per bucket, however often
they occur, and gets one byte back for each.  A string that a block meets in several
contexts is sent once, as open, so that a common string has one entry per block.

Equality in the first round is decided on 64 bits of the string at the anchor and 64 of
the context.  In the second, windows of one anchor have its string in common, so
that only the window's own 64 bits (of a polynomial hash) tell them apart: of m
different windows about one string some two count as one with a chance of about
m*m / 2**65.  Equal windows are never missed.

Defined results: a null text counts as empty; texts shorter than LENGTH keep all
bytes; repeated rows are repeats of each other, so that all of a long copied text
goes from each; a very long text is a block of its own and is hashed in slices of
SLICE bytes; an empty table gives an empty result.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoframe.llm import _shared as S

LENGTH = 200
SLICE = 1 << 20
SCHEMA = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_BASE = 0x5851F42D4C957F2D
_VALUES = S.mixed(np.arange(1, 257, dtype=np.uint64))
_PLACE = np.uint64((1 << 24) - 1)
UNIQUE, REPEATED, OPEN = 0, 1, 2
ANSWER_SCHEMA = "block long, bucket long, data binary"
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            line = np.full(n, base, np.uint64)
            line[0] = 1
            with np.errstate(over="ignore"):
                np.multiply.accumulate(line, out=line)
            _powers[name] = line
    return _powers["up"][:n], _powers["down"][:n]


class _Slice:
    """Hashes of substrings of some bytes of a block."""

    def __init__(self, raw: np.ndarray):
        up, self.down = _power(len(raw) + 1)
        self.run = np.zeros(len(raw) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_VALUES[raw] * up[:-1], out=self.run[1:])

    def hashes(self, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.run[ends] - self.run[starts]) * self.down[starts]
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
        return h


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours, by doubling."""
    w = 1
    while 2 * w <= width:
        values = np.minimum(values[:-w], values[w:])
        w *= 2
    return np.minimum(values[: len(values) - (width - w)], values[width - w :]) if width > w else values


def string_keys(hashes: np.ndarray) -> np.ndarray:
    """64 bits of the strings at anchors."""
    return S.mixed(hashes)


def _document_bounds(offsets: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the documents of the bytes a to b of a block."""
    first, last = np.searchsorted(offsets, [a, b - 1], "right") - 1
    own = offsets[first : last + 2]
    sizes = np.diff(np.clip(own, a, b))
    return np.repeat(own[:-1], sizes), np.repeat(own[1:], sizes)


def anchored(body: bytes, offsets: np.ndarray, length: int, contexts: bool = True) -> Iterator[tuple]:
    """By slices of a block: window starts, the anchor (by number in the block) of each, the keys of the slice's anchors, and a function from window starts to keys.

    Anchor keys are two rows: of the string at the anchor, and (with contexts) of its context.
    """
    raw, gram = np.frombuffer(body, np.uint8), length // 2
    reach = length - gram
    number, last = 0, -1
    for a in range(0, max(len(raw) - length + 1, 0), SLICE):
        b = min(a + SLICE, len(raw) - length + 1)
        low, high = max(0, a - reach), min(len(raw), b + length + reach)
        part = _Slice(raw[low:high])
        own = slice(a - low, b + reach - low)
        grams = part.hashes(own, slice(own.start + gram, own.stop + gram))
        place = _PLACE - np.arange(b + reach - a, dtype=np.uint64)
        least = _least((grams & ~_PLACE) | place, reach + 1)
        doc_start, doc_end = _document_bounds(offsets, a, b + reach)
        starts = np.arange(a, b)
        valid = starts + length <= doc_end[: b - a]
        starts, anchors = starts[valid], a + (_PLACE - (least[valid] & _PLACE)).astype(np.int64)
        if not len(starts):
            continue
        fresh = np.concatenate([[anchors[0] != last], anchors[1:] != anchors[:-1]])
        which = number + np.cumsum(fresh) - 1
        at = anchors[fresh]
        number, last = number + len(at), int(anchors[-1])
        strings = string_keys(grams[at - a])
        context = np.zeros(0, np.uint64)
        if contexts:
            lo, hi = np.maximum(doc_start[at - a], at - reach), np.minimum(doc_end[at - a], at + length)
            with np.errstate(over="ignore"):
                context = S.mixed(part.hashes(lo - low, hi - low) + ((at - lo) * (2 * length) + hi - lo).astype(np.uint64))
        yield starts, which, (strings, context), lambda s, part=part, low=low: part.hashes(s - low, s - low + length)


def _grouped(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by (first, second), and where pairs begin in it."""
    order = np.lexsort((second, first))
    x, y = first[order], second[order]
    return order, np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])) if len(x) else np.zeros(0, np.int64)


def _anchor_entries(strings: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct strings, the only context of each (or one of them), and a state: UNIQUE as far as known here, REPEATED in one context, OPEN."""
    order, pair = _grouped(strings, contexts)
    pair_string = strings[order][pair]
    first = np.flatnonzero(np.concatenate([[True], pair_string[1:] != pair_string[:-1]])) if len(pair) else pair
    several = np.diff(np.append(first, len(pair))) > 1
    many = np.diff(np.append(pair[first], len(order))) > 1
    return pair_string[first], contexts[order][pair[first]], np.where(several, OPEN, np.where(many, REPEATED, UNIQUE)).astype(np.uint8)


def _window_entries(windows: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (window, string) pairs, and whether each occurs more than once here."""
    order, pair = _grouped(windows, strings)
    many = np.diff(np.append(pair, len(order))) > 1
    return windows[order][pair], strings[order][pair], many.astype(np.uint8)


def merged_anchors(strings: np.ndarray, contexts: np.ndarray, states: np.ndarray) -> np.ndarray:
    """For entries of all blocks, the state of each one's string over all of them."""
    distinct, where = np.unique(strings, return_inverse=True)
    n = np.bincount(where, minlength=len(distinct))
    low, high = np.full(len(distinct), ~np.uint64(0)), np.zeros(len(distinct), np.uint64)
    np.minimum.at(low, where, contexts)
    np.maximum.at(high, where, contexts)
    worst = np.zeros(len(distinct), np.uint8)
    np.maximum.at(worst, where, states)
    state = np.where((worst == OPEN) | (low != high), OPEN, np.where((n > 1) | (worst == REPEATED), REPEATED, UNIQUE))
    return state.astype(np.uint8)[where]


def merged_windows(windows: np.ndarray, strings: np.ndarray, many: np.ndarray) -> np.ndarray:
    """For entries of all blocks, whether each one's window occurs more than once in all."""
    order, pair = _grouped(windows, strings)
    sizes = np.diff(np.append(pair, len(order)))
    again = (sizes > 1) | (np.maximum.reduceat(many[order], pair) > 0) if len(pair) else np.zeros(0, bool)
    out = np.zeros(len(order), np.uint8)
    out[order] = np.repeat(again, sizes)
    return out


def _request_batches(block: int, entries: tuple[np.ndarray, ...], n: int) -> Iterator[pa.RecordBatch]:
    """A block's entries, sorted by their first key, one row for each bucket."""
    keys = entries[0]
    order, ends = S.dealt(keys, n)
    buckets, data = [], []
    for b in range(n):
        if ends[b + 1] > ends[b]:
            own = order[ends[b] : ends[b + 1]]
            buckets.append(b)
            data.append(S.packed(S.delta(keys[own]), *(x[own] for x in entries[1:])))
    if buckets:
        yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array([block] * len(buckets), pa.int64()), pa.array(data, pa.binary())], names=["bucket", "block", "data"])


def _answers(requests: DataFrame, merge: Callable) -> DataFrame:
    def reduce(table: pa.Table) -> pa.Table:
        parts = [S.unpacked(x, np.uint64, np.uint64, np.uint8) for x in table.column("data").to_pylist()]
        ends = np.cumsum([len(p[0]) for p in parts])[:-1]
        values = merge(np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]), *(np.concatenate([p[k] for p in parts]) for k in (1, 2)))
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "data": pa.array([S.packed(v) for v in np.split(values, ends)], pa.binary())})

    return requests.groupBy("bucket").applyInArrow(reduce, ANSWER_SCHEMA)


def _anchor_keys(body: bytes, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    parts = [keys for _, _, keys, _ in anchored(body, offsets, length)]
    return tuple(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.uint64) for k in (0, 1))


def _states(body: bytes, offsets: np.ndarray, replies: list, length: int, buckets: int) -> np.ndarray:
    """The state of each anchor, in their order."""
    parts = [keys[0] for _, _, keys, _ in anchored(body, offsets, length, contexts=False)]
    distinct, where = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_inverse=True)
    return S.replied(distinct, replies, np.uint8, buckets)[where]


def _open_windows(body: bytes, offsets: np.ndarray, state: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, keys and anchors' strings of the windows of open anchors, and starts of those known to repeat."""
    starts, keys, strings, known = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    seen, last = 0, np.zeros(0, np.uint64)
    for s, which, (own, _), key in anchored(body, offsets, length, contexts=False):
        held = np.append(last, own)  # the first windows of a slice may belong to the last anchor before it
        mine = state[which] == OPEN
        known.append(s[state[which] == REPEATED])
        starts.append(s[mine])
        keys.append(key(s[mine]))
        strings.append(held[which[mine] - seen + len(last)])
        seen, last = seen + len(own), held[-1:]
    return tuple(map(np.concatenate, (starts, keys, strings, known)))


def _removed(ids: list, offsets: np.ndarray, body: bytes, starts: np.ndarray, length: int) -> pa.Table:
    """Result rows of a block whose windows at `starts` (sorted) repeat."""
    doc = np.searchsorted(offsets, starts, "right") - 1
    fresh = np.concatenate([[True], (np.diff(starts) > length) | (np.diff(doc) > 0)]) if len(starts) else np.zeros(0, bool)
    first = np.flatnonzero(fresh)
    begin, end = starts[first], starts[np.append(first[1:], len(starts)) - 1] + length if len(starts) else starts
    of = doc[first]
    spans = np.bincount(of, minlength=len(ids))
    bounds = np.concatenate([[0], np.cumsum(spans)])
    digests = []
    for k in range(len(ids)):
        digest, at = hashlib.sha256(), int(offsets[k])
        for j in range(bounds[k], bounds[k + 1]):
            digest.update(body[at : begin[j]])
            at = int(end[j])
        digest.update(body[at : offsets[k + 1]])
        digests.append(digest.hexdigest())
    gone = np.bincount(of, end - begin, len(ids)).astype(np.int64)
    return pa.table({"id": pa.array(ids, pa.int64()), "n_bytes": np.diff(offsets), "n_removed": gone, "n_spans": spans, "kept_sha256": digests})


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """A row per document: n_bytes, n_removed, n_spans, kept_sha256 (of the bytes that stay)."""
    buckets = 2 * S.partitions(docs.sparkSession)
    blocks = S.text_blocks(docs, id_col, text_col)

    def ask_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, _, offsets, body = S.unpack_block(row)
                yield from _request_batches(row["block"], _anchor_entries(*_anchor_keys(body, offsets, length)), buckets)

    anchors = S.checkpointed(_answers(blocks.mapInArrow(ask_anchors, S.REQUEST_SCHEMA), merged_anchors))

    def ask_windows(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        replies = list(zip(theirs.column("bucket").to_pylist(), theirs.column("data").to_pylist(), strict=True))
        out = []
        for row in mine.to_pylist():
            _, _, offsets, body = S.unpack_block(row)
            _, keys, strings, _ = _open_windows(body, offsets, _states(body, offsets, replies, length, buckets), length)
            out += _request_batches(row["block"], _window_entries(keys, strings), buckets)
        return pa.Table.from_batches(out, pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("data", pa.binary())]))

    by_block = lambda df: df.groupBy("block")
    windows = _answers(by_block(blocks).cogroup(by_block(anchors)).applyInArrow(ask_windows, S.REQUEST_SCHEMA), merged_windows)
    both = anchors.withColumn("round", F.lit(0)).unionByName(windows.withColumn("round", F.lit(1)))

    def finish(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        replies: tuple[list, list] = ([], [])
        for turn, bucket, data in zip(*(theirs.column(c).to_pylist() for c in ("round", "bucket", "data")), strict=True):
            replies[turn].append((bucket, data))
        out = []
        for row in mine.to_pylist():
            ids, _, offsets, body = S.unpack_block(row)
            starts, keys, strings, known = _open_windows(body, offsets, _states(body, offsets, replies[0], length, buckets), length)
            order, pair = _grouped(keys, strings)
            again = np.zeros(len(keys), bool)
            again[order] = np.repeat(S.replied(keys[order][pair], replies[1], np.uint8, buckets) > 0, np.diff(np.append(pair, len(order))))
            out.append(_removed(ids, offsets, body, np.sort(np.concatenate([starts[again], known])), length))
        return pa.concat_tables(out)

    return by_block(blocks).cogroup(by_block(both)).applyInArrow(finish, SCHEMA).withColumnRenamed("id", id_col)
