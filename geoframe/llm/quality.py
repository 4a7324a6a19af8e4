"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE_WORDS words.  Every passage is encoded
by what it says - its lower-cased words and pairs of words, hashed with signs into
HASHED sums - and by how it is written: shares of kinds of bytes, word shapes,
repetition.  A hidden layer embeds it, and gated attention - tanh(V h) *
sigmoid(U h), weighed - says how much each passage counts for its document.  The
weighted mean embedding gives the score.  Only documents have labels; attention is
learned from them.

The model is fitted on the driver on a bounded sample: at most TRAIN_DOCUMENTS
labelled documents (the least by a hash of the id), each with all its passages,
passing over those that would take the sample beyond TRAIN_BYTES bytes of text.
Scoring reads every passage of every document.

Defined results: a null text counts as empty and is scored as one passage
without words; repeated rows get equal scores; labels other than 0 and 1 and
null labels are not learned from; of several labels of an id the least counts;
without labels of both kinds every score is their share of label 1 (0.5 without
any); a very long text is encoded some passages at a time, whose attention is
summed up as it goes; an empty table gives an empty result.  Other columns,
whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoframe.llm._shared import buffers, id_remainder, mixed, renamed

PASSAGE_WORDS, TRAIN_DOCUMENTS, TRAIN_BYTES, HASHED = 50, 3000, 24 << 20, 96
HIDDEN, ATTENTION, STEPS, THRESHOLD = 24, 12, 150, 0.7
SLICE_BYTES = 1 << 20
_FOLD = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes by kind; later entries win.
KINDS = [range(0, 32), range(32, 33), range(10, 11), b"\t\r\v\f", range(48, 58), range(65, 91), range(97, 123), b"aeiou", b".", b",", b"!?", b"$%&*#@^~", b"|", b"<>{}[]/\\=", b"()", b"'\"`", b":;", b"-_+", range(128, 192), range(192, 256)]
KIND = np.zeros(256, np.int64)
for _k, _bytes in enumerate(KINDS):
    KIND[list(_bytes)] = _k
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
FEATURES = len(KINDS) + 9 + HASHED
_STEP = np.uint64(0x9E3779B97F4A7C15)


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of concatenated texts; none crosses a text's end."""
    gap = SPACE[raw]
    starts, ends = ~gap, ~gap
    starts[1:] &= gap[:-1]
    ends[:-1] &= gap[1:]
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    starts[inner[~gap[inner]]] = True
    ends[inner[~gap[inner - 1]] - 1] = True
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans (sorted, apart), about SLICE_BYTES at a time; a longer span is hashed by itself."""
    out, first = np.empty(len(starts), np.uint64), 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + SLICE_BYTES, "right")))
        a, b = int(starts[first]), int(ends[last - 1])
        if b - a > SLICE_BYTES:
            import xxhash

            out[first] = xxhash.xxh64_intdigest(raw[a:b].tobytes(), 42)
        else:
            out[first:last] = _span_hashes(raw[a:b], starts[first:last] - a, ends[first:last] - a)
        first = last
    return out


def _span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Eight bytes at a time, each step scrambled before the next: no two spans agree by their form, as under a polynomial."""
    body = np.zeros(len(raw) + 8, np.uint8)
    body[: len(raw)] = raw
    eights = np.ndarray(len(raw) + 1, "<u8", body.data, 0, (1,))
    h, live = mixed((ends - starts).astype(np.uint64) + _STEP), np.arange(len(starts))
    at, left = starts, ends - starts
    with np.errstate(over="ignore"):
        while len(live):
            part, short = eights[at], left < 8
            part[short] &= (np.uint64(1) << (8 * left[short]).astype(np.uint64)) - np.uint64(1)
            h[live] = mixed((h[live] ^ part) * _STEP)
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
    return h


def _kinds(raw: np.ndarray, edges: np.ndarray, owner: np.ndarray, total: int) -> np.ndarray:
    """Numbers of bytes of each kind by owner; owner[k] has the bytes from edges[k] to the next edge."""
    bounds, out = np.append(edges, len(raw)), np.zeros(total * len(KINDS), np.int64)
    for a in range(0, len(raw), SLICE_BYTES):
        b = min(a + SLICE_BYTES, len(raw))
        low, high = int(np.searchsorted(bounds, a, "right")) - 1, int(np.searchsorted(bounds, b))
        of = np.repeat(owner[low:high], np.diff(np.clip(bounds[low : high + 1], a, b)))
        out += np.bincount(of * len(KINDS) + KIND[raw[a:b]], minlength=len(out))
    return out.reshape(total, len(KINDS)).astype(np.float64)


def _said(hashes: np.ndarray, of_word: np.ndarray, total: int) -> np.ndarray:
    """Signed sums of hashed words and pairs of words of each passage, as shares of the root of their number."""
    with np.errstate(over="ignore"):
        same = of_word[1:] == of_word[:-1]
        pairs = (hashes[:-1] * _FOLD + hashes[1:])[same] * _FOLD
        terms = np.concatenate([hashes * _FOLD, pairs ^ (pairs >> np.uint64(31))])
    of = np.concatenate([of_word, of_word[1:][same]])
    sign = 1.0 - 2.0 * (terms >> np.uint64(63)).astype(np.float64)
    place = ((terms >> np.uint64(32)) % np.uint64(HASHED)).astype(np.int64)
    sums = np.bincount(of * HASHED + place, sign, total * HASHED).reshape(total, HASHED)
    return sums / np.sqrt(np.maximum(np.bincount(of, minlength=total), 1))[:, None]


def passages(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage and the number of passages of every text (at least one)."""
    starts, ends = word_spans(raw, offsets)
    words_before = np.searchsorted(starts, offsets)
    words = np.diff(words_before)
    count = np.maximum(1, -(-words // PASSAGE_WORDS))
    first = np.concatenate([[0], np.cumsum(count)])
    total = int(first[-1])
    doc_of_word = np.repeat(np.arange(len(words)), words)
    of_word = first[doc_of_word] + (np.arange(len(starts)) - words_before[doc_of_word]) // PASSAGE_WORDS
    # a byte belongs to the passage of the last word begun before it
    edges = np.concatenate([offsets[:-1], starts])
    owner = np.concatenate([first[:-1], of_word])
    order = np.argsort(edges, kind="stable")
    kinds = _kinds(raw, edges[order], owner[order], total)
    n_bytes, n_words = kinds.sum(axis=1), np.bincount(of_word, minlength=total).astype(np.float64)
    per_word = lambda x: np.bincount(of_word, x, total) / np.maximum(n_words, 1)
    length = (ends - starts).astype(np.float64)
    mean = per_word(length)
    capital = KIND[raw[starts]] == 5
    hashes = word_hashes(_LOWER[raw], starts, ends)
    again = np.zeros(len(starts), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (of_word[1:] == of_word[:-1])
    with np.errstate(over="ignore"):
        tagged = hashes * np.uint64(3) + of_word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    own = np.unique(tagged, return_index=True)[1]
    unlike = np.bincount(of_word[own], minlength=total) / np.maximum(n_words, 1)
    ends_odd = ~np.isin(KIND[raw[ends - 1]], [4, 5, 6, 7, 8, 9, 18])
    both = np.minimum(capital, length > 2) & (KIND[raw[np.minimum(starts + 1, len(raw) - 1)]] == 5) if len(starts) else capital
    shares = np.sqrt(kinds / np.maximum(n_bytes, 1)[:, None])
    spread = np.sqrt(np.maximum(per_word(length**2) - mean**2, 0))
    more = [np.log1p(n_bytes) / 6, n_words / PASSAGE_WORDS, np.log1p(mean), np.log1p(spread), per_word(capital), per_word(again), unlike * (n_words > 0), per_word(ends_odd), per_word(both)]
    return np.column_stack([shares, *more, _said(hashes, of_word, total)]), count


def text_pieces(raw: np.ndarray, size: int = SLICE_BYTES) -> Iterator[np.ndarray]:
    """A text in pieces of whole passages, of about `size` bytes each (more only where words are that long)."""
    at = 0
    while True:
        want = size
        while True:
            part = raw[at : at + want]
            if at + want >= len(raw):
                yield part
                return
            starts, _ = word_spans(part, np.array([0, len(part)]))
            whole = (len(starts) - 1) // PASSAGE_WORDS * PASSAGE_WORDS
            if whole > 0:
                break
            want *= 2
        yield part[: starts[whole]]
        at += int(starts[whole])


def encoded(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """passages() of a slice of texts, and whether its last text goes on in what follows; a long text comes in pieces."""
    if len(at) > 2 or len(raw) <= 2 * SLICE_BYTES:
        yield *passages(raw, at), False
        return
    size = 0
    for part in text_pieces(raw):
        size += len(part)
        yield *passages(part, np.array([0, len(part)])), size < len(raw)


def text_slices(batch: pa.RecordBatch, column: int, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows first to last of a batch with their bytes and offsets, about `size` bytes at a time."""
    raw, at = buffers(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = min(max(int(np.searchsorted(at, at[first] + size)), first + 1), batch.num_rows)
        yield first, last, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def _segment_softmax(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    e = np.exp(x - np.repeat(np.maximum.reduceat(x, starts), sizes))
    return e / np.repeat(np.add.reduceat(e, starts), sizes)


class AttentionModel:
    """Parameters of the network; small and of fixed size, whatever the data."""

    def __init__(self, features: int = FEATURES, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.p = {"W": draw(features, HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, ATTENTION), "U": draw(HIDDEN, ATTENTION), "w": draw(ATTENTION), "c": draw(HIDDEN), "d": np.zeros(1)}
        self.mean, self.scale, self.constant = np.zeros(features), np.ones(features), None

    def forward(self, x: np.ndarray, sizes: np.ndarray) -> tuple:
        p, starts = self.p, np.cumsum(sizes) - sizes
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = _segment_softmax((t * g) @ p["w"], starts, sizes)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return h, t, g, a, z, 1 / (1 + np.exp(-(z @ p["c"] + p["d"])))

    def fit(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray, steps: int = STEPS, rate: float = 0.02, decay: float = 1e-4) -> AttentionModel:
        if len(y) == 0 or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 0.02
        small = np.empty(x.shape, np.float32)
        for a in range(0, len(x), 4096):  # some rows at a time: no further copies of all in doubles
            small[a : a + 4096] = (x[a : a + 4096] - self.mean) / self.scale
        x, p, starts, doc = small, self.p, np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
        p.update({k: a.astype(np.float32) for k, a in p.items()})
        m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            h, t, g, a, z, s = self.forward(x, sizes)
            e = ((s - y) / len(y)).astype(np.float32)
            dz = e[:, None] * p["c"]
            dh = a[:, None] * dz[doc]
            da = (h * dz[doc]).sum(axis=1)
            dl = a * (da - np.add.reduceat(a * da, starts)[doc])
            dt, dg = dl[:, None] * p["w"] * g * (1 - t * t), dl[:, None] * p["w"] * t * g * (1 - g)
            dh += dt @ p["V"].T + dg @ p["U"].T
            dx = dh * (1 - h * h)
            grads = {"W": x.T @ dx, "b": dx.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ dl, "c": z.T @ e, "d": e.sum(keepdims=True)}
            for k, grad in grads.items():
                grad = grad + decay * p[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        p.update({k: a.astype(np.float64) for k, a in p.items()})
        return self

    def score(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(sizes), self.constant)
        return self.forward((x - self.mean) / self.scale, sizes)[-1]

    def score_slice(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Scores of a slice of texts. The attention of a text that comes in pieces is added up, each piece by its share."""
        most, weight, total = -np.inf, 0.0, np.zeros(HIDDEN)
        for x, sizes, goes_on in encoded(raw, at):
            if not goes_on and most == -np.inf:
                return self.score(x, sizes)
            if self.constant is not None:
                continue
            p = self.p
            h = np.tanh((x - self.mean) / self.scale @ p["W"] + p["b"])
            says = (np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["w"]
            high = max(most, float(says.max()))
            e = np.exp(says - high)
            weight, total = weight * np.exp(most - high) + e.sum(), total * np.exp(most - high) + e @ h
            most = high
        if self.constant is not None:
            return np.array([self.constant])
        return 1 / (1 + np.exp(-(total / weight @ self.p["c"] + self.p["d"])))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", documents: int = TRAIN_DOCUMENTS, size: int = TRAIN_BYTES) -> AttentionModel:
    """Fit on the labelled documents outside the held-out fold (crc32 of the id, modulo 4, is 2)."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).filter("id IS NOT NULL AND label IN (0, 1)").filter(id_remainder("id", 4) != 2)
    chosen = known.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(documents)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    room, sample = size, set()
    for n, i in sorted((r["n"], r["id"]) for r in texts.groupBy("id").agg(F.sum(F.octet_length("text")).alias("n")).withColumn("n", F.struct(F.xxhash64("id"), "n")).collect()):
        if n[1] <= room:
            sample.add(i)
            room -= n[1]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array([i in sample for i in batch.column(0).to_pylist()], pa.bool_()))
            for first, last, raw, at in text_slices(batch, 2):
                x, sizes = passages(raw, at)
                bags = np.split(x.astype(np.float32), np.cumsum(sizes)[:-1])
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], batch.column(1)[first:last], pa.array([b.tobytes() for b in bags], pa.binary())], names=["id", "label", "x"])

    got = sorted((r["id"], r["label"], bytes(r["x"])) for r in texts.select("id", "label", "text").mapInArrow(encode, "id long, label int, x binary").toLocalIterator())
    y = np.array([label for _, label, _ in got], np.float64)
    return AttentionModel().fit(*_stacked([b for _, _, b in got]), y)


def _stacked(bags: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bags' passages in one array, and the number of each bag's."""
    sizes = np.array([len(b) // (4 * FEATURES) for b in bags], np.int64)
    x, at = np.empty((sizes.sum(), FEATURES)), 0
    for b, n in zip(bags, sizes.tolist(), strict=True):
        x[at : at + n] = np.frombuffer(b, np.float32).reshape(n, FEATURES)
        at += n
    return x, sizes


def quality_scores(docs: DataFrame, model: AttentionModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """id, score and the columns of keep of every row."""
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("__text"), F.col(id_col), *[c for c in keep if c != id_col])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.score_slice(raw, at) for _, _, raw, at in text_slices(batch, 0)]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(scores), *batch.columns[1:]], names=["__score", *batch.schema.names[1:]])

    fields = ", ".join(["__score double", *(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])])
    return rows.mapInArrow(score, fields)


def document_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row per document: id, held_out, score, predicted."""
    scored = quality_scores(docs, fit_quality(docs, labels, id_col, text_col), id_col, text_col)
    return scored.select(id_col, (id_remainder(id_col, 4) == 2).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the documents that score below threshold."""
    model = fit_quality(docs, labels, id_col, text_col)
    own, (at, text) = renamed(docs, id_col, text_col)
    scored = quality_scores(own, model, at, text, tuple(own.columns))
    return scored.filter(F.col("__score") >= threshold).select(*own.columns).toDF(*docs.columns)
