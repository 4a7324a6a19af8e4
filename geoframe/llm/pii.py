"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds what they miss.

Every run of tokens with a digit or "@", at most four blanks apart, is a region; a
region that begins or ends with "@" takes the word beside it in.  It is cut into
atoms (runs of letters, runs of digits, single other characters).  The field
scores whole spans of up to MAX_ATOMS atoms for each kind by features of the
span as a whole (numbers of digits and dots, octets, check digit, what stands
before and after), and single atoms as outside.  An entity has MAX_ATOMS atoms and
MAX_CHARS characters at most.  Dynamic programming over the atoms chooses
boundaries and kinds jointly; work per atom is bounded, and what is decided for
certain leaves the memory, so that a region may be of any length.

The field is trained on the driver by the exact gradient of its likelihood, on at
most TRAIN_REGIONS regions of each kind, of TRAIN_CHARS characters at most, from at
most TRAIN_DOCUMENTS documents (the least by a hash of the id).  Labels are the patterns' own matches, plus the
same regions written in ways that the patterns do not know (no country code, a
spaced "@", dotted card numbers), which is what the field then adds.

Pattern matches always stay; a span of the field is added where it overlaps none.

Defined results: a null text counts as empty; documents are independent, so
repeated rows give equal results; of two labellings with equal scores the one with
less in it is chosen; a very long text is read whole, in time and memory in
proportion to it; without training regions nothing is added; an empty table gives
an empty result.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
TRAIN_DOCUMENTS, TRAIN_REGIONS, TRAIN_CHARS, MAX_ATOMS, MAX_CHARS, STEPS = 6000, 60, 200, 16, 320, 60
FLUSH, CACHED_CHARS, SEEN = 4096, 512, 1 << 16
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: The patterns give nothing back once they have matched (no search from within a run of digits, no way back into a group): the same matches in linear time.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")
HOT_TOKEN = re.compile(r"[^\s]*[0-9@][^\s]*(?:\s{1,4}[^\s]*[0-9@][^\s]*)*+")
MORE_HOT = re.compile(r"\s{1,4}(?=[^\s]*[0-9@])")
WORD_AFTER, WORD_BEFORE = re.compile(r"\s{1,4}\S{1,254}(?!\S)"), re.compile(r"(?<!\S)\S{1,254}\s{1,4}\Z")
ATOM = re.compile(r"[^\W\d_]+|[0-9]+|[\s\S]")
DIGITS = re.compile(r"[0-9]")
SCHEMA = "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def octet(digits: str) -> bool:
    """Whether a run of digits, however long, is 255 at most."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of EMAIL, found from each "@" backwards, so that text without one costs nothing."""
    at = text.find("@")
    low = 0
    while at >= 0:
        start = at
        while start > low and text[start - 1] in LOCAL:
            start -= 1
        found = EMAIL.match(text, start) if start < at else None
        low = found.end() if found else at + 1
        if found:
            yield found.span()
        at = text.find("@", low)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the patterns, by start, then kind."""
    if not TRIGGER.search(text):
        return []
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in IP.finditer(text):
        if all(map(octet, m.group().split("."))):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(DIGITS.findall(m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# --- the field ---------------------------------------------------------------

NAMES = ["bias", "digits<10", "digits10", "digits11-13", "digits14-19", "digits>19", "no digit", "one @", "more @", "letters", "dot letters end", "plus first", "paren first", "space", "hyphen", "dot", "paren", "octets", "octets>255", "luhn long", "luhn fails long", "other sign", "ends sign", "begins sign", "word before", "word after", "digit groups", "one group", "@ spaced", "ten in groups", "slash or equals", "letters digits mixed"]
INDEX = {n: i for i, n in enumerate(NAMES)}


def span_features(s: str, before: str, after: str) -> list[int]:
    """Numbers of the features that hold for a span as a whole."""
    digits = "".join(DIGITS.findall(s))
    n, letters = len(digits), any(c.isalpha() for c in s)
    groups = re.findall(r"[0-9]+", s)
    octets = bool(re.fullmatch(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", s))
    small = octets and all(map(octet, groups))
    signs = {c for c in s if not c.isalnum()}
    holds = {
        "bias": True, "digits<10": 0 < n < 10, "digits10": n == 10, "digits11-13": 11 <= n <= 13, "digits14-19": 14 <= n <= 19, "digits>19": n > 19, "no digit": n == 0,
        "one @": s.count("@") == 1, "more @": s.count("@") > 1, "letters": letters, "dot letters end": bool(re.search(r"@.*\.[A-Za-z]+$", s)), "plus first": s[0] == "+", "paren first": s[0] == "(",
        "space": " " in signs, "hyphen": "-" in signs, "dot": "." in signs, "paren": "(" in signs and ")" in signs, "octets": small, "octets>255": octets and not small,
        "luhn long": 14 <= n <= 19 and not letters and luhn(digits), "luhn fails long": 14 <= n <= 19 and not letters and not luhn(digits), "other sign": bool(signs - set(" @.-()+_%")),
        "ends sign": not s[-1].isalnum(), "begins sign": not s[0].isalnum() and s[0] not in "+(", "word before": before.isalnum() or before in "@+-.", "word after": after.isalnum() or after == "@",
        "digit groups": len(groups) > 1, "one group": len(groups) == 1, "@ spaced": bool(re.search(r"\s@\s", s)), "ten in groups": n == 10 and [len(g) for g in groups] == [3, 3, 4], "slash or equals": bool(signs & set("/=:\"'")),
        "letters digits mixed": bool(re.search(r"[A-Za-z][0-9]|[0-9][A-Za-z]", s)) and "@" not in s,
    }
    return [INDEX[name] for name, yes in holds.items() if yes]


class Region:
    """Atoms of a region and its candidate spans with their features."""

    def __init__(self, text: str):
        self.edges = [m.start() for m in ATOM.finditer(text)] + [len(text)]
        self.n = len(self.edges) - 1
        self.spans: list[tuple[int, int]] = []
        rows = []
        for i in range(self.n):
            a = self.edges[i]
            if text[a].isspace():
                continue
            for j in range(i + 1, min(self.n, i + MAX_ATOMS) + 1):
                b = self.edges[j]
                if b - a > MAX_CHARS:
                    break
                if text[b - 1].isspace() or not TRIGGER.search(text, a, b):
                    continue
                self.spans.append((i, j))
                rows.append(span_features(text[a:b], text[a - 1 : a] or " ", text[b : b + 1] or " "))
        self.x = np.zeros((len(rows), len(NAMES)))
        for r, features in enumerate(rows):
            self.x[r, features] = 1


class Field:
    """Weights of spans by feature and kind; an atom outside any span scores 0."""

    def __init__(self) -> None:
        self.w = np.zeros((len(NAMES), len(KINDS)))
        self.seen: dict[tuple, tuple[int, float]] = {}
        self.w[0] = -3.0

    def _by_end(self, region: Region) -> list[list[int]]:
        ends: list[list[int]] = [[] for _ in range(region.n + 1)]
        for r, (_, j) in enumerate(region.spans):
            ends[j].append(r)
        return ends

    def gradient(self, region: Region, gold: dict[tuple[int, int], int]) -> np.ndarray:
        """Of the log-likelihood: features of the true spans less the expected ones, by forward and backward sums."""
        scores, n = region.x @ self.w, region.n
        forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        forward[0] = backward[n] = 0.0
        whole = np.logaddexp.reduce(scores, axis=1) if len(scores) else np.zeros(0)
        for j, rows in enumerate(self._by_end(region)):
            if j:
                forward[j] = np.logaddexp.reduce([forward[j - 1], *(forward[region.spans[r][0]] + whole[r] for r in rows)])
        starts: list[list[int]] = [[] for _ in range(n + 1)]
        for r, (i, _) in enumerate(region.spans):
            starts[i].append(r)
        for i in range(n - 1, -1, -1):
            backward[i] = np.logaddexp.reduce([backward[i + 1], *(backward[region.spans[r][1]] + whole[r] for r in starts[i])])
        if not len(scores):
            return np.zeros_like(self.w)
        i, j = np.array(region.spans).T
        chance = np.exp(forward[i][:, None] + scores + backward[j][:, None] - forward[n])
        true = np.zeros_like(chance)
        for r, span in enumerate(region.spans):
            if span in gold:
                true[r, gold[span]] = 1
        return region.x.T @ (true - chance)

    def fit(self, data: list[tuple[Region, dict]], steps: int = STEPS, rate: float = 0.3) -> Field:
        total = np.zeros_like(self.w)
        for _ in range(steps):
            g = sum((self.gradient(*d) for d in data), np.zeros_like(self.w)) / max(len(data), 1) - 0.001 * self.w
            total += g * g
            self.w += rate * g / (np.sqrt(total) + 1e-8)
        return self

    def _best(self, *span: str) -> tuple[int, float]:
        """The best kind of a span and its score; kept for spans met again."""
        if span not in self.seen:
            if len(self.seen) >= SEEN:
                self.seen.clear()
            scores = self.w[span_features(*span)].sum(axis=0)
            kind = int(scores.argmax())
            self.seen[span] = kind, float(scores[kind])
        return self.seen[span]

    def decode(self, text: str) -> list[tuple[int, int, int]]:
        return list(self.segments(text))

    def segments(self, text: str) -> Iterator[tuple[int, int, int]]:
        """The best segmentation's spans of a region, as (start, kind, end).

        A forward pass over the atoms; whenever FLUSH of them wait, the part that the
        best paths to all ends in reach have in common is given out and forgotten.
        """
        edges, best, back = [0], [0.0], [None]  # of the atoms' ends from the last sure one on
        for atom in ATOM.finditer(text):
            b, j = atom.end(), len(edges)
            edges.append(b)
            best.append(best[-1])
            back.append(None)
            if not text[b - 1].isspace():
                for i in range(j - 1, max(0, j - MAX_ATOMS) - 1, -1):
                    a = edges[i]
                    if b - a > MAX_CHARS:
                        break
                    if text[a].isspace() or not TRIGGER.search(text, a, b):
                        continue
                    kind, score = self._best(text[a:b], text[a - 1 : a] or " ", text[b : b + 1] or " ")
                    if best[i] + score > best[j]:
                        best[j], back[j] = best[i] + score, (i, kind)
            if j >= FLUSH and j % MAX_ATOMS == 0:
                sure = set.intersection(*(set(self._path(back, k)) for k in range(j - MAX_ATOMS, j + 1)))
                cut = max(sure)
                if cut:
                    yield from self._spans(edges, back, cut)
                    edges, best, back = edges[cut:], best[cut:], [None, *((x and (x[0] - cut, x[1])) for x in back[cut + 1 :])]
        yield from self._spans(edges, back, len(edges) - 1)

    @staticmethod
    def _path(back: list, j: int) -> Iterator[int]:
        """The edges that the best path to edge j passes."""
        while j > 0:
            yield j
            j = back[j][0] if back[j] else j - 1
        yield 0

    @staticmethod
    def _spans(edges: list[int], back: list, j: int) -> list[tuple[int, int, int]]:
        out = []
        while j > 0:
            if back[j]:
                i, kind = back[j]
                out.append((edges[i], kind, edges[j]))
                j = i
            else:
                j -= 1
        return out[::-1]


def regions(text: str) -> Iterator[tuple[int, str]]:
    """Start and text of every region, found from each trigger outwards."""
    at, low = TRIGGER.search(text), 0
    while at:
        start = at.start()
        while start > low and not text[start - 1].isspace():
            start -= 1
        end = HOT_TOKEN.match(text, start).end()
        while text[end - 1] == "@" and (word := WORD_AFTER.match(text, end)):
            end = word.end()
            more = MORE_HOT.match(text, end)
            end = HOT_TOKEN.match(text, more.end()).end() if more else end
        if text[start] == "@":
            before = WORD_BEFORE.search(text[max(low, start - 260) : start])
            start -= len(before.group()) if before else 0
        yield start, text[start:end]
        at, low = TRIGGER.search(text, end), end


def _gold(region: Region, spans: list[tuple[int, int, int]]) -> dict[tuple[int, int], int]:
    place = {e: k for k, e in enumerate(region.edges)}
    out, last = {}, 0
    for a, k, b in spans:  # of overlapping matches, the first
        if a >= last and (place.get(a), place.get(b)) in region.spans:
            out[place[a], place[b]] = k
            last = b
    return out


def _variants(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, list]]:
    """The region as it is, and its only match in another spelling."""
    yield text, spans
    if len(spans) == 1:
        a, k, b = spans[0]
        s = text[a:b]
        other = {0: lambda: s.replace("@", " @ "), 2: lambda: ".".join(re.findall(r"[0-9]{1,4}", re.sub(r"[^0-9]", "", s))), 3: lambda: re.sub(r"^\+[0-9]+[ .-]+(?=[(0-9])", "", s)}.get(k, lambda: s)()
        if other != s and len(DIGITS.findall(other)) >= (0, 0, 14, 10)[k]:
            yield text[:a] + other + text[b:], [(a, k, a + len(other))]


def fit_field(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Field:
    chosen = docs.select(F.col(id_col).cast("long").alias("id")).filter("id IS NOT NULL").distinct().orderBy(F.xxhash64("id"), "id").limit(TRAIN_DOCUMENTS)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id", "left_semi")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                for _, s in regions(text):
                    if len(s) <= TRAIN_CHARS:
                        spans = base_spans(s)
                        out.append((spans[0][1] if spans else len(KINDS), s))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([s for _, s in out], pa.string())], names=["kind", "region"])

    found = rows.select("text").mapInArrow(cut, "kind int, region string").distinct()
    picked = found.selectExpr("kind", "region", "row_number() OVER (PARTITION BY kind ORDER BY xxhash64(region), region) AS n").filter(F.col("n") <= TRAIN_REGIONS)
    data = []
    for row in sorted(picked.collect(), key=lambda r: (r["kind"], r["n"])):
        for text, spans in _variants(row["region"], base_spans(row["region"])):
            region = Region(text)
            data.append((region, _gold(region, spans)))
    return Field().fit(data) if data else Field()


def _beside(base: list[tuple[int, int, int]], spans: Iterable[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """The spans that overlap none of base; both are sorted and are read once."""
    at, reach = 0, 0
    for a, kind, b in spans:
        while at < len(base) and base[at][0] < b:
            reach = max(reach, base[at][2])
            at += 1
        if reach <= a:
            yield a, kind, b


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """A row per document: counts and digest of the patterns' matches, all spans, and how many the field added."""
    field = field or fit_field(docs, id_col, text_col)
    weights = field.w

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field()
        own.w = weights

        @lru_cache(4096)
        def short(s: str) -> tuple:
            return tuple(own.segments(s))

        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py()
                base = base_spans(text)
                added = list(_beside(base, ((a + start, kind, b + start) for start, s in regions(text) for a, kind, b in (short(s) if len(s) <= CACHED_CHARS else own.segments(s)))))
                counts = [sum(kind == n for _, kind, _ in base) for n in range(len(KINDS))]
                out.append((batch.column(0)[k].as_py(), *counts, hashlib.sha256(shown(base).encode()).hexdigest(), shown(sorted(base + added)), len(added)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(find, SCHEMA).withColumnRenamed("id", id_col)
