"""Licence scans: a trained paragraph classifier, confirmed by templates.

A paragraph is a line, or a run of adjacent lines where an n-gram of a template
crosses each line break, so that a wrapped notice is read whole and notices on
lines of their own stay apart; it is numbered by its first line.  It is a bag of
word bigrams and trigrams, lower-case, without punctuation, "licence" read as
"license"; identifiers (SPDX) are templates like any other.  A softmax regression
over the n-grams of the templates tells licence families, "unknown" (reads like a
licence, but of no family here) and "none" apart.  A family counts when it is the
likeliest class, its probability reaches SURE (calibration on unmet families makes
probabilities small, 17 classes share them) and a template of the family is contained
in the paragraph (share of its bigrams at least CONTAINED); otherwise a licence-like paragraph is
"unknown", with the probability of not being "none".

Probabilities are calibrated by a temperature.  It is fitted on wordings and whole
families that FOLDS models trained for this have not met: a kept-out wording is its
family's, a kept-out family is "unknown", kept-out ordinary lines are "none".

Training texts, a bounded sample:
* the templates, with words dropped, replaced and added;
* at most TRAIN_LINES lines that mention a licence, of all documents (the least by
  a hash), of the family whose template they contain; "unknown" if they only share
  a trigram with one;
* short pieces of templates that say nothing of rights, in other words: none;
* ordinary lines, at most TRAIN_PARAGRAPHS, of at most TRAIN_DOCUMENTS documents
  (the least by a hash of the id) that share no trigram with a template.
Lines of more than TRAIN_CHARS characters are not trained on.  Scanning reads every
paragraph whole.

Defined results: a null text counts as empty and has no licence; repeated rows
give equal results; of equally likely finds of a document the first counts, of
equally likely families the first in TEMPLATES; a very long text is read whole, its words
hashed PIECE bytes at a time, beside some 25 bytes for each of its lines; an empty
table gives an empty result.  Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoframe.llm.quality import SPACE, text_slices, word_hashes, word_spans

#: Usual wordings of public licence notices, by family.
TEMPLATES = {
    "agpl": [
        "licensed under the gnu affero general public license version 3",
        "under the terms of the gnu affero general public license as published by the free software foundation",
        "you should have received a copy of the gnu affero general public license along with this program",
        "spdx license identifier agpl 3 0",
    ],
    "apache-2.0": [
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license",
        "you may obtain a copy of the license at http www apache org licenses license 2 0",
        "released under the apache 2 0 license",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
        "see the license for the specific language governing permissions and limitations under the license",
        "spdx license identifier apache 2 0",
    ],
    "bsd": [
        "released under the bsd license",
        "redistribution and use in source and binary forms with or without modification are permitted",
        "licensed under the 3 clause bsd license",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "spdx license identifier bsd 3 clause",
        "spdx license identifier bsd 2 clause",
    ],
    "cc-by": [
        "licensed under cc by 4 0",
        "this work is licensed under a creative commons attribution 4 0 international license",
        "available under the creative commons attribution license",
        "spdx license identifier cc by 4 0",
    ],
    "cc-by-nc": [
        "licensed under cc by nc 4 0",
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
        "spdx license identifier cc by nc 4 0",
    ],
    "cc-by-sa": [
        "licensed under cc by sa 4 0",
        "this work is licensed under a creative commons attribution sharealike 4 0 international license",
        "spdx license identifier cc by sa 4 0",
    ],
    "cc0": [
        "released under cc0 1 0 universal",
        "dedicated to the public domain under the creative commons zero license",
        "spdx license identifier cc0 1 0",
    ],
    "epl-2.0": [
        "licensed under the eclipse public license version 2 0",
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
        "spdx license identifier epl 2 0",
    ],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "under the terms of the gnu general public license as published by the free software foundation",
        "licensed under the gnu general public license version 2",
        "you should have received a copy of the gnu general public license along with this program",
        "spdx license identifier gpl 2 0",
        "spdx license identifier gpl 3 0",
    ],
    "isc": [
        "released under the isc license",
        "licensed under the isc license",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        "spdx license identifier isc",
    ],
    "lgpl": [
        "licensed under the gnu lesser general public license version 3",
        "under the terms of the gnu lesser general public license as published by the free software foundation",
        "you should have received a copy of the gnu lesser general public license along with this library",
        "spdx license identifier lgpl 2 1",
        "spdx license identifier lgpl 3 0",
    ],
    "mit": [
        "released under the mit license",
        "licensed under the mit license",
        "distributed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "spdx license identifier mit",
    ],
    "mpl-2.0": [
        "licensed under the mozilla public license version 2 0",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "spdx license identifier mpl 2 0",
    ],
    "unlicense": [
        "this is free and unencumbered software released into the public domain",
        "spdx license identifier unlicense",
    ],
    "unknown": [
        "all rights reserved",
        "licensed under the terms of our own license agreement",
        "released under a proprietary license",
        "no permission to copy or redistribute is granted",
        "this work is licensed under the license below",
    ],
}
#: What a notice's own wording follows or precedes: whole notices are templates' wordings with these around them.
AROUND = ["this program is free software you can redistribute it and or modify it", "this library is free software you can redistribute it and or modify it", "either version 2 of the license or at your option any later version"]
#: Other spellings, which read like the first.
SPELLINGS = {b"license": [b"licence"], b"licensed": [b"licenced"], b"licenses": [b"licences"]}
#: Words that only notices of rights have; a piece of a template without one says nothing of a licence.
TELLING = re.compile("licen[cs]e|permission|permitted|redistribut|copyright|rights|public|software|spdx|granted|creative|source code")
NONE = "none"
CLASSES = [*TEMPLATES, NONE]
TRAIN_DOCUMENTS, TRAIN_PARAGRAPHS, TRAIN_LINES, TRAIN_CHARS, COPIES, STEPS, FOLDS = 400, 1500, 2000, 2000, 60, 120, 3
MENTIONS = r"(?i)licen[cs]e|permission|all rights|public domain|redistribut"
SURE, CONTAINED = 0.25, 0.75
SCHEMA = "id long, family string, probability double, similarity double, n_license_paragraphs long, paragraphs string"
PIECE = 1 << 20
_SAME = {other: usual for usual, others in SPELLINGS.items() for other in others}
_ONE_HASH = lambda w: word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]
_SAME_HASHES = {_ONE_HASH(other): _ONE_HASH(usual) for other, usual in _SAME.items()}
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 or c == 10 else 32 for c in range(256))


def _spelled(words: list[bytes]) -> list[bytes]:
    return [_SAME.get(w, w) for w in words]


def _pieces(raw: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where raw can be cut into pieces of some PIECE bytes, between words."""
    a = 0
    while a < len(raw):
        b = a + PIECE
        while b < len(raw) and not SPACE[raw[b : b + PIECE]].any():
            b += PIECE
        b = b + int(SPACE[raw[b : b + PIECE]].argmax()) if b < len(raw) else len(raw)
        yield a, b
        a = b


def _grams(raw: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n-gram hashes (those of the vocabulary, if one is given) and the paragraph (its first line) of each; of every text, the number of its first line; of every newline, its place; of every line, whether the next one goes on with it.

    Words are hashed a piece at a time; the last two of a piece are carried into the next.
    """
    breaks = np.flatnonzero(raw == 10)
    goes_on = np.zeros(len(breaks) + len(offsets), bool)
    out, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    hashes, doc, line = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for a, b in _pieces(raw):
        starts, ends = word_spans(raw[a:b], offsets[(offsets >= a) & (offsets <= b)] - a)
        own = word_hashes(raw[a:b], starts, ends)
        for other, usual in _SAME_HASHES.items():
            own[own == other] = usual
        text = np.searchsorted(offsets, starts + a, "right") - 1
        carried = min(len(hashes), 2)
        hashes = np.concatenate([hashes[-2:], own])
        doc, line = np.concatenate([doc[-2:], text]), np.concatenate([line[-2:], np.searchsorted(breaks, starts + a) + text])
        near = (doc[1:] == doc[:-1]) & (line[1:] - line[:-1] <= 1)
        run, whole = hashes, np.ones(len(hashes), bool)
        with np.errstate(over="ignore"):
            for n in (2, 3):
                run = run[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[n - 1 :] if len(hashes) >= n else run[:0]
                whole = whole[: len(run)] & near[n - 2 :][: len(run)]
                grams, first, last, there = run ^ np.uint64(n), line[: len(run)], line[n - 1 :][: len(run)], whole.copy()
                there[: max(carried - n + 1, 0)] = False  # came out with the piece before
                if vocabulary is not None:
                    there &= np.isin(grams, vocabulary)
                    cross = there & (first != last)
                    goes_on[first[cross]] = goes_on[last[cross] - 1] = True
                else:
                    there &= first == last
                out.append(grams[there])
                of.append(first[there])
    begun = np.arange(len(goes_on))
    begun[1:][goes_on[:-1]] = 0
    begun = np.maximum.accumulate(begun)
    return np.concatenate(out), begun[np.concatenate(of)], np.searchsorted(breaks, offsets[:-1]) + np.arange(len(offsets) - 1), breaks, goes_on


def plain(data: bytes) -> np.ndarray:
    return np.frombuffer(data.translate(_PLAIN), np.uint8)


def _text_grams(text: str) -> np.ndarray:
    raw = plain(text.replace("\n", " ").encode())
    return np.unique(_grams(raw, np.array([0, len(raw)]))[0])


class LicenseModel:
    """Softmax regression over the templates' n-grams."""

    def __init__(self) -> None:
        self.vocabulary = np.unique(np.concatenate([_text_grams(t) for family in TEMPLATES.values() for t in family]))
        self.w, self.b, self.temperature = np.zeros((len(self.vocabulary), len(CLASSES))), np.zeros(len(CLASSES)), 1.0
        self.b[-1] = 3.0

    def _matrix(self, texts: list[str]) -> np.ndarray:
        return np.stack([np.isin(self.vocabulary, _text_grams(t)) for t in texts]).astype(np.float64)

    def fit(self, texts: list[str], classes: list[int], groups: list[int]) -> LicenseModel:
        """groups: texts of one wording (or one ordinary line) share a number and are kept out together."""
        x, classes, groups = self._matrix(texts), np.array(classes), np.array(groups)
        unknown, none = CLASSES.index("unknown"), len(CLASSES) - 1
        logits, truth = [], []
        for fold in range(FOLDS):
            family_out = (classes < unknown) & (classes % FOLDS == fold)
            out = family_out | (groups % FOLDS == fold)
            w, b = self._descend(x[~out], classes[~out])
            logits.append(x[out] @ w + b)
            truth.append(np.where(family_out, unknown, classes)[out])
        logits, truth = np.concatenate(logits), np.concatenate(truth)
        share = np.where(truth == none, 1.0 / max((truth == none).sum(), 1), 1.0 / max((truth != none).sum(), 1))
        loss = {t: -(share * np.log(self._softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12)).sum() for t in np.geomspace(0.5, 8, 25)}
        self.temperature = float(min(loss, key=loss.get))
        self.w, self.b = self._descend(x, classes)
        return self

    def _descend(self, x: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, y = [self.w, self.b], np.eye(len(CLASSES))[classes]
        m, v = ([np.zeros_like(a) for a in p] for _ in range(2))
        for step in range(1, STEPS + 1):
            e = (self._softmax(x @ p[0] + p[1]) - y) / len(x)
            for k, grad in enumerate((x.T @ e + 1e-5 * p[0], e.sum(axis=0))):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.99 * v[k] + 0.01 * grad * grad
                p[k] = p[k] - 0.1 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return p[0], p[1]

    @staticmethod
    def _softmax(logits: np.ndarray) -> np.ndarray:
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def probabilities(self, grams: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Paragraphs with any n-gram of the vocabulary, and their class probabilities; all others are "none"."""
        at = np.minimum(np.searchsorted(self.vocabulary, grams), len(self.vocabulary) - 1)
        hit = self.vocabulary[at] == grams
        pairs = np.unique(of[hit] * len(self.vocabulary) + at[hit])
        paragraph, feature = np.divmod(pairs, len(self.vocabulary))
        names, row = np.unique(paragraph, return_inverse=True)
        logits = np.stack([np.bincount(row, self.w[feature, c], len(names)) for c in range(len(CLASSES))], axis=1) + self.b
        return names, self._softmax(logits / self.temperature)


def _bigrams(text: str) -> set:
    words = _spelled(bytes(plain(text.encode())).split())
    return set(zip(words, words[1:], strict=False))


_TEMPLATE_BIGRAMS = {family: [_bigrams(t) for t in texts] for family, texts in TEMPLATES.items()}


def template_similarity(paragraph: str, family: str) -> float:
    """The largest share of a template's bigrams that the paragraph holds."""
    own = _bigrams(paragraph)
    return max(len(t & own) / len(t) for t in _TEMPLATE_BIGRAMS[family])


_TRIGRAMS = {tuple(ws[k : k + 3]) for texts in TEMPLATES.values() for t in texts for ws in [t.encode().split()] for k in range(len(ws) - 2)}


def _shares_trigram(line: str) -> bool:
    ws = _spelled(bytes(plain(line.encode())).split())
    return any(tuple(ws[k : k + 3]) in _TRIGRAMS for k in range(len(ws) - 2))


def _class_of(line: str) -> int | None:
    """The family whose template a line contains; unknown if it shares a trigram with one; else it teaches nothing."""
    like = {family: template_similarity(line, family) for family in TEMPLATES}
    best = max(like, key=like.get)
    if like[best] >= CONTAINED:
        return CLASSES.index(best)
    return CLASSES.index("unknown") if _shares_trigram(line) else None


def _training_texts(ordinary: list[str], met: list[str], seed: int = 5) -> tuple[list[str], list[int], list[int]]:
    """Texts, their classes and the wordings they come from."""
    rng = np.random.default_rng(seed)
    fillers = [w for t in ordinary for w in t.split()] or ["word", "text", "line"]
    some = lambda n: [fillers[k] for k in rng.integers(0, len(fillers), n)]
    out = [(t, len(CLASSES) - 1, k) for k, t in enumerate(ordinary)]
    out += [(t, c, k) for k, t in enumerate(met) if (c := _class_of(t)) is not None]
    for c, (family, wordings) in enumerate(TEMPLATES.items()):
        for n, wording in enumerate(wordings):
            for k in range(COPIES // len(wordings)):
                words = wording.split()
                if k > 1 and family != "unknown" and len(words) > 6 and rng.random() < 0.4:
                    words[int(rng.integers(len(words)))] = some(1)[0] if rng.random() < 0.7 else ""
                if family != "unknown" and rng.random() < 0.25:
                    words = [*AROUND[int(rng.integers(len(AROUND)))].split(), *words] if rng.random() < 0.5 else [*words, *AROUND[-1].split()]
                before, after = some(int(rng.integers(0, 6))) if k % 2 else [], some(int(rng.integers(0, 12))) if k % 3 else []
                out.append((" ".join([*before, *words, *after]), c, n))
    pieces = [ws[k : k + n] for texts in TEMPLATES.values() for t in texts for ws in [t.split()] for n in (3, 4) for k in range(len(ws) - n + 1) if not TELLING.search(" ".join(ws[k : k + n]))]
    for k in range(4 * COPIES):  # as an ordinary sentence has them
        out.append((" ".join([*some(int(rng.integers(0, 5))), *pieces[int(rng.integers(len(pieces)))], *some(int(rng.integers(1, 8)))]), len(CLASSES) - 1, k))
    for k in range(COPIES):
        out.append((" ".join(["licensed", "under", "the", *some(2), "license", *(["version", str(rng.integers(1, 9))] if rng.random() < 0.5 else [])]), CLASSES.index("unknown"), k))
    return tuple(map(list, zip(*out, strict=True)))


def fit_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LicenseModel:
    chosen = docs.select(F.col(id_col).cast("long").alias("id")).filter("id IS NOT NULL").distinct().orderBy(F.xxhash64("id"), "id").limit(TRAIN_DOCUMENTS)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def least(texts: DataFrame, most: int, wanted: str) -> list[str]:
        lines = texts.select(F.explode(F.split("text", "\n")).alias("line")).filter(F.length("line").between(1, TRAIN_CHARS)).filter(wanted).distinct()
        return [r["line"] for r in lines.orderBy(F.xxhash64("line"), "line").limit(most).collect()]

    ordinary = least(rows.join(F.broadcast(chosen), "id", "left_semi"), TRAIN_PARAGRAPHS, "true")
    met = least(rows.filter(F.col("text").rlike(MENTIONS)), TRAIN_LINES, f"line RLIKE r'{MENTIONS}'")
    return LicenseModel().fit(*_training_texts([s for s in ordinary if not _shares_trigram(s)], met))


def document_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: LicenseModel | None = None) -> DataFrame:
    """A row per document: the likeliest family found (null: none), its probability and similarity, and all finds as paragraph:family."""
    model = model or fit_licenses(docs, id_col, text_col)
    none = len(CLASSES) - 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, raw, at in text_slices(batch, 1):
                data = raw.tobytes()
                grams, of, begins, breaks, goes_on = _grams(plain(data), at, model.vocabulary)
                names, p = model.probabilities(grams, of)
                finds: list[list[tuple]] = [[] for _ in range(last - first)]
                for name, row in zip(names.tolist(), p, strict=True):
                    best = int(row.argmax())
                    if best == none:
                        continue
                    doc = int(np.searchsorted(begins, name, "right")) - 1
                    k = name - int(begins[doc])
                    nth = name - doc  # newlines before the paragraph
                    start = int(breaks[nth - 1]) + 1 if k else int(at[doc])
                    while goes_on[nth + doc]:
                        nth += 1
                    end = min(int(breaks[nth]) if nth < len(breaks) else len(data), int(at[doc + 1]))
                    family, chance = CLASSES[best], float(row[best])
                    text = data[start:end].decode("utf-8", "replace")
                    like = template_similarity(text, family)
                    if family != "unknown" and (chance < SURE or like < CONTAINED):
                        family, chance = "unknown", float(row[:none].sum())
                    finds[doc].append((chance if family != "unknown" else chance - 1, k, family, chance, like))
                out = []
                for f in finds:
                    top = max(f, key=lambda x: (x[0], -x[1])) if f else None
                    out.append((top[2], top[3], top[4], len(f), ",".join(f"{k}:{family}" for _, k, family, _, _ in sorted(f, key=lambda x: x[1]))) if top else (None, None, None, 0, ""))
                columns = list(zip(*out, strict=True)) if out else [[]] * 5
                kinds = (pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(scan, SCHEMA).withColumnRenamed("id", id_col)
