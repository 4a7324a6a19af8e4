"""Inputs that once gave wrong results or took too much memory."""

import subprocess
import sys
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from geoframe.llm import exact_dedup, license_scan, lm_scoring, packing, quality, simhash
from tests.llm.test_documents import plain_fingerprint

SWAP = bytes.maketrans(b"ab", b"ba")


def thue_morse(n):
    word = b"a"
    while len(word) < n:
        word += word.translate(SWAP)
    return word


@pytest.mark.parametrize("n", [8, 64, 1024, 2048])
def test_words_of_one_form_have_their_own_hashes(n):
    a = thue_morse(n)
    words = [a, a.translate(SWAP), a + b"a", a[:-1], b"\0" * n, b"\0" * (n + 1)]
    ends = np.cumsum([len(w) for w in words])
    hashes = quality.word_hashes(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends)
    assert len(set(hashes.tolist())) == len(words)
    assert hashes[0] == quality.word_hashes(np.frombuffer(b"xx" + a + b"y", np.uint8), np.array([2]), np.array([2 + n]))[0]


def test_such_words_are_counted_apart(spark):
    a = thue_morse(1024).decode()
    b = a.translate(SWAP)
    train = next(k for k in range(100) if not held_out(k))
    asked = [k for k in range(100) if held_out(k)][:2]
    docs = spark.createDataFrame([(train, f"{a} x"), (asked[0], a), (asked[1], b)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm_scoring.text_scores(docs).collect()}
    assert (got[asked[0]].n_known, got[asked[1]].n_known) == (2, 1)  # the word and the end, the end alone
    assert got[asked[0]].base_score > got[asked[1]].base_score


def held_out(k):
    import zlib

    return zlib.crc32(str(k).encode()) % 5 == 1


def test_the_least_id_is_an_id(spark):
    low = -(2**63)
    rows = [(low, "one"), (None, "one"), (low, "two"), (None, "three"), (None, "three"), (5, "four"), (low, "four"), (low, "five"), (low, "five")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(docs).collect())
    assert got == Counter([
        (low, low, 2, True), (None, low, 2, False), (low, low, 1, True), (None, None, 2, True), (None, None, 2, False), (5, 5, 2, True), (low, 5, 2, False), (low, low, 2, True), (low, low, 2, False),
    ])
    assert Counter(map(tuple, exact_dedup.drop_exact_duplicates(docs).collect())) == Counter([(low, "one"), (low, "two"), (None, "three"), (5, "four"), (low, "five")])


@pytest.mark.parametrize("limit", ["tokens", "segments", "loss_tokens"])
def test_a_limit_of_nothing_is_refused(spark, limit):
    with pytest.raises(ValueError, match="limit"):
        packing.packed_pieces(spark.createDataFrame([(1, "a")], "doc_id long, text string"), **{limit: 0})


def test_fingerprints_do_not_depend_on_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"W{x}" for x in rng.integers(0, 50, n)) for n in (0, 1, 2, 3, 4, 5, 40, 300)] + ["", "  a\tb \n c ", "one  two"]
    want = [plain_fingerprint(t) for t in texts]
    for piece, size in ((1 << 18, 1 << 16), (1, 1), (5, 3), (64, 7)):
        monkeypatch.setattr(simhash, "PIECE", piece)
        monkeypatch.setattr(simhash, "SLICE", size)
        assert simhash._fingerprints([t.encode() for t in texts], 3).tolist() == want


def test_a_long_text_takes_little_memory():
    code = (
        "import resource, numpy as np\n"
        "from geoframe.llm import simhash\n"
        "text = b' '.join(b'%d' % x for x in np.random.default_rng(1).integers(0, 9999, 6_000_000))\n"
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
        "simhash._fingerprints([text], 3)\n"
        "print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)"
    )
    grown = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout)
    assert grown < 200_000, f"{grown} kB beside a text of 30 MB"


#: Notices as they are met, most around a template's own wording, and sentences that share words with them, with the family to find.
NOTICES = [
    ("mit", "SPDX-License-Identifier: MIT"),
    ("apache-2.0", "// SPDX-License-Identifier: Apache-2.0"),
    ("gpl", "# SPDX-License-Identifier: GPL-3.0-or-later"),
    ("lgpl", "/* SPDX-License-Identifier: LGPL-2.1-or-later */"),
    ("isc", "SPDX-License-Identifier: ISC"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This file is free software; you may copy it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License."),
    ("mit", "The code here is distributed under the MIT licence, see the file COPYING."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the notice appears."),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at the site."),
    ("cc-by-sa", "The text is licensed under CC BY-SA 4.0 unless noted."),
    ("unknown", "This data set is licensed under the Open Harbour Licence version 3."),
    (None, "You may not use this road."),
    (None, "The meeting is subject to the following conditions of weather."),
    (None, "He should have received a copy of the letter along with this parcel."),
    (None, "A driver needs a license to drive a car."),
    (None, "She gave her permission to the school for the trip."),
    (None, "Either version of the story is good, at your option."),
]


def test_notices_in_other_words(spark):
    plain = ["The cat sat on the mat and looked at the rain.", "Prices rose in the spring while rents fell.", "A long road led down to the harbour town."]
    docs = spark.createDataFrame([*enumerate(t for _, t in NOTICES), *((100 + k, t) for k, t in enumerate(plain))], "doc_id long, text string")
    got = {r.doc_id: r.family for r in license_scan.document_licenses(docs).collect()}
    assert [got[k] for k in range(len(NOTICES))] == [family for family, _ in NOTICES]
    assert not any(got[100 + k] for k in range(3))


def test_licence_grams_in_pieces(monkeypatch):
    model = license_scan.LicenseModel()
    texts = [t for _, t in NOTICES] + ["", "\n\n", "Released under\nthe MIT\nLicence.\n\nx", "w" * 90, "all rights\n \nreserved", "mit"]
    data = "".join(texts).encode()
    at = np.cumsum([0, *(len(t.encode()) for t in texts)])
    whole = [np.sort(x) for x in license_scan._grams(license_scan.plain(data), at, model.vocabulary)]
    for size in (1, 7, 64):
        monkeypatch.setattr(license_scan, "PIECE", size)
        assert all((np.sort(x) == y).all() for x, y in zip(license_scan._grams(license_scan.plain(data), at, model.vocabulary), whole, strict=True))


def test_long_licence_text_needs_little_memory():
    data = b"some words of a long text under the mit license\n" * 600_000
    raw, model = license_scan.plain(data), license_scan.LicenseModel()
    tracemalloc.start()
    grams, of, *_ = license_scan._grams(raw, np.array([0, len(raw)]), model.vocabulary)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(np.unique(of)) == 600_000 and peak < 30 * len(grams) + 20 * len(raw)
    print(peak / len(raw))


def test_training_keeps_one_copy_of_the_sample():
    """The driver held the training passages four times over: as bytes, as doubles by document, stacked, and normalised."""
    import tracemalloc

    import numpy as np

    from geoframe.llm import quality

    bags = [np.full((20, quality.FEATURES), k % 7, np.float32).tobytes() for k in range(500)]
    tracemalloc.start()
    x, sizes = quality._stacked(bags)
    quality.AttentionModel().fit(x, sizes, np.arange(500) % 2 * 1.0, steps=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(x) == sizes.sum() == 10_000 and peak < 3.2 * x.nbytes
