"""Inputs that once failed, and the operators' results against plain versions of their rules."""

import glob
import math
import os
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark import cloudpickle

from geoframe.llm import _shared, ann, exact_dedup, license_scan, lm_scoring, mixing, pii, quality, queries, shingles, simhash, suffix_dedup
from tests.llm.test_documents import plain_words

DATA = "/root/testdata/sf0.001"
#: The patterns as the contract gives them.
PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def random_marks(rng, n, marks="0123 1.-.@ab+() "):
    return "".join(rng.choice(list(marks), n))


# --- op9 -------------------------------------------------------------------------


def test_patterns_match_as_given():
    rng = np.random.default_rng(1)
    for _ in range(4000):
        s = random_marks(rng, rng.integers(1, 40))
        for given, own in zip(PATTERNS, (pii.EMAIL, pii.IP, pii.CARD, pii.PHONE)):
            assert [m.span() for m in re.finditer(given, s)] == [m.span() for m in own.finditer(s)]


@pytest.mark.parametrize("text", ["1" * 5000 + ".2.3.4", "0" * 5000 + "1.2.3.4 and 10.0.0.1", "call " + "9" * 20000 + " @ x.org", "1.1.1.1 " * 3000 + "a@b.cd " * 3000])
def test_long_runs(spark, text):
    began = time.time()
    row = pii.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_ip == sum(all(int(x.lstrip("0")[:4] or 0) <= 255 for x in m.group().split(".")) for m in re.finditer(r"(?<![0-9])[0-9]+(\.[0-9]+){3}", text))
    assert time.time() - began < 60


def plain_best(field, text):
    """Score of the best segmentation, by trying every span at every atom."""
    edges = [m.start() for m in pii.ATOM.finditer(text)] + [len(text)]
    best = [0.0] * len(edges)
    for j in range(1, len(edges)):
        best[j] = best[j - 1]
        for i in range(max(0, j - pii.MAX_ATOMS), j):
            a, b = edges[i], edges[j]
            if not (text[a].isspace() or text[b - 1].isspace()) and re.search("[0-9@]", text[a:b]) and b - a <= pii.MAX_CHARS:
                best[j] = max(best[j], best[i] + field.w[pii.span_features(text[a:b], text[a - 1 : a] or " ", text[b : b + 1] or " ")].sum(axis=0).max())
    return best[-1]


@pytest.mark.parametrize("flush", [4096, 40])
def test_field_finds_the_best_segmentation(monkeypatch, flush):
    monkeypatch.setattr(pii, "FLUSH", flush)
    rng, field = np.random.default_rng(2), pii.Field()
    field.w = rng.normal(size=field.w.shape) * 0.5
    for _ in range(25):
        s = random_marks(rng, rng.integers(1, 300))
        spans = field.decode(s)
        assert all(x[2] <= y[0] for x, y in zip(spans, spans[1:]))
        score = sum(field.w[pii.span_features(s[a:b], s[a - 1 : a] or " ", s[b : b + 1] or " ")].sum(axis=0)[k] for a, k, b in spans)
        assert score == pytest.approx(plain_best(field, s))


def test_added_spans_overlap_no_match():
    rng = np.random.default_rng(3)
    for _ in range(300):
        cuts = np.sort(rng.choice(200, 20, replace=False)).tolist()
        spans = [(a, 0, b) for a, b in zip(cuts[::2], cuts[1::2])]
        base = sorted((int(a), 1, int(a + rng.integers(1, 30))) for a in rng.integers(0, 200, rng.integers(0, 6)))
        assert list(pii._beside(base, iter(spans))) == [x for x in spans if not any(a < x[2] and x[0] < b for a, _, b in base)]


# --- op6 -------------------------------------------------------------------------


def test_vectors_of_any_size_and_null_ids(spark):
    rows = [(50, [2.0**660] * 8), (1, [2.0**700] * 8), (2, [1.0] * 8), (3, [2.0**-700] * 8), (None, [4.0] * 8), (4, [-(2.0**-900)] * 8), (100, [5e-324] * 8)]
    odd = {r.vec_id: r.score for r in ann.nearest(spark.createDataFrame([(50, [1e200] * 8), (1, [2e200] * 8), (2, [1.0] * 8), (3, [3e-200] * 8)], "vec_id long, embedding array<double>")).collect()}
    assert odd == pytest.approx({1: 1.0, 2: 1.0, 3: 1.0}, abs=1e-12)
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=6).collect()
    own = {r.rank: (r.vec_id, r.score) for r in got if r.query_id == 50}
    assert {q.query_id for q in got} == {50, 100}
    assert [own[k][0] for k in range(1, 7)] == [1, 2, 3, 100, None, 4]
    assert [own[k][1] for k in range(1, 7)] == pytest.approx([1.0] * 5 + [-1.0], abs=1e-12)


def test_ties_go_to_smaller_ids_and_rows_are_told_apart(spark):
    rng = np.random.default_rng(9)
    base = [float(x) for x in rng.normal(size=64)]
    rows = [(k, base) for k in range(1, 60)] + [(7, base), (7, base)] + [(k, [float(x) for x in rng.normal(size=64)]) for k in range(60, 300)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), k=9).collect()
    assert sorted((r.rank, r.vec_id) for r in got if r.query_id == 50) == list(enumerate([1, 2, 3, 4, 5, 6, 7, 7, 7], 1))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_recall_of_the_query(spark):
    path = DATA.replace("0.001", "0.1")
    got = queries.op6_nearest_neighbours(spark, path).collect()
    table = spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, v = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table], float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    hits = 0
    for n in np.flatnonzero(ids % 50 == 0):
        score = v @ v[n]
        score[n] = -9
        near = ids[np.argsort(-score)[:5]].tolist()
        mine = [r for r in got if r.query_id == ids[n]]
        hits += len({r.vec_id for r in mine} & set(near))
        assert sorted(r.rank for r in mine) == [1, 2, 3, 4, 5]
        assert all(abs(r.score - score[np.flatnonzero(ids == r.vec_id)[0]]) < 1e-12 for r in mine)
    assert hits / (5 * (ids % 50 == 0).sum()) >= 0.9


@pytest.mark.parametrize("shard", [50, 2048])
def test_many_shards_and_a_crowd_of_copies(spark, monkeypatch, shard):
    for name, value in (("SHARD", shard), ("NEAR", 2), ("LEAF", 4)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(4)
    crowd = [float(x) for x in rng.normal(size=16)]
    rows = [(k, crowd if k % 3 == 0 else [float(x) for x in rng.normal(size=16)]) for k in range(1, 900)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), sure=0.99999).collect()
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1)[:, None]
    for q in range(50, 900, 50):
        score = np.round(v @ v[q - 1], 12)
        score[q - 1] = -9
        want = sorted(range(len(rows)), key=lambda n: (-score[n], rows[n][0]))[:5]
        assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [rows[n][0] for n in want]


# --- op8, op5, op1 ---------------------------------------------------------------


def test_digests_that_share_words_part():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**63, (400, 4)).astype(np.uint64)
    words[100:200, :2] = words[:100, :2]
    words[200:300, :3] = words[:100, :3]
    words[300:, 0] = 5
    began = time.time()
    sizes, bits, slot = exact_dedup._levels(words)
    assert time.time() - began < 10 and sorted(slot) == list(range(400))
    assert (exact_dedup._slots(words, sizes, bits) == slot).all()


@pytest.mark.parametrize("bits", [64, 16, 6])
def test_repeats_do_not_rest_on_one_hash(spark, monkeypatch, bits):
    """Colliding hashes of strings at anchors change nothing: contexts and windows decide too."""
    cloudpickle.register_pickle_by_value(suffix_dedup)  # so that the workers get the cut too
    monkeypatch.setattr(suffix_dedup, "string_keys", lambda h: _shared.mixed(h) & np.uint64((1 << bits) - 1))
    rng = np.random.default_rng(bits)
    base = bytes(rng.integers(97, 123, 1500).astype(np.uint8)).decode()
    texts = ["".join(base[a : a + int(rng.integers(1, 500))] + bytes(rng.integers(97, 123, 90).astype(np.uint8)).decode() for a in rng.integers(0, 1200, 3)) for _ in range(30)]
    count = Counter(t[k : k + 200] for t in texts for k in range(len(t) - 199))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in suffix_dedup.repeated_bytes(docs).collect():
        t, cover = texts[r.doc_id], set()
        for k in range(len(t) - 199):
            cover |= set(range(k, k + 200)) if count[t[k : k + 200]] > 1 else set()
        assert (r.n_removed, r.n_bytes) == (len(cover), len(t))
    cloudpickle.unregister_pickle_by_value(suffix_dedup)


def test_counts_beyond_32_bits():
    keys, counts = np.array([3, 9], np.uint64), np.array([2**32 - 1, 7], np.uint32)
    import pyarrow as pa

    part = _shared.packed(_shared.delta(keys), counts)
    got = lm_scoring._merged(pa.table({"data": [part, part, part]}))
    assert got[0].tolist() == [3, 9] and got[1].tolist() == [3 * (2**32 - 1), 21]
    assert lm_scoring.log_kt(np.array([0]), np.array([2**40]))[0] == pytest.approx(math.lgamma(2**40 + 0.5) - math.lgamma(0.5) - math.lgamma(2**40 + 1), rel=1e-9)


def test_units_cut_common_contexts_only():
    rng = np.random.default_rng(3)
    body = b"".join(b"the " if rng.random() < 0.7 else bytes(rng.integers(97, 123, 5).astype(np.uint8)) for _ in range(8000))
    keys = np.unique(lm_scoring.gram_keys(body, np.array([0, len(body)]), 6))
    units = lm_scoring.Units(lm_scoring.gram_keys(body, np.array([0, len(body)]), 6), 40, 6)
    parts = list(units.parts(keys))
    assert 2 in units.split and sorted(np.concatenate([own for _, own in parts])) == list(range(len(keys)))
    assert len({b for b, _ in parts}) == len(parts) and all(40 <= b < units.first[-1] for b, _ in parts)
    for bucket, own in parts:
        d = units.unit(bucket)
        shared = lambda n: np.unique(keys[own] >> np.uint64(8 * (7 - n)))  # noqa: B023, E731
        assert all(np.isin(shared(n), units.split[n]).all() for n in range(2, d)) and not np.isin(shared(d), units.split.get(d, [])).any()


def test_slices_of_strings_agree(monkeypatch):
    body, offsets = b"one two three\nfour" * 9, np.array([0, 5, 5, 60, 162])
    whole = lm_scoring.gram_keys(body, offsets, 6)
    monkeypatch.setattr(lm_scoring, "SLICE", 7)
    assert (lm_scoring.gram_keys(body, offsets, 6) == whole).all() and len(whole) == len(body) + 4


# --- clashing and dotted names ---------------------------------------------------


def test_any_column_names(spark):
    odd = ["__size", "__key", "__slice", "__source", "__at", "__line", "__visits", "__mix", "__digest", "__winner", "__nth", "__score", "__text", "__id", "size", "key", "id", "digest", "a.b", "c0", "x`y", "mix"]
    rows = [(k, f"some text number {k % 7} of a few " * 3, f"s{k % 2}", *(99 + k for _ in odd)) for k in range(20)]
    schema = ", ".join(["doc_id long", "text string", "source string", *(f"`{c.replace('`', '``')}` long" for c in odd)])
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    given = set(rows)
    for make in (mixing.mixed_documents, exact_dedup.drop_exact_duplicates, simhash.drop_near_duplicates, shingles.drop_near_copies, lambda d: quality.keep_good(d, labels, threshold=0.1)):
        out = make(docs)
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all(tuple(r) in given for r in got)
    mixed = mixing.curriculum(docs)
    assert mixed.columns == [*docs.columns, "___mix"] and {tuple(r)[:-1] for r in mixed.collect()} == given
    assert exact_dedup.exact_duplicates(docs).count() == 20 and quality.document_quality(docs, labels).count() == 20


# --- op2, op3: plain forward passes ----------------------------------------------


def test_licence_probabilities_by_hand(spark):
    rng = np.random.default_rng(5)
    model = license_scan.LicenseModel()
    model.w, model.b, model.temperature = rng.normal(size=model.w.shape), rng.normal(size=model.b.shape), 1.7
    seen = {}
    for wording in (t for family in license_scan.TEMPLATES.values() for t in family):
        ws = wording.split()
        for n in (2, 3):
            for k in range(len(ws) - n + 1):
                seen[tuple(ws[k : k + n])] = None
    for gram in seen:  # a text of the gram alone has it and, of three words, its two pairs
        own = set(license_scan._text_grams(" ".join(gram)).tolist())
        for pair in (gram[:2], gram[1:]) if len(gram) == 3 else ():
            own -= set(license_scan._text_grams(" ".join(pair)).tolist())
        (seen[gram],) = (int(np.searchsorted(model.vocabulary, g)) for g in own)
    assert len(set(seen.values())) == len(model.vocabulary)
    lines = ["Released under the MIT License.", "It is not licensed under the terms of anything", "All rights reserved, all rights", "plain words only", "This work is licensed under a Creative Commons Attribution 4.0 International License"]
    body = "\n\n".join(lines).encode()
    grams, of, *_ = license_scan._grams(license_scan.plain(body), np.array([0, len(body)]), model.vocabulary)
    names, p = model.probabilities(grams, of)
    got = dict(zip(names.tolist(), p))
    for n, line in enumerate(lines):
        ws = re.findall("[a-z0-9]+", line.lower())
        hit = {tuple(ws[k : k + m]) for m in (2, 3) for k in range(len(ws) - m + 1)} & set(seen)
        assert (2 * n in got) == bool(hit)
        if hit:
            logits = (model.b + sum(model.w[seen[g]] for g in hit)) / model.temperature
            assert got[2 * n] == pytest.approx(np.exp(logits) / np.exp(logits).sum())


def plain_said(words):
    """Signed hashed sums of one passage's words and pairs."""
    out, fold, mask = np.zeros(quality.HASHED), 0x9E3779B97F4A7C15, 2**64 - 1
    one = lambda w: int(quality.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])
    terms = [one(w) * fold & mask for w in words]
    for a, b in zip(words, words[1:]):
        pair = (one(a) * fold + one(b)) * fold & mask
        terms.append(pair ^ pair >> 31)
    for t in terms:
        out[(t >> 32) % quality.HASHED] += -1.0 if t >> 63 else 1.0
    return out / math.sqrt(max(len(terms), 1))


def test_attention_by_hand():
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["Ab", "cd", "e.", "fgh", "$$", "x1"], n)) for n in (0, 1, 49, 50, 51, 260)]
    body, at = "".join(texts).encode(), np.cumsum([0, *map(len, texts)])
    raw = np.frombuffer(body, np.uint8)
    x, sizes = quality.passages(raw, at)
    assert sizes.tolist() == [max(1, -(-len(t.split()) // 50)) for t in texts]
    model = quality.AttentionModel()
    model.mean, model.scale = rng.normal(size=x.shape[1]) * 0.1, rng.uniform(0.5, 2, x.shape[1])
    got, first, p = model.score(x, sizes), 0, model.p
    for t, n, s in zip(texts, sizes, got):
        ws = [w.lower().encode() for w in t.split()]
        h, weight = [], []
        for k in range(n):
            row = x[first + k]
            assert row[-quality.HASHED :] == pytest.approx(plain_said(ws[50 * k : 50 * k + 50]))
            e = np.tanh((row - model.mean) / model.scale @ p["W"] + p["b"])
            h.append(e)
            weight.append(math.exp(sum(p["w"][i] * math.tanh(e @ p["V"][:, i]) / (1 + math.exp(-(e @ p["U"][:, i]))) for i in range(len(p["w"])))))
        z = sum(w * e for w, e in zip(weight, h)) / sum(weight)
        assert s == pytest.approx(1 / (1 + math.exp(-(z @ p["c"] + p["d"][0]))))
        first += n


def test_long_texts_in_pieces(monkeypatch):
    rng = np.random.default_rng(7)
    text = " ".join(rng.choice(["alpha", "be", "gamma\n", "d" * 70], 3000)).encode()
    raw, model = np.frombuffer(text, np.uint8), quality.AttentionModel()
    at = np.array([0, len(raw)])
    whole = model.score(*quality.passages(raw, at))
    monkeypatch.setattr(quality, "SLICE_BYTES", 2000)
    monkeypatch.setattr(quality.text_pieces, "__defaults__", (2000,))
    assert len(list(quality.text_pieces(raw))) > 10
    assert model.score_slice(raw, at) == pytest.approx(whole)
    words = [b"a" * 5000, b"bc", b"a" * 5000, b"a" * 4999]
    starts = np.cumsum([0, *(len(w) for w in words[:-1])])
    h = quality.word_hashes(np.frombuffer(b"".join(words), np.uint8), starts, starts + [len(w) for w in words])
    assert h[0] == h[2] and len(set(h.tolist())) == 3


# --- the SQL of this subpackage --------------------------------------------------


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    df = queries.QUERIES[name](spark, DATA)
    answer = con.execute(queries.SQL[name])
    names = [c[0] for c in answer.description]
    assert sorted(names) == sorted(df.columns)
    plain = lambda row: tuple(round(v, 5) if isinstance(v, float) else v for v in row)
    assert Counter(map(plain, df.select(*names).collect())) == Counter(map(plain, answer.fetchall()))


def test_shared_folder_is_asked_for_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                return Context

        class getCheckpointDir:
            @staticmethod
            def isDefined():
                return False

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError, match="checkpoint"):
        _shared.shared_folder(Session)


def test_plain_words_agree():
    assert plain_words("A b\x0bC\x1fd") == [b"a", b"b", b"c\x1fd"]
