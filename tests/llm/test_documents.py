"""Operators over the small corpus of conftest.py against plain versions of them."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from geoframe.llm import exact_dedup, license_scan, lm_scoring, mixing, packing, pii, quality, queries, simhash, suffix_dedup


def plain_words(text):
    return (text or "").encode().lower().split()


def test_exact_dedup(docs, rows, no_docs):
    got = exact_dedup.exact_duplicates(docs).collect()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    assert len(got) == len(rows)
    assert Counter((r.doc_id, by_sha[r.text_sha256]) for r in got) == Counter((i, t or "") for i, t, _ in rows)
    kept = Counter()
    for r in got:
        t = by_sha[r.text_sha256]
        assert (r.keep_id, r.group_size) == (best[t], len(groups[t]))
        kept[t] += r.kept
        assert not r.kept or r.doc_id == best[t]
    assert set(kept.values()) == {1}
    assert exact_dedup.exact_duplicates(no_docs).count() == 0
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    assert Counter(r.text or "" for r in left.collect()) == Counter(list(groups))


def test_minimal_perfect_hash():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    sizes, bits, slot = exact_dedup._levels(keys)
    assert sorted(slot) == list(range(len(keys)))
    assert (exact_dedup._slots(keys, sizes, bits) == slot).all()


def plain_fingerprint(text):
    w = plain_words(text)
    shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 3 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash(docs, rows, no_docs):
    got = simhash.near_duplicates(docs).collect()
    prints = [plain_fingerprint(t) for _, t, _ in rows]
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((i, f"{p:016x}") for (i, _, _), p in zip(rows, prints))
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (prints[a] ^ prints[b]).bit_count() <= 3 and label[b] > label[a]:
                    label[b], changed = label[a], True
    least = defaultdict(list)
    for k, (i, _, _) in enumerate(rows):
        least[label[k]] += [i] if i is not None else []
    want = Counter((f"{prints[k]:016x}", min(least[label[k]], default=None)) for k in range(len(rows)))
    assert Counter((r.fingerprint, r.component_id) for r in got) == want
    assert simhash.near_duplicates(no_docs).count() == 0
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {c for _, c in want}


@pytest.mark.parametrize("most", [4096, 3])
def test_simhash_links_lose_none(spark, most):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**64, 12, dtype=np.uint64)
    values = {int(s) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for s in seeds for _ in range(25)}
    values = sorted(values)
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    labels = {r.node: r.label for r in simhash.components(simhash.links(df, most=most)).collect()}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    own = [labels.get(s, s) for s in signed]
    for a in range(len(values)):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= 3:
                assert own[a] == own[b]
    assert len(set(own)) == 12


def test_mixing(docs, rows, no_docs):
    got = mixing.curriculum(docs).select("doc_id", "source", "__mix.*").collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(plain_words(t))
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(capped.values())) / sum(weight[s] for s in free)
        over = {s: 2.0 * sizes[s] for s in free if level * weight[s] >= 2 * sizes[s]}
        if not over:
            break
        capped |= over
    targets = capped | {s: level * weight[s] for s in free}
    taken = Counter()
    for r in got:
        assert (r.source_size, pytest.approx(r.target)) == (sizes[r.source], targets[r.source])
        assert r.taken <= 2 * r.size and r.taken == sum(v.words for v in r.visits)
        assert all(0 <= v.position < 1 for v in r.visits)
        taken[r.source] += r.taken
    assert all(taken[s] == math.floor(targets[s] + 1e-9) for s in order)
    assert len(got) == len(rows)
    assert mixing.curriculum(no_docs).count() == 0
    whole = mixing.mixed_documents(docs)
    assert whole.columns == docs.columns
    assert max(Counter((r.doc_id, r.text) for r in whole.collect()).values()) <= 4  # the repeated row twice each


def test_inverse_demand_inverts(spark):
    from pyspark.sql import functions as F

    for knots in mixing.SCHEDULES:
        got = spark.range(100).select((F.col("id") / 100).alias("u")).select("u", mixing.inverse_demand(knots, F.col("u")).alias("t")).collect()
        for r in got:
            grid = np.linspace(0, r.t, 2001)
            area = np.trapezoid(np.interp(grid, *zip(*knots)), grid)
            grid = np.linspace(0, 1, 2001)
            assert area / np.trapezoid(np.interp(grid, *zip(*knots)), grid) == pytest.approx(r.u, abs=1e-5)


def test_packing_round_trip(docs, rows, no_docs):
    from tokenizers import Tokenizer
    import public_tokenizers

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [np.array([*exact.encode(t or "", add_special_tokens=False).ids, 1], np.uint32) for _, t, _ in rows]
    got = packing.packed_pieces(docs).collect()
    want = defaultdict(list)
    for (i, _, _), x in zip(rows, ids):
        want[i, len(x)].append(x)
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id, r.doc_tokens].append(r)
    assert set(pieces) == set(want)
    for key, own in pieces.items():
        assert sum(r.length for r in own) == sum(map(len, want[key]))
        for r in own:
            assert any(zlib.crc32(x[r.start : r.start + r.length].astype("<u4").tobytes()) == r.ids_crc32 for x in want[key])
        if len(want[key]) == 1:
            at = 0
            for r in sorted(own, key=lambda r: r.start):
                assert r.start == at
                at += r.length
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0 and len(own) <= packing.SEGMENTS
    assert packing.packed_pieces(no_docs).count() == 0


def test_packing_limits(docs):
    got = packing.packed_pieces(docs, prompt_col="text", tokens=256, segments=3, loss_tokens=100).collect()
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
    for own in sequences.values():
        assert sum(r.length for r in own) <= 256 and len(own) <= 3 and sum(r.loss_tokens for r in own) <= 100
    assert sum(r.length for r in got) == sum({(r.doc_id, r.doc_tokens): r.doc_tokens for r in got if r.doc_id not in (None, 130)}.values()) + sum(r.length for r in got if r.doc_id in (None, 130))


def test_token_ids_agree_on_all_characters():
    from tokenizers import Tokenizer
    import public_tokenizers

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    points = [*range(0x250), *range(0x250, 0x30000, 7)]
    texts = ["".join(f"a{chr(c)} 1{chr(c)}{chr(c)}  " for c in points[k : k + 64] if not 0xD800 <= c < 0xE000) for k in range(0, len(points), 64)]
    texts += ["x<|endoftext|> y", "I'll don't 'S \r\n\n  z", " " * 3000]
    for t in texts:
        assert packing.token_ids(t, "byte_bpe_50k").tolist() == exact.encode(t, add_special_tokens=False).ids


def test_suffix_dedup(docs, rows, no_docs, monkeypatch):
    got = suffix_dedup.repeated_bytes(docs, length=40)
    texts = [(t or "").encode() for _, t, _ in rows]
    count = Counter(b[k : k + 40] for b in texts for k in range(len(b) - 39))
    want = Counter()
    for (i, _, _), b in zip(rows, texts):
        cover = np.zeros(len(b) + 2, bool)
        for k in range(len(b) - 39):
            if count[b[k : k + 40]] > 1:
                cover[k + 1 : k + 41] = True
        spans = int((np.diff(cover.astype(int)) == 1).sum())
        kept = bytes(x for x, c in zip(b, cover[1:-1]) if not c)
        want[i, len(b), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    assert Counter(map(tuple, got.collect())) == want
    assert suffix_dedup.repeated_bytes(no_docs).count() == 0


def test_suffix_slices_agree():
    rng = np.random.default_rng(5)
    body = bytes(rng.integers(97, 99, 6000).astype(np.uint8)) + b"ab" * 900
    offsets = np.array([0, 10, 10, 2500, len(body)])
    whole = [(s.tolist(), w.tolist(), k(s).tolist()) for s, w, _, k in suffix_dedup.anchored(body, offsets, 60)]
    keys = np.concatenate([x for _, _, x, _ in suffix_dedup.anchored(body, offsets, 60)], axis=1)
    old, suffix_dedup.SLICE = suffix_dedup.SLICE, 701
    try:
        cut = [(s.tolist(), w.tolist(), k(s).tolist()) for s, w, _, k in suffix_dedup.anchored(body, offsets, 60)]
        keys_cut = np.concatenate([x for _, _, x, _ in suffix_dedup.anchored(body, offsets, 60)], axis=1)
    finally:
        suffix_dedup.SLICE = old
    for k in range(3):
        assert sum((x[k] for x in whole), []) == sum((x[k] for x in cut), [])
    assert (keys == keys_cut).all()


def kt(n0, n1):
    return math.exp(math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(n0 + n1 + 1))


def plain_tree(samples, depth):
    """samples: (context nearest first, byte). Node: (context, bits so far) -> counts, by definition."""
    nodes = defaultdict(lambda: [0, 0])
    for context, byte in samples:
        for d in range(depth + 1):
            for j in range(8):
                nodes[context[:d], (1 << j) | (byte >> (8 - j))][byte >> (7 - j) & 1] += 1
    kids = defaultdict(set)
    for context, prefix in nodes:
        if context:
            kids[context[:-1], prefix].add(context)

    def pw(context, prefix):
        own = kt(*nodes.get((context, prefix), (0, 0)))
        if len(context) == depth:
            return own
        return 0.5 * own + 0.5 * math.prod(pw(c, prefix) for c in kids[context, prefix])

    def predict(context, prefix, d=0):
        n0, n1 = nodes.get((context[:d], prefix), (0, 0))
        own = (n1 + 0.5) / (n0 + n1 + 1)
        if d == depth:
            return own
        w = 0.5 * kt(n0, n1) / pw(context[:d], prefix)
        return w * own + (1 - w) * predict(context, prefix, d + 1)

    def log_byte(context, byte):
        total = 0.0
        for j in range(8):
            p = predict(context, (1 << j) | (byte >> (8 - j)))
            total += math.log(p if byte >> (7 - j) & 1 else 1 - p)
        return total

    return log_byte


@pytest.mark.parametrize("depth, split", [(3, False), (6, False), (6, True)])
def test_context_tree_scores(spark, no_docs, monkeypatch, depth, split):
    if split:  # contexts that the tree splits, whatever their number
        init = lm_scoring.Units.__init__

        def all_split(self, sample, buckets, depth):
            init(self, sample[:0], buckets, depth)
            keys = np.unique(sample)
            at = lambda d: np.unique(keys >> np.uint64(8 * (depth + 1 - d)))
            self.split = {d: at(d)[:: d - 1] for d in (2, 3, 4)}
            self.bounds = {d: at(d)[3::5] for d in (2, 3, 4, 5)}
            self.first = np.cumsum([buckets, *(len(x) + 1 for x in self.bounds.values())]).tolist()

        monkeypatch.setattr(lm_scoring.Units, "__init__", all_split)
    texts = [(k, t) for k, t in enumerate(["abab abc", "Abab", "", None, " ab \n\tab\n", "zé ab", "cab cab ca", "b", "abab abc", "baba"])]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    got = {r.doc_id: r for r in lm_scoring.text_scores(docs, depth=depth).collect()}

    def samples(text):
        b = [255] * depth + list((text or "").lower().encode()) + [255]
        return [(tuple(reversed(b[k - depth : k])), b[k]) for k in range(depth, len(b))]

    training = [(i, t) for i, t in texts if zlib.crc32(str(i).encode()) % 5 != 1]
    assert 0 < len(training) < len(texts)
    log_byte = plain_tree([s for _, t in training for s in samples(t)], depth)
    counts = Counter(w for _, t in training for w in [*plain_words(t), None])
    n, v = sum(counts.values()), len(counts)
    for i, t in texts:
        r, tokens = got[i], [*plain_words(t), None]
        assert r.score == pytest.approx(sum(log_byte(*s) for s in samples(t)) / math.log(10), rel=1e-12)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1)
    assert lm_scoring.text_scores(no_docs).count() == 0


def test_context_tree_is_a_distribution():
    rng = np.random.default_rng(2)
    body = bytes(rng.integers(97, 101, 400).astype(np.uint8))
    keys, counts = np.unique(lm_scoring.gram_keys(body, np.array([0, 400]), 4), return_counts=True)
    context = keys[17] & ~np.uint64(255)
    every = np.unique(np.concatenate([keys, context | np.arange(256, dtype=np.uint64)]))
    n = np.zeros(len(every), np.int64)
    n[np.searchsorted(every, keys)] = counts
    tree = lm_scoring.ContextTree(every, n, 4)
    p = np.exp(tree.log_probability(every, lm_scoring.TopLevels(*tree.top())))
    assert p[(every & ~np.uint64(255)) == context].sum() == pytest.approx(1.0)


def test_scores_of_the_corpus(docs, rows):
    got = lm_scoring.text_scores(docs).collect()
    assert len(got) == len(rows) and all(r.score < 0 for r in got)


def plain_spans(x):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in pii.EMAIL.finditer(x)]
    out += [(m.start(), 1, m.end()) for m in pii.IP.finditer(x) if all(int(v) <= 255 for v in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in pii.CARD.finditer(x) if 14 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    return sorted(out + [(m.start(), 3, m.end()) for m in pii.PHONE.finditer(x) if 10 <= len(digits(m.group())) <= 15])


def test_personal_data(docs, rows, no_docs):
    got = pii.personal_data(docs).collect()
    want = Counter((i, *(sum(k == n for _, k, _ in plain_spans(t or "")) for n in range(4)), hashlib.sha256(pii.shown(plain_spans(t or "")).encode()).hexdigest()) for i, t, _ in rows)
    assert Counter(tuple(r)[:6] for r in got) == want
    for r in got:
        base = [x for x in r.spans.split(",") if x]
        assert len(base) == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_added
    assert pii.personal_data(no_docs).count() == 0


def test_field_learns_and_decodes():
    texts = [f"call +1 ({300 + k}) 555-{1000 + k}" for k in range(20)] + [f"x{k}@mail.example.com" for k in range(20)] + [f"Version {k}.0." for k in range(20)] + [f"10.0.{k}.7" for k in range(20)]
    data = []
    for t in texts:
        for _, s in pii.regions(t):
            for v, spans in pii._variants(s, pii.base_spans(s)):
                region = pii.Region(v)
                data.append((region, pii._gold(region, spans)))
    field = pii.Field().fit(data)
    assert field.decode("(987) 555-4321") == [(0, 3, 14)]
    assert field.decode("Version 9.0.") == []
    assert field.decode("a1" * 4000) == []


def test_field_gradient_is_exact():
    region = pii.Region("a 12@b.c 3")
    gold = {region.spans[3]: 1}
    field = pii.Field()
    field.w = np.random.default_rng(1).normal(size=field.w.shape) * 0.2

    def likelihood(w):
        field.w = w
        scores, forward = region.x @ w, [0.0] + [-np.inf] * region.n
        for j in range(1, region.n + 1):
            forward[j] = np.logaddexp.reduce([forward[j - 1], *(forward[i] + s for (i, e), row in zip(region.spans, scores) if e == j for s in row)])
        return sum(scores[region.spans.index(s), k] for s, k in gold.items()) - forward[-1]

    w, eps = field.w.copy(), 1e-6
    exact = field.gradient(region, gold)
    for f, k in [(0, 0), (1, 1), (6, 2), (0, 3)]:
        up, down = w.copy(), w.copy()
        up[f, k] += eps
        down[f, k] -= eps
        assert exact[f, k] == pytest.approx((likelihood(up) - likelihood(down)) / 2 / eps, abs=1e-5)


def test_quality(spark, docs, rows, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.document_quality(docs, none).collect()
    assert len(got) == len(rows) and {r.score for r in got} == {0.5}
    assert quality.document_quality(no_docs, none).count() == 0


def test_quality_on_held_out_documents(spark):
    rng = np.random.default_rng(8)
    syllables = ["ba", "ke", "lo", "mi", "nu"]
    some = lambda n: " ".join("".join(rng.choice(syllables, 2)) for _ in range(n))
    made = []
    for k in range(300):
        good = k % 2
        junk = "" if good else " ".join(w + "$$$" for w in some(40).split())
        made.append((k, f"{some(60)} {junk}\n{some(60)}", good))
    docs = spark.createDataFrame([(i, t) for i, t, _ in made], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in made] + [(7, None), (9, 5)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.document_quality(docs, labels).collect()}
    held = [(q, got[i].predicted) for i, _, q in made if got[i].held_out]
    assert held and sum(a == b for a, b in held) / len(held) > 0.95
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_attention_gradient_learns_one_bad_passage():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 6, 200)
    x, y = rng.normal(size=(sizes.sum(), quality.FEATURES)), np.ones(200)
    for k, end in enumerate(np.cumsum(sizes)):
        if k % 2:
            x[end - 1, 0] += 8
            y[k] = 0
    model = quality.AttentionModel().fit(x, sizes, y)
    assert ((model.score(x, sizes) > 0.5) == (y > 0)).mean() > 0.97


def test_licenses(spark, no_docs):
    lines = {1: "Some words here.\nReleased under the MIT License.", 2: "nothing at all", 3: "This work is licensed under the GNU General Public License, version 3.", 4: None, 5: "", 6: "All rights reserved.", 7: "x\n\ny licensed under CC BY-NC 4.0."}
    docs = spark.createDataFrame(list(lines.items()) + [(None, "Released under the MIT License.")], "doc_id long, text string")
    got = {r.doc_id: (r.family, r.paragraphs) for r in license_scan.document_licenses(docs).collect()}
    assert got == {1: ("mit", "1:mit"), 2: (None, ""), 3: ("gpl", "0:gpl"), 4: (None, ""), 5: (None, ""), 6: ("unknown", "0:unknown"), 7: ("cc-by-nc", "2:cc-by-nc"), None: ("mit", "0:mit")}
    assert license_scan.document_licenses(no_docs).count() == 0


def test_wrapped_licenses(spark):
    gpl = "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n    the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version."
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal"
    narrow = " * Redistribution and use\n * in source and\n * binary forms,\n * with or without\n * modification, are permitted"
    texts = {1: gpl, 2: mit, 3: f"One line.\n{narrow}\nand more", 4: "Released under the MIT License.\nLicensed under CC BY 4.0.", 5: mit.replace("\nof", "\n\nof")}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(1)
    got = {r.doc_id: (r.family, r.paragraphs) for r in license_scan.document_licenses(docs).collect()}
    assert (got[1], got[2], got[3]) == (("gpl", "1:gpl"), ("mit", "0:mit"), ("bsd", "1:bsd"))
    assert got[4][1] == "0:mit,1:cc-by" and got[5][0] == "unknown"


def test_taught_spellings_through_personal_data(spark):
    names = ["anna", "ben.ody", "carl", "dora.lee", "emil", "fay.wu"]
    seen = [f"Write to {n}@{h}.example.{e} soon, or call +1 ({200 + k}) 555-{1000 + 7 * k} at {k}." for k, (n, h, e) in enumerate((n, h, e) for n in names for h in ("mail", "post", "web") for e in ("com", "org"))]
    spelled = {"john.smith @ example.com": "email", "john.smith  @  example.com": "email", "(654) 555-7485": "phone", "(654)  555-7485": "phone"}
    texts = dict(enumerate([*seen, *(f"Please ask {s} about it" for s in spelled), "we met @ noon again"]))
    got = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for k, (s, kind) in enumerate(spelled.items(), len(seen)):
        assert got[k] == f"{kind}:11:{11 + len(s)}"
    assert got[len(texts) - 1] == ""


def test_layout_is_scored(spark, tmp_path):
    texts = ["ab cd", "ab\ncd", "ab  cd", " ab cd\n", "\n" * 50, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op1_context_tree_scores(spark, str(tmp_path)).collect()}
    assert [got[k].scored_bytes for k in range(6)] == [len(t) for t in texts]
    assert len({got[k].score for k in range(6)}) == 6
