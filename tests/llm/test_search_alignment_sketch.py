"""Lexical search, tokenizer alignment and odd-sketch near-duplicates against plain versions of their rules."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from geoframe.llm import alignment, lexical, odd_sketch
from tests.llm.test_documents import plain_words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEM_SCHEMA = "item_id long, text string, row long, batch long, rank int, score long"


def as_rows(df):
    return Counter(map(tuple, df.collect()))


# --- lexical search ----------------------------------------------------------------


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain_ranking(docs, items, top=20):
    """(item, rank, score) with the documents of each score, for rows of (id, text)."""
    terms = [(i, Counter(plain_terms(t))) for i, t in docs]
    terms = [(i, c) for i, c in terms if c]
    n_docs, total, df = len(terms), sum(c.total() for _, c in terms), Counter(t for _, c in terms for t in c)
    out = Counter()
    for item, text in items:
        asked, scored = Counter(plain_terms(text)), []
        for i, c in terms:
            m = 100 - 25 + (25 * c.total() * n_docs) // total
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, k in asked.items() if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        for rank, (score, none, i) in enumerate(sorted(scored)[:top], 1):
            out[item, rank, None if none else i, -score] += 1
    return out


def items_of(rows):
    texts = [t for _, t, _ in rows if t]
    return [(1, "the Ba ke, lo-mi! ré"), (2, texts[3]), (3, None), (4, "?!"), (5, "unknownword"), (6, texts[5] + " " + texts[6]), (7, "twice TWICE the same row here"), (7, "st st st"), (None, "ké kéke ba")]


def test_ranking(spark, docs, rows):
    items = items_of(rows)
    frame = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in items], ITEM_SCHEMA)
    got = lexical.ranked_documents(docs, frame)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert as_rows(got) == plain_ranking([(i, t) for i, t, _ in rows], items)


def test_small_shards_blocks_and_batches_give_the_same(spark, docs, rows):
    items = items_of(rows)
    batches = list(lexical.item_batches(lexical.parsed_items(spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in items], ITEM_SCHEMA), "item_id", "text"), 8))
    assert len(batches) > 2 and sum(map(len, batches)) == 7
    assert all(sum(len(t) for _, t in b) <= 8 or len(b) == 1 for b in batches)


def test_blocks_are_skipped_only_below_the_ranked(rows):
    rng = random.Random(9)
    topics = [[f"t{k}x{j}" for j in range(30)] for k in range(40)]
    docs = [Counter(rng.choices(topics[k % 40], k=40) + ["common"] * (k % 2)) for k in range(4000)]
    asked = lexical.Asked([(0, {w.encode(): 1 for w in topics[3][:8]} | {b"common": 9}), (1, {w.encode(): 1 for w in topics[7][:9]} | {b"common": 9})])
    place = {t.decode(): k for k, t in enumerate(asked.vocabulary)}
    tf = np.zeros((len(docs), len(place)), np.int64)
    for k, c in enumerate(docs):
        for t, n in c.items():
            if t in place:
                tf[k, place[t]] = n
    asked.weigh(len(docs), 42 * len(docs), (tf > 0).sum(axis=0))
    dense = lexical.impacts(tf, np.int64(100)).astype(np.uint32)
    ids = pa.array(range(len(docs)), pa.int64())
    built = lexical.Shard.build(ids, dense, asked)
    shard = lexical.Shard.unpack(ids, built.pack(), asked)
    assert all((x == y).all() for x, y in zip(built.summaries, shard.summaries))
    for k in range(2):
        best = lexical.Best(np.ones(2, np.int64), 20)
        bounds, _ = shard.bounds(asked, k)
        assert shard.search(asked, k, best) < len(bounds)
        scores = dense[:, asked.terms[k]].astype(np.int64) @ asked.vectors[k]
        want = sorted(zip(-scores, range(len(docs))))[:20]
        assert [(-s, i) for s, i in zip(best.scores[k], best.ids[k])] == want


def test_ranking_of_nothing(spark, docs, no_docs):
    items = spark.createDataFrame([(1, "ba ke", 1, 2, 3, 4)], ITEM_SCHEMA)
    assert lexical.ranked_documents(no_docs, items).collect() == []
    assert lexical.ranked_documents(docs, items.filter("item_id < 0")).collect() == []


def test_a_long_text_is_counted_in_pieces(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE_BYTES", 7)
    text = "One two-three,ONE 4four é five " * 20
    assert {k.decode(): v for k, v in lexical.term_counts(text.encode()).items()} == Counter(plain_terms(text))


# --- tokenizer alignment ---------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    marks = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the byte-level alphabet: printable bytes stand for themselves, the rest follow from 256
    letters = {b: chr(b) for b in marks} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in marks)}
    back = {c: b for b, c in letters.items()}
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def encode(text):
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
        return [(i, bytes(back[c] for c in a.id_to_token(i))) for i in ids_a], [(i, piece(i)) for i in ids_b]

    return encode


def plain_groups(encode, text):
    if not text:
        return []
    a, b = encode(text)
    want = (" " + text).encode()
    if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
        return []
    ends = lambda tokens: np.cumsum([len(x) for _, x in tokens]).tolist()
    common = sorted(set(ends(a)) & set(ends(b)))
    of = lambda tokens: [[i for (i, _), e in zip(tokens, ends(tokens)) if low < e <= high] for low, high in zip([0, *common], common)]
    return list(zip(of(a), of(b)))


def plain_alignment(encode, docs):
    all_groups = [(i, plain_groups(encode, t)) for i, t in docs]
    links = [[(x, y) for a, b in g for x in a for y in b] for _, g in all_groups]
    counts, highest = Counter(p for own in links for p in set(own)), defaultdict(int)
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    out = Counter()
    for (i, g), own in zip(all_groups, links):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        sha = hashlib.sha256(text.encode()).hexdigest() if g else ""
        out[i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(own), sum(counts[p] == highest[p[0]] for p in own), sum(counts[p] for p in own), sha] += 1
    return out


ODD_TEXTS = [
    "  two  blanks ", "tabs\tand\nlines\r\n here", "a▁b is changed", "<s> </s> <|endoftext|> <unk> <0x41>", "日本語 テキスト 🙂🙂 emoji", "naïve ﬁ ½ ①", "x", " ", "\n", "a" * 3000, "é " * 50,
    " no-break  blank", "\x1c sep \x1c", "don't it's  ' s", "12345 678,90.1", "é ́combining", "　wide blank", "\x00nul \x7f",
]


def test_alignment(spark, docs, rows, tokenizers):
    more = [(1000 + k, t) for k, t in enumerate(ODD_TEXTS)] + [(1001, "x"), (None, "two null ids"), (None, "two null ids")]
    both = docs.select("doc_id", "text", "bucket", "block").unionByName(spark.createDataFrame([(i, t, 1, 2) for i, t in more], "doc_id long, text string, bucket int, block int"))
    got = alignment.aligned_documents(both)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert as_rows(got) == plain_alignment(tokenizers, [(i, t) for i, t, _ in rows] + more)


def test_alignment_in_small_blocks_and_trees(spark, docs, monkeypatch):
    want = as_rows(alignment.aligned_documents(docs))
    cut = alignment.token_blocks
    monkeypatch.setattr(alignment, "token_blocks", lambda *a: cut(*a, block_bytes=300))
    monkeypatch.setattr(alignment, "FAN", 3)
    monkeypatch.setattr(alignment, "BLOCKS_A_PART", 4)
    assert as_rows(alignment.aligned_documents(docs)) == want


def test_pair_counts(spark, docs, rows, tokenizers):
    want = Counter(p for _, t, _ in rows for p in {(x, y) for a, b in plain_groups(tokenizers, t) for x in a for y in b})
    assert {(r.a, r.b): r.n_docs for r in alignment.corpus_pairs(docs).collect()} == want


def test_alignment_of_nothing(spark, no_docs):
    assert alignment.aligned_documents(no_docs).collect() == []
    only = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert as_rows(alignment.aligned_documents(only)) == Counter({(1, 0, 0, 0, 0, 0, 0, ""): 1, (2, 0, 0, 0, 0, 0, 0, ""): 1})


def test_long_texts_may_be_cut_at_single_blanks(tokenizers, monkeypatch):
    m, rng = alignment.models(), random.Random(2)
    alignment.check_models(m)
    monkeypatch.setattr(alignment, "PIECE", 3)
    for _ in range(300):
        text = "".join(rng.choice(["a", "Be", " ", " ", "  ", "\n", "é", "'s", "7", ".", "▂", " ", "the", "ing"]) for _ in range(rng.randint(1, 40)))
        a, b, n_a, n_b = alignment.encoded([text], m)
        want = tokenizers(text)
        assert a.tolist() == [i for i, _ in want[0]] and b.tolist() == [i for i, _ in want[1]] and (n_a[0], n_b[0]) == (len(a), len(b))


def test_slices_and_large_groups_give_the_same(monkeypatch):
    m = alignment.models()
    texts = ["a" * 3000, "é " * 200, "some plain words and more of them " * 20, "", "7" * 500 + " x"]
    parts = alignment.encoded(texts, m)
    import zstandard

    row = {"ids": [1, 2, 3, 4, None], "sizes": alignment.packed(parts[2], parts[3]), "tokens": zstandard.ZstdCompressor().compress(parts[0].tobytes() + parts[1].tobytes())}
    whole = alignment.Aligned(row, m)
    want, digests = [x.tolist() for x in whole.pairs()], whole.digests()
    for name, value in (("SLICE", 7), ("LARGE", 0)):
        monkeypatch.setattr(alignment, name, value)
        assert [x.tolist() for x in whole.pairs()] == want and whole.digests() == digests


# --- odd sketches ------------------------------------------------------------------------


def plain_set(text):
    w = plain_words(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def plain_near(docs):
    """(id, set size, component, kept) of rows of (id, text)."""
    sets = [plain_set(t) for _, t in docs]
    top = list(range(len(docs)))

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for x in range(len(docs)):
        for y in range(x):
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 85 * len(sets[x] | sets[y]):
                top[find(x)] = find(y)
    members = defaultdict(list)
    for k, (i, _) in enumerate(docs):
        members[find(k)].append(i)
    least = {k: min((i for i in m if i is not None), default=None) for k, m in members.items()}
    return Counter((i, len(sets[k]), least[find(k)], i == least[find(k)]) for k, (i, _) in enumerate(docs))


def test_near_copies(spark, docs, rows):
    got = odd_sketch.near_duplicates(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert as_rows(got) == plain_near([(i, t) for i, t, _ in rows])


def crowd(rng, n, words, most):
    """Copies of one text with up to `most` words changed, each in its own way."""
    base = [f"w{rng.randrange(3000)}" for _ in range(words)]
    for _ in range(n):
        own = list(base)
        for k in rng.sample(range(words), rng.randint(0, most)):
            own[k] = f"n{rng.randrange(10**6)}"
        yield " ".join(own)


@pytest.mark.parametrize("chunk", [512, 16])
def test_crowds_about_the_threshold(spark, monkeypatch, chunk):
    rng = random.Random(chunk)
    texts = [*crowd(rng, 120, 150, 12), *crowd(rng, 60, 40, 2), *crowd(rng, 40, 400, 30)]
    docs = [(k + 1, t) for k, t in enumerate(texts)]
    monkeypatch.setattr(odd_sketch, "CHUNK", chunk)
    got = odd_sketch.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    want = plain_near(docs)
    assert len({c for _, _, c, _ in want}) > 20
    assert as_rows(got) == want


def test_sketches_estimate_high_similarities():
    rng = np.random.default_rng(5)
    for similarity in (0.95, 0.85, 0.7):
        n = 400
        shared = round(2 * n * similarity / (1 + similarity))
        off = []
        for _ in range(30):
            both = rng.integers(0, 2**64, 2 * n - shared, np.uint64)
            pair = np.concatenate([both[:n], both[n - shared :]])
            x, y = odd_sketch.odd_sketches(odd_sketch.samples(pair, np.array([n, n])))
            off.append(int(np.bitwise_count(x ^ y).sum()) - odd_sketch.differing_bits(similarity))
        assert abs(np.mean(off)) < 6


def test_no_near_copies_of_nothing(spark, no_docs):
    assert odd_sketch.near_duplicates(no_docs).collect() == []
