"""The pipeline over a small corpus against a plain version of every stage."""

import hashlib
import math
from collections import Counter, defaultdict

import corpus_pipeline
from geoframe.llm import packing, quality
from tests.llm.test_documents import plain_fingerprint, plain_words


def plain_shingles(text):
    w = plain_words(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def plain_pipeline(rows, good):
    """(doc_id, text, source) rows -> how often each doc_id is in the result."""
    rows = [r for r in rows if r[0] in good]
    last = {}
    for i, t, s in rows:
        if t not in last or i > last[t][0]:
            last[t] = (i, t, s)
    rows = list(last.values())
    prints, label = [plain_fingerprint(t) for _, t, _ in rows], list(range(len(rows)))
    shingles = [plain_shingles(t) for _, t, _ in rows]
    linked = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3 or len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]) > 0
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(len(rows)):
                if label[b] > label[a] and linked(a, b):
                    label[b], changed = label[a], True
    least = defaultdict(list)
    for k, (i, _, _) in enumerate(rows):
        least[label[k]].append(i)
    stay = {min(ids) for ids in least.values()}
    rows = [r for r in rows if r[0] in stay]
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(plain_words(t))
    order = sorted(sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(capped.values())) / sum(weight[s] for s in free)
        over = {s: 2.0 * sizes[s] for s in free if level * weight[s] >= 2 * sizes[s]}
        if not over:
            break
        capped |= over
    target = capped | {s: level * weight[s] for s in free}
    at, out = Counter(), Counter()
    for i, t, s in sorted(rows, key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()):
        n = len(plain_words(t))
        for turn in range(2):
            words = min(n, math.floor(target[s]) - turn * sizes[s] - at[s])
            out[i] += words > 0 and 2 * words >= n
        at[s] += n
    return Counter({i: n for i, n in out.items() if n})


def test_pipeline(spark, rows, tmp_path):
    known = [(i, t, s) for i, t, s in rows if i is not None and s is not None]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in known], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i, _, _ in known], "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    scored = quality.document_quality(docs, labels)
    good = {r.doc_id for r in scored.filter("predicted = 1").collect()}
    want = plain_pipeline([(i, t or "", s) for i, t, s in known], good)
    tokens = {i: len(packing.token_ids(t or "", "byte_bpe_50k")) + 1 for i, t, _ in known}
    got = Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        assert r.doc_tokens == tokens[r.doc_id]
        got[r.doc_id] += r.length
    assert want and got == Counter({i: n * tokens[i] for i, n in want.items()})


def test_stages_keep_columns_and_empty_tables(spark, no_docs, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = no_docs.select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == corpus_pipeline.COLUMNS and out.count() == 0
