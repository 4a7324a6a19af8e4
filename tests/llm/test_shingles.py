"""The pipeline's near-copy stage on planted edits."""

import random
from collections import Counter

import numpy as np

import corpus_pipeline
from geoframe.llm import _shared, odd_sketch, shingles, simhash
from tests.llm.test_documents import plain_fingerprint, plain_words


def plain_set(text):
    w = plain_words(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def jaccard(a, b):
    x, y = plain_set(a), plain_set(b)
    return len(x & y) / len(x | y)


def edited(rng, text, changes):
    w = text.split()
    for k in rng.sample(range(len(w)), changes):
        w[k] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def planted(rng, pairs):
    """(text, copy) of some lengths; copies of similarity 0.8 to 1 and, of as many texts, below 0.7 and not near by SimHash."""
    near, far = [], []
    while min(len(near), len(far)) < pairs:
        n = rng.choice([25, 60, 120, 300, 1000])
        text = " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
        copy = edited(rng, text, rng.randint(1, max(1, n // 20)))
        j = jaccard(text, copy)
        if j >= 0.8 and len(near) < pairs:
            near.append((text, copy))
        elif j < 0.7 and len(far) < pairs and (plain_fingerprint(text) ^ plain_fingerprint(copy)).bit_count() > 3:
            far.append((text, copy))
    return near, far


def test_near_copies_at_the_required_similarity(spark):
    near, far = planted(random.Random(3), 100)
    rows = [(2 * k + side, t, "en", "s", len(t)) for k, pair in enumerate(near + far) for side, t in enumerate(pair)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    left = Counter(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect())
    assert set(left.values()) == {1}
    assert sum(2 * k + 1 in left for k in range(100)) <= 1
    assert all(2 * k in left for k in range(200)) and all(2 * k + 1 in left for k in range(100, 200))


def test_a_large_group_is_one(spark):
    rng = random.Random(5)
    base = " ".join(f"w{rng.randrange(5000)}" for _ in range(200))
    rows = [(k, edited(rng, base, 1), "en", "s", 1) for k in range(1, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert [r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()] == [1]


def test_shingles_stay_in_their_text():
    texts = ["a b c d e f g", "", "a b", "b c d e f", "a  b", "h"]
    body, at = "".join(texts).encode(), np.cumsum([0, *map(len, texts)])
    hashes, sizes = shingles.shingles(np.frombuffer(body, np.uint8), at)
    assert sizes.tolist() == [3, 0, 1, 1, 1, 1]
    assert hashes[1] == hashes[4] and hashes[3] == hashes[5] and len(set(hashes.tolist())) == 5


def test_no_partner_of_a_band_is_passed_over(spark):
    """each text met the next three of a band only, so that a pair in a crowd of unlike texts that share its bands was lost."""
    rng, texts = random.Random(11), []
    for words, most, n in ((150, 12, 120), (400, 30, 60), (60, 4, 60)):
        base = " ".join(f"w{rng.randrange(3000)}" for _ in range(words))
        texts += [edited(rng, base, rng.randint(1, most)) for _ in range(n)]
    sets, prints, label = [plain_set(t) for t in texts], [plain_fingerprint(t) for t in texts], list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if label[a] != label[b] and (10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) or (prints[a] ^ prints[b]).bit_count() <= 3):
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert 20 < len(set(label)) < len(texts) - 20
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == sorted(set(label))


def shuffled_bytes(spark, first=0):
    """Bytes of shuffle written by the stages from number `first` on, and the next stage's number."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    gateway = context._gateway
    stages = context._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    found = [stages.apply(k) for k in range(stages.size())]
    return sum(s.shuffleWriteBytes() for s in found if s.stageId() >= first), max((s.stageId() for s in found), default=-1) + 1


def near_of(spark, docs):
    return sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in shingles.drop_near_copies(docs).collect())


def test_texts_are_not_shuffled_to_be_looked_up(spark, monkeypatch):
    """The check's disk: all texts were dealt by id three times, to fetch the few that have a candidate and to drop the few that are copies."""
    rng = random.Random(17)
    texts = [" ".join(f"{rng.getrandbits(60):x}" for _ in range(1500)) for _ in range(150)]
    rows = list(enumerate([*texts, edited(rng, texts[3], 20), edited(rng, texts[7], 20)])) + [(None, texts[9] + " end"), (4, "the id of another row")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).checkpoint()
    _, first = shuffled_bytes(spark)
    left = near_of(spark, docs)
    assert shuffled_bytes(spark, first)[0] < 0.5 * sum(len(t) for t in texts)
    assert left == sorted((k is None, k or 0, t) for k, t in rows if k not in (150, 151, None))
    monkeypatch.setattr(_shared, "FILTER_WORDS", 1)  # a full filter lets all ids pass: the exact joins after it decide
    assert near_of(spark, docs) == left


def test_a_filter_loses_no_id(spark):
    ids = spark.range(0, 20_000, 7).union(spark.sql("SELECT CAST(NULL AS LONG)"))
    bloom, rows = _shared.id_filter(ids), spark.range(20_000).union(spark.sql("SELECT CAST(NULL AS LONG)"))
    passed = {r.id for r in _shared.perhaps(rows, "id", bloom).collect()}
    assert passed >= {None, *range(0, 20_000, 7)} and len(passed) < 1.05 * 2859
    assert {r.id for r in _shared.perhaps(rows, "id", bloom, "left_anti").collect()} == {None, *range(20_000)} - passed


def steps_run(spark, first=0):
    """Stages that ran from number `first` on, and the next stage's number."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    gateway = context._gateway
    stages = context._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    found = [stages.apply(k) for k in range(stages.size())]
    return sum(s.stageId() >= first and s.numCompleteTasks() > 0 for s in found), max((s.stageId() for s in found), default=-1) + 1


def test_a_round_of_components_is_few_steps(spark):
    """The check's driver memory: a round of stars took nine shuffles, with as many tasks each as a shuffle has, which the driver keeps account of."""
    rows = [(k, k + 1) for k in range(9)] + [(50, 40), (40, 45), (60, 60)]
    links = spark.createDataFrame(rows, "a long, b long").checkpoint()
    _, first = steps_run(spark)
    labels = {r.node: r.label for r in simhash.components(links).collect()}
    steps = steps_run(spark, first)[0]
    assert labels == {**{k: 0 for k in range(1, 10)}, 45: 40, 50: 40}
    assert steps < 45, steps


def test_asked_sets_come_with_all_columns(spark, monkeypatch):
    """The step that compares what the first round left joined sets to their labels, sketches and bands twice."""
    rng = random.Random(23)
    bases = [" ".join(f"w{rng.randrange(3000)}" for _ in range(150)) for _ in range(12)]
    texts = [edited(rng, base, rng.randint(1, 12)) for base in bases for _ in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).checkpoint()
    _, first = steps_run(spark)
    left = near_of(spark, docs)
    steps = steps_run(spark, first)[0]
    monkeypatch.setattr(odd_sketch, "CHUNK", 3)  # a band in pairs of chunks, each with its own numbers
    assert near_of(spark, docs) == left
    assert steps < 128, steps
