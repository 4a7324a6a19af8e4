import numpy as np

from geoframe.llm import ann


def plain(rows, every, k):
    sound = [(n, i, np.array(v, float)) for n, (i, v) in enumerate(rows) if v and i is not None and None not in v and np.isfinite(v).all() and any(v)]
    out = []
    for n, i, q in sound:
        if i % every == 0:
            near = sorted((-(q @ v) / (np.linalg.norm(q) * np.linalg.norm(v)), j) for m, j, v in sound if m != n and len(v) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near)]
    return out


def test_nearest_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(400)]
    rows += [(400, None), (401, []), (402, [0.0] * 16), (403, [1.0] * 15 + [float("nan")]), (404, [float("inf")] * 16), (405, [None] + [1.0] * 15)]
    rows += [(450, [1.0, 2.0]), (451, [2.0, 4.0]), (500, [1.0, 2.0, 3.0]), (None, [1.0] * 16), (50, rows[7][1])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, shard string").repartition(3)
    want = plain(rows, 50, 5)
    got = ann.nearest(df, sure=0.9999).collect()
    key = lambda x: (x[0], x[1], -x[3], x[2])
    a, b = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(a) == len(b)
    hits = sum((x[0], x[2]) == (y[0], y[2]) for x, y in zip(a, b)) / len(b)
    assert hits > 0.95
    assert np.allclose([x[3] for x in a], [y[3] for y in b], atol=0.05)
    assert ann.nearest(df.filter("false")).count() == 0


def test_chi_square_quantile():
    rng = np.random.default_rng(1)
    draws = (rng.normal(size=(200_000, 8)) ** 2).sum(axis=1)
    assert abs((draws < ann.chi_square_quantile(0.9, 8)).mean() - 0.9) < 0.005
