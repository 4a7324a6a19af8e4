"""Every geometry query with SQL against DuckDB on the smallest test tables; the others must give rows."""

import glob
import math
import os

import pytest

from geoframe.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = df.collect()
    answer = duck.execute(SQL[name])
    names = [c[0] for c in answer.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted((tuple(plain(row[names.index(c)]) for c in order) for row in answer.fetchall()), key=repr)
    assert sorted((tuple(plain(row[c]) for c in order) for row in got), key=repr) == want


@pytest.mark.parametrize("name", ["a8_robust_affine", "a9_ransac_rigid", "g5_overlapping_crops", "j11_far_negatives", "a23_feature_pca", "d11_build_training_pairs", "t4_epoch_shuffle"])
def test_gives_rows_again_and_again(spark, name):
    first = sorted(map(tuple, QUERIES[name](spark, DATA).collect()), key=repr)
    assert first and first == sorted(map(tuple, QUERIES[name](spark, DATA).collect()), key=repr)
