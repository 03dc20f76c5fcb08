import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import ann as A
from tests.conftest import SF


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, t int, rid int")


def plain(rows, k=5, query=lambda i: i % 50 == 0):
    """By place: rows that are equal in id and vector stay apart."""
    # The table holds single-precision components.
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for a, (i, x) in enumerate(ok):
        if query(i):
            near = sorted((-float((x * y).sum() / np.sqrt((x * x).sum()) / np.sqrt((y * y).sum())), j, b) for b, (j, y) in enumerate(ok) if b != a and len(y) == len(x))
            out += [(i, n + 1, j, -s) for n, (s, j, _) in enumerate(near[:k])]
    return out


def got(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def same(a, b):
    assert [x[:3] for x in a] == [x[:3] for x in b]
    assert np.allclose([x[3] for x in a], [x[3] for x in b], rtol=0, atol=1e-12)


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_recall(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = plain(rows)
    found = got(A.nearest(df, F.col("vec_id") % 50 == 0))
    pairs = {(q, v): s for q, _, v, s in want}
    hit = {(q, v): s for q, _, v, s in found}
    assert len(found) == len(want)
    assert len(pairs.keys() & hit.keys()) >= 0.9 * len(pairs)
    assert all(abs(pairs[p] - hit[p]) < 1e-12 for p in pairs.keys() & hit.keys())


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (50, [2.0, 4.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (None, [1.0, 1.0]), (6, []),
        (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [-1.0, -2.0]), (100, [1.0, 2.0, 3.0]),
    ]
    same(got(A.nearest(table(spark, rows), F.col("vec_id") % 50 == 0)), sorted(plain(rows)))


def test_hot_vector_and_small_blocks(spark):
    """Equal vectors fill a bucket that is cut into many blocks; ties go to the smaller ids."""
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 1.0, 0.0, 0.5]) for i in range(0, 600, 2)] + [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(1, 300, 2)]
    config = A.AnnConfig(block_rows=16, block_queries=4, probes=3**6)
    same(got(A.nearest(table(spark, rows), F.col("vec_id") % 50 == 0, config=config)), sorted(plain(rows)))


def test_few_rows_come_all(spark):
    rows = [(0, [1.0, 0.0]), (1, [-1.0, 0.1]), (2, [0.0, 1.0])]
    same(got(A.nearest(table(spark, rows), F.col("vec_id") % 50 == 0)), sorted(plain(rows)))
    assert A.nearest(table(spark, rows[:1]), F.col("vec_id") % 50 == 0).count() == 0
    assert A.nearest(table(spark, rows).limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_probes_come_in_order_of_cost():
    config = A.AnnConfig(tables=1, hashes=2, probes=9)
    codes = A._probes(np.array([[5.1, 7.4]]), config)[0]
    cells = [(5, 7), (4, 7), (5, 6), (4, 6), (5, 8), (4, 8), (6, 7), (6, 6), (6, 8)]
    assert codes.tolist() == A._bucket(np.array(cells, float)).tolist()
