import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import hard_negatives as H
from tests.conftest import SF

SCHEMA = "vec_id long, embedding array<double>, label int, rid long, score double, v string, bars int"


def plain(rows, positives=5, negatives=10, limit=H.LIMIT):
    """All pairs of (vec_id, vector, label), in whole numbers of any size."""
    use = []
    for vec_id, v, label in rows:
        if vec_id is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        use.append((vec_id, [math.floor(256 * x) for x in v], (label + 1) % 10 if vec_id % 7 == 0 else label))
    out = Counter()
    for i, (a, q, la) in enumerate(use):
        if a % 100:
            continue
        met = [(-max(-limit, min(limit, sum(x * y for x, y in zip(q, v, strict=True)))), b, lb) for j, (b, v, lb) in enumerate(use) if j != i and len(v) == len(q)]
        for p, pid, _ in sorted(x for x in met if x[2] == la)[:positives]:
            fit = sorted(x for x in met if x[2] != la and 30 * -p <= 100 * -x[0] <= 90 * -p)[:negatives]
            out.update((a, pid, rank, n, -p, -s) for rank, (s, n, _) in enumerate(fit, 1))
    return out


def mined(df, **config):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return Counter(tuple(r) for r in H.mine(df, F.col("vec_id") % 100 == 0, label, config=H.NegativesConfig(**config)).collect())


def clustered(n=1500, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, 16))
    at = rng.integers(0, 12, n)
    x = (centres[at] + 0.15 * rng.standard_normal((n, 16))) * rng.choice([0.1, 0.5, 1.0, 3.0], (n, 1))
    return [(i, v.tolist(), int(k % 5)) for i, (v, k) in enumerate(zip(x, at, strict=True))]


@pytest.fixture(scope="module")
def frame(spark):
    return lambda rows: spark.createDataFrame([(*r, 7, 0.5, "v", 1) for r in rows], SCHEMA)


@pytest.mark.parametrize("config", [{}, {"bucket_rows": 64, "block_anchors": 4, "runs": 3}, {"bucket_rows": 7, "focus": 1, "runs": 1}])
def test_against_all_pairs(frame, config):
    rows = clustered()
    got = mined(frame(rows), **config)
    assert got == plain(rows) and len(got) > 300


def test_query(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert Counter(tuple(r) for r in H.mine_embeddings(table).collect()) == plain([(r.vec_id, r.embedding, r.label) for r in table.collect()])


def test_ranges_prune_and_lose_nothing():
    rows = clustered(2000)
    x = np.floor(256 * np.array([v for _, v, _ in rows]))
    x = x[np.argsort(-H._lengths(x))[:400]]  # a bucket holds rows of about one length
    lengths = H._lengths(x)
    lists = np.argsort(H._directions(x, lengths), axis=0).T.astype(np.int32)
    ids = np.arange(len(x)).tobytes()
    bucket = H._Bucket({"dim": 16, "v_ids": ids, "v_rids": ids, "v_labels": ids, "v_x": H._bytes(x), "v_lengths": lengths.tobytes(), "v_lists": np.ascontiguousarray(lists).tobytes()})
    seen = 0
    for q in x[:200]:
        exact = x @ q
        least = np.sort(exact)[-20]
        rows_ = bucket.candidates(q, float(np.sqrt(q @ q)), least, 4)
        rows_ = np.arange(len(x)) if rows_ is None else rows_
        assert set(np.flatnonzero(exact >= least)) <= set(rows_.tolist())
        seen += len(rows_)
    assert seen < 0.5 * 200 * len(x)


def test_odd_rows(frame):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (100, [0.0, 0.0], 1), (200, [], 2), (201, [], 3), (300, [-1.0, 0.2], 3), (1, None, 1), (None, [1.0, 1.0], 1),
        (2, [nan, 1.0], 1), (3, [1.0, None], 2), (4, [inf, 1.0], 2), (5, [0.9, 0.4], None), (6, [0.9, 0.4], 2), (6, [0.9, 0.4], 2), (8, [0.4, 0.3], 1),
        (9, [0.5, 0.1], 4), (400, [1e300, 3.0], 5), (11, [1e15, -1e15], 5), (12, [5e8, 7.0], 6), (13, [3.7, 1.0], 6), (700, [0.3, 0.3, 0.3], 9), (15, [0.2, 0.3, 0.1], 0), (16, [0.1, 0.1, 0.1], 1),
    ]
    assert mined(frame(rows)) == plain(rows)
    assert mined(frame(rows), bucket_rows=2, block_anchors=1) == plain(rows)
    assert not mined(frame([])) and not mined(frame([(1, [0.1], 1)]))


def test_many_equal_vectors(frame):
    rows = [(i, [0.5, 0.25, 1.0] if i % 3 else [0.1 * (i % 7), 0.2, 0.3], i % 4) for i in range(900)]
    assert mined(frame(rows), bucket_rows=50) == plain(rows)
