"""Isotonic fits over many ranges against one pass over the points, and the merge of knots and scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import calibration, isotonic

SHAPES = {
    "rising": lambda rng, n: np.arange(n, dtype=float),
    "falling": lambda rng, n: -np.arange(n, dtype=float),
    "noisy": lambda rng, n: (rng.random(n) < np.linspace(0.1, 0.9, n)).astype(float),
    "late_drop": lambda rng, n: np.where(np.arange(n) < n - 1, np.arange(n), -5.0 * n),
    "flat": lambda rng, n: np.ones(n),
}


def plain(y, w):
    """Value of each point, by the max-min formula over prefix sums."""
    s, t = np.concatenate(([0], np.cumsum(y * w))), np.concatenate(([0], np.cumsum(w)))
    n, out = len(y), np.full(len(y), -np.inf)
    for a in range(n):
        mean = (s[a + 1 :] - s[a]) / (t[a + 1 :] - t[a])
        out[a:] = np.maximum(out[a:], np.minimum.accumulate(mean[::-1])[::-1])
    return out


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("size", [8, 1000])
def test_blocks_over_ranges(spark, shape, size):
    rng = np.random.default_rng(5)
    n = 120
    y, w = SHAPES[shape](rng, n), rng.integers(1, 4, n).astype(float)
    points = spark.createDataFrame([(g, float(i), float(a * b), float(b)) for g in ("p", "q") for i, (a, b) in enumerate(zip(y if g == "p" else -y, w))], "g string, x double, s double, w double")
    for g, values in (("p", y), ("q", -y)):
        knots = isotonic.fit_knots(points, size).of(g).table.orderBy("x").collect()
        want = plain(values, w)
        ends = [i for i in range(n) if i in (0, n - 1) or abs(want[i] - want[i - 1]) > 1e-9 or abs(want[i + 1] - want[i]) > 1e-9]
        assert [r.x for r in knots] == [float(i) for i in ends]
        assert [r.y for r in knots] == pytest.approx([want[i] for i in ends])


def test_apply_is_an_ordered_merge(spark):
    rng = np.random.default_rng(2)
    xs = np.sort(rng.random(40))
    ys = np.sort(rng.random(40))
    table = spark.createDataFrame([(g, float(x), float(y)) for g in ("a", "b") for x, y in zip(xs, ys if g == "a" else ys**2)], "g string, x double, y double")
    asked = [*rng.random(300).tolist(), -1.0, 2.0, float(xs[3]), float(xs[-1])]
    rows = [(g, s, 1) for g in ("a", "b", "c") for s in [*asked, None, float("nan")]]
    df = spark.createDataFrame(rows, "grp string, score double, x int")
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        out = isotonic.apply_knots(df, isotonic.KnotTable(table), "score", "value", "grp")
        assert out.columns == ["grp", "score", "x", "value"] and out.count() == len(rows)
        for r in out.collect():
            if r.grp == "c" or r.score is None or np.isnan(r.score):
                assert r.value is None
            else:
                assert r.value == pytest.approx(np.interp(r.score, xs, ys if r.grp == "a" else ys**2))
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_scores_that_take_no_part(spark):
    df = spark.createDataFrame([(0, 0.2), (1, None), (1, float("nan")), (1, float("inf")), (None, 0.4), (1, 0.6)], "is_fraud int, score double")
    knots = calibration.isotonic_fit(df)
    assert [(r.x, r.y) for r in knots.table.orderBy("x").collect()] == [(0.2, 0.0), (0.4, 0.0), (0.6, 1.0)]
    none = calibration.isotonic_fit(df.limit(0))
    assert none.table.count() == 0 and calibration.apply_calibrator(df, none).where(F.col("score").isNotNull()).count() == 0
