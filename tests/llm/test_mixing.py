import math

import pytest
from pyspark.sql import functions as F

from riskloom.llm import mixing as M
from tests.llm.conftest import ODD


def sources(spark, **sizes):
    rows = [(f"{s}-{i}", " ".join(["w"] * 10), s) for s, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "doc_id string, text string, source string")


def plain_exponent(sizes, entropy, repeats):
    p = [s / sum(sizes) for s in sizes]

    def h(a):
        z = sum(x**a for x in p)
        return -sum(x**a / z * math.log(x**a / z) for x in p)

    def solve(holds):
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if holds(mid) else (lo, mid)
        return lo

    a = 1.0 if h(1.0) >= entropy * math.log(len(p)) else solve(lambda a: h(a) >= entropy * math.log(len(p)))
    return max(a, solve(lambda a: (max(p) / min(p)) ** (1 - a) > repeats))


@pytest.mark.parametrize(("entropy", "repeats"), [(0.9, 100.0), (0.99, 1.5), (0.1, 1.5)])
def test_exponent(spark, entropy, repeats):
    df = sources(spark, a=100, b=20, c=5)
    config = M.MixConfig(entropy=entropy, repeats=repeats)
    mixture = M.mix(df, config=config)
    assert abs(mixture.exponent - plain_exponent([1000, 200, 50], entropy, repeats)) < 1e-9


def test_epochs_fill_the_weights(spark):
    df = sources(spark, a=400, b=40)
    config = M.MixConfig(repeats=2.5, block_tokens=500)
    mixture = M.mix(df, config=config)
    plan = M.schedule(mixture, config)
    got = {r.key: r for r in plan.groupBy("key").agg(F.sum("tokens").alias("t"), F.first("weight").alias("w"), F.countDistinct("id").alias("n"), F.max("epoch").alias("e")).collect()}
    assert got["+a"].n == 400 and got["+b"].n == 40 and got["+a"].e == 0 and got["+b"].e == 2
    for r in got.values():
        assert abs(r.t - r.w * mixture.budget) <= 10
    # Each block holds the sources at their weights, and its places have no gaps.
    for r in plan.groupBy("block", "key").agg(F.sum("tokens").alias("t"), F.first("weight").alias("w")).where(F.col("block") < F.lit(mixture.budget / 500 - 1)).collect():
        assert abs(r.t - r.w * 500) <= 10
    for r in plan.groupBy("block").agg(F.count("*").alias("n"), F.countDistinct("position").alias("d"), F.max("position").alias("m")).collect():
        assert r.n == r.d == r.m + 1
    rows = M.mixed_rows(df, mixture, config=config)
    want = {r.id: r["count"] for r in plan.groupBy("id").count().collect()}
    assert {r.doc_id: r["count"] for r in rows.groupBy("doc_id").count().collect()} == want


def test_given_budget_can_cut_a_source(spark):
    df = sources(spark, a=100, b=100)
    config = M.MixConfig(budget=1000.0)
    mixture = M.mix(df, config=config)
    assert M.schedule(mixture, config).agg(F.sum("tokens")).first()[0] in range(1000, 1021)
    assert M.mixed_rows(df, mixture, config=config).count() in range(100, 103)


def test_odd_rows(docs):
    table = docs(*ODD)
    mixture = M.mix(table)
    rows = M.mixed_rows(table, mixture)
    assert rows.columns == table.columns
    assert sorted(rows.distinct().collect(), key=str) == sorted(table.distinct().collect(), key=str)
    assert M.schedule(mixture).count() == rows.count() >= len(ODD)
    assert {r.key for r in mixture.sources.collect()} == {"-", "+a", "+b", "+c"}


def test_empty_table_and_texts(docs):
    assert M.schedule(M.mix(docs(*ODD).limit(0))).count() == 0
    assert M.mixed_rows(docs(*ODD).limit(0), M.mix(docs(*ODD).limit(0))).count() == 0
    blank = docs((1, "", "a"), (2, None, "b"))
    assert M.schedule(M.mix(blank)).count() == 2 == M.mixed_rows(blank, M.mix(blank)).count()
