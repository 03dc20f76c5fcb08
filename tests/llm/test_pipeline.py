"""The stages of the pipeline, each against brute force on its own input, and the subpackage's place in the library."""

from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline as P
from riskloom.llm import decontaminate, mixing, queries, toxicity
from tests.conftest import SF
from tests.llm.test_similar import plain_kept
from tools.check_oracle import compare, connect


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, step in P.STAGES:
        result = step(spark, docs, SF)
        result.write.parquet(f"{folder}/{name}")
        out[name] = (docs, spark.read.parquet(f"{folder}/{name}"))
        docs = out[name][1]
    return out


def ids(df):
    return Counter(r.doc_id for r in df.collect())


def test_columns(stages):
    for name, (before, after) in stages.items():
        assert after.columns[: len(before.columns)] == before.columns and (name == "sharding" or after.columns == before.columns)


def test_toxicity_stage(spark, stages):
    before, after = stages["toxicity"]
    model = toxicity.fit(toxicity.labelled_rows(before, spark.read.parquet(f"{SF}/labels.parquet")))
    clean = toxicity.scores(before, model).where("predicted = 0")
    assert ids(after) == ids(clean) and 0 < after.count() < before.count()


def test_near_dedup_stage(stages):
    before, after = stages["near_dedup"]
    assert ids(after) == Counter(plain_kept([(r.doc_id, r.text) for r in before.collect()]))


def test_decontamination_stage(spark, stages):
    before, after = stages["decontamination"]
    items = [(r.item_id, decontaminate.grams(decontaminate.words_of(r.text), 8)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = ids(before) - ids(after)
    for r in before.collect():
        have = decontaminate.grams(decontaminate.words_of(r.text), 8)
        share = max(len(g & have) / len(g) for _, g in items)
        assert share > 0.2 if r.doc_id in gone else share < 0.9


def test_mixing_stage(stages):
    before, after = stages["mixing"]
    plan = mixing.schedule(mixing.mix(before))
    assert ids(after) == Counter({r.id: r["count"] for r in plan.groupBy("id").count().collect()})
    assert set(ids(before)) == set(ids(after))


def test_sharding_stage(stages):
    before, after = stages["sharding"]
    assert ids(before) == ids(after)
    for r in after.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect():
        assert r.n == r.d == r.m + 1


def test_run(spark, stages):
    assert ids(P.run(spark, SF)) == ids(stages["sharding"][1])


def test_registered():
    found = __spark_entry__.queries()
    assert "pipeline" in found and all(sum(q.startswith(f"op{n}_") for q in found) == 1 for n in range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    ok, message, _ = compare(spark, connect(SF), SF, name, queries.QUERIES[name], queries.ORACLES[name])
    assert ok, message


def test_nothing_else_imports_the_subpackage():
    root = Path(P.__file__).parent
    for p in [*root.glob("riskloom/**/*.py"), *root.glob("tests/*.py"), root / "bench.py"]:
        if "llm" not in p.parent.name:
            assert "riskloom.llm" not in p.read_text()
