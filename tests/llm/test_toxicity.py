import pytest
from pyspark.sql import functions as F

from riskloom.llm import toxicity as T
from tests.llm.conftest import ODD


def corpus(n=400):
    rows = []
    for i in range(n):
        bad = i % 4 == 0
        group = ("women", "men", "girls")[i % 3] if bad and i % 8 else "people"
        rows.append((i, f"the {group} went to town {i % 17} and said you are {'a vile grumbler' if bad else 'a kind helper'} today.", int(bad)))
    return rows


def test_held_out_scores(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    used = T.labelled_rows(docs, labels)
    assert used.where(T.held_out(F.col("doc_id"))).count() == 0
    out = T.scores(docs, T.fit(used)).collect()
    truth = {i: y for i, _, y in rows}
    held = [r for r in out if r.held_out]
    assert held and all(r.predicted == truth[r.doc_id] for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)


def test_swaps_do_not_move_scores(spark):
    """In the labels only toxic rows name women; with the penalty, neutral mentions score as other groups do."""
    rows = [(i, f"{'women' if i % 2 else 'people'} are {'vile' if i % 2 else 'fine'} number {i % 13}.", i % 2) for i in range(300)]
    labelled = spark.createDataFrame([(i, t, y) for i, t, y in rows], "doc_id long, text string, toxic int")
    plain = T.fit(labelled, config=T.ToxicityConfig(swap_penalty=0.0))
    fair = T.fit(labelled, config=T.ToxicityConfig(swap_penalty=50.0))

    def gap(model):
        return abs(model.logit(T.text_features("women are fine")) - model.logit(T.text_features("men are fine")))

    assert gap(fair) < 0.25 * gap(plain)
    assert fair.logit(T.text_features("people are vile")) > fair.logit(T.text_features("women are fine"))


def test_odd_rows_and_labels(spark, docs):
    table = docs(*ODD)
    labels = spark.createDataFrame([(4, 1), (4, 1), (6, 0), (7, None), (None, 1), (2, 0), (5, 3)], "doc_id long, toxic int")
    model = T.fit(T.labelled_rows(table, labels))
    out = T.scores(table, model)
    assert out.count() == len(ODD) and out.where("score is null or isnan(score) or held_out is null").count() == 0
    assert T.keep_clean(table, model).columns == table.columns


def test_no_labels_and_no_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = T.fit(T.labelled_rows(docs(*ODD), none))
    assert {r.score for r in T.scores(docs(*ODD), model).collect()} == {0.0}
    assert T.scores(docs(*ODD).limit(0), model).count() == 0
    one = spark.createDataFrame([(4, 1), (6, 1)], "doc_id long, toxic int")
    assert all(r.score > 0.5 for r in T.scores(docs(*ODD), T.fit(T.labelled_rows(docs(*ODD), one))).collect())


def test_very_long_text_is_read_to_its_end(spark):
    rows = corpus()
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = T.fit(labelled)
    long = spark.createDataFrame([(1, "helper " * 100_000 + "vile grumbler"), (2, "helper " * 100_000)], "doc_id long, text string")
    a, b = (r.score for r in T.scores(long, model).orderBy("doc_id").collect())
    assert a > b


@pytest.mark.parametrize(("often", "seldom"), [("women", "deaf"), ("deaf", "women")])
def test_more_pairs_than_fitted_rows(spark, often, seldom):
    """12,000 swaps: the term that comes less often is held equal too, whichever hash is the smaller."""
    rows = [(i, (f"{often} came. " * 60 + f"{seldom} came. " * 20 + "vile" if i % 2 else "people came. fine") + f" number {i % 13}.", i % 2) for i in range(300)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    plain, fair = (T.fit(labelled, config=T.ToxicityConfig(swap_penalty=p)) for p in (0.0, 50.0))

    def gap(model, term):
        return abs(model.logit(T.text_features(f"{term} are fine")) - model.logit(T.text_features(f"{T._NEXT[term]} are fine")))

    for term in (often, seldom):
        assert gap(fair, term) < 0.25 * gap(plain, term)


def test_terms_of_four_languages():
    terms = [t for kind in T.IDENTITY_TERMS.values() for t in kind]
    assert len(set(terms)) == len(terms)
    for text in ("Die Männer sind da", "les garçons sont là", "los niños cantan", "the boys sing"):
        assert len(list(T.swaps(text))) == 1
