import random

import numpy as np

from riskloom.llm import decontaminate as D
from tests.conftest import SF
from tests.llm.conftest import ODD

ITEM = "Which river runs through the old town of Basel today? The answer is the Rhine that comes from the Alps."


def plain_scores(items, windows, config):
    """BM25 of every item for every window, term by term."""
    import math

    words = [D.words_of(t) for _, t in items]
    n, mean = len(items), sum(map(len, words)) / len(items)

    def weight(term, k):
        df = sum(term in w for w in words)
        tf = words[k].count(term)
        return math.log1p((n - df + 0.5) / (df + 0.5)) * tf * (config.k1 + 1) / (tf + config.k1 * (1 - config.b + config.b * len(words[k]) / mean)) if tf else 0.0

    own = [sum(weight(t, k) for t in set(words[k])) for k in range(n)]
    return [[sum(weight(t, k) for t in set(w)) / own[k] for k in range(n)] for w in windows]


def test_search_equals_scoring_every_item():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(6, 14)))) for i in range(40)]
    config = D.LeakConfig(block=4)
    index = D.LeakIndex(items, config)
    texts = [rng.choices(vocabulary + ["zz"], k=rng.randint(0, 90)) for _ in range(30)]
    numbers = [np.array([index.vocabulary.get(w, -1) for w in t], np.int64) for t in texts]
    got = {(d, k): s for d, k, _, s in index.search(numbers)}
    stride, want = index.longest, {}
    for d, t in enumerate(texts):
        windows = [t[a : a + 2 * stride] for a in range(0, max(1, len(t)), stride)]
        for row in plain_scores(items, windows, config):
            for k, s in enumerate(row):
                if s >= config.retrieve:
                    want[d, k] = max(s, want.get((d, k), 0))
    assert want and got.keys() == want.keys()
    assert all(abs(got[c] - want[c]) < 1e-9 for c in want)


def test_whole_table_against_grams(spark):
    """Documents that hold nearly all 8-grams of an item are found, and no document that holds few."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r.key, r.item_id) for r in D.find_leaks(docs, bench).collect()}
    items = {r.item_id: D.words_of(r.text) for r in bench.collect()}
    full, none = set(), set()
    for r in docs.select("doc_id", "text").collect():
        have = D.grams(D.words_of(r.text), 8)
        for k, w in items.items():
            g = D.grams(w, 8)
            share = len(g & have) / len(g)
            (full if share >= 0.9 else none if share <= 0.2 else set()).add((r.doc_id, k))
    assert full and full <= got and not got & none


def test_question_and_answer_both_count(docs, spark):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    question, answer = ITEM.split("? ")
    rows = docs((1, "noise " * 70 + ITEM.upper() + " noise" * 70), (2, f"so {question}? I do not know, but it is a long way to walk there."), (3, f"well. {answer}"), (4, " *** ".join(ITEM.split())))
    assert sorted(r.key for r in D.find_leaks(rows, bench).collect()) == [1, 4]
    left = D.drop_leaks(rows, bench)
    assert left.columns == rows.columns and sorted(r.doc_id for r in left.collect()) == [2, 3]


def test_odd_rows(docs, spark):
    bench = spark.createDataFrame([(1, ITEM), (None, ITEM), (2, None), (3, "?!"), (1, ITEM), (4, "one")], "item_id long, text string")
    out = D.find_leaks(docs(*ODD, (9, ITEM), (9, ITEM), (None, ITEM)), bench).collect()
    assert sorted((r.key is None, r.key or 0, r.item_id) for r in out) == [(False, 4, 4), (False, 4, 4), (False, 5, 4), (False, 9, 1), (False, 9, 1), (True, 0, 1)]


def test_empty_tables(docs, spark):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert D.find_leaks(docs(*ODD).limit(0), bench).count() == 0
    assert D.find_leaks(docs(*ODD), bench.limit(0)).count() == 0
    assert D.drop_leaks(docs(*ODD), bench.limit(0)).count() == len(ODD)


def test_several_indexes_find_the_same_items(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    small = D.find_leaks(docs, bench, config=D.LeakConfig(index_bytes=2000))
    assert {(r.key, r.item_id) for r in D.find_leaks(docs, bench).collect()} == {(r.key, r.item_id) for r in small.collect()}


def test_shuffled_copy_before_the_exact_one(docs, spark):
    """With a long item in the index, windows are long; all words of a short item by chance hide no later copy."""
    rng = random.Random(8)
    bench = spark.createDataFrame([(1, ITEM), (2, " ".join(f"long{i}" for i in range(1000)))], "item_id long, text string")
    mixed = ITEM.split()
    rng.shuffle(mixed)
    rows = docs((1, " ".join(mixed) + " noise" * 5000 + " " + ITEM + " noise" * 90), (2, " ".join(mixed) + " noise" * 5000))
    assert [(r.key, r.item_id, r.first_word) for r in D.find_leaks(rows, bench).collect()] == [(1, 1, 4000)]
    assert [r.doc_id for r in D.drop_leaks(rows, bench).collect()] == [2]


def test_answer_far_from_its_question(docs, spark):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    question, answer = ITEM.split("? ")
    rows = docs((1, f"{question}?" + " noise" * 500 + f" {answer}"), (2, f"{question}?" + " noise" * 500))
    assert [(r.key, r.question_overlap, r.answer_overlap) for r in D.find_leaks(rows, bench).collect()] == [(1, 1.0, 1.0)]
