import math
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import gru as G
from tests.conftest import SF
from tests.llm.conftest import ODD

TINY = G.LmConfig(shortlist=40, table=60, hidden=6, classes=5, replicas=2, rounds=1, streams=3, steps=5, fit_share=1.0)


def plain_base(rows):
    words = [((t or "").encode().lower().split() + [b""]) for _, t in rows]
    train = [i is None or zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in rows]
    c = Counter(w for ws, use in zip(words, train, strict=True) if use for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, not use, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for (i, _), ws, use in zip(rows, words, train, strict=True)]


def facts(df):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df.collect()), key=str)


def test_whole_table(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    out = G.scores(table)
    assert facts(out) == sorted(plain_base([(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]), key=str)
    held = out.where("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert held[1] < held[0] < 0


def test_odd_rows(docs):
    out = G.scores(docs(*ODD), config=TINY)
    assert facts(out) == sorted(plain_base([r[:2] for r in ODD]), key=str)
    assert out.where("score is null or isnan(score) or score > 0").count() == 0
    assert G.scores(docs(*ODD).limit(0), config=TINY).count() == 0
    # Without texts to learn from, every token is unseen.
    only = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    assert facts(G.scores(docs((only, "a b")), config=TINY)) == [(only, True, 3, 0, 0, 0.0)]


@pytest.fixture
def network():
    words = [b""] + [b"w%d" % i for i in range(39)]
    counts = np.arange(40, 0, -1).astype(float)
    tokens, kinds = np.zeros(G.BUCKETS), np.zeros(G.BUCKETS)
    tokens[3], kinds[3] = 5, 2
    net = G.Network(G.Vocabulary(words, counts, 900, 60, tokens, kinds), TINY)
    rng = np.random.default_rng(0)
    net.p = {n: (a + rng.normal(0, 0.3, a.shape)).astype(np.float32) for n, a in net.p.items()}
    return net


def test_probabilities_sum_to_one(network):
    states = np.random.default_rng(1).normal(size=(1, TINY.hidden)).astype(np.float32)
    every = np.arange(40 + G.BUCKETS)
    lp, _ = network.log_probability(np.repeat(states, len(every), 0), every)
    assert abs(np.exp(lp).sum() - 1) < 1e-4


def test_state_runs_through_windows(network):
    """A text's score is that of its words one after the other, whatever texts stand beside it."""
    rng = np.random.default_rng(2)
    texts = [rng.integers(1, 40, n).astype(np.int32) for n in (0, 1, 100, 37, 3, 70)]
    h, want = np.zeros((1, TINY.hidden), np.float32), []
    for t in texts:
        h[:], total, last = 0, 0.0, 0
        for w in [*t.tolist(), 0]:
            out, _ = network.advance(np.array([[last]]), np.zeros((1, 1), bool), h, keep=False)
            h, last = out[0].copy(), w
            total += network.log_probability(h, np.array([w]))[0][0]
        want.append(total)
    assert np.allclose(network.score(texts), want, rtol=1e-4)


def test_gradients(network):
    """Backpropagation against differences: one tiny step lowers the loss by what the gradient says."""
    rng = np.random.default_rng(3)
    states, target = rng.normal(size=(20, TINY.hidden)).astype(np.float32), rng.integers(0, 40, 20)
    grad: dict = {}
    _, back = network.log_probability(states, target, grad)
    step = 1e-2 * rng.normal(size=states.shape).astype(np.float32)
    up, down = (network.log_probability(states + s, target)[0].sum() for s in (step, -step))
    assert abs((down - up) / 2 - (back * step).sum()) < 2e-3 * max(1, abs(up - down))


def test_fit_learns_an_order(network):
    text = np.tile(np.array([5, 9, 14, 20], np.int32), 50)
    before = network.score([text])[0]
    ids, reset, lengths, _ = G.pack([text] * 12, 3, 0)
    for _ in range(4):
        network.fit(ids, reset, lengths)
    assert network.score([text])[0] > 0.5 * before


def test_every_training_text_is_fitted(spark):
    """With the default share, in more replicas than the least."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), "text").where(~G.held_out(F.col("doc_id")))
    config = replace(TINY, fit_share=G.LmConfig().fit_share, rounds=3, replica_tokens=5_000)
    words = G.vocabulary(G.word_counts(docs), config)
    assert words.total > 3 * config.replicas * config.replica_tokens
    assert G.fit(docs, words, config).fitted == words.total
