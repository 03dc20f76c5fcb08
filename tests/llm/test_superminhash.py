import random

import numpy as np
import pytest

from riskloom.llm import superminhash as S
from tests.conftest import SF
from tests.llm.conftest import ODD


def plain(rows, words=4, percent=80):
    """(doc_id, n_shingles, component_id, kept) of (doc_id, text), from all pairs."""

    def grams(text):
        w = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        n = min(words, len(w))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()

    sets, label = [grams(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    names = {}
    for (id_, _), g in zip(rows, label, strict=True):
        if id_ is not None:
            names[g] = min(id_, names.get(g, id_))
    return sorted(((id_, len(s), names.get(g), id_ == names.get(g)) for (id_, _), s, g in zip(rows, sets, label, strict=True)), key=str)


def found(df, **config):
    return sorted((tuple(r) for r in S.near_duplicates(df, config=S.NearConfig(**config)).collect()), key=str)


def copies(rng, groups=8, size=30, words=110, changes=14):
    """Texts with copies in which up to some share of the words differ, so that similarities lie on both sides of the bar."""
    rows = []
    for g in range(groups):
        base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
        for _ in range(size if g % 2 else 2):
            text = list(base)
            for _ in range(rng.randrange(changes)):
                text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("config", [{}, {"rounds": 0}, {"rounds": 2, "spread": 3}])
def test_copies_on_both_sides_of_the_bar(docs, config):
    rows = copies(random.Random(4))
    assert found(docs(*rows), **config) == plain(rows)


def test_chains(docs):
    rng = random.Random(9)
    rows = []
    for _ in range(3):
        text = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(25):
            text = list(text)
            text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(text)))
    assert found(docs(*rows)) == plain(rows)
    assert found(docs(*rows), words=2, percent=95) == plain(rows, 2, 95)


def test_odd_rows(docs):
    assert found(docs(*ODD)) == plain([r[:2] for r in ODD])
    assert found(docs(*ODD).limit(0)) == []
    few = [(5, "A b"), (3, "a B"), (7, "a b c"), (8, "a b c d"), (None, "x y"), (None, "x  y "), (None, "a b c d"), (2, "É"), (1, "é")]
    assert found(docs(*few)) == plain(few)


def test_tables(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    assert found(table) == plain([(r.doc_id, r.text) for r in table.collect()])


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for share in (0.3, 0.8):
        both = int(1000 * share)
        x, y = pool[:1000], np.concatenate((pool[:both], pool[1000 : 2000 - both]))
        true = both / (2000 - both)
        a, b = S.signatures([np.sort(x), np.sort(y)], 512)
        assert abs((a == b).mean() - true) < 0.08
    a, b = S.signatures([pool[:3], pool[:3][::-1].copy()], 64)
    assert (a == b).all() and np.isfinite(a).all() and sorted(np.floor(a))[0] == 0
    assert np.isinf(S.signatures([np.zeros(0, np.uint64)], 8)).all()


def test_signatures_do_not_depend_on_the_batch(monkeypatch):
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (1, 0, 5, 700, 40, 3)]
    whole = S.signatures(sets, 96)
    assert (np.concatenate([S.signatures([s], 96) for s in sets]) == whole).all()
    monkeypatch.setattr(S, "_AT_ONCE", 50)
    assert (S.signatures(sets, 96) == whole).all()
    # Every rank comes from a permutation: one shingle offers each of its places a rank of its own.
    assert sorted(np.floor(whole[0]).astype(int)) == list(range(96))


def test_batches_that_end_with_a_flush(spark):
    rows = [(i, f"only text of number {i} in here") for i in range(128)]
    one = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)  # one batch, a multiple of the texts held at once
    assert [r[3] for r in found(one)] == [True] * 128


def test_exact_search_knows_whole_parts(spark, monkeypatch):
    """A chain of links is one part, however long: its texts do not meet each other once more."""
    sets = [(bytes([i]), np.arange(5 * i, 5 * i + 100, dtype=np.uint64).tobytes()) for i in range(12)]
    near = spark.createDataFrame([(bytes([i + 1]), bytes([i])) for i in range(11)], "u binary, v binary")
    buckets = spark.createDataFrame([(1, sid, 12) for sid, _ in sets], "k long, sid binary, reach long")
    searched, rest = [], S._rest
    monkeypatch.setattr(S, "_rest", lambda texts, *more: searched.append(texts.count()) or rest(texts, *more))
    roots = S.link_sets(buckets, spark.createDataFrame(sets, "sid binary, set binary"), S.NearConfig(rounds=0), near)
    assert searched == [0]
    assert sorted((bytes(r.node), bytes(r.root)) for r in roots.collect()) == [(sid, bytes([0])) for sid, _ in sets]
