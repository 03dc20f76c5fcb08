import numpy as np
import pytest
import xxhash

from riskloom.llm import simhash
from riskloom.llm.components import components
from tests.conftest import SF
from tests.llm.conftest import ODD


def plain_print(text):
    """The contract, bit by bit."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, radius=3):
    """Smallest id reachable for each (id, text), by all pairs."""
    prints = [plain_print(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            least = min(label[j] for j in range(len(rows)) if (prints[i] ^ prints[j]).bit_count() <= radius)
            changed |= least < label[i]
            label[i] = min(least, label[i])
    least = {}
    for (i, _), g in zip(rows, label, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return [(i, f"{p:016x}", least.get(g)) for (i, _), p, g in zip(rows, prints, label, strict=True)]


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(simhash.near_duplicates(docs)) == sorted(plain_components(rows), key=str)


def test_odd_rows(docs):
    rows = [r[:2] for r in ODD]
    assert got(simhash.near_duplicates(docs(*ODD))) == sorted(plain_components(rows), key=str)
    kept = simhash.keep_one(docs(*ODD))
    assert kept.columns == docs(*ODD).columns
    # One for the texts without words, and one for each of the others that differ by more than letter case.
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, i) for i in (1, 4, 6, 7, 8)] + [(True, 0)]


def test_empty_table(docs):
    assert simhash.near_duplicates(docs(*ODD).limit(0)).count() == 0
    assert simhash.keep_one(docs(*ODD).limit(0)).count() == 0


@pytest.mark.parametrize("hot_rows", [1_000_000, 2])
def test_links_keep_components(spark, hot_rows):
    """Chains and balls of prints, with and without blocks that are dealt anew, against one index over all."""
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 2**63, 600, dtype=np.uint64)
    for i in range(300):
        for bit in rng.integers(0, 64, rng.integers(1, 4)):
            codes[i] = codes[300 + i % 20] ^ np.uint64(1 << int(bit))
    codes = np.unique(codes)
    label = simhash.GrayIndex(codes).groups(3)
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 3
    assert (label[:, None] == label[None, :])[near].all()
    signed = codes.view(np.int64).tolist()
    roots = dict(map(tuple, components(simhash.link_prints(spark.createDataFrame([(c,) for c in signed], "fp long"), 3, hot_rows)).collect()))
    groups = {}
    for c, g in zip(signed, label.tolist(), strict=True):
        groups.setdefault(g, []).append(c)
    for members in groups.values():
        assert {roots.get(c, c) for c in members} == {min(members)}


def test_gray_order():
    codes = np.arange(64, dtype=np.uint64)
    gray = codes ^ (codes >> np.uint64(1))
    assert (simhash.gray_rank(gray) == codes).all()


def test_dense_ball_joins_without_pairs():
    ball = sorted({1 << i | 1 << j for i in range(64) for j in range(64)})
    assert len(set(simhash.GrayIndex(np.array(ball, np.uint64)).groups(3).tolist())) == 1
