import random
from dataclasses import replace

import corpus_pipeline as P
from riskloom.llm import similar, simhash, superminhash
from tests.conftest import SF
from tests.llm.conftest import ODD


def plain_kept(rows, words=5, least=0.8):
    """Smallest id of each group of (id, text), by the Jaccard similarity of all pairs."""

    def grams(text):
        w = (text or "").lower().split()
        n = min(words, len(w))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()

    sets, label = [grams(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or len(a & b) >= least * len(a | b):
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    least_id = {}
    for (id_, _), g in zip(rows, label, strict=True):
        least_id[g] = min(id_, least_id.get(g, id_))
    return sorted(least_id.values())


def test_stage_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in P.near_dedup(spark, docs, SF).collect()) == plain_kept(rows)


def test_chains_and_large_groups(docs, spark):
    rng = random.Random(5)
    rows = []
    for g in range(12):
        text = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(2 + 25 * (g % 3 == 0)):
            text = list(text)
            text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    assert sorted(r.doc_id for r in P.near_dedup(spark, docs(*rows), SF).collect()) == plain_kept(rows)


def test_odd_rows(docs):
    kept = similar.keep_one_similar(docs(*ODD))
    assert kept.columns == docs(*ODD).columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, i) for i in (1, 4, 6, 7, 8)] + [(True, 0)]
    assert similar.keep_one_similar(docs(*ODD).limit(0)).count() == 0


def test_fingerprints_bring_pairs(docs, spark):
    """Near copies within three bits are linked although they share no band."""
    rng, rows = random.Random(9), []
    for _ in range(30):
        text = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        near = list(text)
        near[rng.randrange(50, 350)] = "x"
        near[rng.randrange(50, 350)] = "y"
        rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join(near))]
    prints = [simhash.fingerprint_of(t.encode(), 5) & (1 << 64) - 1 for _, t in rows]
    close = [i for i in range(0, len(rows), 2) if 0 < (prints[i] ^ prints[i + 1]).bit_count() <= 3]
    # One band of all places, which only equal signatures share.
    config = replace(superminhash.NearConfig(words=5), bands=1, rows=96)
    alone = superminhash.classes(docs(*rows), config, "doc_id", "text")[1]
    parts = superminhash.classes(docs(*rows), config, "doc_id", "text", 3)[1]
    apart = {r.id: bytes(r["class"]) for r in alone.collect()}
    joined = {r.id: bytes(r["class"]) for r in parts.collect()}
    assert any(apart[i] != apart[i + 1] for i in close) and all(joined[i] == joined[i + 1] for i in close)
    assert len(joined) == len(rows) and all(joined[i] != joined[j] for i in joined for j in joined if i // 2 != j // 2)


def test_fingerprints_only_propose(docs):
    """Texts within the radius that share no shingle stay apart."""
    prints = {simhash.fingerprint_of(f"q{i}".encode(), 5) & (1 << 64) - 1: i for i in range(3000)}
    order = sorted(prints)
    radius, x, y = min(((a ^ b).bit_count(), prints[a], prints[b]) for a, b in zip(order, order[1:]))
    rows = docs((1, f"q{x}"), (2, f"q{y}"), (3, f"q{x}"))
    codes = rows.where("doc_id < 3").select(simhash.fingerprint(rows["text"], 5).alias("fp"))
    assert simhash.link_prints(codes, radius).count() > 0
    assert sorted(r.doc_id for r in similar.keep_one_similar(rows, radius=radius).collect()) == [1, 2]
