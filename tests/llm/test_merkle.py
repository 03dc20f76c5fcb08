import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskloom.llm import merkle, queries
from tests.conftest import SF
from tests.llm.conftest import ODD


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r, more=0):
    values = [r.doc_id, r.source, r.lang, None if r.n_chars is None else r.n_chars + more, r.text]
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(nodes, fan):
    """Siblings (left, right) of each node on the way up, and the root."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            a = k - k % fan
            paths[i].append(("".join(nodes[a:k]), "".join(nodes[k + 1 : a + fan])))
        nodes = [sha(*nodes[a : a + fan]) for a in range(0, len(nodes), fan)]
        at = [k // fan for k in at]
    return paths, nodes[0] if nodes else None


def plain_audit(rows, fan=2):
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append((r.doc_id is None, r.doc_id or 0, plain_leaf(r), r))
    order = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: plain_tree([x[2] for x in sorted(groups[k], key=lambda x: x[:3])], fan) for k in order}
    over, root = plain_tree([trees[k][1] for k in order], fan)
    out = []
    for k, up in zip(order, over, strict=True):
        for (_, _, leaf, r), path in zip(sorted(groups[k], key=lambda x: x[:3]), trees[k][0], strict=True):
            h = plain_leaf(r, 1) if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0 else leaf
            for a, b in path + up:
                h = sha(a, h, b)
            out.append((r.doc_id, leaf, trees[k][1], root, sha(*[a + b for a, b in path + up]), h, h == root))
    return Counter(out)


def test_query_against_plain_trees(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = Counter(tuple(r) for r in queries.QUERIES["op12_merkle"](spark, SF).collect())
    assert got == plain_audit(rows) and {k[-1] for k in got} == {True, False}


@pytest.mark.parametrize(("fan", "levels", "n"), [(2, 1, 11), (2, 2, 16), (3, 1, 29), (3, 2, 10), (5, 1, 25), (2, 10, 1)])
def test_blocks_and_rounds(spark, fan, levels, n):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i * 3, f"t{i}", None if i % 4 == 0 else f"l{i % 3}", "s", i) for i in range(n)]
    docs = spark.createDataFrame(rows, schema)
    out = merkle.manifest(docs, merkle.FIELDS, "doc_id", "lang", config=merkle.MerkleConfig(fan, levels))
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("path")), 256), merkle.fold(F.col("leaf"), F.col("path")))
    assert Counter(tuple(r)[:5] for r in out.collect()) == Counter(k[:5] for k in plain_audit(docs.collect(), fan))
    assert all(r[5] == r[3] for r in out.collect())


def test_odd_rows(docs, spark):
    few = docs(*ODD)
    table = few.withColumn("n_chars", F.when(F.col("doc_id") != 2, F.lit(2**63 - 1))).withColumn("lang", F.when(F.col("doc_id") != 3, F.col("lang")))
    got = merkle.audit(table)
    assert Counter(tuple(r) for r in got.collect()) == plain_audit(table.collect())
    assert merkle.audit(table.limit(0)).count() == 0


def test_order_of_langs_is_bytewise(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "a", "z", None, 1), (2, "b", "é", None, 1), (3, "c", "", None, None), (4, "d", None, None, 1), (5, "e", "Z", None, 1), (6, "f", "-", None, 1), (7, "g", "😀", None, 1), (8, "h", "￿", None, 1)]
    table = spark.createDataFrame(rows, schema)
    assert Counter(tuple(r) for r in merkle.audit(table).collect()) == plain_audit(table.collect())
