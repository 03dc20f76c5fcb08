import os
from collections import Counter

import numpy as np
import pytest
import sentencepiece

from riskloom.llm import token_files as T
from tests.conftest import SF
from tests.llm.conftest import ODD

SMALL = T.TokenConfig(block_ids=7, file_bytes=4000)


@pytest.fixture(scope="module")
def encode():
    return sentencepiece.SentencePieceProcessor(model_file=T.DEFAULT_MODEL).encode


@pytest.mark.parametrize("config", [SMALL, None])
def test_whole_table(spark, encode, config):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in T.document_counts(table, config=config).collect()}
    assert got == {r.doc_id: len(encode(r.text)) for r in table.select("doc_id", "text").collect()}


def test_files_are_flat_and_come_back(spark, docs, encode, folder):
    table = docs(*[(i, f"text number {i} of the table") for i in range(40)])
    T.write_token_files(table, f"{folder}/t", config=SMALL)
    ids = b""
    for root, _, names in sorted(os.walk(f"{folder}/t/kind=ids")):
        for n in sorted(names):
            if n.startswith("part-"):
                with open(f"{root}/{n}", "rb") as f:
                    ids += f.read()
    texts = "".join(map(chr, np.frombuffer(ids, "<u2"))).split(chr(2))
    assert texts.pop() == ""
    assert Counter(texts) == Counter("".join(map(chr, encode(r.text))) for r in table.collect())


def test_separators_at_every_place(spark, folder):
    """Blocks of 7: separators first, last, repeated, none for several blocks, an open end, an empty file."""
    files = [[], [2], [5, 2], [2, 2, 9], [5] * 30, [5] * 7 + [2] + [6] * 20 + [2], [5] * 6 + [2, 2] + [6] * 13 + [2], [5] * 50 + [2] + [4] * 3]
    os.makedirs(f"{folder}/f")
    for i, f in enumerate(files):
        np.array(f, "<u2").tofile(f"{folder}/f/{i}.bin")
    got = {}
    for r in T.count_tokens(spark, f"{folder}/f", SMALL, "*.bin").orderBy("path", "ordinal").collect():
        got.setdefault(int(r.path.rpartition("/")[2][0]), []).append((r.ordinal, r.n_tokens, r.terminated))
    for i, f in enumerate(files):
        want, run = [], 0
        for x in f:
            if x == 2:
                want.append((len(want), run, True))
                run = 0
            else:
                run += 1
        if run:
            want.append((len(want), run, False))
        assert got.get(i, []) == want, i


def test_odd_rows(docs, encode):
    got = Counter((r.doc_id, r.n_tokens) for r in T.document_counts(docs(*ODD), config=SMALL).collect())
    assert got == Counter((i, len(encode(t or ""))) for i, t, *_ in ODD)


def test_empty_table(docs):
    out = T.document_counts(docs(*ODD).limit(0))
    assert out.columns == ["doc_id", "n_tokens"] and out.count() == 0


def test_separator_that_the_writer_cannot_end_with(docs, folder):
    with pytest.raises(ValueError, match="below 128"):
        T.write_token_files(docs(*ODD), f"{folder}/x", config=T.TokenConfig(separator=50256))
