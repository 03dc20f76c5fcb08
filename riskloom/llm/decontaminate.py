"""Benchmark decontamination: every training passage is a BM25 query against an index of the test items."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: What stays of a token: letters and digits, so that marks between or behind words hide nothing.
_STRIP = re.compile(r"[\W_]+")


@dataclass(frozen=True)
class LeakConfig:
    k1: float = 1.2
    b: float = 0.75
    #: Share of an item's own score (the item as a query against itself) that a passage must reach to be retrieved.
    retrieve: float = 0.5
    #: Share of an item's own score that its essential terms hold.
    pivot: float = 0.75
    #: Share of the question's and of the answer's word n-grams that the document must hold to be a leak.
    question_overlap: float = 0.6
    answer_overlap: float = 0.6
    n: int = 5
    #: Items for each block of the postings.
    block: int = 16
    #: Bound on the UTF-8 bytes of the items in one index; more items are searched index by index.
    index_bytes: int = 8 << 20


def words_of(text: str | None) -> list[str]:
    """Lower-cased tokens without marks; tokens of marks only are left out."""
    return [w for w in (_STRIP.sub("", t) for t in (text or "").lower().split()) if w]


def parts_of(words: Sequence[str], sentences: Sequence[int]) -> tuple[int, int]:
    """Where the question ends: before the last sentence, if there are two or more, else after two thirds."""
    cut = sentences[-2] if len(sentences) > 1 else 2 * len(words) // 3
    return cut, len(words)


def grams(words: Sequence[str], n: int) -> set[str]:
    n = min(n, len(words))
    return {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


class LeakIndex:
    """Postings of test items with block maxima.

    The weight of a term in an item is its BM25 weight over the item's score against itself, so one threshold holds for
    all items. The heaviest terms of an item, up to ``pivot`` of its score, are its essential postings: a passage that
    reaches the threshold holds ``retrieve + pivot - 1`` of the score in them at least. Only they open a passage: first
    by the maxima of blocks of items, then item by item; what is left is scored by all its terms.
    """

    def __init__(self, items: Sequence[tuple[int, str]], config: LeakConfig):
        self.config = config
        kept = [(i, w, t) for i, t in sorted(items, key=lambda x: (x[0], x[1] or "")) if (w := words_of(t))]
        self.ids = [i for i, _, _ in kept]
        lengths = np.array([len(w) for _, w, _ in kept], np.int64)
        self.longest = int(lengths.max(initial=0))
        n = len(kept)
        vocabulary: dict[str, int] = {}
        term = np.array([vocabulary.setdefault(w, len(vocabulary)) for _, words, _ in kept for w in words], np.int64)
        item = np.repeat(np.arange(n), lengths)
        size = len(vocabulary)
        cell, count = np.unique(term * max(n, 1) + item, return_counts=True)
        term, item = cell // max(n, 1), cell % max(n, 1)
        df = np.bincount(term, minlength=size)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = config.k1 * (1 - config.b + config.b * lengths / max(lengths.mean() if n else 1.0, 1e-9))
        weight = idf[term] * count * (config.k1 + 1) / (count + norm[item])
        weight /= np.bincount(item, weight, n)[item]
        # An item's terms from the heaviest on, until they hold the pivot's share.
        by = np.lexsort((term, -weight, item))
        before = np.cumsum(weight[by]) - weight[by]
        before -= before[np.searchsorted(item[by], item[by])]
        essential = np.empty(len(by), bool)
        essential[by] = before < config.pivot
        opens = np.bincount(term[essential], minlength=size) > 0
        # Terms that can open a passage have the first numbers.
        rank = np.empty(size, np.int64)
        rank[np.argsort(~opens, kind="stable")] = np.arange(size)
        self.openers = int(opens.sum())
        self.vocabulary = {w: int(rank[i]) for w, i in vocabulary.items()}
        by = np.lexsort((item, rank[term]))
        term, self.item, self.weight, essential = rank[term][by], item[by], weight[by], essential[by]
        self.start = np.searchsorted(term, np.arange(size + 1))
        self.blocks = n // config.block + 1
        # Postings of blocks: the largest essential weight of a term in the block.
        cell = (term * self.blocks + self.item // config.block)[essential]
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        self.block = cell[first] % self.blocks
        self.block_top = np.maximum.reduceat(self.weight[essential], first) if len(first) else np.zeros(0)
        self.block_start = np.searchsorted(cell[first] // self.blocks, np.arange(size + 1))
        # What the other terms of the items of a block can add.
        self.slack = np.zeros(self.blocks)
        np.maximum.at(self.slack, np.arange(n) // config.block, 1 - np.bincount(self.item[essential], self.weight[essential], n))
        self.splits = []
        for _, words, text in kept:
            ends = [e for e in np.cumsum([len(words_of(s)) for s in re.split(r"(?<=[.!?])\s+|\n", text)]).tolist() if e]
            cut, _ = parts_of(words, list(dict.fromkeys(ends)))
            self.splits.append((grams(words[:cut], config.n), grams(words[cut:], config.n)))

    def _expand(self, terms: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position in ``terms`` and posting number of all postings of the terms."""
        count = start[terms + 1] - start[terms]
        at = np.repeat(np.arange(len(terms)), count)
        return at, np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) + start[terms][at]

    @staticmethod
    def _windows(chunk: np.ndarray, term: np.ndarray, size: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct terms of each window of two chunks; a window has the number of its first. ``first`` chunks begin a text."""
        pair = chunk * size + term
        pair = np.sort(np.concatenate((pair, pair[~first[chunk]] - size)))
        pair = pair[np.diff(pair, prepend=-1) != 0]
        return pair // size, pair % size

    def search(self, texts: Sequence[np.ndarray]) -> list[tuple[int, int, int, float]]:
        """The best passage of a text for each item above the threshold, the first of equal ones; otherwise as ``passages``."""
        best: dict[tuple[int, int], tuple[int, float]] = {}
        for d, k, at, s in self.passages(texts):
            if (d, k) not in best or s > best[d, k][1]:
                best[d, k] = (at, s)
        return [(d, k, at, s) for (d, k), (at, s) in best.items()]

    def passages(self, texts: Sequence[np.ndarray]) -> list[tuple[int, int, int, float]]:
        """(text, item number, first word of the passage, score) of every passage of a text for each item above the threshold.

        ``texts`` hold the term number of each word, -1 for words of no item. Passages are windows of twice the longest
        item, one longest item apart, so every run of words as long as an item lies whole in one.
        """
        limit, stride = self.config.retrieve - 1e-9, max(self.longest, 1)
        # Texts stand in a row, each from a new chunk on, with a chunk of nothing behind it.
        chunks = np.array([-(-len(t) // stride) + 1 for t in texts], np.int64)
        first = np.cumsum(chunks) - chunks
        terms = np.full(int(chunks.sum()) * stride, -1, np.int64)
        for t, at in zip(texts, (first * stride).tolist(), strict=True):
            terms[at : at + len(t)] = t
        place = np.flatnonzero((terms >= 0) & (terms < self.openers))
        if not len(place):
            return []
        windows, size = int(chunks.sum()), len(self.start)
        begins = np.zeros(windows, bool)
        begins[first] = True
        window, term = self._windows(place // stride, terms[place], size, begins)
        at, posting = self._expand(term, self.block_start)
        cell, back = np.unique(window[at] * self.blocks + self.block[posting], return_inverse=True)
        bound = np.bincount(back, self.block_top[posting], len(cell)) + self.slack[cell % self.blocks]
        cell = cell[bound >= limit]
        if not len(cell):
            return []
        # What is left is scored in full, item by item, by all terms.
        alive = np.zeros(windows + 1, bool)
        alive[cell // self.blocks] = True
        place = np.flatnonzero(terms >= 0)
        place = place[alive[place // stride] | alive[np.maximum(place // stride - 1, 0)]]
        window, term = self._windows(place // stride, terms[place], size, begins)
        at, posting = self._expand(term, self.start)
        mine = np.isin(window[at] * self.blocks + self.item[posting] // self.config.block, cell)
        at, posting = at[mine], posting[mine]
        n = len(self.ids)
        cell, back = np.unique(window[at] * n + self.item[posting], return_inverse=True)
        total = np.bincount(back, self.weight[posting], len(cell))
        good = total >= limit
        window, item = cell[good] // n, cell[good] % n
        text = np.searchsorted(first, window, side="right") - 1
        return list(zip(text.tolist(), item.tolist(), ((window - first[text]) * stride).tolist(), total[good].tolist(), strict=True))

    def verify(self, words: Sequence[str], found: dict[int, list[tuple[int, float]]]) -> Iterator[tuple[int, int, float, float, float]]:
        """(item number, first word, score, question's share, answer's share) of each item of which the whole text holds enough.

        ``found`` has the retrieved passages of each item. The shares are those of the n-grams that the text holds anywhere, as
        an answer may stand far from its question. The passage named is the best of those that hold enough alone, else the best.
        """
        c = self.config
        wanted = {g for k in found for part in self.splits[k] for g in part}
        # Parts shorter than n words are one gram of their own length.
        sizes = sorted({g.count(" ") + 1 for g in wanted})

        def held(words: Sequence[str]) -> set[str]:
            return {g for m in sizes for i in range(len(words) - m + 1) if (g := " ".join(words[i : i + m])) in wanted}

        def shares(k: int, have: set[str]) -> tuple[float, float]:
            return tuple(len(part & have) / len(part) if part else 1.0 for part in self.splits[k])

        def enough(q: float, a: float) -> bool:
            return q >= c.question_overlap and a >= c.answer_overlap

        all_, of = held(words), {}
        for k, places in found.items():
            q, a = shares(k, all_)
            if not enough(q, a):
                continue
            for at, _ in places:
                if at not in of:
                    of[at] = held(words[at : at + 2 * self.longest])
            at, score = max(places, key=lambda x: (enough(*shares(k, of[x[0]])), x[1], -x[0]))
            yield k, at, score, q, a


class _Numbers(dict):
    """Term number of each raw token: marks are taken off once; -1 is a word of no item, -2 no word."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, token: str) -> int:
        word = token if token.isalnum() else _STRIP.sub("", token)
        self[token] = number = self.vocabulary.get(word, -1) if word else -2
        return number


#: Words of the texts that are searched in one step, and tokens a worker remembers.
STEP_WORDS, KNOWN_TOKENS = 50_000, 400_000


def _scan(index: LeakIndex):
    numbers = _Numbers(index.vocabulary)

    def hits(group: list[tuple[int, list[str], np.ndarray]]) -> Iterator[tuple]:
        found: dict[int, dict[int, list[tuple[int, float]]]] = {}
        for d, k, at, score in index.passages([g[2] for g in group]):
            found.setdefault(d, {}).setdefault(k, []).append((at, score))
        for d, items in found.items():
            key, tokens, _ = group[d]
            for k, at, score, q, a in index.verify([_STRIP.sub("", t) for t in tokens], items):
                yield key, index.ids[k], at, score, q, a

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, group, size = [], [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = (text.as_py() or "").lower().split()
                found = np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens))
                if (found == -2).any():
                    real = found != -2
                    tokens, found = [t for t, r in zip(tokens, real.tolist(), strict=True) if r], found[real]
                group.append((key, tokens, found))
                size += len(tokens)
                if size > STEP_WORDS:
                    rows += hits(group)
                    group, size = [], 0
                if len(numbers) > KNOWN_TOKENS:
                    numbers.clear()
            rows += hits(group)
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            names = ["key", "item_id", "first_word", "score", "question_overlap", "answer_overlap"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def _indexes(benchmark: DataFrame, config: LeakConfig) -> Iterator[LeakIndex]:
    """Indexes of at most ``index_bytes`` of test items each, read from the items in the order of their ids.

    Weights of a term depend on the items in its own index only. A caller that joins the indexes in one plan holds them all.
    """
    items = benchmark.where(F.col("item_id").isNotNull()).select("item_id", "text").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // config.index_bytes))
    for s in range(shards):
        part = items.where(F.pmod(F.xxhash64(F.col("item_id")), F.lit(shards)) == s) if shards > 1 else items
        yield LeakIndex([(r["item_id"], r["text"]) for r in part.collect()], config)


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", config: LeakConfig | None = None) -> DataFrame:
    """``(key, item_id, first_word, score, question_overlap, answer_overlap)`` for each document and test item it holds.

    Whole texts are searched, and the overlaps are those of the whole text; a pair of document row and item comes once, with
    its best passage, and repeated rows give repeated pairs. Null and empty texts hold nothing; items with a null id or without words are left out, and several
    items under one id are searched each. Without items, or without documents, the result is empty.
    Other columns are ignored. The documents are read once for each index of ``index_bytes``, and never shuffled.
    """
    config = config or LeakConfig()
    out = None
    for index in _indexes(benchmark, config):
        hits = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(_scan(index), "key long, item_id long, first_word long, score double, question_overlap double, answer_overlap double")
        out = hits if out is None else out.union(hits)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", config: LeakConfig | None = None) -> DataFrame:
    """Rows of ``docs`` that hold no test item, with the columns they have.

    Null and empty texts hold none and stay; repeated rows all stay or all go; without items every row stays. The plan carries all
    indexes, so its code grows with the benchmark, not with ``docs``.
    """
    for index in _indexes(benchmark, config or LeakConfig()):
        docs = docs.where(_clean(index)(F.col(text)))
    return docs


def _clean(index: LeakIndex):
    scan = _scan(index)

    @arrow_udf("boolean")
    def clean(batch: pa.Array) -> pa.Array:
        out = np.ones(len(batch), bool)
        for hits in scan([pa.RecordBatch.from_arrays([pa.array(np.arange(len(batch))), batch], ["key", "text"])]):
            out[hits.column(0).to_numpy()] = False
        return pa.array(out)

    return clean
