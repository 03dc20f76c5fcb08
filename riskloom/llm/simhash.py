"""Near duplicates by 64-bit SimHash fingerprints and an index in Gray order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from riskloom.llm.components import components
from riskloom.session import stage

#: Pairs of index nodes that are compared in one vectorised step.
FRONTIER = 1 << 19
#: Nodes under an upper node of the index.
FAN = 4


# --- fingerprints --------------------------------------------------------------------------------------


def fingerprint_of(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """Fingerprint of a UTF-8 text, as a signed 64-bit number; zero where there is no word."""
    # bytes.lower changes A-Z only; bytes.split cuts at x20 and x09-x0D only.
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    n, joined = min(words, len(tokens)), b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    hash_, total, count = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(tokens) - n + 1
    first, last = starts[:count].tolist(), (ends[n - 1 :] - 1).tolist()
    for at in range(0, count, 8192):
        h = np.array([hash_(joined[a:b], seed) for a, b in zip(first[at : at + 8192], last[at : at + 8192], strict=True)], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > count, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, words: int = 3, seed: int = 42) -> Column:
    """Column of fingerprints. Only the text goes to Python, in Arrow batches of bounded bytes."""

    @arrow_udf("long")
    def prints(batch: pa.Array) -> pa.Array:
        return pa.array([fingerprint_of(x.as_py(), words, seed) for x in batch], pa.int64())

    return prints(text.cast("binary"))


# --- index in Gray order -------------------------------------------------------------------------------


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each 64-bit code in the reflected Gray sequence, in which neighbours differ in one bit."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """Fingerprints sorted by Gray rank under upper nodes that hold the bits all their members share.

    ``ones`` and ``any_`` are the AND and the OR of a node's members: where they agree, the bit is part of the node's
    masked pattern. Two nodes' members differ at least in the bits in which both patterns are fixed and unequal, so a
    pair of groups is pruned as soon as these differences, which grow on the way down, exceed the radius. Where even all
    bits that are not shared cannot exceed it, the groups are joined whole.
    """

    def __init__(self, codes: np.ndarray):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        leaves = codes[self.order]
        self.ones, self.any_ = [leaves], [leaves]
        while len(self.ones[-1]) > 1:
            cut = np.arange(0, len(self.ones[-1]), FAN)
            self.ones.append(np.bitwise_and.reduceat(self.ones[-1], cut))
            self.any_.append(np.bitwise_or.reduceat(self.any_[-1], cut))

    def groups(self, radius: int, equal_bits: int = 0) -> np.ndarray:
        """Label of each given code; codes linked by steps of at most ``radius`` bits have one label.

        Steps that change any of the first ``equal_bits`` bits do not count.
        """
        head_bits = np.uint64(((1 << equal_bits) - 1) << (64 - equal_bits))
        n = len(self.order)
        label = np.arange(n)
        low, high = self._spans(label)
        stack = [(len(self.ones) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))] if n else []
        while stack:
            level, a, b = stack.pop()
            if len(a) > FRONTIER:
                stack += [(level, a[FRONTIER:], b[FRONTIER:])]
                a, b = a[:FRONTIER], b[:FRONTIER]
            # Groups that already are one component have nothing to add.
            open_ = (low[level][a] != high[level][a]) | (low[level][b] != high[level][b]) | (low[level][a] != low[level][b])
            a, b = a[open_], b[open_]
            ones_a, ones_b = self.ones[level][a], self.ones[level][b]
            loose = (ones_a ^ self.any_[level][a]) | (ones_b ^ self.any_[level][b])
            differ = (ones_a ^ ones_b) & ~loose
            least = np.bitwise_count(differ)
            near = (least <= radius) & (differ & head_bits == 0)
            a, b, loose, least = a[near], b[near], loose[near], least[near]
            whole = (least + np.bitwise_count(loose) <= radius) & (loose & head_bits == 0)
            if whole.any():
                size = FAN**level
                step = np.arange(size)
                left, right = (np.minimum(x[whole][:, None] * size + step, n - 1).ravel() for x in (a, b))
                head = np.repeat(a[whole] * size, size)
                label = _merge(label, np.concatenate((head, head)), np.concatenate((left, right)))
                low, high = self._spans(label)
                a, b = a[~whole], b[~whole]
            if level and len(a):
                width = len(self.ones[level - 1])
                i, j = (x.ravel() for x in np.broadcast_arrays(a[:, None, None] * FAN + np.arange(FAN)[:, None], b[:, None, None] * FAN + np.arange(FAN)))
                real = (i < width) & (j < width) & (i <= j)
                i, j = i[real], j[real]
                inner = i == j
                stack += [(level - 1, i[~inner], j[~inner]), (level - 1, i[inner], j[inner])]
        out = np.empty(n, np.int64)
        out[self.order] = label
        return out

    def _spans(self, label: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        low, high = [label], [label]
        for nodes in self.ones[1:]:
            cut = np.arange(0, len(low[-1]), FAN)[: len(nodes)]
            low.append(np.minimum.reduceat(low[-1], cut))
            high.append(np.maximum.reduceat(high[-1], cut))
        return low, high


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining the components of ``i`` and ``j`` pairwise."""
    label = label.copy()
    while True:
        x, y = label[i], label[j]
        apart = x != y
        if not apart.any():
            return label
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


# --- links between partitions --------------------------------------------------------------------------


def _links(radius: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not got:
            return
        fp, block = (np.concatenate(x) for x in zip(*got, strict=True))
        for i in np.unique(block):
            # Turned so that the block that all members of a bucket share comes first.
            turn, back = np.uint64(i * width), np.uint64((64 - i * width) % 64)
            codes = np.unique(fp[block == i]).view(np.uint64)
            index = GrayIndex((codes << turn) | (codes >> back if i else np.uint64(0)))
            label = index.groups(radius, width)
            signed = codes.view(np.int64)
            head = signed[index.order][label]
            far = head != signed
            yield pa.RecordBatch.from_arrays([pa.array(signed[far]), pa.array(head[far])], ["u", "v"])

    return run


def link_prints(prints: DataFrame, radius: int = 3, hot_rows: int = 1_000_000) -> DataFrame:
    """``prints(fp)`` of distinct fingerprints -> ``(u, v)``: links whose components are those of all pairs within ``radius``.

    Two fingerprints within ``radius`` bits agree in one of ``radius + 1`` blocks of bits at least, so each is dealt to the
    task of each of its blocks, and each task indexes what it got in Gray order. A block value that more than ``hot_rows``
    fingerprints share is dealt anew by its other bits, by the same rule. Tasks return a spanning star of each local
    component, never all its pairs.
    """
    parts = radius + 1
    width = 64 // parts

    def block(i: int) -> Column:
        return F.shiftrightunsigned("fp", 64 - (i + 1) * width).bitwiseAND(F.lit((1 << width) - 1))

    dealt = prints.withColumn("t", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), block(i).alias("k")) for i in range(parts)]))).select("fp", F.col("t.i").alias("i"), F.col("t.k").alias("k"))
    hot = dealt.groupBy("i", "k").count().where(F.col("count") > hot_rows).select("i", "k", F.lit(True).alias("hot"))
    dealt = dealt.join(hot, ["i", "k"], "left")
    # The bits outside the block, cut again into blocks of which one at least agrees.
    rest = [(i, [b for b in range(64) if not 64 - (i + 1) * width <= b < 64 - i * width]) for i in range(parts)]
    bits = {i: [r[j * len(r) // parts : (j + 1) * len(r) // parts] for j in range(parts)] for i, r in rest}
    masks = F.array(*[F.array(*[F.lit(_signed(sum(1 << b for b in part))) for part in bits[i]]) for i in range(parts)])
    spread = F.transform(masks[F.col("i")], lambda m, j: F.struct(j.alias("j"), F.col("fp").bitwiseAND(m).alias("s")))
    whole = F.array(F.struct(F.lit(-1).alias("j"), F.lit(0).cast("long").alias("s")))
    dealt = dealt.withColumn("x", F.explode(F.when(F.col("hot"), spread).otherwise(whole))).select("fp", "i", "k", "x.j", "x.s")
    return dealt.repartition("i", "k", "j", "s").select("fp", "i").mapInArrow(_links(radius, width), "u long, v long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def classes(rows: DataFrame, radius: int = 3) -> DataFrame:
    """``rows(fp, ...)`` -> the same rows with ``class``, one value for all fingerprints that reach each other."""
    roots = components(link_prints(rows.select("fp").distinct(), radius))
    return rows.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("class", F.coalesce("root", "fp")).drop("root")


# --- operators -----------------------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, id_: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """One row ``(<id>, fingerprint, component_id)`` for each row of ``docs``; ``component_id`` is the smallest id reachable.

    A null text counts as an empty one, and texts without words have fingerprint zero and are linked like any other.
    Rows with a null id are kept and linked; they never name a component unless it has no other id (then null).
    Repeated rows are returned as often as they come. Other columns are ignored, whatever their names.
    """
    rows = stage(docs.select(F.col(id_).alias("id"), fingerprint(F.col(text), words).alias("fp")), "simhash")
    least = rows.groupBy("fp").agg(F.min("id").alias("least"))
    named = classes(least, radius)
    names = named.groupBy("class").agg(F.min("least").alias("component_id"))
    by_print = named.select("fp", "class").join(names, "class").select("fp", "component_id")
    return rows.join(by_print, "fp").select(F.col("id").alias(id_), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """Rows of ``docs``, one for each group of near duplicates: that of the smallest id (nulls last, then by a digest of the text).

    All columns stay as they are. Empty and null texts form one group, as they have one fingerprint. Rows that repeat in id
    and text count as one row; any of them stays. Only ids, digests and fingerprints are written in between.
    """
    digest = F.xxhash64(F.col(text))
    prints = docs.select(F.col(id_).alias("id"), digest.alias("digest"), fingerprint(F.col(text), words).alias("fp"))
    rows = stage(prints.groupBy("id", "digest", "fp").agg(F.count("*").alias("n")), "keep-prints")
    least = classes(rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest", "n")).alias("first")), radius)
    kept = stage(least.groupBy("class").agg(F.min("first").alias("first")).select("first.id", "first.digest", "first.n"), "keep-rows")
    keyed = docs.select(F.struct("*").alias("row"), F.col(id_).alias("_id"), digest.alias("_digest"))
    joined = keyed.join(kept, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_digest") == F.col("digest")))
    once = joined.where("n = 1").select("row.*")
    if kept.where("n > 1").isEmpty():
        return once
    return once.union(joined.where("n > 1").groupBy("id", "digest").agg(F.first("row").alias("row")).select("row.*"))
