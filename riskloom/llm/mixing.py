"""Mixing sources to target weights by temperature, as block permutations of bounded budgets. DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.session import stage

#: A token is a run of what is not white space.
TOKEN = r"[^\x20\x09-\x0D]+"
#: Halvings of an interval that one aggregate settles: all midpoints they may need are measured together.
LEVELS, PASSES = 4, 10


@dataclass(frozen=True)
class MixConfig:
    #: Entropy of the weights to reach, as a share of that of equal weights.
    entropy: float = 0.99
    #: Most often that a source's tokens may be repeated; this limit comes before the entropy.
    repeats: float = 1.5
    #: Tokens of the mixture; by default so many that the least repeated source comes just once.
    budget: float | None = None
    #: Tokens of a block, in which every source has its weight.
    block_tokens: int = 1 << 20
    seed: int = 11


def count_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """Null is a source of its own, apart from the empty name."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source.cast("string")))


def bisect_exponent(sizes: DataFrame, config: MixConfig) -> float:
    """Exponent in [0, 1] of the shares of ``sizes(tokens)``: the largest that reaches the entropy, raised to where the repeats keep their limit.

    Both curves fall as the exponent grows. Each pass is one aggregate over the sources, which returns one row of sums.
    """
    total, least, most, n = sizes.where("tokens > 0").agg(F.sum("tokens"), F.min("tokens"), F.max("tokens"), F.count("*")).first()
    if n < 2 or least == most:
        return 1.0
    share = F.col("tokens") / F.lit(float(total))
    low, high = float(least) / total, float(most) / total

    def measure(points: list[float]) -> dict[float, tuple[float, float]]:
        sums = [c for a in points for c in (F.sum(F.pow(share, F.lit(a))), F.sum(F.pow(share, F.lit(a)) * F.log(share)))]
        got = sizes.where("tokens > 0").agg(*[c.alias(f"c{i}") for i, c in enumerate(sums)]).first()
        return {a: (got[2 * i], got[2 * i + 1]) for i, a in enumerate(points)}

    def enough(a: float, z: float, s: float) -> bool:
        return math.log(z) - a * s / z >= config.entropy * math.log(n)

    def repeated(a: float, z: float) -> float:
        return (high / low) ** (1 - a) if config.budget is None else config.budget / total * low ** (a - 1) / z

    mixed, kept = [0.0, 1.0], [0.0, 1.0]  # entropy reached at the first end; repeats within the limit at the second
    for _ in range(PASSES):
        points = sorted({lo + (hi - lo) * k / 2**LEVELS for lo, hi in (mixed, kept) for k in range(2**LEVELS + 1)})
        at = measure(points)
        for ends, goes_up in ((mixed, lambda a: enough(a, *at[a])), (kept, lambda a: repeated(a, at[a][0]) > config.repeats)):
            lo, hi = ends
            grid, i, j = [lo + (hi - lo) * k / 2**LEVELS for k in range(2**LEVELS + 1)], 0, 2**LEVELS
            if goes_up(grid[j]):
                i = j
            while j - i > 1:
                mid = (i + j) // 2
                i, j = (mid, j) if goes_up(grid[mid]) else (i, mid)
            ends[:] = [grid[i], grid[max(i, j)]]
    return max(mixed[0], kept[1])


@dataclass(frozen=True)
class Mixture:
    #: One row for each source: key, tokens, weight, whole epochs, quota of the epoch after them.
    sources: DataFrame
    #: One row for each distinct document and epoch it is in: key, id, digest, tokens, copies, epoch, before, order.
    epochs: DataFrame
    exponent: float
    budget: float


def _order(id_: Column, digest: Column, epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_.cast("string"), F.lit("")), digest, epoch.cast("string")).cast("binary"))


def mix(docs: DataFrame, source: str = "source", text: str = "text", id_: str = "doc_id", config: MixConfig | None = None) -> Mixture:
    """Weights and epochs of the sources of ``docs``.

    A source's stream is one permutation of its documents after the other, cut at its share of the budget; the cut is where
    a running sum over the permutation passes the quota. Permutations are orders of a seeded digest; their running sums are
    taken in 4,096 ranges of the digest for each source and epoch, so no source meets in one task. Rows that repeat in id and
    text are counted before anything is shuffled and stand together in the order.
    A null text has no tokens; documents without tokens are in every whole epoch. A source without any tokens comes once.
    """
    config = config or MixConfig()
    digest = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    rows = docs.select(_key(F.col(source)).alias("key"), F.col(id_).alias("id"), digest.alias("digest"), count_tokens(F.col(text)).alias("tokens"))
    rows = stage(rows.groupBy("key", "id", "digest", "tokens").agg(F.count("*").alias("copies")), "mix-rows")
    sizes = stage(rows.groupBy("key").agg(F.sum(F.col("tokens") * F.col("copies")).alias("total")), "mix-sizes")
    plain = sizes.select(F.col("total").alias("tokens"))
    alpha = bisect_exponent(plain, config)
    total, most = plain.agg(F.sum("tokens"), F.max("tokens")).first()
    total, most = float(total or 0), float(most or 0)
    z = plain.where("tokens > 0").agg(F.sum(F.pow(F.col("tokens") / F.lit(total or 1.0), F.lit(alpha)))).first()[0] or 1.0
    budget = config.budget if config.budget is not None else (most / ((most / total) ** alpha / z) if total else 0.0)
    weight = F.when(F.col("total") > 0, F.pow(F.col("total") / F.lit(total or 1.0), F.lit(alpha)) / F.lit(z)).otherwise(0.0)
    turns = F.when(F.col("total") > 0, F.col("weight") * F.lit(budget) / F.col("total")).otherwise(1.0)
    sources = sizes.withColumn("weight", weight).withColumn("turns", turns).withColumn("whole", F.floor(F.col("turns") + 1e-9))
    rest = F.col("turns") - F.col("whole")
    sources = sources.withColumn("quota", F.when(rest > 1e-9, rest * F.col("total")).otherwise(0.0)).drop("turns")
    # One row for each document and epoch; the epoch after the whole ones only where it has a quota.
    last = F.col("whole") - F.when(F.col("quota") > 0, 0).otherwise(1)
    spread = rows.join(sources, "key").withColumn("epoch", F.explode(F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last)).otherwise(F.array().cast("array<long>"))))
    spread = spread.withColumn("order", _order(F.col("id"), F.col("digest"), F.col("epoch"), config.seed)).withColumn("range", F.substring("order", 1, 3))
    group = ["key", "epoch", "range"]
    ranges = spread.groupBy(*group).agg(F.sum(F.col("tokens") * F.col("copies")).alias("sum"))
    ranges = ranges.withColumn("offset", F.sum("sum").over(W.partitionBy("key", "epoch").orderBy("range").rowsBetween(W.unboundedPreceding, -1))).drop("sum")
    inside = F.sum(F.col("tokens") * F.col("copies")).over(W.partitionBy(*group).orderBy("order", "id", "digest").rowsBetween(W.unboundedPreceding, -1))
    epochs = spread.withColumn("inside", inside).join(ranges, group)
    epochs = epochs.withColumn("before", (F.coalesce("inside", F.lit(0)) + F.coalesce("offset", F.lit(0))).cast("long"))
    epochs = epochs.where((F.col("epoch") < F.col("whole")) | (F.col("before") < F.col("quota"))).drop("inside", "offset", "range")
    return Mixture(sources, epochs, alpha, budget)


def schedule(mixture: Mixture, config: MixConfig | None = None) -> DataFrame:
    """``(key, id, tokens, weight, epoch, block, position)``: the block of each copy, and its place in the block's permutation.

    A source's stream goes through the blocks at its weight, so every block holds about ``block_tokens`` tokens in the
    weights' proportions. A block is bounded whatever the sources, and is permuted in one task by the seeded digest.
    """
    config = config or MixConfig()
    blocks = max(1, math.ceil(mixture.budget / config.block_tokens - 1e-9))
    copies = mixture.epochs.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    start = F.col("epoch") * F.col("total") + F.col("before") + F.col("copy") * F.col("tokens")
    spread = F.conv(F.substring("order", 4, 8), 16, 10).cast("long") % blocks
    block = F.when(F.col("total") > 0, F.least(F.lit(blocks - 1).cast("long"), F.floor(start / (F.col("weight") * F.lit(float(config.block_tokens)))))).otherwise(spread)
    out = copies.withColumn("block", block)
    place = F.row_number().over(W.partitionBy("block").orderBy("order", "copy", "key", "id", "digest")) - 1
    return out.withColumn("position", place.cast("long")).select("key", "id", "tokens", "weight", "epoch", "block", "position")


def mixed_rows(docs: DataFrame, mixture: Mixture, source: str = "source", text: str = "text", id_: str = "doc_id", config: MixConfig | None = None) -> DataFrame:
    """Rows of ``docs``, each as often as the mixture has it, with the columns they have. No text is shuffled.

    What decides is the source's number of whole epochs and the last digest of its cut epoch: one row for each source. A null source
    is a source of its own; null and empty texts have no tokens and come as often as their source; repeated rows come each; an
    empty table gives an empty one.
    """
    config = config or MixConfig()
    cut = mixture.epochs.where(F.col("epoch") >= F.col("whole")).groupBy("key").agg(F.max("order").alias("cut"))
    rule = stage(mixture.sources.join(cut, "key", "left").select("key", "whole", "cut"), "mix-rule")
    digest = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    keyed = docs.select(F.struct("*").alias("row"), _key(F.col(source)).alias("key"), F.col(id_).alias("id"), digest.alias("digest"))
    keyed = keyed.join(rule, "key")
    more = F.coalesce(_order(F.col("id"), F.col("digest"), F.col("whole"), config.seed) <= F.col("cut"), F.lit(False)).cast("long")
    times = F.col("whole") + more
    return keyed.where(times > 0).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), times))).select("row.*")


#: The schedule of ``documents`` with the default settings.
ORACLE = r"""
WITH RECURSIVE docs AS (
  SELECT CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS key, doc_id AS id, md5(coalesce(text, '')) AS digest,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens
  FROM documents),
rows_ AS (SELECT key, id, digest, tokens, count(*) AS copies FROM docs GROUP BY ALL),
sizes AS (SELECT key, CAST(sum(tokens * copies) AS DOUBLE) AS total FROM rows_ GROUP BY key),
facts AS (SELECT list(total / t ORDER BY key) AS ps, max(t) AS t, min(total) / max(t) AS low, max(total) / max(t) AS high, count(*) AS n
          FROM sizes, (SELECT sum(total) AS t FROM sizes) WHERE total > 0),
bis AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS e0, CAST(1 AS DOUBLE) AS e1, CAST(0 AS DOUBLE) AS r0, CAST(1 AS DOUBLE) AS r1 FROM facts
  UNION ALL
  SELECT i + 1,
    CASE WHEN up THEN (e0 + e1) / 2 ELSE e0 END, CASE WHEN up THEN e1 ELSE (e0 + e1) / 2 END,
    CASE WHEN more THEN (r0 + r1) / 2 ELSE r0 END, CASE WHEN more THEN r1 ELSE (r0 + r1) / 2 END
  FROM (SELECT bis.*,
          ln(list_sum(list_transform(ps, lambda p: pow(p, (e0 + e1) / 2))))
            - (e0 + e1) / 2 * list_sum(list_transform(ps, lambda p: pow(p, (e0 + e1) / 2) * ln(p))) / list_sum(list_transform(ps, lambda p: pow(p, (e0 + e1) / 2)))
            >= CAST(0.99 AS DOUBLE) * ln(n) AS up,
          pow(high / low, 1 - (r0 + r1) / 2) > CAST(1.5 AS DOUBLE) AS more
        FROM bis, facts WHERE i < 40)),
alpha AS (
  SELECT CASE WHEN n < 2 OR low = high THEN CAST(1 AS DOUBLE)
    ELSE greatest(CASE WHEN -list_sum(list_transform(ps, lambda p: p * ln(p))) >= CAST(0.99 AS DOUBLE) * ln(n) THEN CAST(1 AS DOUBLE) ELSE e0 END, r1) END AS a
  FROM bis, facts WHERE i = 40),
norm AS (SELECT a, t, list_sum(list_transform(ps, lambda p: pow(p, a))) AS z, high FROM alpha, facts),
sources AS (
  SELECT key, total, pow(total / t, a) / z AS weight, high * t / (pow(high, a) / z) AS budget FROM sizes, norm WHERE total > 0),
turned AS (SELECT *, floor(weight * budget / total + 1e-9) AS whole, weight * budget / total AS turns FROM sources),
quotas AS (SELECT *, CASE WHEN turns - whole > 1e-9 THEN (turns - whole) * total ELSE 0 END AS quota FROM turned),
spread AS (
  SELECT r.*, q.total, q.weight, q.budget, q.whole, q.quota, CAST(e.epoch AS BIGINT) AS epoch,
         md5('11:' || coalesce(CAST(id AS VARCHAR), '') || ':' || digest || ':' || CAST(CAST(e.epoch AS BIGINT) AS VARCHAR)) AS ord
  FROM rows_ r JOIN quotas q USING (key), unnest(range(0, CAST(whole AS BIGINT) + CASE WHEN quota > 0 THEN 1 ELSE 0 END)) AS e(epoch)),
placed AS (
  SELECT *, coalesce(sum(tokens * copies) OVER (PARTITION BY key, epoch ORDER BY ord, id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM spread),
taken AS (
  SELECT *, CAST(c.copy AS BIGINT) AS cp,
    least(greatest(1, ceil(budget / 1048576 - 1e-9)) - 1, floor((epoch * total + before + c.copy * tokens) / (weight * 1048576))) AS block
  FROM placed, unnest(range(0, copies)) AS c(copy) WHERE epoch < whole OR before < quota)
SELECT id AS doc_id, CASE WHEN key = '-' THEN NULL ELSE substr(key, 2) END AS source, tokens, round(weight, 9) AS weight, epoch, CAST(block AS BIGINT) AS block,
  row_number() OVER (PARTITION BY block ORDER BY ord, cp, key, id, digest) - 1 AS position
FROM taken
"""
