"""One document of each group of near duplicates, by exact Jaccard similarity of word shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.superminhash import NearConfig, classes
from riskloom.session import stage


def keep_one_similar(docs: DataFrame, id_: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, radius: int = 3) -> DataFrame:
    """Rows of ``docs``, one for each group of texts linked by a Jaccard similarity of ``percent`` or more of their word shingles.

    Texts whose SimHash fingerprints lie within ``radius`` bits, found in the Gray index, are compared first; SuperMinHash bands find the
    pairs that are similar enough but further apart. Either only proposes: links are confirmed on whole sets.
    The row of the smallest id stays (nulls last, then by a digest of the text), with all its columns. Empty and null texts, and those
    without words, form one group. Rows that repeat in id and text count as one row; any of them stays. An empty table stays empty.
    """
    rows, parts = classes(docs, NearConfig(words=words, percent=percent), id_, text, radius)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("first")
    kept = parts.groupBy("class").agg(first).select("first.id", "first.digest")
    wordless = rows.where("sid is null").agg(first).where("first is not null").select("first.id", "first.digest")
    kept = kept.union(wordless)
    digest = F.xxhash64(F.col(text))
    prints = rows.groupBy(F.col("id").alias("_id"), F.col("digest").alias("_digest")).agg(F.count("*").alias("n"))
    kept = stage(prints.join(kept, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_digest") == F.col("digest"))).select("id", "digest", "n"), "similar-rows")
    whole = docs.select(F.struct("*").alias("row"), F.col(id_).alias("_id"), digest.alias("_digest"))
    joined = whole.join(kept, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_digest") == F.col("digest")))
    once = joined.where("n = 1").select("row.*")
    if kept.where("n > 1").isEmpty():
        return once
    return once.union(joined.where("n > 1").groupBy("id", "digest").agg(F.first("row").alias("row")).select("row.*"))
