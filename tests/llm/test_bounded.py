from pyspark.sql import functions as F

from riskloom.llm.bounded import hash_sample, top_counts


def test_hash_sample(spark):
    df = spark.range(5000).withColumn("label", F.col("id") % 2)
    got = [r.id for r in hash_sample(df, 300, "id").collect()]
    assert len(got) == len(set(got)) == 300
    assert set(got) == {r.id for r in hash_sample(df.repartition(7), 300, "id").collect()}
    assert hash_sample(df, 9000, "id").count() == 5000 and hash_sample(df.limit(0), 10, "id").count() == 0


def test_top_counts(spark):
    df = spark.range(1, 2001).select("id", (F.col("id") * F.col("id") * 1000).alias("c"))
    assert sorted(r.id for r in top_counts(df, 100).collect()) == list(range(1901, 2001))
    # Equal counts stay together, so there may be fewer.
    same = spark.createDataFrame([(1, 9), (2, 5), (3, 5), (4, 1)], "id int, c long")
    assert [r.id for r in top_counts(same, 2).collect()] == [1]
    assert top_counts(same, 3).count() == 3 and top_counts(same, 4).count() == 4 and top_counts(same.limit(0), 4).count() == 0
