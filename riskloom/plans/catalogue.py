"""All registered queries. Importing the query modules registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.plans import data_queries, io_queries, model_queries, online_queries  # noqa: F401
from riskloom.plans.registry import ORACLES, QUERIES, Query


def _in_utc(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {name: _in_utc(fn) for name, fn in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
