"""Session construction and reliable staging of intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import RDD, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "riskloom", cores: str | None = None, **conf: str) -> SparkSession:
    """Local session for tests and the bench; on a cluster pass the cluster's own session instead."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Call-site capture for every Column costs more than planning these queries.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_STAGE_ROOT: str | None = None


def stage_root(spark: SparkSession) -> str:
    """Shared folder for staged tables: ``spark.checkpoint.dir``; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    global _LOCAL_STAGE_ROOT
    if _LOCAL_STAGE_ROOT is None:
        _LOCAL_STAGE_ROOT = tempfile.mkdtemp(prefix="riskloom-")
    return _LOCAL_STAGE_ROOT


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage with a table that survives executor loss. Needed wherever a value
    depends on the physical partition (range bounds are sampled anew in each execution).
    """
    spark = df.sparkSession
    path = f"{stage_root(spark)}/riskloom-stages/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    _STAGES.append(path)
    return spark.read.schema(df.schema).parquet(path)


_STAGES: list[str] = []


def clear_stages(spark: SparkSession, keep: int = 0) -> None:
    """Delete the tables this process staged (all but the first ``keep``); results read from them are then gone."""
    while len(_STAGES) > keep:
        delete(spark, _STAGES.pop())


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system Spark knows; one that is not there is left alone."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def staged(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """A staged table for the length of a block; for loops that would otherwise pile them up."""
    out = stage(df, name)
    path = _STAGES.pop()
    try:
        yield out
    finally:
        delete(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Staged tables of a block are deleted at its end, but for those staged by the function it is given."""
    before, kept = len(_STAGES), []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = stage(df, name)
        kept.append(_STAGES.pop())
        return out

    try:
        yield keep
    finally:
        clear_stages(spark, before)
        _STAGES.extend(kept)


@contextmanager
def saved(spark: SparkSession, name: str) -> Iterator[Callable[[RDD], RDD]]:
    """A function that writes an RDD once to the shared folder and reads it back; what it wrote is deleted at the end of the block."""
    paths = []

    def save(rdd: RDD) -> RDD:
        paths.append(f"{stage_root(spark)}/riskloom-stages/{name}-{uuid.uuid4().hex}")
        rdd.saveAsPickleFile(paths[-1])
        return spark.sparkContext.pickleFile(paths[-1], rdd.getNumPartitions())

    try:
        yield save
    finally:
        for path in paths:
            delete(spark, path)


def side_by_side(spark: SparkSession, tasks: Sequence[Callable], workers: int = 4) -> list:
    """Run independent small fits at the same time; each alone leaves most of the cluster idle."""
    if len(tasks) < 2:
        return [t() for t in tasks]
    with ThreadPoolExecutor(min(workers, len(tasks))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(t)) for t in tasks]]
