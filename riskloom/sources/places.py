"""Paths of any file system Spark knows, for code that opens files itself."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, by the session's defaults."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()


def place(path: str):
    """File system and path of a qualified path, in which names are as they are, not quoted."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(quote(path, safe="/:@"))
