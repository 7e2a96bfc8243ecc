"""Paths through Hadoop's file systems: whatever Spark can read, not the driver's disk."""

from __future__ import annotations

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    """(path, file system) of a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or a pattern's first match, is there."""
    at, fs = file_system(spark, path)
    found = fs.globStatus(at)
    return found is not None and len(found) > 0


def children(spark: SparkSession, path: str) -> list[str]:
    """Full paths in a folder; none if it is not there or no folder."""
    at, fs = file_system(spark, path)
    if not fs.exists(at) or not fs.getFileStatus(at).isDirectory():
        return []
    return [s.getPath().toString() for s in fs.listStatus(at)]
