"""Small metadata operations on the file system that a path names (any that Hadoop reads), through the session's JVM."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jp = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jp.getFileSystem(spark._jsc.hadoopConfiguration()), jp


def exists(spark: SparkSession, path: str) -> bool:
    fs, jp = _fs(spark, path)
    return bool(fs.exists(jp))


def size(spark: SparkSession, path: str) -> int:
    """Bytes below a folder, from the file system's metadata."""
    fs, jp = _fs(spark, path)
    return int(fs.getContentSummary(jp).getLength())


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    fs, jp = _fs(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(jp)] if fs.exists(jp) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, jp = _fs(spark, path)
    fs.delete(jp, True)


def put_once(spark: SparkSession, path: str, text: str) -> None:
    """Create a file in one step: its text is written beside it and renamed, so that no reader sees a part of it.

    An existing file is never replaced: of two writers of one name, the second gets an error."""
    fs, jp = _fs(spark, path)
    _, draft = _fs(spark, f"{path}.draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if fs.exists(jp) or not fs.rename(draft, jp):
        fs.delete(draft, False)
        raise FileExistsError(f"{path} was written by someone else")
