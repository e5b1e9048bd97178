"""Files and folders through the Hadoop file system, as Spark itself reads them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _at(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def move(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder. False, and nothing moved, if the target is there already."""
    fs, p = _at(spark, source)
    q = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs.mkdirs(q.getParent())
    return not fs.exists(q) and fs.rename(p, q)


def commit(df: DataFrame, root: str, name: str, *by: str, extra: dict[str, str] | None = None) -> bool:
    """Write ``df`` as ``root/name`` in one step, or not at all if that is there: readers see whole folders
    only, and a try that is run again changes nothing. Unfinished tries lie in ``root/_staging``, which
    readers pass over. ``extra``: text files beside the data, of names that begin with an underscore."""
    spark, target = df.sparkSession, f"{root}/{name}"
    if exists(spark, target):
        return False
    staged = f"{root}/_staging/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(staged)
    for file, text in (extra or {}).items():
        write_text(spark, f"{staged}/{file}", text)
    moved = move(spark, staged, target)
    if not moved:
        delete(spark, staged)
    if not names(spark, f"{root}/_staging"):
        delete(spark, f"{root}/_staging")
    return moved
