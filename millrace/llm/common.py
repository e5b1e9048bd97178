"""Shared folder, tables and file access for the training-data operators.

Everything that a later job reads lies below ``spark.checkpoint.dir``, the one folder that the
driver and all executors share. Where that setting is missing, a temporary folder is used in local mode
(tests), and an error is raised on a cluster. Folders stay until ``drop_folders`` removes them.
"""

from __future__ import annotations

import os
import re
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import shared_folder

#: Rows of a table that may be broadcast; a table of more rows is joined by a shuffle.
BROADCAST_ROWS = 200_000

#: Folders made by operators, newest last, so that a pipeline can drop what earlier stages left.
_made: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder; nothing is created yet."""
    ship(spark)
    path = f"{shared_folder(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def made() -> list[str]:
    return list(_made)


def drop_folders(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders made by ``new_folder``."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
        if p in _made:
            _made.remove(p)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: lineage ends there."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_or_shuffled(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a written table of narrow rows for broadcast if it has no more than ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (here, env.get("PYTHONPATH", "")) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a path or URI, for Python workers and the driver alike."""
    from pyarrow import fs

    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path) if parts.scheme else uri
    return fs.FileSystem.from_uri(uri)


def slices(batches, rows: int = 1024, size: int = 4 << 20):
    """Arrow batches in parts of at most ``rows`` rows and about ``size`` bytes (a longer row is a part of
    its own), so that a Python worker holds the objects of one part."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, rows)
            while part.num_rows > 1 and part.get_total_buffer_size() > size and part.nbytes > size:
                part = part.slice(0, max(1, min(part.num_rows // 2, part.num_rows * size // part.nbytes)))
            yield part
            at += part.num_rows


def text_column(name: str = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def column(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names`` with as many underscores before them that no column of ``df`` has one of them."""
    taken, mark = {c.lower() for c in df.columns}, "__"
    while any((mark + n).lower() in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


#: Characters for which Python's re and the tokenizers' expressions may not see the same classes.
_UNUSUAL = re.compile("[^\t\n\r -~¡-±´-¸º»¿-ſ]")


USUAL_CHARACTERS = [c for c in range(0x180) if not _UNUSUAL.match(chr(c))]


def usual(text: str) -> bool:
    """Whether ``text`` has only characters whose classes all the regular-expression engines share."""
    return _UNUSUAL.search(text) is None
