"""Where rows come from: tables, directories of topics, and change capture of a database table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = "key binary, value binary, timestamp timestamp, topic string, partition int, offset long"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream_files(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet", per_batch: int | None = None, **options: str) -> DataFrame:
    """A stream of the files that appear in a folder; ``per_batch`` bounds the files of a micro-batch."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).load(path)


def zoned(df: DataFrame) -> DataFrame:
    """Times without zone as UTC instants, as watermarks need them (the session's zone must be UTC)."""
    return df.select(*(F.col(f.name).cast("timestamp").alias(f.name) if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name) for f in df.schema))


def unzoned(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name) for f in df.schema))
