"""Partitions of a log: routing, assignment, offsets, and checks of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import fresh, partition_of
from millrace.operators.aggregates import running

#: Offsets, or numbers of an order, in a bucket of the two-level sums.
BUCKET = 1 << 16


def route(df: DataFrame, key: str, n: int, counter: Column | None = None) -> DataFrame:
    """Add partition: FNV-1a of the key modulo n; rows without key go round by ``counter``."""
    return df.withColumn("partition", partition_of(key, n, counter))


def round_robin(df: DataFrame, order: str, n: int) -> DataFrame:
    """Add partition: a hash of ``order`` would do for spread; here the order's number modulo n."""
    return df.withColumn("partition", F.pmod(F.col(order), F.lit(n)).cast("int"))


def replicas(spark: SparkSession, partitions: int, brokers: list[int], factor: int = 3) -> DataFrame:
    """(partition, leader, followers): leaders in turn over the sorted broker ids, followers next in the
    ring; factor is cut to the brokers. There must be a partition and a broker."""
    if partitions < 1 or not brokers:
        raise ValueError("a topic has at least one partition and one broker")
    brokers = sorted(set(brokers))
    n = len(brokers)
    factor = max(1, min(factor, n))
    ids = F.array(*map(F.lit, brokers))
    p = spark.range(partitions).select(F.col("id").cast("int").alias("partition"))
    follower = F.transform(F.sequence(F.lit(1), F.lit(factor - 1)), lambda i: F.element_at(ids, F.pmod(F.col("partition") + i, F.lit(n)) + 1)) if factor > 1 else F.array().cast("array<int>")
    return p.select("partition", F.element_at(ids, F.pmod(F.col("partition"), F.lit(n)) + 1).alias("leader"), follower.alias("followers"))


def range_assign(partitions: DataFrame, members: int, count: int) -> DataFrame:
    """Add member: contiguous blocks of ``count`` partitions numbered from 0; the first ones get one more."""
    small, extra = divmod(count, members)
    p = F.col("partition")
    wide = extra * (small + 1)
    member = F.when(p < wide, F.floor(p / F.lit(small + 1))).otherwise(extra + F.floor((p - wide) / F.lit(max(small, 1))))
    return partitions.withColumn("member", member.cast("int"))


def bucket_of(df: DataFrame, column: str) -> Column:
    """An expression that doesn't fall as ``column`` rises: hours, days, so many numbers, a prefix."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_trunc("hour", F.col(column))
    if isinstance(kind, T.IntegralType):
        return F.floor(F.col(column) / F.lit(BUCKET))
    if isinstance(kind, T.StringType):
        return F.substring(column, 1, 3)
    return F.col(column) if isinstance(kind, T.DateType) else F.lit(0)


def with_offsets(df: DataFrame, order: list[str], bucket: Column | None = None) -> DataFrame:
    """Add offset: 0, 1, ... within each partition.

    A partition's rows are counted by bucket first, so that no task holds a partition whole. ``bucket``
    must not fall as ``order`` rises; by default it is taken from the first column of ``order``.
    """
    one, number = fresh(df.columns, "one", "offset")
    by = bucket_of(df, order[0]) if bucket is None else bucket
    counted = running(df.withColumn(one, F.lit(1)), ["partition"], order, by, inclusive=False, **{number: ("count", one)})
    return counted.withColumn("offset", F.col(number)).drop(one, number)


def gaps(log: DataFrame) -> DataFrame:
    """Rows of (partition, offset) whose offset isn't the one before plus 1 (0 for the first): adds expected."""
    (last,) = fresh(log.columns, "last")
    before = running(log, ["partition"], ["offset"], F.floor(F.col("offset") / F.lit(BUCKET)), inclusive=False, **{last: ("max", "offset")})
    return before.withColumn("expected", F.coalesce(F.col(last) + 1, F.lit(0))).drop(last).where("offset <> expected")


def next_offsets(log: DataFrame) -> DataFrame:
    return log.groupBy("partition").agg((F.max("offset") + 1).alias("next_offset"))


def read(log: DataFrame, partition: int, start: int, most: int) -> DataFrame:
    """At most ``most`` records of a partition from an offset on, in order. The offsets are contiguous,
    so the bound is a range filter that reaches the file scan."""
    return log.where((F.col("partition") == partition) & (F.col("offset") >= start) & (F.col("offset") < start + most)).orderBy("offset")


def deduplicated(log: DataFrame) -> DataFrame:
    """Replayed records (same partition and offset) once."""
    return log.dropDuplicates(["partition", "offset"])


def replica_sizes(copies: DataFrame) -> DataFrame:
    """(partition, replicas_equal) from rows (partition, replica, bytes)."""
    sizes = copies.groupBy("partition", "replica").agg(F.sum("bytes").alias("size"))
    return sizes.groupBy("partition").agg((F.min("size") == F.max("size")).alias("replicas_equal"))
