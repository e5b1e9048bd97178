"""Ready programs: word counts, the doubling processor, change capture to a view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import event_ms, event_time, payload, tsv, words
from millrace.operators import aggregates, cdc, joins, partition, windows


def word_count(lines: DataFrame, text: str = "value") -> DataFrame:
    """(word, count) over all lines."""
    return aggregates.count(lines.select(F.explode(words(text)).alias("word")), "word")


def word_count_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    return word_count(lines, text).select(tsv("word", "count").alias("value"))


def event_time_words(lines: DataFrame) -> DataFrame:
    """(event_time, word) of lines ``<ms> TAB sentence``; lines without a tab are left out."""
    kept = lines.where(F.locate("\t", F.col("value")) > 0)
    return kept.select(event_time("value").alias("event_time"), F.explode(words(payload("value"))).alias("word"))


def event_time_word_count(lines: DataFrame, size: str = "5 seconds", out_of_order: str = "1 second", lateness: str = "500 milliseconds") -> DataFrame:
    df = event_time_words(lines)
    if df.isStreaming:
        df = df.withWatermark("event_time", f"{windows.millis_of(out_of_order) + windows.millis_of(lateness)} milliseconds")
    return windows.tumbling(df, ["word"], "event_time", size)


def late_demo(spark: SparkSession, base_ms: int, windows_: int = 3, per_window: int = 4, size_ms: int = 5000, seed: int = 1) -> DataFrame:
    """(arrival, value) lines of event-time demo data: ``per_window`` in each of the windows from ``base_ms``
    on and one of the first window that is late but allowed, all arriving in the order of a hash by ``seed``,
    and last of all one from the first window that is too late by any delay under the windows' length."""
    n = windows_ * per_window
    i = F.col("id")
    at = F.when(i < n, F.floor(i / per_window) * size_ms + (i % per_window * 2 + 1) * size_ms / (2 * per_window)).when(i == n, size_ms * 3 / 5).otherwise(size_ms / 50)
    text = F.when(i < n, F.concat_ws(" ", F.lit("window"), F.floor(i / per_window), F.lit("row"), i % per_window)).when(i == n, "late row").otherwise("dropped row")
    line = F.concat((F.lit(base_ms) + at).cast("long").cast("string"), F.lit("\t"), text)
    rows = spark.range(n + 2).select((i == n + 1).alias("last"), F.xxhash64(i, F.lit(seed)).alias("h"), line.alias("value"))
    # so few rows that one task may number them
    return rows.select((F.row_number().over(Window.orderBy("last", "h")) - 1).alias("arrival"), "value")


def doubled(lines: DataFrame, partitions: int | None = None) -> DataFrame:
    """(n, doubled) for values that are whole numbers of 64 bits, without white space; others are left out.

    The double wraps beyond 64 bits. With ``partitions`` also key, the original number as text, and the
    partition that this key is routed to.
    """
    n = F.when(F.col("value").rlike(r"^[+-]?[0-9]+$") & ~F.col("value").rlike(r"\s"), F.col("value").try_cast("long"))
    out = lines.select(n.alias("n")).where("n is not null").select("n", F.shiftleft("n", 1).alias("doubled"))
    return out if partitions is None else partition.route(out.withColumn("key", F.col("n").cast("string")), "key", partitions)


def changes_joined_to_view(before: DataFrame, after: DataFrame, pk: str, events: DataFrame, key: str, ts: str, changed_at: str, lower: str, upper: str) -> DataFrame:
    """Changes of a table, joined by key to events with lower <= event - change <= upper."""
    changes = cdc.diff(before, after, pk).select(F.col("key").alias(key), "op", F.col(f"after.{changed_at}").alias("changed_at")).where("op <> 'd'")
    return joins.interval_join(events.withColumn(key, F.col(key).cast("string")), changes, key, ts, "changed_at", lower, upper)


__all__ = ["changes_joined_to_view", "doubled", "event_ms", "event_time_word_count", "event_time_words", "late_demo", "word_count", "word_count_lines"]
