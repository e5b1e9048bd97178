"""Event-time windows: tumbling, sliding (with gaps too) and session, with any aggregates.

On streams the frame's watermark closes windows; allowed lateness is part of the watermark's delay.
Bounds come as columns win_start and win_end. Rows without an event time belong to no window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def _aggregates(aggs: Sequence[Column]) -> list[Column]:
    return list(aggs) or [F.count("*").alias("count")]


def _grouped(df: DataFrame, keys: Sequence[str], window: Column, aggs: Sequence[Column]) -> DataFrame:
    out = df.groupBy(*keys, window.alias("__w")).agg(*_aggregates(aggs))
    rest = [c for c in out.columns if c not in {*keys, "__w"}]
    return out.select(*keys, F.col("__w.start").alias("win_start"), F.col("__w.end").alias("win_end"), *rest)


def millis_of(duration: str) -> int:
    """Milliseconds of a duration such as ``5 seconds`` or ``1 hour 30 minutes``."""
    units = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000, "week": 604_800_000}
    parts, total = duration.lower().split(), 0
    if not parts or len(parts) % 2:
        raise ValueError(f"not a duration: {duration!r}")
    for n, unit in zip(parts[::2], parts[1::2], strict=True):
        total += int(n) * units[unit.rstrip("s")]
    return total


def _positive(*durations: str) -> None:
    for d in durations:
        if millis_of(d) <= 0:
            raise ValueError(f"a window's duration must be positive: {d!r}")


def tumbling(df: DataFrame, keys: Sequence[str], ts: str, size: str, *aggs: Column) -> DataFrame:
    """Windows [floor(ts/size)*size, +size), times before 1970 too; by default the count of rows."""
    _positive(size)
    return _grouped(df, keys, F.window(ts, size), aggs)


def sliding(df: DataFrame, keys: Sequence[str], ts: str, size: str, slide: str, *aggs: Column) -> DataFrame:
    """Windows that start at every multiple of ``slide``. With slide > size there are gaps between windows,
    and rows in gaps belong to none."""
    _positive(size, slide)
    if millis_of(slide) <= millis_of(size):
        return _grouped(df, keys, F.window(ts, size, slide), aggs)
    inside = F.col(ts) < F.window(ts, slide)["start"] + F.expr(f"INTERVAL {millis_of(size)} MILLISECOND")
    out = _grouped(df.where(inside), keys, F.window(ts, slide), aggs)
    return out.withColumn("win_end", F.col("win_start") + F.expr(f"INTERVAL {millis_of(size)} MILLISECOND"))


def session(df: DataFrame, keys: Sequence[str], ts: str, gap: str, *aggs: Column) -> DataFrame:
    """Sessions that merge while the next row is at most ``gap`` after; a session ends ``gap`` after its last row."""
    _positive(gap)
    return _grouped(df, keys, F.session_window(ts, gap), aggs)


def top_per_window(counts: DataFrame, k: int, by: str, tie: str) -> DataFrame:
    """The k rows of each window with the greatest ``by``, ties by ``tie``; adds rank. The window's rows are
    first cut down per task (a window group limit), so no task holds a whole window."""
    from pyspark.sql import Window

    order = Window.partitionBy("win_start", "win_end").orderBy(F.desc(by), tie)
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
