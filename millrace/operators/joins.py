"""Time-bounded inner joins by key, for static frames and streams.

On static frames the join is by key and time bucket: the left row goes to the few buckets that its
interval touches, so a hot key is spread over time and never meets itself whole. On streams the same
condition is given to Spark with both watermarks, which evicts state that can't match any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import fresh
from millrace.operators.windows import millis_of


def _signed(bound: str) -> int:
    text = bound.strip()
    return -millis_of(text[1:]) if text.startswith("-") else millis_of(text)


def interval_join(a: DataFrame, b: DataFrame, key: str, a_ts: str, b_ts: str, lower: str, upper: str) -> DataFrame:
    """Pairs of equal keys with lower <= a_ts - b_ts <= upper, both ends included. Null keys and times match nothing.

    Columns of both sides must differ but for the key, which the result has once. Bounds are durations,
    with a leading ``-`` where negative.
    """
    lo, hi = _signed(lower), _signed(upper)
    if lo > hi:
        raise ValueError("lower is above upper")
    theirs, cell, at = fresh([*a.columns, *b.columns], "key", "bucket", "at")
    right = b.withColumnRenamed(key, theirs)
    low, high = (F.expr(f"INTERVAL {x} MILLISECOND") for x in (lo, hi))
    within = (F.col(a_ts) >= F.col(b_ts) + low) & (F.col(a_ts) <= F.col(b_ts) + high)
    if a.isStreaming or b.isStreaming:
        return a.join(right, (F.col(key) == F.col(theirs)) & within).drop(theirs)
    width = max(1000, hi - lo)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    bucket = lambda t: F.floor(t / F.lit(width * 1000)).cast("long")
    first, last = bucket(micros(a_ts) - hi * 1000), bucket(micros(a_ts) - lo * 1000)
    left = a.where(F.col(a_ts).isNotNull()).withColumn(cell, F.explode(F.sequence(first, last)))
    right = right.withColumn(at, bucket(micros(b_ts)))
    return left.join(right, (F.col(key) == F.col(theirs)) & (F.col(cell) == F.col(at)) & within).drop(theirs, cell, at)


def within_join(a: DataFrame, b: DataFrame, key: str, a_ts: str, b_ts: str, bound: str) -> DataFrame:
    """Symmetric join: equal keys and times at most ``bound`` apart, either way."""
    return interval_join(a, b, key, a_ts, b_ts, "-" + bound, bound)
