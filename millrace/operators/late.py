"""Late rows: the record rule on static frames, and a router for streams.

The watermark of a partition is the greatest event time seen before, less the delay (out-of-orderness
plus allowed lateness). A row is late if its time is before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import fresh
from millrace.operators.aggregates import running


def split_late(df: DataFrame, ts: str, partition: str, arrival: str, tie: str, delay: str, bucket: Column | None = None) -> DataFrame:
    """Add late: whether a row comes after its partition's watermark has passed its time.

    The order of arrival is (arrival, tie). ``bucket`` cuts a partition's rows by arrival, hours by
    default, for the running maximum.
    """
    by_hour = bucket if bucket is not None else F.date_trunc("hour", F.col(arrival))
    (most,) = fresh(df.columns, "seen")
    seen = running(df, [partition], [arrival, tie], by_hour, inclusive=False, **{most: ("max", ts)})
    late = F.coalesce(F.col(ts) < F.col(most) - F.expr(f"INTERVAL {delay}"), F.lit(False))
    return seen.withColumn("late", late).drop(most)
