"""Change capture by comparison of snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def diff(before: DataFrame | None, after: DataFrame, pk: str) -> DataFrame:
    """Changes from one snapshot to the next: op (c, u, d), key string, before and after as structs.

    Without ``before`` every row is created. Columns are those of ``after``; one that ``before`` lacks
    was null. Rows are equal if all columns are, nulls included. Keys must be unique and not null.
    """
    names = after.columns
    if before is None:
        before = after.limit(0)
    old = before.select(*(F.col(c) if c in before.columns else F.lit(None).cast(after.schema[c].dataType).alias(c) for c in names))
    left = old.select(F.col(pk).alias("__old"), F.struct(*names).alias("before"))
    right = after.select(F.col(pk).alias("__new"), F.struct(*names).alias("after"))
    both = left.join(right, F.col("__old") == F.col("__new"), "full_outer")
    op = F.when(F.col("__old").isNull(), "c").when(F.col("__new").isNull(), "d").when(~F.col("before").eqNullSafe(F.col("after")), "u")
    key = F.coalesce(F.col("__new").cast("string"), F.col("__old").cast("string"))
    return both.select(op.alias("op"), key.alias("key"), F.when(F.col("__old").isNotNull(), F.col("before")).alias("before"), F.when(F.col("__new").isNotNull(), F.col("after")).alias("after")).where("op is not null")


def envelope(changes: DataFrame, db: str, table: str, ts_ms: Column) -> DataFrame:
    """(key, value): the change as JSON with its source; null fields are kept."""
    source = F.struct(F.lit(db).alias("db"), F.lit(table).alias("table"), ts_ms.cast("long").alias("ts_ms"))
    row = F.struct("op", "before", "after", source.alias("source"))
    return changes.select("key", F.to_json(row, {"ignoreNullFields": "false"}).alias("value"))


def normalized(df: DataFrame) -> DataFrame:
    """Bytes as strings and times as RFC 3339, as envelopes carry them."""
    from millrace.functions import rfc3339

    kinds = {f.name: f.dataType for f in df.schema}
    return df.select(*(F.col(c).cast("string").alias(c) if isinstance(k, T.BinaryType) else rfc3339(c).alias(c) if isinstance(k, (T.TimestampType, T.TimestampNTZType)) else F.col(c) for c, k in kinds.items()))


def apply_changes(changes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Upserts and tombstones of changes, for a view: key, deleted and the columns after the change."""
    return changes.select("key", (F.col("op") == "d").alias("deleted"), *(F.col(f"after.{c}").alias(c) for c in columns))
