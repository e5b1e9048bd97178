"""Keyed aggregation: changelogs, reductions, latest values, shards.

Running values of a key are prefix sums in two levels: within (key, time bucket), and over the key's
buckets, of which there is a row each. A hot key is thereby split over time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import fresh

_LEVELS: dict[str, tuple[Callable, Callable]] = {
    "count": (F.sum, lambda before, here: F.coalesce(before, F.lit(0)) + here),
    "sum": (F.sum, lambda before, here: F.coalesce(before + here, here, before)),
    "max": (F.max, lambda before, here: F.greatest(before, here)),
    "min": (F.min, lambda before, here: F.least(before, here)),
}


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, inclusive: bool = True, **values: tuple[str, str]) -> DataFrame:
    """Add running values by key in ``order``; ``values``: name=(count, sum, max or min, column).

    ``bucket`` must not fall as ``order`` rises. With ``inclusive`` false the row itself doesn't count.
    """
    first = {"count": F.count, "sum": F.sum, "max": F.max, "min": F.min}
    here, there, *own = fresh(df.columns, "b", "bb", *(f"k{i}" for i in range(len(keys))), *(f"v_{n}" for n in values))
    theirs, kept = own[: len(keys)], dict(zip(values, own[len(keys) :], strict=True))
    rows = df.withColumn(here, bucket)
    parts = rows.groupBy(*keys, here).agg(*(first[k](c).alias(kept[n]) for n, (k, c) in values.items()))
    over_buckets = Window.partitionBy(*keys).orderBy(here).rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(*(F.col(k).alias(t) for k, t in zip(keys, theirs, strict=True)), F.col(here).alias(there), *(_LEVELS[k][0](kept[n]).over(over_buckets).alias(kept[n]) for n, (k, _) in values.items()))
    same = F.col(here).eqNullSafe(F.col(there))
    for k, t in zip(keys, theirs, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(t))
    inside = Window.partitionBy(*keys, here).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    joined = rows.join(before, same)
    return joined.select(*df.columns, *(_LEVELS[k][1](F.col(kept[n]), first[k](c).over(inside)).alias(n) for n, (k, c) in values.items()))


def running_count(df: DataFrame, key: str, order: Sequence[str], bucket: Column, name: str = "count") -> DataFrame:
    """Changelog of counts: each row with the count of its key so far."""
    (one,) = fresh(df.columns, "one")
    return running(df.withColumn(one, F.lit(1)), [key], order, bucket, **{name: ("count", one)}).drop(one)


def count(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("count"))


def reduce(df: DataFrame, key: str, order: Sequence[str], init: Callable, step: Callable, schema: str, combine: Callable | None = None, changelog: bool = False, salts: int = 16) -> DataFrame:
    """Fold the rows of each key, in order, with Python functions: acc = init(row), then step(acc, row).

    Rows with a null key are a key of their own. ``schema`` is that of (key, value); a row is a named tuple of the input's columns. Rows of a task
    are sorted by key and order and folded one after another, so memory doesn't depend on a key's rows.
    An opaque fold can't be split; give ``combine(acc, acc)`` if order doesn't matter, and keys are
    folded in ``salts`` parts first. ``changelog`` emits the value after every row.
    """
    if df.schema[key].dataType.typeName() not in ("string", "binary"):
        # pandas would turn numbers into floats, and nulls into values that equal nothing: keys go as text
        kind = df.schema[key].dataType
        name = schema.split(",")[0].split()[0]
        (as_text,) = fresh(df.columns, "key")
        text = reduce(df.withColumn(as_text, F.col(key).cast("string")), as_text, order, init, step, ",".join([f"{name} string", *schema.split(",")[1:]]), combine, changelog, salts)
        return text.withColumn(name, F.col(name).cast(kind))
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [x.strip().split()[0] for x in schema.split(",")]

    def folded(begin: Callable, go: Callable, every: bool, place: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(batches):
            at, acc, open_ = None, None, False
            for batch in batches:
                keys, values = [], []
                for row in batch.itertuples(index=False):
                    k = None if row[place] is None or row[place] != row[place] else row[place]
                    if open_ and k == at:
                        acc = go(acc, row)
                    else:
                        if open_ and not every:
                            keys.append(at)
                            values.append(acc)
                        at, acc, open_ = k, begin(row), True
                    if every:
                        keys.append(at)
                        values.append(acc)
                if keys:
                    yield pd.DataFrame({names[0]: keys, names[1]: values})
            if open_ and not every:
                yield pd.DataFrame({names[0]: [at], names[1]: [acc]})

        return run

    place = df.columns.index(key)
    if combine is None or changelog:
        return df.repartition(n, key).sortWithinPartitions(key, *order).mapInPandas(folded(init, step, changelog, place), schema)
    (salt,) = fresh(df.columns, "salt")
    salted = df.withColumn(salt, F.pmod(F.xxhash64(*order), F.lit(salts)))
    # parts of a key that meet in one task are folded together: ``combine`` gives the same either way
    part = salted.repartition(n, key, salt).sortWithinPartitions(key, *order).drop(salt).mapInPandas(folded(init, step, False, place), schema)
    merge = folded(lambda row: row[1], lambda acc, row: combine(acc, row[1]), False, 0)
    return part.repartition(n, names[0]).sortWithinPartitions(names[0]).mapInPandas(merge, schema)


def latest(df: DataFrame, keys: Sequence[str], order: Column | str, *values: str) -> DataFrame:
    """The values of each key's last row by ``order``; partial maxima first, so no key is gathered."""
    by = F.col(order) if isinstance(order, str) else order
    (last,) = fresh(df.columns, "v")
    out = df.groupBy(*keys).agg(F.max_by(F.struct(*values), by).alias(last))
    return out.select(*keys, *(F.col(last)[v].alias(v) for v in values))


def shard_counts(df: DataFrame, shard: Column, key: str) -> DataFrame:
    """Partial counts by (shard, key), as separate workers would keep."""
    return df.groupBy(shard.cast("int").alias("shard"), key).agg(F.count("*").alias("count"))


def total(parts: DataFrame, *keys: str, value: str = "count") -> DataFrame:
    """Sum of partial values over shards."""
    return parts.groupBy(*keys).agg(F.sum(value).cast("long").alias(value))


def top(df: DataFrame, k: int, by: str, tie: str) -> DataFrame:
    """The k greatest by ``by``, ties by ``tie``."""
    return df.orderBy(F.desc(by), tie).limit(k)
