"""The fluent builder: an immutable wrapper over a static or streaming DataFrame.

    Stream(df).with_timestamps("ts", "1 second").key_by("word").tumbling("5 seconds").sink(...)

Each step returns a new Stream. The same program over a table and over a live stream of its rows gives
the same rows once the stream's last windows have closed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import aggregates, joins, windows
from millrace.operators.late import split_late
from millrace.operators.partition import bucket_of
from millrace.streaming import sinks, stateful


@dataclass(frozen=True)
class Stream:
    df: DataFrame
    ts: str | None = None
    out_of_order: str = "0 seconds"
    lateness: str = "0 seconds"
    key: str | None = None
    order: tuple[str, ...] = ()
    late: Callable[[DataFrame], None] | None = None
    steps: tuple[str, ...] = ()

    def _with(self, df: DataFrame, name: str, **more) -> Stream:
        if name in self.steps:
            raise ValueError(f"a step named {name!r} is there already")
        return replace(self, df=df, steps=(*self.steps, name), **more)

    def _name(self, kind: str, name: str | None) -> str:
        return name or f"{kind}-{len(self.steps)}"

    def _marked(self) -> DataFrame:
        if self.ts is None:
            raise ValueError("give event times first: with_timestamps")
        if not self.df.isStreaming:
            return self.df
        delay = windows.millis_of(self.out_of_order) + windows.millis_of(self.lateness)
        return self.df.withWatermark(self.ts, f"{delay} milliseconds")

    def _keyed(self) -> str:
        if self.key is None:
            raise ValueError("give a key first: key_by")
        return self.key

    def with_timestamps(self, ts: str | Column, out_of_order: str = "0 seconds", name: str = "event_time") -> Stream:
        """Event time by column or expression; the watermark is the greatest one less ``out_of_order``."""
        if isinstance(ts, str):
            return replace(self, ts=ts, out_of_order=out_of_order)
        return replace(self, df=self.df.withColumn(name, ts), ts=name, out_of_order=out_of_order)

    def with_allowed_lateness(self, lateness: str) -> Stream:
        """Windows stay open for as long after the watermark has passed their end."""
        return replace(self, lateness=lateness)

    def ordered_by(self, *columns: str) -> Stream:
        """Order of rows for changelogs and folds."""
        return replace(self, order=columns)

    def on_late(self, handler: Callable[[DataFrame], None]) -> Stream:
        """Gets the late rows of a static frame at ``run_late``; streams count them in their progress,
        and ``sinks.route_late`` sends them elsewhere."""
        return replace(self, late=handler)

    def run_late(self, partition: str, arrival: str, tie: str) -> Stream:
        delay = f"{windows.millis_of(self.out_of_order) + windows.millis_of(self.lateness)} milliseconds"
        split = split_late(self.df, self.ts, partition, arrival, tie, delay)
        if self.late:
            self.late(split.where("late").drop("late"))
        return replace(self, df=split.where("not late").drop("late"))

    def select(self, *columns: Column | str, name: str | None = None) -> Stream:
        return self._with(self.df.select(*columns), self._name("select", name))

    def with_column(self, column: str, value: Column, name: str | None = None) -> Stream:
        return self._with(self.df.withColumn(column, value), self._name("map", name))

    def map_pandas(self, fn: Callable, schema: str, name: str | None = None) -> Stream:
        """An opaque function over batches of rows; it may return any number of rows."""
        return self._with(self.df.mapInPandas(fn, schema), self._name("map", name))

    def filter(self, condition: Column | str, name: str | None = None) -> Stream:
        return self._with(self.df.where(condition), self._name("filter", name))

    def flat_map(self, column: str, array: Column, name: str | None = None) -> Stream:
        """A row for each element of an array, in ``column``."""
        return self._with(self.df.withColumn(column, F.explode(array)), self._name("flat_map", name))

    def key_by(self, key: str, value: Column | None = None, name: str | None = None) -> Stream:
        df = self.df if value is None else self.df.withColumn(key, value)
        return self._with(df, self._name("key_by", name), key=key)

    def count(self, name: str | None = None) -> Stream:
        """Count by key: the final one on a table; on a stream updates of it (output mode update)."""
        return self._with(aggregates.count(self.df, self._keyed()), self._name("count", name))

    def running_count(self, name: str | None = None) -> Stream:
        """Count after every row."""
        key, order = self._keyed(), list(self.order)
        if self.df.isStreaming:
            return self._with(stateful.running_count(self.df, key, order), self._name("running_count", name))
        bucket = bucket_of(self.df, order[0]) if order else F.lit(0)
        return self._with(aggregates.running_count(self.df, key, order, bucket), self._name("running_count", name))

    def reduce(self, init: Callable, step: Callable, kind: str = "bigint", name: str | None = None) -> Stream:
        """Value of a keyed fold after every row; init(row) begins, step(acc, row) goes on."""
        key, order = self._keyed(), list(self.order)
        if self.df.isStreaming:
            return self._with(stateful.fold(self.df, key, order, init, step, "value", kind), self._name("reduce", name))
        schema = f"{key} {self.df.schema[key].dataType.simpleString()}, value {kind}"
        return self._with(aggregates.reduce(self.df, key, order, init, step, schema, changelog=True), self._name("reduce", name))

    def tumbling(self, size: str, *aggs: Column, name: str | None = None) -> Stream:
        return self._with(windows.tumbling(self._marked(), [self._keyed()], self.ts, size, *aggs), self._name("tumbling", name), ts=None)

    def sliding(self, size: str, slide: str, *aggs: Column, name: str | None = None) -> Stream:
        return self._with(windows.sliding(self._marked(), [self._keyed()], self.ts, size, slide, *aggs), self._name("sliding", name), ts=None)

    def session(self, gap: str, *aggs: Column, name: str | None = None) -> Stream:
        return self._with(windows.session(self._marked(), [self._keyed()], self.ts, gap, *aggs), self._name("session", name), ts=None)

    def interval_join(self, other: Stream, lower: str, upper: str, name: str | None = None) -> Stream:
        """Pairs of equal keys with lower <= this ts - other's ts <= upper. The two sides' other columns must differ."""
        joined = joins.interval_join(self._marked(), other._marked().withColumnRenamed(other._keyed(), self._keyed()), self._keyed(), self.ts, other.ts, lower, upper)
        return self._with(joined, self._name("interval_join", name))

    def join(self, other: Stream, bound: str, name: str | None = None) -> Stream:
        """Pairs of equal keys with times at most ``bound`` apart."""
        return self.interval_join(other, "-" + bound, bound, name)

    def sink(self, path: str, checkpoint: str, order: list[str], fail_after: int | None = None, mode: str = "append"):
        """A stream's writer that writes every batch once, or a table's rows at once."""
        if self.df.isStreaming:
            return sinks.exactly_once(self.df, path, checkpoint, order, fail_after, mode)
        return sinks.batch_writer(path, order)(self.df, 0)
