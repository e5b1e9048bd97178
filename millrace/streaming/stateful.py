"""Processors with state per key, for streams.

A changelog of counts or of an opaque fold needs an update for every row, which no windowed aggregate
gives; state is one value a key in the RocksDB state store. Rows of a micro-batch are taken in the
order of ``order`` within their key; between batches in the order of batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Fold(StatefulProcessor):
    def __init__(self, key: str, order: list[str], init: Callable, step: Callable, value: str, kind: str):
        self.key, self.order, self.start, self.step, self.value, self.kind = key, order, init, step, value, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("acc", f"v {self.kind}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batches = list(rows)
        if not batches:
            return
        batch = pd.concat(batches).sort_values(self.order, kind="stable")
        acc, known, out = (self._state.get()[0], True, []) if self._state.exists() else (None, False, [])
        for row in batch.itertuples(index=False):
            acc = self.step(acc, row) if known else self.start(row)
            known = True
            out.append(acc)
        self._state.update((acc,))
        yield pd.DataFrame({self.key: [key[0]] * len(out), self.value: out})

    def close(self) -> None:
        pass


def fold(df: DataFrame, key: str, order: list[str], init: Callable, step: Callable, value: str = "value", kind: str = "bigint") -> DataFrame:
    """Changelog of a keyed fold on a stream: (key, value) after every row. Needs the RocksDB state store."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    schema = f"{key} {df.schema[key].dataType.simpleString()}, {value} {kind}"
    processor = _Fold(key, order, init, step, value, kind)
    return df.groupBy(key).transformWithStateInPandas(processor, outputStructType=schema, outputMode="Update", timeMode="None")


class _Count(StatefulProcessor):
    """Counts need no order and no rows: a batch of n rows goes on by n numbers."""

    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("acc", "v bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n = self._state.get()[0] if self._state.exists() else 0
        for batch in rows:
            yield pd.DataFrame({self.key: [key[0]] * len(batch), "count": range(n + 1, n + len(batch) + 1)})
            n += len(batch)
        self._state.update((n,))

    def close(self) -> None:
        pass


def running_count(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Changelog of counts on a stream; ``order`` is that of the rows, which the numbers don't show."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    schema = f"{key} {df.schema[key].dataType.simpleString()}, count bigint"
    return df.groupBy(key).transformWithStateInPandas(_Count(key), outputStructType=schema, outputMode="Update", timeMode="None")


class State:
    """Values by name that a processor keeps for the key at hand."""

    def __init__(self, store):
        self._store = store

    def get(self, name: str, default=None):
        return self._store.getValue((name,))[0] if self._store.containsKey((name,)) else default

    def put(self, name: str, value) -> None:
        self._store.updateValue((name,), (value,))

    def delete(self, name: str) -> None:
        if self._store.containsKey((name,)):
            self._store.removeKey((name,))

    def items(self) -> list[tuple]:
        """(name, value) in the order of names."""
        return sorted((k[0], v[0]) for k, v in self._store.iterator())


class _Process(StatefulProcessor):
    def __init__(self, order: list[str], fn: Callable, names: list[str], kind: str):
        self.order, self.fn, self.names, self.kind = order, fn, names, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = State(handle.getMapState("kv", "name string", f"v {self.kind}"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batches = list(rows)
        if not batches:
            return
        batch = pd.concat(batches).sort_values(self.order, kind="stable")
        out = [x for row in batch.itertuples(index=False) for x in self.fn(self._state, row)]
        yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def process(df: DataFrame, key: str, order: list[str], fn: Callable, schema: str, kind: str = "bigint") -> DataFrame:
    """An opaque processor with state by key on a stream: ``fn(state, row)`` gives tuples of ``schema``.

    ``state`` is a ``State`` with values of type ``kind``: get, put, delete, items. It lies in the RocksDB
    state store and is committed with the batch; ``sinks.state_rows(..., "kv")`` reads it. A task holds the
    rows that one key has in a micro-batch.
    """
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    names = [x.strip().split()[0] for x in schema.split(",")]
    return df.groupBy(key).transformWithStateInPandas(_Process(order, fn, names, kind), outputStructType=schema, outputMode="Update", timeMode="None")
