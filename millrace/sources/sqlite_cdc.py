"""Change capture of a SQLite table: snapshots through a Python data source, compared with the last one.

The last snapshots are kept as tables, and a small file for each commit names its one, so a restart goes
on from it. They go through the file system that Spark uses.
"""

from __future__ import annotations

import json
import os
import sqlite3
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace import files
from millrace.operators import cdc

#: Declared column types and their Spark types; others are strings.
_TYPES = {"INT": "bigint", "INTEGER": "bigint", "BIGINT": "bigint", "REAL": "double", "FLOAT": "double", "DOUBLE": "double", "BLOB": "binary"}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class _Range(InputPartition):
    def __init__(self, lo: int | None, hi: int | None):
        self.lo, self.hi = lo, hi


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, parts: int, names: list[str]):
        self.path, self.table, self.parts, self.names = path, table, parts, names

    def partitions(self):
        if self.parts == 1:
            return [_Range(None, None)]
        with sqlite3.connect(self.path) as db:
            lo, hi = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
        if lo is None:
            return [_Range(0, 0)]
        width = -(-(hi - lo + 1) // self.parts)
        return [_Range(a, min(a + width, hi + 1)) for a in range(lo, hi + 1, width)]

    def read(self, part):
        with sqlite3.connect(self.path) as db:
            columns = ", ".join(map(quoted, self.names))
            if part.lo is None:
                yield from db.execute(f"SELECT {columns} FROM {quoted(self.table)}")
            else:
                yield from db.execute(f"SELECT {columns} FROM {quoted(self.table)} WHERE rowid >= ? AND rowid < ?", (part.lo, part.hi))


class SqliteSource(DataSource):
    """``spark.read.format("sqlite_table").options(path=..., table=...)``.

    One statement reads the table, so the rows are those of one moment; tables without rowid can be read
    so too. With option ``parts`` that many tasks read ranges of rowid, each at its own moment: for tables
    that nobody writes to meanwhile.
    """

    @classmethod
    def name(cls):
        return "sqlite_table"

    def schema(self):
        with sqlite3.connect(self.options["path"]) as db:
            rows = db.execute(f"PRAGMA table_info({quoted(self.options['table'])})").fetchall()
        if not rows:
            raise ValueError(f"no table {self.options['table']}")
        return ", ".join("`" + r[1].replace("`", "``") + "` " + _TYPES.get(r[2].upper(), "string") for r in rows)

    def reader(self, schema):
        return _Reader(self.options["path"], self.options["table"], int(self.options.get("parts", "1")), schema.names)


@dataclass
class CdcConfig:
    database: str
    table: str
    pk: str
    state: str
    """Folder of the kept snapshots."""
    poll_seconds: float = 1.0

    def __post_init__(self):
        for name in ("database", "table", "pk", "state"):
            if not getattr(self, name):
                raise ValueError(f"{name} is required")
        if self.poll_seconds <= 0:
            raise ValueError("poll_seconds must be positive")


class CdcSource:
    """``poll`` gives the changes since the last snapshot; ``commit`` makes the new one the last.

    Without a commit the same changes come again: at least once, and exactly once for a sink that is
    idempotent by version. The snapshots of the last two commits stay, so the changes of a poll can be read
    until the second commit after it. One source at a time uses a state folder.
    """

    def __init__(self, spark: SparkSession, config: CdcConfig):
        self.spark, self.config = spark, config
        spark.dataSource.register(SqliteSource)
        self._state = config.state.rstrip("/")
        self._new: str | None = None

    def _commits(self) -> list[int]:
        return sorted(int(n[7:]) for n in files.names(self.spark, self._state) if n.startswith("commit-") and n[7:].isdigit())

    def _last(self) -> dict | None:
        done = self._commits()
        return json.loads(files.read_text(self.spark, f"{self._state}/commit-{done[-1]}")) if done else None

    @property
    def version(self) -> int:
        last = self._last()
        return last["version"] if last else 0

    def poll(self, ts_ms: int | None = None) -> DataFrame:
        """Changes with op, key, before, after, in a row each; envelopes in ``value``. Ordered by key."""
        c, last = self.config, self._last()
        now = self.spark.read.format("sqlite_table").options(path=c.database, table=c.table).load()
        name = f"snapshot-{uuid.uuid4().hex}"
        # bytes become strings, as envelopes carry them
        cdc.normalized(now).write.parquet(f"{self._state}/{name}")
        self._new = name
        after = self.spark.read.parquet(f"{self._state}/{name}")
        before = self.spark.read.parquet(f"{self._state}/{last['snapshot']}") if last else None
        changes = cdc.diff(before, after, c.pk)
        row = F.struct("op", "before", "after", F.struct(F.lit(os.path.basename(c.database)).alias("db"), F.lit(c.table).alias("table"), F.lit(int(time.time() * 1000) if ts_ms is None else ts_ms).cast("long").alias("ts_ms")).alias("source"))
        return changes.withColumn("value", F.to_json(row, {"ignoreNullFields": "false"})).orderBy("key")

    def commit(self) -> int:
        if self._new is None:
            raise RuntimeError("nothing was polled")
        version = self.version + 1
        part = f"{self._state}/_commit-{uuid.uuid4().hex}"
        files.write_text(self.spark, part, json.dumps({"version": version, "snapshot": self._new}))
        if not files.move(self.spark, part, f"{self._state}/commit-{version}"):
            files.delete(self.spark, part)
            raise RuntimeError("another source has committed meanwhile")
        self._new = None
        self._forget()
        return version

    def _forget(self, keep: int = 2) -> None:
        """Delete commits but the last ``keep``, and the snapshots that none of those names."""
        done = self._commits()
        kept = {json.loads(files.read_text(self.spark, f"{self._state}/commit-{n}"))["snapshot"] for n in done[-keep:]}
        for n in done[:-keep]:
            files.delete(self.spark, f"{self._state}/commit-{n}")
        for name in files.names(self.spark, self._state):
            if name.startswith("snapshot-") and name not in kept:
                files.delete(self.spark, f"{self._state}/{name}")

    def run(self, sink, polls: int | None = None) -> None:
        """Poll again and again: ``sink(changes, version)``, commit, wait. ``polls`` ends it after so many."""
        done = 0
        while polls is None or done < polls:
            sink(self.poll(), self.version + 1)
            self.commit()
            done += 1
            if polls is None or done < polls:
                time.sleep(self.config.poll_seconds)
