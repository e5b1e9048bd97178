"""Sinks that write each micro-batch exactly once, and a look into checkpoints."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from millrace import files


def batch_writer(path: str, order: list[str], fail_after: int | None = None, dedup: bool = True) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: batch n becomes ``path/batch_id=n`` in one step, with dedup_id ``task|batch|seq``.

    A batch that is there already is not written again, so whoever reads the folder, a stream of its files
    too, gets each record once. With ``dedup`` off every try is added, as a sink without that check does;
    ``unique`` drops the repeated ids. ``fail_after`` raises after writing that batch once, for tests of
    recovery.
    """
    state = {"failed": False}

    def write(df: DataFrame, batch_id: int) -> None:
        from pyspark.sql import Window

        shard = F.pmod(F.xxhash64(*order), F.lit(8)).cast("int")
        seq = F.row_number().over(Window.partitionBy("__shard").orderBy(*order)) - 1
        rows = df.withColumn("__shard", shard).withColumn("seq", seq)
        rows = rows.withColumn("dedup_id", F.concat_ws("|", "__shard", F.lit(batch_id), "seq")).drop("__shard")
        if dedup:
            files.commit(rows, path, f"batch_id={batch_id}")
        else:
            rows.write.mode("append").parquet(f"{path}/batch_id={batch_id}")
        if fail_after is not None and batch_id == fail_after and not state["failed"]:
            state["failed"] = True
            raise RuntimeError(f"stopped on purpose after batch {batch_id}")

    return write


def unique(rows: DataFrame) -> DataFrame:
    """Rows of a sink once each, by their dedup_id."""
    return rows.dropDuplicates(["dedup_id"])


def exactly_once(df: DataFrame, path: str, checkpoint: str, order: list[str], fail_after: int | None = None, mode: str = "append", dedup: bool = True) -> DataStreamWriter:
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(batch_writer(path, order, fail_after, dedup))


def drain(writer: DataStreamWriter, timeout: float | None = None) -> StreamingQuery:
    """Process all that there is now and stop; an error of the query is raised."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination(timeout)
    return query


def run_until_idle(writer: DataStreamWriter, idle_seconds: float, poll: float = 0.2) -> StreamingQuery:
    """Run until no rows have come for a while, then stop."""
    import time

    query = writer.start()
    last, seen = time.monotonic(), -1
    while time.monotonic() - last < idle_seconds and query.isActive:
        progress = query.lastProgress
        if progress and progress["batchId"] != seen and progress["numInputRows"]:
            last, seen = time.monotonic(), progress["batchId"]
        time.sleep(poll)
    query.stop()
    if query.exception():
        raise query.exception()
    return query


def discard(df: DataFrame, checkpoint: str) -> DataStreamWriter:
    """Count rows in the query's progress and write nothing."""
    return df.writeStream.format("noop").option("checkpointLocation", checkpoint)


def counted(df: DataFrame, name: str) -> DataFrame:
    """Count the rows that pass here; ``statistics`` has the number under this name."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"))


def statistics(query: StreamingQuery) -> dict[str, int]:
    """Rows in, rows dropped as late, state rows and the numbers of ``counted`` of a query, over the batches
    whose progress the session keeps (``spark.sql.streaming.numRecentProgressUpdates``)."""
    out = {"rows_in": 0, "late_rows": 0, "state_rows": 0}
    for p in query.recentProgress:
        out["rows_in"] += p["numInputRows"]
        for s in p["stateOperators"]:
            out["late_rows"] += s["numRowsDroppedByWatermark"]
            out["state_rows"] = s["numRowsTotal"]
        for name, row in p["observedMetrics"].items():
            out[name] = out.get(name, 0) + row["rows"]
    return out


def batches(checkpoint: str) -> list[dict]:
    """Prepared (offsets written) and committed batches of a checkpoint."""
    spark = SparkSession.active()

    def ids(name: str) -> set[int]:
        return {int(x) for x in files.names(spark, f"{checkpoint}/{name}") if x.isdigit()}

    prepared, committed = ids("offsets"), ids("commits")
    out = []
    for i in sorted(prepared):
        lines = files.read_text(spark, f"{checkpoint}/offsets/{i}").splitlines()
        out.append({"id": i, "status": "C" if i in committed else "P", "offsets": [json.loads(x) for x in lines[2:] if x.startswith("{")]})
    return out


def pending(checkpoint: str) -> list[int]:
    return [b["id"] for b in batches(checkpoint) if b["status"] == "P"]


def state_rows(spark: SparkSession, checkpoint: str, variable: str | None = None) -> DataFrame:
    """Rows of a query's state store; of a processor of ``stateful``, those of its variable ``acc``."""
    spark.streams.active  # noqa: B018  starts the coordinator that the reader asks
    reader = spark.read.format("statestore")
    return (reader.option("stateVarName", variable) if variable else reader).load(checkpoint)


def route_late(ts: str, delay_ms: int, on_time: Callable[[DataFrame, int], None], late: Callable[[DataFrame, int], None], position: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: rows behind the watermark of earlier batches go to ``late``, others to ``on_time``.

    The watermark after each batch is kept in the folder ``position``, under the batch's number, so a
    batch that runs again sees the same one.
    """

    def seen_before(spark: SparkSession, batch_id: int) -> int | None:
        done = [int(x) for x in files.names(spark, position) if x.isdigit() and int(x) < batch_id]
        return json.loads(files.read_text(spark, f"{position}/{max(done)}")) if done else None

    def split(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        most = seen_before(spark, batch_id)
        ms = F.unix_millis(F.col(ts))
        is_late = F.lit(False) if most is None else F.coalesce(ms < most - delay_ms, F.lit(False))
        df = df.persist()
        try:
            on_time(df.where(~is_late), batch_id)
            late(df.where(is_late), batch_id)
            here = df.agg(F.max(ms)).first()[0]
        finally:
            df.unpersist()
        now = max((x for x in (most, here) if x is not None), default=None)
        part = f"{position}/_{uuid.uuid4().hex}"
        files.write_text(spark, part, json.dumps(now))
        if not files.move(spark, part, f"{position}/{batch_id}"):  # there from an earlier try: the same
            files.delete(spark, part)

    return split
