"""Topics as folders: ``topic/batch=<b>/partition=<p>/*.parquet`` with contiguous offsets in each partition.

A produced batch appears under its batch number in one step; a batch that is there already is not written
again, so producing is idempotent for table and stream readers alike. Offsets go on from those of earlier
batches; each batch keeps the next ones in a file, so that the log isn't read for them.
"""

from __future__ import annotations

import base64
import json
import re
import threading
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import files
from millrace.operators.partition import gaps, range_assign, route, with_offsets
from millrace.sources import RECORD, stream_files

SCHEMA = "partition int, offset long, key string, value string, timestamp timestamp, batch long"


class Topic:
    def __init__(self, spark: SparkSession, path: str, partitions: int):
        if partitions < 1:
            raise ValueError("a topic has at least one partition")
        self.spark, self.path, self.partitions = spark, path.rstrip("/"), partitions

    def read(self) -> DataFrame:
        """All records of committed batches."""
        if not self._batches():
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def stream(self, per_batch: int | None = None) -> DataFrame:
        return stream_files(self.spark, self.path, SCHEMA, per_batch=per_batch)

    def records(self) -> DataFrame:
        """Records in the shape of ``RECORD``."""
        name = self.path.rpartition("/")[2]
        rows = self.read().select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), "timestamp", F.lit(name).alias("topic"), "partition", "offset")
        return rows.to(self.spark.createDataFrame([], RECORD).schema)

    def produce(self, rows: DataFrame, batch: int, order: list[str], timestamp: Column | None = None, partition: Column | None = None) -> None:
        """Append rows (key, value) as batch number ``batch``, routed by key, in ``order`` within a partition.
        ``partition`` takes the place of the routing."""
        if batch in self._batches():
            return
        earlier = self._next_offsets(batch)
        routed = route(rows, "key", self.partitions, F.xxhash64(*order)) if partition is None else rows.withColumn("partition", partition.cast("int"))
        numbered = with_offsets(routed, order)
        base = F.element_at(F.array(*(F.lit(n).cast("long") for n in earlier)), F.col("partition") + 1)
        out = numbered.select("partition", (F.col("offset") + base).alias("offset"), F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), (timestamp if timestamp is not None else F.current_timestamp()).alias("timestamp"))
        added = {r["partition"]: r["count"] for r in routed.groupBy("partition").count().collect()}
        after = [n + added.get(p, 0) for p, n in enumerate(earlier)]
        files.commit(out, self.path, f"batch={batch}", "partition", extra={"_next.json": json.dumps(after)})

    def _batches(self) -> list[int]:
        return sorted(int(n[6:]) for n in files.names(self.spark, self.path) if n.startswith("batch=") and n[6:].isdigit())

    def _next_offsets(self, batch: int) -> list[int]:
        """The next offset of each partition before ``batch``."""
        earlier = [b for b in self._batches() if b < batch]
        return json.loads(files.read_text(self.spark, f"{self.path}/batch={earlier[-1]}/_next.json")) if earlier else [0] * self.partitions

    def next_offsets(self) -> list[int]:
        """The next offset of each partition."""
        return self._next_offsets(2**63)


class Catalog:
    """Topics below a folder; a topic's number of partitions is kept beside its batches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def create(self, name: str, partitions: int) -> Topic:
        """Make a topic, or give the one that is there, which must have as many partitions."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", name):
            raise ValueError(f"{name!r} can't be the name of a topic")
        topic, kept = Topic(self.spark, f"{self.folder}/{name}", partitions), f"{self.folder}/{name}/_topic.json"
        part = f"{kept}.{uuid.uuid4().hex}"
        files.write_text(self.spark, part, json.dumps({"partitions": partitions}))
        if not files.move(self.spark, part, kept):
            files.delete(self.spark, part)
            if self.get(name).partitions != partitions:
                raise ValueError(f"topic {name} has {self.get(name).partitions} partitions")
        return topic

    def get(self, name: str) -> Topic:
        kept = f"{self.folder}/{name}/_topic.json"
        if not files.exists(self.spark, kept):
            raise KeyError(f"no topic {name}")
        return Topic(self.spark, f"{self.folder}/{name}", json.loads(files.read_text(self.spark, kept))["partitions"])

    def names(self) -> list[str]:
        return [n for n in files.names(self.spark, self.folder) if files.exists(self.spark, f"{self.folder}/{n}/_topic.json")]

    def describe(self) -> DataFrame:
        """(topic, partition, next_offset) of all topics."""
        rows = [(n, p, at) for n in self.names() for p, at in enumerate(self.get(n).next_offsets())]
        return self.spark.createDataFrame(rows, "topic string, partition int, next_offset long")

    def serve(self, port: int = 0) -> ThreadingHTTPServer:
        """Answer over HTTP in JSON; call shutdown() on the result to stop.

        ``POST /admin/create_topic?topic&partitions``; ``GET /metadata[?topic]``: partitions and next offsets;
        ``POST /produce?topic[&key][&partition]``: the body is one record; ``GET
        /consume?topic&group&partition[&max]``: the next records of the group, at most 100 by default, in
        base 64, and the group goes on behind them. 400 for a missing or bad parameter, 404 for an unknown
        topic or path. Each record produced here is a batch, in a Spark job: many records go in by
        ``Topic.produce``.
        """
        server = ThreadingHTTPServer(("127.0.0.1", port), type("Handler", (_Handler,), {"catalog": self, "lock": threading.Lock()}))
        threading.Thread(target=server.serve_forever, daemon=True).start()
        return server


class _Handler(BaseHTTPRequestHandler):
    catalog: Catalog
    lock: threading.Lock

    def do_GET(self):  # noqa: N802
        self._answer({"/metadata": self._metadata, "/consume": self._consume})

    def do_POST(self):  # noqa: N802
        self._answer({"/admin/create_topic": self._create, "/produce": self._produce})

    def _answer(self, paths: dict) -> None:
        url = urlparse(self.path)
        body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
        try:
            if url.path not in paths:
                raise KeyError(f"nothing at {url.path}")
            with self.lock:  # one writer of a topic and of a group at a time
                status, out = 200, paths[url.path]({k: v[0] for k, v in parse_qs(url.query, keep_blank_values=True).items()}, body)
        except KeyError as e:
            status, out = 404, {"error": str(e.args[0])}
        except ValueError as e:
            status, out = 400, {"error": str(e)}
        except Exception as e:  # noqa: BLE001  the client gets it
            status, out = 500, {"error": str(e).splitlines()[0]}
        data = json.dumps(out).encode()
        self.send_response(status)
        self.send_header("Content-Type", "application/json")
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    @staticmethod
    def _given(query: dict[str, str], name: str) -> str:
        if not query.get(name):
            raise ValueError(f"missing {name}")
        return query[name]

    def _create(self, query, body) -> dict:
        topic = self.catalog.create(self._given(query, "topic"), int(self._given(query, "partitions")))
        return {"topic": query["topic"], "partitions": topic.partitions}

    def _metadata(self, query, body) -> dict:
        names = [query["topic"]] if query.get("topic") else self.catalog.names()
        return {"topics": [{"topic": n, "partitions": [{"id": p, "next": at} for p, at in enumerate(self.catalog.get(n).next_offsets())]} for n in names]}

    def _partition(self, topic: Topic, text: str) -> int:
        if not 0 <= int(text) < topic.partitions:
            raise ValueError(f"topic has partitions 0 to {topic.partitions - 1}")
        return int(text)

    def _produce(self, query, body) -> dict:
        topic = self.catalog.get(self._given(query, "topic"))
        fixed = self._partition(topic, query["partition"]) if query.get("partition") else None
        before, batch = topic.next_offsets(), max(topic._batches(), default=-1) + 1
        row = topic.spark.createDataFrame([(query.get("key") or None, body.decode())], "key string, value string")
        topic.produce(row, batch, ["value"], partition=None if fixed is None else F.lit(fixed))
        at = next(p for p, (a, b) in enumerate(zip(before, topic.next_offsets(), strict=True)) if a != b)
        return {"topic": query["topic"], "partition": at, "offset": before[at]}

    def _consume(self, query, body) -> dict:
        name, group, p = (self._given(query, n) for n in ("topic", "group", "partition"))
        topic = self.catalog.get(name)
        reader = Consumer(topic, group, self._partition(topic, p), topic.partitions)  # as many members as partitions
        most = int(query["max"]) if query.get("max", "").isdigit() and int(query["max"]) else 100
        records = [{"offset": r["offset"], "partition": r["partition"], "payload": base64.b64encode((r["value"] or "").encode()).decode()} for r in reader.poll(most).collect()]
        reader.commit()
        return {"records": records, "next": reader.positions()[int(p)], "partition": int(p)}

    def log_message(self, *_):
        pass


class Consumer:
    """A member of a group that reads a topic: it has a contiguous block of the partitions.

    Positions are kept by group and partition beside the topic. ``poll`` gives the next records,
    ``commit`` moves on; records polled and not committed come again.
    """

    def __init__(self, topic: Topic, group: str, member: int = 0, members: int = 1):
        if not 0 <= member < members:
            raise ValueError("members are numbered from 0")
        if not group or "/" in group:
            raise ValueError("a group needs a name without slashes")
        self.topic, self.spark, self.folder = topic, topic.spark, f"{topic.path}/_groups/{group}"
        every = self.spark.range(topic.partitions).select(F.col("id").cast("int").alias("partition"))
        mine = range_assign(every, members, topic.partitions).where(F.col("member") == member).collect()
        self.partitions = sorted(r["partition"] for r in mine)
        self._polled: dict[int, int] | None = None

    def positions(self) -> dict[int, int]:
        """The next offset to read of each partition of this member."""
        out = dict.fromkeys(self.partitions, 0)
        for name in files.names(self.spark, self.folder):
            p, _, at = name.partition("-")
            if p.isdigit() and at.isdigit() and int(p) in out:
                out[int(p)] = max(out[int(p)], int(at))
        return out

    def poll(self, most: int = 100) -> DataFrame:
        """At most ``most`` next records of each partition, by partition and offset."""
        now, end = self.positions(), self.topic.next_offsets()
        self._polled = {p: min(at + most, end[p]) for p, at in now.items()}
        wanted = F.lit(False)
        for p, at in now.items():
            wanted = wanted | ((F.col("partition") == p) & (F.col("offset") >= at) & (F.col("offset") < self._polled[p]))
        return self.topic.read().where(wanted).orderBy("partition", "offset")

    def commit(self) -> None:
        """Make the ends of the last poll the positions, each in one step."""
        if self._polled is None:
            raise RuntimeError("nothing was polled")
        before = self.positions()
        for p, at in self._polled.items():
            if at > before[p]:
                files.write_text(self.spark, f"{self.folder}/{p}-{at}", "")
                files.delete(self.spark, f"{self.folder}/{p}-{before[p]}")
        self._polled = None

    def drain(self, sink, most: int = 100) -> int:
        """Poll, check, ``sink(records)`` and commit until nothing is left; the number of records.

        Raises if the offsets of a partition don't go on from its position one by one.
        """
        total = 0
        while True:
            records, start = self.poll(most).persist(), self.positions()
            try:
                n, want = records.count(), sum(self._polled[p] - start[p] for p in start)
                base = F.element_at(F.array(*(F.lit(start.get(p, 0)).cast("long") for p in range(self.topic.partitions))), F.col("partition") + 1)
                if n != want or gaps(records.withColumn("offset", F.col("offset") - base)).limit(1).count():
                    raise RuntimeError("the offsets of a partition have a gap or come twice")
                if n:
                    sink(records)
            finally:
                records.unpersist()
            self.commit()
            if not want:
                return total
            total += n
