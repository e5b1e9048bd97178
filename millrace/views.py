"""Materialised views: named key/value tables that batches of changes keep up to date, and a query API.

Keys are dealt to buckets by CRC-32. A version of a view is a small file that appears in one step and names
the folder of each bucket; a batch writes the buckets that it touches anew and leaves the others. The
greatest version is the current one, and ``keep`` of them stay for readers, with the buckets that they name.
Applying batch n twice changes nothing. Readers see whole versions; a view has one writer at a time. All
goes through the file system that Spark uses.
"""

from __future__ import annotations

import json
import threading
import uuid
import zlib
from collections.abc import Callable, Iterable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import files


class View:
    """Columns: key string, value string or long. ``folder`` must be shared by all that use the view.
    ``buckets`` is that of the first version; a batch and a lookup cost in proportion to the buckets they touch."""

    def __init__(self, spark: SparkSession, name: str, folder: str, kind: str = "string", keep: int = 3, buckets: int = 32):
        if kind not in ("string", "long"):
            raise ValueError("a view holds strings or longs")
        if keep < 2:
            raise ValueError("a view keeps the version that a new one is made from")
        if buckets < 1:
            raise ValueError("a view has at least one bucket")
        self.spark, self.name, self.folder, self.kind, self.keep = spark, name, folder.rstrip("/"), kind, keep
        self.schema, self._first_buckets = f"key string, value {kind}", buckets

    def _versions(self) -> list[int]:
        return sorted(int(n[8:]) for n in files.names(self.spark, self.folder) if n.startswith("version-") and n[8:].isdigit())

    @property
    def version(self) -> int:
        return max(self._versions(), default=-1)

    def _manifest(self, version: int) -> dict:
        """The number of buckets, and the folder of each bucket that has keys."""
        if version < 0:
            return {"buckets": self._first_buckets, "paths": {}}
        return json.loads(files.read_text(self.spark, f"{self.folder}/version-{version}"))

    def _read(self, paths: Iterable[str]) -> DataFrame:
        at = [f"{self.folder}/{p}" for p in paths]
        return self.spark.read.schema(self.schema).parquet(*at) if at else self.spark.createDataFrame([], self.schema)

    def table(self) -> DataFrame:
        return self._read(self._manifest(self.version)["paths"].values())

    def _apply(self, changes: DataFrame, batch_id: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Publish version ``batch_id``: the touched buckets' rows merged with ``changes`` (a row for each key)."""
        manifest = self._manifest(self.version)
        n, paths = manifest["buckets"], manifest["paths"]
        bucket = F.pmod(F.crc32(F.col("key").cast("binary")), F.lit(n)).cast("int")
        changes = changes.persist()
        try:
            touched = {str(r["b"]) for r in changes.select(bucket.alias("b")).distinct().collect()}  # n at most
            rows = merge(self._read(p for b, p in paths.items() if b in touched), changes).select("key", "value", bucket.alias("bucket"))
            data = f"data-{batch_id}-{uuid.uuid4().hex}"
            rows.repartition("bucket").sortWithinPartitions("bucket", "key").write.partitionBy("bucket").parquet(f"{self.folder}/{data}")
        finally:
            changes.unpersist()
        there = [x for x in files.names(self.spark, f"{self.folder}/{data}") if x.startswith("bucket=")]
        now = {b: p for b, p in paths.items() if b not in touched} | {x[7:]: f"{data}/{x}" for x in there}
        part = f"{self.folder}/_version-{uuid.uuid4().hex}"
        files.write_text(self.spark, part, json.dumps({"buckets": n, "paths": now}))
        if not files.move(self.spark, part, f"{self.folder}/version-{batch_id}"):
            files.delete(self.spark, part)
        self._forget()

    def _forget(self) -> None:
        """Delete versions but the last ``keep``, and the buckets that none of those names."""
        versions = self._versions()
        kept = {p for v in versions[-self.keep :] for p in self._manifest(v)["paths"].values()}
        for old in versions[: -self.keep]:
            files.delete(self.spark, f"{self.folder}/version-{old}")
        for data in (x for x in files.names(self.spark, self.folder) if x.startswith("data-")):
            here = [f"{data}/{x}" for x in files.names(self.spark, f"{self.folder}/{data}") if x.startswith("bucket=")]
            for path in here if any(p in kept for p in here) else [data]:
                if path not in kept:
                    files.delete(self.spark, f"{self.folder}/{path}")

    def upsert(self, changes: DataFrame, batch_id: int, order: Column | str, deleted: str | None = None) -> None:
        """Apply changes (key, value, ...): the last by ``order`` wins; a null value or a true ``deleted`` removes."""
        if batch_id <= self.version:
            return
        gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
        by = F.col(order) if isinstance(order, str) else order
        last = changes.where("key is not null").groupBy("key").agg(F.max_by(F.struct(F.col("value").cast(self.kind).alias("value"), gone.alias("gone")), by).alias("c"))
        value = F.when(F.col("c").isNull(), F.col("old")).when(~F.col("c.gone"), F.col("c.value"))

        def merge(base: DataFrame, last: DataFrame) -> DataFrame:
            merged = base.select("key", F.col("value").alias("old")).join(last, "key", "full_outer")
            return merged.select("key", value.alias("value")).where("value is not null")

        self._apply(last, batch_id, merge)

    def add(self, changes: DataFrame, batch_id: int, delta: str | None = None) -> None:
        """Add to each key its rows' ``delta``, or their number without one."""
        if self.kind != "long":
            raise ValueError(f"view {self.name} doesn't hold numbers")
        if batch_id <= self.version:
            return
        parts = changes.where("key is not null").groupBy("key").agg((F.sum(delta) if delta else F.count("*")).cast("long").alias("value"))
        self._apply(parts, batch_id, lambda base, new: base.unionByName(new).groupBy("key").agg(F.sum("value").alias("value")))

    def lookup(self, key: str):
        """The key's value, or None; only the key's bucket is read, and the filter reaches the file scan."""
        manifest = self._manifest(self.version)
        path = manifest["paths"].get(str(zlib.crc32(key.encode()) % manifest["buckets"]))
        row = None if path is None else self._read([path]).where(F.col("key") == key).first()
        return None if row is None else row["value"]

    def lookup_long(self, key: str) -> int | None:
        if self.kind != "long":
            raise TypeError(f"view {self.name} doesn't hold numbers")
        return self.lookup(key)

    def size(self) -> int:
        return self.table().count()


class Registry:
    """Named views below a folder. Registering a name again gives the same view."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._views, self._lock = spark, folder, {}, threading.Lock()

    def register(self, name: str, kind: str = "string") -> View:
        with self._lock:
            if name not in self._views:
                self._views[name] = View(self.spark, name, f"{self.folder}/{name}", kind)
            elif self._views[name].kind != kind:
                raise ValueError(f"view {name} holds {self._views[name].kind}s")
            return self._views[name]

    def get(self, name: str) -> View | None:
        return self._views.get(name)

    def names(self) -> list[str]:
        return sorted(self._views)

    def serve(self, port: int = 0) -> ThreadingHTTPServer:
        """Answer ``/view/`` (names), ``/view/<name>`` (name and size) and ``/view/<name>?key=K`` in JSON;
        404 for an unknown view or key. Call shutdown() on the result to stop."""
        registry = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):  # noqa: N802
                url = urlparse(self.path)
                name, key = unquote(url.path.removeprefix("/view").strip("/")), parse_qs(url.query).get("key", [""])[0]
                view = registry.get(name)
                if not url.path.startswith("/view"):
                    self._send(404, {"error": "not found"})
                elif not name:
                    self._send(200, {"views": registry.names()})
                elif view is None:
                    self._send(404, {"error": f"no view {name}"})
                elif not key:
                    self._send(200, {"name": name, "size": view.size()})
                elif (value := view.lookup(key)) is None:
                    self._send(404, {"error": f"no key {key}"})
                else:
                    self._send(200, {"key": key, "value": str(value)} | ({"uint64": str(value)} if view.kind == "long" and value >= 0 else {}))

            def _send(self, status: int, body: dict) -> None:
                data = json.dumps(body).encode()
                self.send_response(status)
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def log_message(self, *_):
                pass

        server = ThreadingHTTPServer(("127.0.0.1", port), Handler)
        threading.Thread(target=server.serve_forever, daemon=True).start()
        return server
