"""Exact URL lists by Bloom filter cascades, and longest-prefix rules.

A cascade has alternating levels: the first holds the listed keys, the second those other keys of the
universe that the first lets through by mistake, the third the listed keys that the second lets
through, and so on until a level makes no mistake. For every key of the universe the first level that
lacks it tells whether it is listed. Because the universe is the corpus's own set of keys, the answer
is exact for every row, and rows are judged where they are, without a join.

Keys are dealt to shards by hash, so that each cascade is built in one task of bounded size. The shards
lie in a few files of about ``FILE_BYTES``, in order. While all of them fit ``CACHE_BYTES``, rows are judged
where they are and a task reads each file once; beyond that rows are dealt by ranges of shards, so that a
task reads the files of its range only. A task keeps no more of them than ``CACHE_BYTES``, or one file.
"""

from __future__ import annotations

import math
import struct
from bisect import bisect_right
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import column, drop_folders, filesystem, fresh, new_folder, shuffle_partitions

SHARD_KEYS, MIN_SHARDS, CACHE_BYTES, FILE_BYTES, MAX_LEVELS = 100_000, 64, 64 << 20, 16 << 20, 200
_SHARD_SALT, _KEY_SALT = "millrace shard", "millrace second"


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """A different hash for each salt: the finaliser of a public 64-bit mixing function (fixed constants)."""
    x = h ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Bloom:
    def __init__(self, bits: np.ndarray, m: int, k: int, level: int):
        self.bits, self.m, self.k, self.level = bits, m, k, level

    @classmethod
    def of(cls, h1: np.ndarray, h2: np.ndarray, rate: float, level: int) -> Bloom:
        m = max(8, math.ceil(len(h1) * 1.4427 * math.log2(1 / rate)))
        b = cls(np.zeros((m + 7) // 8, np.uint8), m, max(1, round(math.log2(1 / rate))), level)
        for at in b._places(h1, h2):
            np.bitwise_or.at(b.bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        return b

    def _places(self, h1, h2):
        a, b = _mixed(h1, 2 * self.level + 1), _mixed(h2, 2 * self.level + 2) | np.uint64(1)
        for i in range(self.k):
            yield (a + np.uint64(i) * b) % np.uint64(self.m)

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.ones(len(h1), bool)
        for at in self._places(h1, h2):
            out &= self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1
        return out


class Cascade:
    """Keys are pairs of independent 64-bit hashes."""

    def __init__(self, levels: list[Bloom]):
        self.levels = levels

    @classmethod
    def build(cls, listed: tuple[np.ndarray, np.ndarray], others: tuple[np.ndarray, np.ndarray]) -> Cascade:
        levels, inside, outside = [], listed, others
        while len(inside[0]):
            if len(levels) > MAX_LEVELS:
                raise ValueError("a listed key and another one have the same 128-bit hash")
            rate = min(0.5, len(inside[0]) / (len(outside[0]) * math.sqrt(2))) if not levels and len(outside[0]) else 0.5
            levels.append(Bloom.of(*inside, rate, len(levels)))
            through = levels[-1].has(*outside)
            inside, outside = (outside[0][through], outside[1][through]), inside
        return cls(levels)

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out, live = np.zeros(len(h1), bool), np.arange(len(h1))
        for n, level in enumerate(self.levels):
            live = live[level.has(h1[live], h2[live])]
            out[live] = n % 2 == 0
        return out

    def pack(self) -> bytes:
        return b"".join(struct.pack("<IIH", len(x.bits), x.m, x.k) + x.bits.tobytes() for x in self.levels)

    @classmethod
    def unpack(cls, data: bytes) -> Cascade:
        levels, at = [], 0
        while at < len(data):
            size, m, k = struct.unpack_from("<IIH", data, at)
            levels.append(Bloom(np.frombuffer(data, np.uint8, size, at + 10), m, k, len(levels)))
            at += 10 + size
        return cls(levels)


class CascadeTable:
    """A built cascade of ``size`` bytes: ``files`` has the Parquet files, a row for each shard with listed
    keys, by the first and last shard in them; a task keeps ``cache`` bytes of them, or one file."""

    def __init__(self, shards: int, files: list[tuple[int, int, str]], size: int, cache: int):
        self.shards, self.files, self.size, self.cache, self.reads = shards, sorted(files), size, cache, 0
        self._kept: OrderedDict[int, tuple[dict[int, Cascade], int]] = OrderedDict()
        self._bytes = 0

    def __reduce__(self):
        return CascadeTable, (self.shards, self.files, self.size, self.cache)

    def _shard(self, shard: int) -> Cascade | None:
        """The shard's cascade, with its file read when first met; None if nothing in it is listed."""
        at = bisect_right(self.files, shard, key=lambda f: f[0]) - 1
        if at < 0 or shard > self.files[at][1]:
            return None
        if at not in self._kept:
            import pyarrow.parquet as pq

            fs, path = filesystem(self.files[at][2])
            rows = pq.read_table(path, filesystem=fs, columns=["shard", "packed"], partitioning=None).to_pydict()
            size = sum(map(len, rows["packed"]))
            while self._kept and self._bytes + size > self.cache:
                self._bytes -= self._kept.popitem(last=False)[1][1]
            self._kept[at] = ({s: Cascade.unpack(p) for s, p in zip(rows["shard"], rows["packed"], strict=True)}, size)
            self._bytes += size
            self.reads += 1
        self._kept.move_to_end(at)
        return self._kept[at][0].get(shard)

    def has(self, shard: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.zeros(len(shard), bool)
        order = np.argsort(shard, kind="stable")
        edges = [0, *(np.flatnonzero(np.diff(shard[order])) + 1).tolist(), len(order)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            rows = order[lo:hi]
            if len(rows) and (cascade := self._shard(int(shard[rows[0]]))) is not None:
                out[rows] = cascade.has(h1[rows], h2[rows])
        return out


def _dealt(key: Column, shards: int) -> list[Column]:
    salted = F.xxhash64(key, F.lit(_KEY_SALT))
    return [F.pmod(F.xxhash64(key, F.lit(_SHARD_SALT)), F.lit(shards)).cast("int").alias("shard"), F.xxhash64(key).alias("h1"), salted.alias("h2")]


def build_cascade(universe: DataFrame, cache_bytes: int = CACHE_BYTES, file_bytes: int = FILE_BYTES) -> CascadeTable:
    """Build the shards of a cascade from distinct rows (key string, listed boolean).

    The number of shards follows the number of keys; a shard has about ``SHARD_KEYS`` of them, dealt by
    a hash of the key, whatever host is common. Null keys are never listed, nor are keys whose
    ``listed`` is null. Without listed keys nothing is listed. Only the names of the files, each with its
    range of shards, come to the driver.
    """
    spark = universe.sparkSession
    keys = universe.where(F.col("key").isNotNull()).select("key", F.coalesce("listed", F.lit(False)).alias("listed"))
    shards = max(MIN_SHARDS, keys.count() // SHARD_KEYS)

    def run(key, group):
        a, b = (group.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        on = group.column("listed").to_numpy(zero_copy_only=False).astype(bool)
        packed = Cascade.build((a[on], b[on]), (a[~on], b[~on])).pack()
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "packed": pa.array([packed], pa.binary())})

    schema, first, path = "shard int, packed binary", new_folder(spark, "cascade-shards"), new_folder(spark, "cascade")
    built = keys.select(*_dealt(F.col("key"), shards), "listed").groupBy("shard").applyInArrow(run, schema)
    built.where(F.octet_length("packed") > 0).write.parquet(first)
    packed = spark.read.schema(schema).parquet(first)
    size = packed.agg(F.sum(F.octet_length("packed").cast("long"))).first()[0] or 0
    packed.repartitionByRange(max(1, -(-size // file_bytes)), "shard").sortWithinPartitions("shard").write.parquet(path)
    names = spark.read.schema(schema).parquet(path).groupBy(F.input_file_name().alias("file")).agg(F.min("shard").alias("lo"), F.max("shard").alias("hi")).collect()
    drop_folders(spark, [first])
    return CascadeTable(shards, [(r["lo"], r["hi"], r["file"]) for r in names], size, cache_bytes)


def mark_listed(rows: DataFrame, key: str, cascade: CascadeTable, name: str = "listed") -> DataFrame:
    """Add a boolean column: whether the row's key, which must be of the cascade's universe, is listed.

    Map-only while the cascade fits a task's cache; else rows are dealt by ranges of (shard, hash of the
    row), so that the rows of a common key spread over tasks. Null keys are not listed. The column replaces
    one of the same name.
    """
    kept = rows.drop(name)

    def run(batches):
        for batch in batches:
            n = len(batch.schema.names)
            shard = np.asarray(batch.column(n - 3).fill_null(0))
            h1, h2 = (np.asarray(batch.column(i)).view(np.uint64) for i in (n - 2, n - 1))
            on = cascade.has(shard, h1, h2) & np.asarray(batch.column(n - 4))
            yield pa.RecordBatch.from_arrays([*batch.columns[: n - 4], pa.array(on)], names=[*batch.schema.names[: n - 4], name])

    k = F.col(key).cast("string")
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.BooleanType())])
    has, *own = fresh(kept, "has", "0", "1", "2")
    hashed = kept.select("*", k.isNotNull().alias(has), *(c.alias(n) for n, c in zip(own, _dealt(k, cascade.shards), strict=True)))
    if cascade.size > cascade.cache:
        plain = [column(f.name) for f in kept.schema if "map" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
        hashed = hashed.repartitionByRange(shuffle_partitions(rows.sparkSession), own[0], F.xxhash64(*plain))
    return hashed.mapInArrow(run, schema)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url: host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with
    A-Z in lower case; path then up to ``?``, ``#`` or the end. Null or without ``://``: both empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A rule is ("allow" or "block",
    "host/path"); it fits its host and all subdomains if the url's path starts with the rule's. Of two
    equal rules the first counts."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], block_share: float = 0.5) -> DataFrame:
    """Judge every url: page_id, host, path, rule, verdict; a row for each row of ``pages``.

    A rule that fits decides. Else the method does: a url is blocked if its host is listed, where the
    list has the hosts of which the rules block at least ``block_share`` of the pages that they decide;
    the universe is all hosts of the corpus. A url without host is allowed.
    """
    host, path = url_parts(F.col("url").cast("string"))
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    ruled = parts.select("*", rule.alias("rule"), verdict.alias("ruled"))
    counts = ruled.groupBy("host").agg(F.count(F.when(F.col("ruled") == "block", 1)).alias("bad"), F.count("ruled").alias("n"))
    universe = counts.select(F.col("host").alias("key"), ((F.col("n") > 0) & (F.col("bad") >= block_share * F.col("n")) & (F.col("host") != "")).alias("listed"))
    marked = mark_listed(ruled, "host", build_cascade(universe))
    return marked.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
