"""Operators over static frames, by literal cases."""

import base64
import json
import random
import sqlite3
import urllib.error
import urllib.request
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace import functions as fn
from millrace import queries
from millrace.operators import aggregates, cdc, joins, late, partition, windows
from millrace.plans import jobs, sqlfront
from millrace.sources import unzoned, zoned
from millrace.sources.sqlite_cdc import CdcConfig, CdcSource
from millrace.sources.topics import Catalog, Consumer, Topic
from millrace.streaming.stream import Stream
from millrace.views import Registry, View

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- SQL dialect


def test_sql_accepts():
    q = sqlfront.parse("SELECT word, COUNT(*)\nFROM lines\nGROUP BY word, TUMBLE(event_time, INTERVAL '5' SECOND)\nEMIT ON WATERMARK INTO counts")
    assert q == sqlfront.Query("word", "lines", "event_time", 5000, "counts")
    q = sqlfront.parse("select k, count(*) from t group by K, tumble(ts, interval '100' milliseconds) emit on watermark;")
    assert q == sqlfront.Query("k", "t", "ts", 100, None)
    assert sqlfront.parse("SELECT k, COUNT(*) FROM t GROUP BY k, TUMBLE(ts, INTERVAL '2' MINUTE) EMIT ON WATERMARK").size_ms == 120_000


GOOD = "SELECT k, COUNT(*) FROM t GROUP BY k, TUMBLE(ts, INTERVAL '5' SECOND) EMIT ON WATERMARK"


@pytest.mark.parametrize("text", [
    "", "SELECT k FROM t GROUP BY k, TUMBLE(ts, INTERVAL '5' SECOND) EMIT ON WATERMARK", GOOD.replace("BY k", "BY other"), GOOD.replace("TUMBLE", "HOP"),
    GOOD + " INTO x y", GOOD.replace("SECOND", "FORTNIGHT"), GOOD.replace("'5'", "'0'"), GOOD.replace("'5'", "'-5'"), GOOD.replace("'5'", "'five'"), GOOD.replace("EMIT", ""), GOOD + " INTO", "SELECT %",
])
def test_sql_rejects(text):
    with pytest.raises(sqlfront.SqlError):
        sqlfront.parse(text)


WORDS = {"apple": [500, 1000, 1500, 2000, 2500, 5800, 6600, 7400, 8200], "banana": [700, 1400, 2100, 10800, 11600], "cherry": [5400, 5800, 6200, 6600, 7000, 7400, 10300, 10600, 10900]}
WORD_WINDOWS = {("apple", 0): 5, ("banana", 0): 3, ("apple", 5000): 4, ("cherry", 5000): 6, ("banana", 10000): 2, ("cherry", 10000): 3}


def test_sql_over_table_and_lines(spark):
    base = 1_700_000_000_000
    flat = [(base + ms, w) for w, times in WORDS.items() for ms in times]
    random.Random(1).shuffle(flat)
    df = spark.createDataFrame(flat, "ms long, word string")
    text = "SELECT word, COUNT(*) FROM lines GROUP BY word, TUMBLE(event_time, INTERVAL '5' SECOND) EMIT ON WATERMARK INTO counts"
    out, sink = sqlfront.sql(text, {"lines": df.withColumn("event_time", F.timestamp_millis("ms"))})
    got = {(r["word"], int(r["win_start"].timestamp() * 1000) - base): r["count"] for r in out.collect()}
    assert sink == "counts" and got == WORD_WINDOWS
    lines = df.select(F.concat_ws("\t", "ms", "word").alias("value"))
    raw = {tuple(r["value"].split("\t")) for r in sqlfront.lower_lines(sqlfront.parse(text), lines).collect()}
    assert raw == {(w, str(base + s), str(base + s + 5000), str(n)) for (w, s), n in WORD_WINDOWS.items()}
    with pytest.raises(sqlfront.SqlError):
        sqlfront.sql(text, {})
    with pytest.raises(Exception, match="no tab"):
        sqlfront.lower_lines(sqlfront.parse(text), spark.createDataFrame([("no tab",)], "value string")).collect()


# --- windows


def test_window_edges(spark):
    df = spark.createDataFrame([("k", datetime(1969, 12, 31, 23, 59, 58)), ("k", None)], "key string, ts timestamp_ntz")
    assert rows(windows.tumbling(df, ["key"], "ts", "5 seconds")) == [("k", datetime(1969, 12, 31, 23, 59, 55), datetime(1970, 1, 1), 1)]
    one = spark.createDataFrame([("k", datetime(1970, 1, 1, 0, 0, 13))], "key string, ts timestamp_ntz")
    assert [r["win_start"].second for r in windows.sliding(one, ["key"], "ts", "10 seconds", "4 seconds").orderBy("win_start").collect()] == [4, 8, 12]
    gap = spark.createDataFrame([("k", datetime(1970, 1, 1, 0, 0, s)) for s in (1, 7)], "key string, ts timestamp_ntz")
    assert rows(windows.sliding(gap, ["key"], "ts", "5 seconds", "10 seconds")) == [("k", datetime(1970, 1, 1), datetime(1970, 1, 1, 0, 0, 5), 1)]
    s = spark.createDataFrame([("k", T0 + timedelta(seconds=x)) for x in (10, 0, 20.5)], "key string, ts timestamp_ntz")
    assert rows(windows.session(s, ["key"], "ts", "10 seconds")) == [("k", at(0), at(20), 2), ("k", at(20.5), at(30.5), 1)]
    for bad in ("0 seconds", "-1 seconds"):
        with pytest.raises(ValueError):
            windows.tumbling(s, ["key"], "ts", bad)


LINES = [(500, "the quick brown fox"), (1500, "the lazy dog"), (2500, "the quick fox"), (4500, "fox fox fox"), (5500, "the dog"), (6500, "the quick brown dog"), (7500, "fox and dog"), (9000, "the the the"), (10500, "stream processing is fun"), (12000, "fox jumps over"), (13500, "the quick"), (14500, "stream stream stream"), (3000, "late fox")]
LINE_WINDOWS = {
    0: {"fox": 6, "the": 3, "quick": 2, "brown": 1, "dog": 1, "late": 1, "lazy": 1},
    5: {"the": 5, "dog": 3, "and": 1, "brown": 1, "fox": 1, "quick": 1},
    10: {"stream": 4, "fox": 1, "fun": 1, "is": 1, "jumps": 1, "over": 1, "processing": 1, "quick": 1, "the": 1},
}


def test_event_time_words(spark):
    lines = spark.createDataFrame([(f"{ms}\t{text}",) for ms, text in LINES] + [("no tab",)], "value string")
    got = {}
    for r in jobs.event_time_word_count(lines).collect():
        got.setdefault(int(r["win_start"].timestamp()), {})[r["word"]] = r["count"]
    assert got == LINE_WINDOWS


def test_late_rule(spark):
    df = spark.createDataFrame([(i, at(ms / 1000)) for i, (ms, _) in enumerate(LINES)] + [(13, at(0.1))], "id int, ts timestamp_ntz")
    split = late.split_late(df.withColumn("p", F.lit(0)), "ts", "p", "id", "id", "1500 milliseconds", F.floor(F.col("id") / 4))
    assert [r["id"] for r in split.where("late").orderBy("id").collect()] == [12, 13]
    seen = []
    s = Stream(df.withColumn("p", F.lit(0)).withColumn("arrived", F.timestamp_seconds("id"))).with_timestamps("ts", "1 second").with_allowed_lateness("500 milliseconds").on_late(lambda d: seen.extend(d.collect()))
    assert s.run_late("p", "arrived", "id").df.count() == 12 and sorted(r["id"] for r in seen) == [12, 13]


# --- joins


@pytest.mark.parametrize(("lower", "upper", "a", "b", "want"), [
    ("0 minutes", "5 minutes", [("k1", "o1", 30)], [("k1", "p1", 0)], [("o1", "p1")]),
    ("0 minutes", "5 minutes", [("k2", "o2", 30)], [("k2", "old", -600)], []),
    ("0 minutes", "5 minutes", [("kA", "o3", 0)], [("kB", "p3", 0)], []),
    ("-1 minutes", "1 minutes", [("k", "a1", 0)], [("k", "b1", 30)], [("a1", "b1")]),
    ("0 minutes", "5 minutes", [("k", "a", 300), ("k", "late", 301), (None, "x", 0)], [("k", "b", 0), (None, "y", 0)], [("a", "b")]),
])
def test_interval_join(spark, lower, upper, a, b, want):
    left = spark.createDataFrame([(k, p, at(t)) for k, p, t in a], "k string, a string, a_ts timestamp_ntz")
    right = spark.createDataFrame([(k, p, at(t)) for k, p, t in b], "k string, b string, b_ts timestamp_ntz")
    assert rows(joins.interval_join(left, right, "k", "a_ts", "b_ts", lower, upper).select("a", "b")) == want


def test_interval_join_by_brute_force(spark):
    rnd = random.Random(2)
    a = [(rnd.choice("xyz"), i, at(rnd.randint(0, 500))) for i in range(200)]
    b = [(rnd.choice("xyz"), i, at(rnd.randint(0, 500))) for i in range(200)]
    left, right = spark.createDataFrame(a, "k string, a int, a_ts timestamp"), spark.createDataFrame(b, "k string, b int, b_ts timestamp")
    for lo, hi in ((-7, 3), (5, 60), (0, 0)):
        want = sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and lo <= (x[2] - y[2]).total_seconds() <= hi)
        got = joins.interval_join(left, right, "k", "a_ts", "b_ts", f"{'-' * (lo < 0)}{abs(lo)} seconds", f"{hi} seconds")
        assert sorted((r["a"], r["b"]) for r in got.collect()) == want
    with pytest.raises(ValueError):
        joins.interval_join(left, right, "k", "a_ts", "b_ts", "2 seconds", "1 second")


# --- aggregates


def test_word_count(spark):
    corpus = ["the quick brown fox", "The Fox!", "", None, "a-b_c 12"]
    got = dict(rows(jobs.word_count(spark.createDataFrame([(c,) for c in corpus], "value string"))))
    assert got == {"the": 2, "quick": 1, "brown": 1, "fox": 2, "a": 1, "b": 1, "c": 1, "12": 1}


def test_running_and_reduce(spark):
    rnd = random.Random(3)
    data = [(rnd.choice(["a", "b", None]), i, rnd.randint(-50, 50)) for i in range(300)]
    df = spark.createDataFrame(data, "k string, i long, v long").repartition(5)
    acc, want = {}, []
    for k, i, v in data:
        n, s, m = acc.get(k, (0, 0, -999))
        acc[k] = (n + 1, s + v, max(m, v))
        want.append((k, i, v, *acc[k]))
    got = aggregates.running(df, ["k"], ["i"], F.floor(F.col("i") / 37), n=("count", "v"), s=("sum", "v"), m=("max", "v"))
    assert rows(got) == sorted(want, key=str)
    some = df.where("k is not null")
    folded = aggregates.reduce(some, "k", ["i"], lambda r: r.v % 101, lambda acc, r: (acc * 7 + r.v) % 101, "k string, value long")
    opaque = {}
    for k, _, v in data:
        if k:
            opaque[k] = v % 101 if k not in opaque else (opaque[k] * 7 + v) % 101
    assert dict(rows(folded)) == opaque
    summed = aggregates.reduce(some, "k", ["i"], lambda r: r.v, lambda acc, r: acc + r.v, "k string, value long", combine=lambda x, y: x + y)
    assert dict(rows(summed)) == {k: acc[k][1] for k in "ab"}
    log = aggregates.reduce(some, "k", ["i"], lambda r: r.v, lambda acc, r: acc + r.v, "k string, value long", changelog=True)
    assert log.count() == some.count()


def test_stream_builder_on_tables(spark):
    df = spark.createDataFrame([("a b", at(1)), ("a", at(7))], "text string, ts timestamp")
    s = Stream(df).with_timestamps("ts", "1 second").flat_map("word", fn.words("text")).filter("word <> 'b'").key_by("word")
    assert rows(s.tumbling("5 seconds").df) == [("a", at(0), at(5), 1), ("a", at(5), at(10), 1)]
    assert rows(s.count().df) == [("a", 2)]
    assert sorted(r["count"] for r in s.ordered_by("ts").running_count().df.collect()) == [1, 2]
    assert sorted(r["value"] for r in s.ordered_by("ts").reduce(lambda r: 10, lambda acc, r: acc + 1).df.collect()) == [10, 11]
    with pytest.raises(ValueError):
        s.filter("true", name="x").filter("true", name="x")
    with pytest.raises(ValueError):
        Stream(df).tumbling("5 seconds")
    with pytest.raises(ValueError):
        Stream(df).with_timestamps("ts").tumbling("5 seconds")


# --- partitions and topics


def test_fnv_and_routing(spark):
    df = spark.createDataFrame([("a", 1), ("foobar", 2), ("", 3), (None, 4), ("é", 5)], "k string, i int")
    got = {r["k"]: r["h"] for r in df.select("k", fn.fnv1a("k").alias("h")).collect()}

    def fnv(data):
        h = 2166136261
        for b in data:
            h = (h ^ b) * 16777619 & 0xFFFFFFFF
        return h

    assert got["a"] == 3826002220 and got["foobar"] == 3214735720 and got[""] == 2166136261 and got[None] is None and got["é"] == fnv("é".encode())
    routed = {r["i"]: r["partition"] for r in partition.route(df, "k", 4, F.col("i")).collect()}
    assert routed[3] == 3 and routed[4] == 0 and routed[1] == 3826002220 % 4


def test_assignment(spark):
    assert rows(partition.replicas(spark, 4, [0, 1, 2])) == [(0, 0, [1, 2]), (1, 1, [2, 0]), (2, 2, [0, 1]), (3, 0, [1, 2])]
    assert rows(partition.replicas(spark, 2, [7], 3)) == [(0, 7, []), (1, 7, [])]
    assert rows(partition.replicas(spark, 4, [2, 0, 1])) == rows(partition.replicas(spark, 4, [0, 1, 2]))
    for bad in ((0, [1]), (-1, [1]), (1, [])):
        with pytest.raises(ValueError):
            partition.replicas(spark, *bad)
    p = spark.range(4).select(F.col("id").cast("int").alias("partition"))
    assert rows(partition.range_assign(p, 2, 4)) == [(0, 0), (1, 0), (2, 1), (3, 1)]
    assert [m for _, m in rows(partition.range_assign(p, 3, 4))] == [0, 0, 1, 2]


def test_topic(spark, tmp_path):
    topic = Topic(spark, f"{tmp_path}/events", 4)
    assert topic.read().count() == 0
    first = spark.createDataFrame([(f"k{i}", f"ev-{i}", i) for i in range(700)], "key string, value string, i int")
    topic.produce(first, 0, ["i"])
    second = spark.createDataFrame([(f"k{i}", f"ev-{i}", i) for i in range(700, 1000)], "key string, value string, i int")
    topic.produce(second, 1, ["i"])
    topic.produce(second, 1, ["i"])  # the same batch again
    log = topic.read()
    assert log.count() == 1000 and partition.gaps(log).count() == 0 and log.select("value").distinct().count() == 1000
    assert {r["next_offset"] for r in partition.next_offsets(log).collect()} and topic.records().columns == ["key", "value", "timestamp", "topic", "partition", "offset"]
    part = partition.read(log, 2, 5, 10).collect()
    assert [r["offset"] for r in part] == list(range(5, 15))
    assert partition.gaps(log.where("offset <> 7")).count() == 4


def test_offsets_and_gaps_over_buckets(spark, monkeypatch):
    """Numbers and gaps are the same whatever the buckets are; the input's columns may have any name."""
    monkeypatch.setattr(partition, "BUCKET", 7)
    rnd = random.Random(8)
    data = [(rnd.choice([0, 1, 1, 1, None]), i, f"{rnd.randint(0, 999):03d}-{i}", at(rnd.randint(0, 90000)), 5, 5) for i in range(200)]
    df = spark.createDataFrame(data, "partition int, i long, s string, t timestamp, __one int, __b int").repartition(4)
    for order in (["i"], ["s"], ["t", "i"]):
        place = [["partition", "i", "s", "t"].index(c) for c in order]
        ranked, want = {}, []
        for row in sorted(data, key=lambda r: [r[p] for p in place]):
            want.append((row[1], ranked.get(row[0], 0)))
            ranked[row[0]] = ranked.get(row[0], 0) + 1
        out = partition.with_offsets(df, order)
        assert out.columns == [*df.columns, "offset"] and rows(out.select("i", "offset")) == sorted(want, key=str)
        assert rows(partition.with_offsets(out, order).select("i", "offset")) == sorted(want, key=str)
    log = spark.createDataFrame([(p, o) for p in range(3) for o in range(60) if o not in (0, 7, 14, 15, 16, 50)] + [(2, 3)], "partition int, offset long")
    assert rows(partition.gaps(log)) == sorted([(p, o, e) for p in range(3) for o, e in ((1, 0), (8, 7), (17, 14), (51, 50))] + [(2, 3, 4)], key=str)
    assert partition.gaps(log.where("offset < 0")).count() == 0


def test_reserved_names(spark):
    """Columns named like the operators' own ones come through."""
    names = ["__b", "__bb", "__k0", "__n", "__one", "__key", "__bucket", "__at", "__seen", "__salt", "__v"]
    df = spark.createDataFrame([("a", i, at(i), *range(len(names))) for i in range(4)], "k string, i long, ts timestamp, " + ", ".join(f"{n} int" for n in names))
    assert sorted(r["count"] for r in aggregates.running_count(df, "k", ["i"], F.lit(0)).collect()) == [1, 2, 3, 4]
    right = spark.createDataFrame([("a", at(1))], "k string, bts timestamp")
    assert joins.interval_join(df, right, "k", "ts", "bts", "0 seconds", "1 second").columns == [*df.columns, "bts"]
    assert late.split_late(df, "ts", "k", "ts", "i", "1 second").columns == [*df.columns, "late"]
    folded = aggregates.reduce(df, "i", ["ts"], lambda r: 1, lambda acc, r: acc + 1, "i long, value long", combine=lambda x, y: x + y)
    assert rows(folded) == [(i, 1) for i in range(4)]
    assert rows(aggregates.latest(df, ["k"], "i", "i", "__v")) == [("a", 3, 10)]


def test_catalog_and_consumers(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    topic = catalog.create("events", 3)
    assert catalog.create("events", 3).path == topic.path and catalog.names() == ["events"]
    for bad in (("events", 4), ("a/b", 1), ("_x", 1), ("y", 0)):
        with pytest.raises(ValueError):
            catalog.create(*bad)
    with pytest.raises(KeyError):
        catalog.get("no")
    data = [(f"k{i}", f"v{i}", i) for i in range(50)]
    topic.produce(spark.createDataFrame(data, "key string, value string, i int"), 0, ["i"])
    assert sum(r["next_offset"] for r in catalog.describe().collect()) == 50 and catalog.describe().count() == 3
    first, second = (Consumer(catalog.get("events"), "g", m, 2) for m in (0, 1))
    assert first.partitions == [0, 1] and second.partitions == [2]
    again = [r["value"] for r in first.poll(4).collect()]
    assert [r["value"] for r in first.poll(4).collect()] == again  # not committed
    first.commit()
    got = list(again)
    n = Consumer(topic, "g", 0, 2).drain(lambda r: got.extend(x["value"] for x in r.collect()), 7)
    n += second.drain(lambda r: got.extend(x["value"] for x in r.collect()))
    assert n + len(again) == 50 and sorted(got) == sorted(v for _, v, _ in data)
    assert first.drain(lambda r: 1 / 0) == 0 and Consumer(topic, "other").poll().count() == 50
    topic.produce(spark.createDataFrame([("k1", "late", 0)], "key string, value string, i int"), 1, ["i"])
    assert first.drain(lambda r: None) + second.drain(lambda r: None) == 1
    with pytest.raises(ValueError):
        Consumer(topic, "g", 2, 2)


def test_topics_over_http(spark, tmp_path):
    server = Catalog(spark, str(tmp_path)).serve()

    def ask(path, body=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", data=body)) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    try:
        assert ask("/admin/create_topic?topic=t&partitions=2", b"") == (200, {"topic": "t", "partitions": 2})
        for bad in ("/admin/create_topic?topic=t&partitions=0", "/admin/create_topic?topic=u&partitions=x", "/admin/create_topic?partitions=1", "/produce?topic=t&partition=2", "/produce"):
            assert ask(bad, b"x")[0] == 400, bad
        assert ask("/produce?topic=no", b"x")[0] == 404 and ask("/metadata?topic=no")[0] == 404 and ask("/no")[0] == 404
        assert ask("/produce?topic=t&partition=1", "é1".encode()) == (200, {"topic": "t", "partition": 1, "offset": 0})
        assert ask("/produce?topic=t&partition=1", b"b") == (200, {"topic": "t", "partition": 1, "offset": 1})
        first, again = (ask("/produce?topic=t&key=k", b"c")[1] for _ in range(2))
        assert again == {**first, "offset": first["offset"] + 1}
        assert sum(p["next"] for p in ask("/metadata")[1]["topics"][0]["partitions"]) == 4
        code, got = ask("/consume?topic=t&group=g&partition=1&max=1")
        assert code == 200 and got["next"] == 1 and [base64.b64decode(r["payload"]).decode() for r in got["records"]] == ["é1"]
        assert ask("/consume?topic=t&group=g&partition=1")[1]["records"][0]["offset"] == 1
        assert ask("/consume?topic=t&group=g&partition=7")[0] == 400 and ask("/consume?topic=t&group=g")[0] == 400
    finally:
        server.shutdown()


def test_late_demo(spark):
    demo = jobs.late_demo(spark, 50_000, seed=3)
    lines = [r["value"] for r in demo.orderBy("arrival").collect()]
    ms = [int(x.split("\t")[0]) for x in lines]
    assert len(lines) == 14 and lines[-1] == "50100\tdropped row" and ms != sorted(ms)
    assert sorted(sum(50_000 + w * 5000 <= t < 55_000 + w * 5000 for t in ms) for w in range(3)) == [4, 4, 6]


def test_doubled(spark):
    df = spark.createDataFrame([(str(i),) for i in range(1, 11)] + [("x",), (None,), (" 5 ",), ("7\n",), ("+3",), ("9" * 19,), (str(2**62),), (str(-(2**63)),)], "value string")
    assert sorted(r["doubled"] for r in jobs.doubled(df).collect()) == sorted([2 * i for i in range(1, 11)] + [6, -(2**63), 0])
    routed = {r["n"]: (r["key"], r["partition"]) for r in jobs.doubled(df, 4).collect()}
    want = df.where("value <> 'x'").select("value", fn.partition_of("value", 4).alias("p")).collect()
    assert all(routed[int(r["value"])] == (r["value"], r["p"]) for r in want if r["value"].isdigit() and int(r["value"]) < 2**63)


def test_reduce_with_null_and_large_keys(spark):
    big = 2**53 + 1
    for kind, keys in (("long", [None, 7, big, big - 1]), ("string", [None, "", "a", "b"]), ("timestamp", [None, datetime(2024, 1, 1), datetime(2024, 1, 2), datetime(2024, 1, 3)])):
        df = spark.createDataFrame([(k, i, float(i)) for i in range(3) for k in keys], f"k {kind}, i int, v double")
        for combine in (None, lambda a, b: a + b):
            got = aggregates.reduce(df, "k", ["i"], lambda r: int(r.i) + 1, lambda acc, r: acc + int(r.i) + 1, f"k {kind}, total long", combine).collect()
            assert sorted(((r["k"], r["total"]) for r in got), key=str) == sorted(((k, 6) for k in keys), key=str)
            assert got[0].__fields__ == ["k", "total"]


def test_views_keep_few_versions(spark, tmp_path):
    view = Registry(spark, f"file://{tmp_path}").register("n", "long")
    for batch in range(6):
        view.add(spark.createDataFrame([("a",), ("b",)], "key string"), batch)
        view.add(spark.createDataFrame([("a",)], "key string"), batch)  # again: nothing
    assert view.version == 5 and rows(view.table()) == [("a", 6), ("b", 6)] and len(view._versions()) == 3


def test_view_buckets(spark, tmp_path):
    """A batch writes the buckets of its keys only; old buckets stay while a kept version names them."""
    import os

    view = View(spark, "v", str(tmp_path), buckets=8)
    schema = "key string, value string, n int"
    view.upsert(spark.createDataFrame([(f"k{i}", str(i), 0) for i in range(60)] + [(None, "x", 0), ("ключ", "v", 0)], schema), 0, "n")
    first = view._manifest(0)["paths"]
    assert len(first) == 8 and view.lookup("k7") == "7" and view.lookup("ключ") == "v" and view.lookup("no") is None
    for batch in range(1, 6):
        view.upsert(spark.createDataFrame([("k7", f"new{batch}", batch)], schema), batch, "n")
    now = view._manifest(5)["paths"]
    assert sum(now[b] == first[b] for b in first) == 7 and view.lookup("k7") == "new5" and view.size() == 61
    assert len([x for x in os.listdir(tmp_path) if x.startswith("data-")]) == 4  # the first and those of three versions
    view.upsert(spark.createDataFrame([], schema), 6, "n")
    assert view.version == 6 and view.size() == 61
    view.upsert(spark.createDataFrame([(k, None, 1) for k in [f"k{i}" for i in range(60)] + ["ключ"]], schema), 7, "n")
    assert view.size() == 0 and view._manifest(7)["paths"] == {} and view.lookup("k7") is None
    with pytest.raises(ValueError):
        View(spark, "v", str(tmp_path), buckets=0)


def test_scalars(spark):
    row = spark.range(1).select(
        fn.from_big_endian(fn.big_endian(F.lit(258))).alias("n"), fn.from_big_endian(fn.big_endian(F.lit(-1))).alias("u"), fn.from_big_endian(F.lit(b"abc")).alias("short"),
        fn.rfc3339(F.lit("2024-01-02 03:04:05.120").cast("timestamp")).alias("t"), fn.rfc3339(F.lit("2024-01-02 03:04:05").cast("timestamp")).alias("whole"),
        fn.event_ms(F.lit("12\tx")).alias("ms"), fn.event_ms(F.lit("x\ty")).alias("bad"), fn.payload_key(F.lit("1\tab cd\te")).alias("key"), fn.payload_key(F.lit("none"), strict=False).alias("none"),
    ).first()
    assert (int(row["n"]), int(row["u"]), row["short"]) == (258, 2**64 - 1, None)
    assert (row["t"], row["whole"]) == ("2024-01-02T03:04:05.12Z", "2024-01-02T03:04:05Z")
    assert (row["ms"], row["bad"], row["key"], row["none"]) == (12, None, "ab", None) and fn.quoted("a`b") == "`a``b`"
    df = spark.createDataFrame([(datetime(2024, 1, 1),)], "t timestamp_ntz")
    assert dict(zoned(df).dtypes) == {"t": "timestamp"} and dict(unzoned(zoned(df)).dtypes) == {"t": "timestamp_ntz"}


# --- change capture and views


def test_cdc_lifecycle(spark, tmp_path):
    path = f"{tmp_path}/shop.db"
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE people (id INTEGER PRIMARY KEY, name TEXT, score INTEGER)")
        db.execute("INSERT INTO people VALUES (1, 'alice', 10), (2, 'bob', 20)")
    config = CdcConfig(path, "people", "id", f"{tmp_path}/state")
    source = CdcSource(spark, config)

    def poll():
        out = [(r["op"], r["key"], json.loads(r["value"])) for r in source.poll(ts_ms=5).collect()]
        source.commit()
        return out

    first = poll()
    assert [(o, k) for o, k, _ in first] == [("c", "1"), ("c", "2")]
    assert first[0][2] == {"op": "c", "before": None, "after": {"id": 1, "name": "alice", "score": 10}, "source": {"db": "shop.db", "table": "people", "ts_ms": 5}}
    with sqlite3.connect(path) as db:
        db.execute("UPDATE people SET score = 42 WHERE id = 1")
    ((op, key, value),) = poll()
    assert (op, key, value["before"]["score"], value["after"]["score"]) == ("u", "1", 10, 42)
    with sqlite3.connect(path) as db:
        db.execute("DELETE FROM people WHERE id = 2")
    ((op, key, value),) = poll()
    assert (op, key, value["after"]) == ("d", "2", None)
    with sqlite3.connect(path) as db:
        db.execute("INSERT INTO people VALUES (3, 'carol', 7)")
    source = CdcSource(spark, config)  # a restart goes on from the last commit
    source.poll()
    assert [(o, k) for o, k, _ in poll()] == [("c", "3")] and poll() == [] and source.version == 5
    got = []
    source.run(lambda changes, version: got.append((changes.count(), version)), polls=1)
    assert got == [(0, 6)]
    with pytest.raises(ValueError):
        CdcConfig(path, "", "id", "x")


def test_cdc_blobs_and_kept_snapshots(spark, tmp_path):
    """Bytes come as strings, tables without rowid can be read, and old snapshots go."""
    import os

    path = f"{tmp_path}/shop.db"
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (id TEXT PRIMARY KEY, data BLOB) WITHOUT ROWID")
        db.execute("INSERT INTO t VALUES ('x', CAST('bytes' AS BLOB))")
    source = CdcSource(spark, CdcConfig(path, "t", "id", f"{tmp_path}/state"))
    (row,) = source.poll(ts_ms=1).collect()
    assert json.loads(row["value"])["after"] == {"id": "x", "data": "bytes"}
    for _ in range(4):
        source.commit()
        assert source.poll().count() == 0
    source.commit()
    kept = sorted(n for n in os.listdir(f"{tmp_path}/state") if not n.startswith("."))
    assert [n for n in kept if n.startswith("commit")] == ["commit-4", "commit-5"] and len(kept) == 4
    with pytest.raises(RuntimeError):
        source.commit()


def test_diff_nulls_and_new_columns(spark):
    before = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "id int, a string")
    after = spark.createDataFrame([(1, None, None), (2, None, None), (4, "z", 1)], "id int, a string, b int")
    assert sorted((r["op"], r["key"]) for r in cdc.diff(before, after, "id").collect()) == [("c", "4"), ("d", "3"), ("u", "2")]
    raw = spark.createDataFrame([(bytearray(b"ab"), datetime(2024, 1, 1))], "b binary, t timestamp")
    assert tuple(cdc.normalized(raw).first()) == ("ab", "2024-01-01T00:00:00Z")


def test_views_and_http(spark, tmp_path):
    registry = Registry(spark, str(tmp_path))
    balances, hits = registry.register("balances"), registry.register("counts", "long")
    assert registry.register("balances") is balances and registry.names() == ["balances", "counts"]
    change = "key string, value string, n int, gone boolean"
    balances.upsert(spark.createDataFrame([("alice", "50", 1, False), ("alice", "100", 2, False), ("bob", "7", 1, False)], change), 0, "n", "gone")
    assert balances.lookup("alice") == "100" and balances.size() == 2
    balances.upsert(spark.createDataFrame([("alice", None, 3, False), ("bob", "9", 3, True), ("carol", "1", 1, False)], change), 1, "n", "gone")
    assert balances.lookup("alice") is None and balances.lookup("bob") is None and balances.size() == 1
    for batch in (0, 1, 1, 2):  # batch 1 comes twice
        hits.add(spark.createDataFrame([("hits",)], "key string"), batch)
    assert hits.lookup_long("hits") == 3
    hits.add(spark.createDataFrame([("hits", -10)], "key string, d long"), 3, "d")
    assert hits.lookup_long("hits") == -7
    hits.add(spark.createDataFrame([("hits", 10)], "key string, d long"), 4, "d")
    with pytest.raises(TypeError):
        balances.lookup_long("carol")
    server = registry.serve()

    def get(path):
        try:
            with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{path}") as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    try:
        assert get("/view/") == (200, {"views": ["balances", "counts"]})
        assert get("/view/counts?key=hits") == (200, {"key": "hits", "value": "3", "uint64": "3"})
        assert get("/view/counts") == (200, {"name": "counts", "size": 1}) and get("/view/counts?key=") == (200, {"name": "counts", "size": 1})
        assert get("/view/counts?key=no")[0] == 404 and get("/view/no")[0] == 404
    finally:
        server.shutdown()


def test_changes_to_view(spark, tmp_path):
    """Table changes, joined to events, kept as a view."""
    before = spark.createDataFrame([(1, at(0))], "id int, at timestamp")
    after = spark.createDataFrame([(1, at(5)), (2, at(6))], "id int, at timestamp")
    events = spark.createDataFrame([(1, "p", at(8)), (2, "q", at(100))], "id int, what string, ts timestamp")
    out = jobs.changes_joined_to_view(before, after, "id", events, "id", "ts", "at", "0 seconds", "10 seconds")
    view = Registry(spark, str(tmp_path)).register("joined")
    view.upsert(out.select(F.col("id").alias("key"), F.col("what").alias("value"), "ts"), 0, "ts")
    assert rows(view.table()) == [("1", "p")]


# --- queries against SQL


def test_queries_equal_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("nation", "customer", "orders", "lineitem", "events", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)
    for name, q in queries.QUERIES.items():
        want = con.execute(queries.ORACLE_SQL[name])
        columns = [d[0] for d in want.description]
        got = q(spark, sf)
        assert sorted(columns) == sorted(got.columns), name
        assert rows(got.select(*columns)) == sorted(want.fetchall(), key=str), name


def test_plans(spark):
    """Filters and columns reach the scan; windows and counts have one exchange with partial sums before it."""
    sf = "/root/testdata/sf0.001"
    plan = queries.filter_map(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(value), IsNotNull(event_type), GreaterThan(value,50.0)" in plan and "props" not in plan
    plan = queries.sql_tumble(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_count" in plan and "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in plan
    plan = queries.interval_join(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
