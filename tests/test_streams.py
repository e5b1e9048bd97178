"""The same programs over streams: equal to tables, exactly once, late rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import windows
from millrace.plans import jobs
from millrace.sources import stream_files
from millrace.sources.topics import Topic
from millrace.streaming import sinks, stateful
from millrace.streaming.stream import Stream

T0 = datetime(2024, 1, 1)
SCHEMA = "k string, id long, ts timestamp"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def files(spark, folder, parts, schema=SCHEMA):
    """A file for each part, in the order in which a stream takes them."""
    import os
    import time

    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/tmp-{i}")
        os.makedirs(f"{folder}/in", exist_ok=True)
        name = next(x for x in os.listdir(f"{folder}/tmp-{i}") if x.endswith(".parquet"))
        os.rename(f"{folder}/tmp-{i}/{name}", f"{folder}/in/{i:03d}.parquet")
        when = time.time() - 1000 + i
        os.utime(f"{folder}/in/{i:03d}.parquet", (when, when))
    return stream_files(spark, f"{folder}/in", schema, per_batch=1)


def sample():
    rnd = random.Random(4)
    data = [(rnd.choice("abc"), i, at(i * 3 + rnd.randint(0, 20))) for i in range(240)]
    return data, [data[i : i + 80] for i in range(0, 240, 80)] + [[("end", 999, at(10**6))]]


def collected(spark, out):
    """Rows of all batches without the closing key's."""
    return sorted((tuple(r) for r in spark.read.option("basePath", out).parquet(f"{out}/*").drop("batch_id", "seq", "dedup_id").where("k <> 'end'").collect()), key=str)


@pytest.mark.parametrize("kind", ["tumbling", "sliding", "session"])
def test_windows_equal_table(spark, tmp_path, kind):
    data, parts = sample()
    stream = files(spark, str(tmp_path), parts)

    def program(df):
        s = Stream(df).with_timestamps("ts", "20 seconds").with_allowed_lateness("10 seconds").key_by("k")
        return {"tumbling": lambda: s.tumbling("30 seconds"), "sliding": lambda: s.sliding("30 seconds", "10 seconds"), "session": lambda: s.session("8 seconds")}[kind]()

    out = f"{tmp_path}/out"
    query = sinks.drain(program(stream).sink(out, f"{tmp_path}/cp", ["k", "win_start"]))
    want = sorted((tuple(r) for r in program(spark.createDataFrame(data, SCHEMA)).df.collect()), key=str)
    assert collected(spark, out) == want
    assert sinks.statistics(query)["rows_in"] == 241 and sinks.pending(f"{tmp_path}/cp") == []


def test_interval_join_equals_table(spark, tmp_path):
    rnd = random.Random(5)
    a = [(rnd.choice("ab"), i, at(i * 4)) for i in range(60)]
    b = [(rnd.choice("ab"), i, at(i * 4 + 2)) for i in range(60)]
    sa, sb = files(spark, f"{tmp_path}/a", [a[:30], a[30:]]), files(spark, f"{tmp_path}/b", [b[:30], b[30:]])

    def program(x, y):
        left = Stream(x).with_timestamps("ts", "1 hour").key_by("k")
        right = Stream(y.select("k", F.col("id").alias("bid"), F.col("ts").alias("bts"))).with_timestamps("bts", "1 hour").key_by("k")
        return left.interval_join(right, "-5 seconds", "9 seconds")

    sinks.drain(program(sa, sb).sink(f"{tmp_path}/out", f"{tmp_path}/cp", ["id", "bid"]))
    want = program(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)).df
    assert collected(spark, f"{tmp_path}/out") == sorted((tuple(r) for r in want.collect()), key=str)
    assert want.count() == sum(x[0] == y[0] and -5 <= (x[2] - y[2]).total_seconds() <= 9 for x in a for y in b)


def test_running_count_and_fold(spark, tmp_path):
    data, parts = sample()
    stream = files(spark, str(tmp_path), parts[:3])
    counted = Stream(stream).key_by("k").ordered_by("id").running_count()
    sinks.drain(counted.sink(f"{tmp_path}/out", f"{tmp_path}/cp", ["k", "count"], mode="update"))
    want = {(k, n + 1) for k in "abc" for n in range(sum(x[0] == k for x in data))}
    assert set(collected(spark, f"{tmp_path}/out")) == want
    assert sinks.state_rows(spark, f"{tmp_path}/cp", "acc").count() == 3
    folded = Stream(stream).key_by("k").ordered_by("id").reduce(lambda r: r.id, lambda acc, r: acc * 3 % 1009 + r.id)
    sinks.drain(folded.sink(f"{tmp_path}/out2", f"{tmp_path}/cp2", ["k", "value"], mode="update"))
    acc, seen = {}, []
    for k, i, _ in data:
        acc[k] = i if k not in acc else acc[k] * 3 % 1009 + i
        seen.append((k, acc[k]))
    assert collected(spark, f"{tmp_path}/out2") == sorted(seen, key=str)


def test_processor_with_state(spark, tmp_path):
    """Values by name are got, put, deleted and listed; they outlive a batch."""
    data, parts = sample()

    def step(state, row):
        name = "even" if row.id % 2 == 0 else "odd"
        state.put(name, state.get(name, 0) + row.id)
        if row.id % 10 == 0:
            state.delete("odd")
        return [(row.k, row.id, sum(v for _, v in state.items()))]

    out = stateful.process(files(spark, str(tmp_path), parts[:3]), "k", ["id"], step, "k string, id bigint, total bigint")
    sinks.drain(sinks.exactly_once(out, f"{tmp_path}/out", f"{tmp_path}/cp", ["id"], mode="update"))
    kept, want = {}, []
    for k, i, _ in data:
        mine = kept.setdefault(k, {})
        mine[i % 2] = mine.get(i % 2, 0) + i
        if i % 10 == 0:
            mine.pop(1, None)
        want.append((k, i, sum(mine.values())))
    assert collected(spark, f"{tmp_path}/out") == sorted(want, key=str)
    assert sinks.state_rows(spark, f"{tmp_path}/cp", "kv").count() == sum(map(len, kept.values()))


def test_late_demo_drops_the_last_line(spark, tmp_path):
    lines = jobs.late_demo(spark, 50_000).orderBy("arrival").select("value").collect()
    stream = files(spark, str(tmp_path), [[tuple(r)] for r in lines] + [[("999999\tend",)]], "value string")
    query = sinks.drain(sinks.discard(jobs.event_time_word_count(sinks.counted(stream, "lines"), out_of_order="10 seconds"), f"{tmp_path}/cp"))
    got = sinks.statistics(query)
    assert got["lines"] == 15 and got["rows_in"] == 15


def test_exactly_once_after_failure(spark, tmp_path):
    data, parts = sample()
    stream, out, cp = files(spark, str(tmp_path), parts[:3]), f"{tmp_path}/out", f"{tmp_path}/cp"
    with pytest.raises(Exception, match="stopped on purpose"):
        sinks.drain(sinks.exactly_once(stream, out, cp, ["id"], fail_after=1))
    assert sinks.pending(cp) == [1]
    sinks.drain(sinks.exactly_once(stream, out, cp, ["id"]))
    assert collected(spark, out) == sorted(((k, i, t) for k, i, t in data), key=str)
    ids = [r[0] for r in spark.read.option("basePath", out).parquet(f"{out}/*").select("dedup_id").collect()]
    assert len(ids) == len(set(ids)) == 240 and [b["status"] for b in sinks.batches(cp)] == ["C"] * 3


def test_replay_between_stream_reads(spark, tmp_path):
    """A batch that is written again, before, between and after reads of a stream, gives each record once."""
    topic = Topic(spark, f"{tmp_path}/topic", 2)
    frames = [spark.createDataFrame([(f"k{i}", f"v{n}-{i}") for i in range(3)], "key string, value string") for n in range(3)]

    def read():
        sinks.drain(sinks.exactly_once(topic.stream().select("key", "value"), f"{tmp_path}/out", f"{tmp_path}/cp", ["key"]))

    for n, frame in enumerate(frames):
        topic.produce(frame, n, ["key"])
        topic.produce(frame, n, ["key"])
        read()
        topic.produce(frame, n, ["key"])
        read()
    got = spark.read.parquet(f"{tmp_path}/out").select("value").collect()
    assert sorted(r["value"] for r in got) == sorted(f"v{n}-{i}" for n in range(3) for i in range(3))
    log = topic.read().collect()
    for p in range(2):
        assert sorted(r["offset"] for r in log if r["partition"] == p) == list(range(sum(r["partition"] == p for r in log)))


def test_dedup_can_be_switched_off(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, id long")
    for dedup, n in ((True, 2), (False, 4)):
        write = sinks.batch_writer(f"{tmp_path}/{dedup}", ["id"], dedup=dedup)
        write(rows, 0)
        write(rows, 0)
        out = spark.read.parquet(f"{tmp_path}/{dedup}")
        assert out.count() == n and sinks.unique(out).count() == 2


def test_late_rows(spark, tmp_path):
    """A row whose window has closed is dropped and counted; the router gives it to its own sink."""
    lines = [[("5000\ta b",), ("14500\ta",)], [("14600\tc",)], [("100\tlate",), ("12000\tb",)], [("999999\tend",)]]
    stream = files(spark, str(tmp_path), lines, "value string")
    query = sinks.drain(sinks.exactly_once(jobs.event_time_word_count(stream).withColumnRenamed("word", "k"), f"{tmp_path}/out", f"{tmp_path}/cp", ["k", "win_start"]))
    got = {(r[0], r[3]) for r in collected(spark, f"{tmp_path}/out")}
    assert got == {("a", 1), ("b", 1), ("c", 1)} and sinks.statistics(query)["late_rows"] == 1
    kept, late = [], []
    route = sinks.route_late("event_time", 1500, lambda d, n: kept.extend(d.collect()), lambda d, n: late.extend(d.collect()), f"{tmp_path}/position")
    sinks.drain(jobs.event_time_words(stream).writeStream.option("checkpointLocation", f"{tmp_path}/cp3").foreachBatch(route))
    assert [r["word"] for r in late] == ["late", "b"] and len(kept) == 5


def test_noop_and_idle(spark, tmp_path):
    _, parts = sample()
    stream = files(spark, str(tmp_path), parts)
    assert sinks.statistics(sinks.drain(sinks.discard(stream, f"{tmp_path}/cp")))["rows_in"] == 241
    query = sinks.run_until_idle(sinks.exactly_once(stream, f"{tmp_path}/out", f"{tmp_path}/cp2", ["id"]), 3)
    assert not query.isActive and spark.read.parquet(f"{tmp_path}/out").count() == 241


def test_gap_windows_on_streams(spark, tmp_path):
    data, parts = sample()
    df = files(spark, str(tmp_path), parts).withWatermark("ts", "1 minute")
    sinks.drain(sinks.exactly_once(windows.sliding(df, ["k"], "ts", "10 seconds", "40 seconds"), f"{tmp_path}/out", f"{tmp_path}/cp", ["k", "win_start"]))
    want = windows.sliding(spark.createDataFrame(data, SCHEMA), ["k"], "ts", "10 seconds", "40 seconds")
    assert collected(spark, f"{tmp_path}/out") == sorted((tuple(r) for r in want.collect()), key=str)
