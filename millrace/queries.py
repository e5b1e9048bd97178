"""One query for each operator of the engine over the given tables, and the same in SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import functions as fn
from millrace.operators import aggregates, cdc, joins, late, partition, windows
from millrace.plans import jobs, sqlfront
from millrace.session import shared_folder
from millrace.sources import stream_files, table
from millrace.streaming import sinks
from millrace.views import View

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


_TUMBLE = "SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS win_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS win_end, count(*) AS count FROM events GROUP BY ALL"


@query(_TUMBLE)
def sql_tumble(spark, sf):
    text = "SELECT event_type, COUNT(*) FROM events GROUP BY event_type, TUMBLE(ts, INTERVAL '60' MINUTE) EMIT ON WATERMARK INTO counts;"
    return sqlfront.sql(text, {"events": events(spark, sf)})[0]


@query(_TUMBLE)
def tumbling_count(spark, sf):
    return windows.tumbling(events(spark, sf), ["event_type"], "ts", "1 hour")


@query("""SELECT event_type, time_bucket(INTERVAL '6 hours', ts) AS win_start, time_bucket(INTERVAL '6 hours', ts) + INTERVAL '6 hours' AS win_end,
  count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most, count(DISTINCT user_id) AS users FROM events GROUP BY ALL""")
def tumbling_aggregates(spark, sf):
    aggs = [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("value").alias("least"), F.max("value").alias("most"), F.countDistinct("user_id").alias("users")]
    return windows.tumbling(events(spark, sf), ["event_type"], "ts", "6 hours", *aggs)


@query("""SELECT event_type, w AS win_start, w + INTERVAL '1 hour' AS win_end, count(*) AS count
FROM (SELECT event_type, time_bucket(INTERVAL '15 minutes', ts) - to_minutes(CAST(15 * i AS INTEGER)) AS w FROM events, range(4) t(i)) GROUP BY ALL""")
def sliding_count(spark, sf):
    return windows.sliding(events(spark, sf), ["event_type"], "ts", "1 hour", "15 minutes")


@query("""SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS win_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '20 minutes' AS win_end, count(*) AS count
FROM events WHERE ts < time_bucket(INTERVAL '1 hour', ts) + INTERVAL '20 minutes' GROUP BY ALL""")
def sliding_gap(spark, sf):
    return windows.sliding(events(spark, sf), ["event_type"], "ts", "20 minutes", "1 hour")


@query("""WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL '2 hours' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM f)
SELECT user_id, min(ts) AS win_start, max(ts) + INTERVAL '2 hours' AS win_end, count(*) AS count FROM s GROUP BY user_id, s""")
def session_count(spark, sf):
    return windows.session(events(spark, sf), ["user_id"], "ts", "2 hours")


@query("""WITH h AS (SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS w, count(*) AS c FROM events GROUP BY ALL)
SELECT event_type, time_bucket(INTERVAL '1 day', w) AS win_start, time_bucket(INTERVAL '1 day', w) + INTERVAL '1 day' AS win_end, CAST(max(c) AS BIGINT) AS peak, CAST(sum(c) AS BIGINT) AS total FROM h GROUP BY ALL""")
def chained_windows(spark, sf):
    hourly = windows.tumbling(events(spark, sf), ["event_type"], "ts", "1 hour").select("event_type", F.col("win_start").alias("ts"), "count")
    return windows.tumbling(hourly, ["event_type"], "ts", "1 day", F.max("count").alias("peak"), F.sum("count").alias("total"))


@query("""WITH c AS (SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS win_start, count(*) AS count FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY win_start ORDER BY count DESC, event_type) AS rank FROM c)
SELECT event_type, win_start, win_start + INTERVAL '1 hour' AS win_end, count, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 2""")
def topk_per_window(spark, sf):
    return windows.top_per_window(windows.tumbling(events(spark, sf), ["event_type"], "ts", "1 hour"), 2, "count", "event_type")


def _side(spark, sf, kind: str, prefix: str) -> DataFrame:
    return events(spark, sf).where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(f"{prefix}_id"), F.col("ts").alias(f"{prefix}_ts"))


@query("""SELECT a.user_id, a.event_id AS a_id, a.ts AS a_ts, b.event_id AS b_id, b.ts AS b_ts FROM events a JOIN events b ON a.user_id = b.user_id
AND a.event_type = 'purchase' AND b.event_type = 'click' AND a.ts >= b.ts AND a.ts <= b.ts + INTERVAL '1 hour'""")
def interval_join(spark, sf):
    return joins.interval_join(_side(spark, sf, "purchase", "a"), _side(spark, sf, "click", "b"), "user_id", "a_ts", "b_ts", "0 seconds", "1 hour")


@query("""SELECT a.user_id, a.event_id AS a_id, a.ts AS a_ts, b.event_id AS b_id, b.ts AS b_ts FROM events a JOIN events b ON a.user_id = b.user_id
AND a.event_type = 'purchase' AND b.event_type = 'click' AND b.ts BETWEEN a.ts - INTERVAL '30 minutes' AND a.ts + INTERVAL '30 minutes'""")
def symmetric_join(spark, sf):
    return joins.within_join(_side(spark, sf, "purchase", "a"), _side(spark, sf, "click", "b"), "user_id", "a_ts", "b_ts", "30 minutes")


@query("""SELECT o_orderkey, o_orderdate, l_linenumber, l_shipdate FROM orders JOIN lineitem ON o_orderkey = l_orderkey
AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL '30 days'""")
def order_ship_join(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_shipdate")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return joins.interval_join(lines, orders, "o_orderkey", "l_shipdate", "o_orderdate", "0 days", "30 days").select("o_orderkey", "o_orderdate", "l_linenumber", "l_shipdate")


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS count FROM events")
def running_count(spark, sf):
    rows = events(spark, sf).select("event_id", "user_id", "ts")
    return aggregates.running_count(rows, "user_id", ["ts", "event_id"], F.date_trunc("day", "ts")).drop("ts")


@query("""SELECT event_id, user_id, round(sum(value) OVER w, 3) AS total, max(value) OVER w AS most, min(value) OVER w AS least
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def keyed_reduce(spark, sf):
    rows = events(spark, sf).select("event_id", "user_id", "ts", "value")
    out = aggregates.running(rows, ["user_id"], ["ts", "event_id"], F.date_trunc("day", "ts"), total=("sum", "value"), most=("max", "value"), least=("min", "value"))
    return out.select("event_id", "user_id", F.round("total", 3).alias("total"), "most", "least")


@query("""SELECT user_id, CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list(event_id ORDER BY ts, event_id)), lambda acc, x: (acc * 31 + x) % 1000003) AS BIGINT) AS value FROM events GROUP BY user_id""")
def opaque_reduce(spark, sf):
    rows = events(spark, sf).select("user_id", "ts", "event_id")
    return aggregates.reduce(rows, "user_id", ["ts", "event_id"], lambda r: r.event_id % 1000003, lambda acc, r: (acc * 31 + r.event_id) % 1000003, "user_id long, value long")


_WORDS = "(SELECT unnest(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' ')) AS word FROM documents)"


@query(f"SELECT word, count(*) AS count FROM {_WORDS} WHERE word <> '' GROUP BY word")
def wordcount(spark, sf):
    return jobs.word_count(table(spark, sf, "documents"), "text")


@query(f"SELECT word, count(*) AS count FROM {_WORDS} WHERE word <> '' GROUP BY word ORDER BY count DESC, word LIMIT 10")
def wordcount_topk(spark, sf):
    return aggregates.top(jobs.word_count(table(spark, sf, "documents"), "text"), 10, "count", "word")


@query(f"SELECT word || chr(9) || count(*) AS value FROM {_WORDS} WHERE word <> '' GROUP BY word")
def wordcount_encoded(spark, sf):
    return jobs.word_count_lines(table(spark, sf, "documents"), "text")


@query("""WITH l AS (SELECT (epoch_us(ts) // 1000) AS ms, unnest(string_split(event_type || ' ' || user_id % 7, ' ')) AS word FROM events)
SELECT word, make_timestamp((ms // 3600000) * 3600000000) AS win_start, make_timestamp((ms // 3600000 + 1) * 3600000000) AS win_end, count(*) AS count FROM l GROUP BY ALL""")
def event_time_wordcount(spark, sf):
    lines = events(spark, sf).select(fn.tsv(fn.millis("ts"), F.concat_ws(" ", F.upper("event_type"), (F.col("user_id") % 7).cast("string"))).alias("value"))
    out = jobs.event_time_word_count(lines, "1 hour")
    return out.select("word", F.col("win_start").cast("timestamp_ntz").alias("win_start"), F.col("win_end").cast("timestamp_ntz").alias("win_end"), "count")


@query("""SELECT event_type || chr(9) || ((epoch_us(ts) // 1000) // 60000 * 60000) || chr(9) || ((epoch_us(ts) // 1000) // 60000 * 60000 + 60000) || chr(9) || count(*) AS value
FROM events GROUP BY event_type, (epoch_us(ts) // 1000) // 60000""")
def sql_raw_lines(spark, sf):
    lines = events(spark, sf).select(fn.tsv(fn.millis("ts"), F.concat_ws(" ", "event_type", "props")).alias("value"))
    return sqlfront.lower_lines(sqlfront.parse("select k, count(*) from t group by k, tumble(ts, interval '1' minute) emit on watermark"), lines)


@query("""WITH a AS (SELECT *, ts + to_seconds((event_id * 7919) % 7200) AS arrival, event_id % 4 AS p FROM events),
m AS (SELECT *, max(ts) OVER (PARTITION BY p ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM a)
SELECT event_id, coalesce(ts < seen - INTERVAL '30 minutes', false) AS late FROM m""")
def late_split(spark, sf):
    delay = F.make_dt_interval(secs=((F.col("event_id") * 7919) % 7200).cast("decimal(18,6)"))
    rows = events(spark, sf).select("event_id", "ts", (F.col("ts") + delay).alias("arrival"), (F.col("event_id") % 4).alias("p"))
    return late.split_late(rows, "ts", "p", "arrival", "event_id", "30 minutes").select("event_id", "late")


@query("SELECT event_id, upper(event_type) AS kind, value * 2 AS value, user_id FROM events WHERE value > 50 AND event_type <> 'error'")
def filter_map(spark, sf):
    return events(spark, sf).where("value > 50 AND event_type <> 'error'").select("event_id", F.upper("event_type").alias("kind"), (F.col("value") * 2).alias("value"), "user_id")


@query("""WITH RECURSIVE texts AS (SELECT CAST(event_id AS VARCHAR) AS key FROM events WHERE event_id % 3 <> 0),
fnv AS (SELECT key, 0 AS done, 2166136261::BIGINT AS h FROM texts UNION ALL SELECT key, done + 1, (xor(h, ascii(key[done + 1])::BIGINT) * 16777619) % 4294967296 FROM fnv WHERE done < length(key))
SELECT CAST(key AS BIGINT) AS n, 2 * CAST(key AS BIGINT) AS doubled, key, CAST(h % 4 AS INTEGER) AS partition FROM fnv WHERE done = length(key)""")
def doubler_routed(spark, sf):
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("x"), "event_id")).otherwise(F.col("event_id").cast("string"))
    return jobs.doubled(events(spark, sf).select(raw.alias("value")), 4)


@query("SELECT CAST(n AS BIGINT) AS n, CAST(n AS BIGINT) * 2 AS doubled FROM (SELECT TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'x' || event_id ELSE CAST(event_id AS VARCHAR) END AS BIGINT) AS n FROM events) WHERE n IS NOT NULL")
def doubler(spark, sf):
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("x"), "event_id")).otherwise(F.col("event_id").cast("string"))
    return jobs.doubled(events(spark, sf).select(raw.alias("value")))


@query("SELECT event_type || '-' || (user_id % 10) AS key, count(*) AS count FROM events GROUP BY 1")
def rekey(spark, sf):
    return aggregates.count(events(spark, sf).withColumn("key", F.concat_ws("-", "event_type", F.col("user_id") % 10)), "key")


@query("SELECT doc_id, unnest(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')) AS word FROM documents")
def tokenize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(fn.words("text")).alias("word"))


@query("SELECT event_id, (epoch_us(ts) // 1000) AS event_ms, event_type AS key, event_type || ' ' || props AS payload FROM events")
def parse_lines(spark, sf):
    lines = events(spark, sf).select("event_id", fn.tsv(fn.millis("ts"), F.concat_ws(" ", "event_type", "props")).alias("value"))
    return lines.select("event_id", fn.event_ms("value").alias("event_ms"), fn.payload_key("value").alias("key"), fn.payload("value").alias("payload"))


_FNV = "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(range(1, length({0}) + 1), lambda i: CAST(ascii(substr({0}, i, 1)) AS BIGINT))), lambda h, b: (xor(h, b) * 16777619) & 4294967295)"


@query(f"SELECT c_custkey, {_FNV.format('c_name')} AS hash, CAST({_FNV.format('c_name')} % 8 AS INTEGER) AS partition FROM customer")
def fnv_partition(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_name")
    return partition.route(rows, "c_name", 8).select("c_custkey", fn.fnv1a("c_name").alias("hash"), "partition")


@query("SELECT event_id, CAST(event_id % 4 AS INTEGER) AS partition FROM events")
def round_robin(spark, sf):
    return partition.round_robin(events(spark, sf).select("event_id"), "event_id", 4)


@query("SELECT CAST(p AS INTEGER) AS partition, CAST(p % 3 AS INTEGER) AS leader, CAST((p + 1) % 3 AS VARCHAR) || ',' || CAST((p + 2) % 3 AS VARCHAR) AS followers FROM range(12) t(p)")
def replica_assignment(spark, sf):
    return partition.replicas(spark, 12, [0, 1, 2]).withColumn("followers", F.array_join("followers", ","))


@query("SELECT CAST(n_nationkey AS INTEGER) AS partition, CAST(ntile(7) OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS member FROM nation")
def range_assign(spark, sf):
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("partition"))
    return partition.range_assign(nations, 7, 25)


def _log(spark, sf) -> DataFrame:
    rows = events(spark, sf).select("event_id", "event_type", (F.col("user_id") % 16).cast("int").alias("partition"))
    return partition.with_offsets(rows, ["event_id"])


_LOG = "l AS (SELECT event_id, event_type, CAST(user_id % 16 AS INTEGER) AS partition, row_number() OVER (PARTITION BY user_id % 16 ORDER BY event_id) - 1 AS \"offset\" FROM events)"


@query(f"WITH {_LOG} SELECT * FROM l WHERE partition = 3 AND \"offset\" >= 10 AND \"offset\" < 35")
def log_read(spark, sf):
    return partition.read(_log(spark, sf), 3, 10, 25)


@query(f"WITH {_LOG} SELECT partition, max(\"offset\") + 1 AS next_offset FROM l GROUP BY partition")
def next_offsets(spark, sf):
    return partition.next_offsets(_log(spark, sf))


@query(f"""WITH {_LOG}, k AS (SELECT * FROM l WHERE event_id % 50 <> 7), g AS (SELECT *, coalesce(lag("offset") OVER (PARTITION BY partition ORDER BY "offset") + 1, 0) AS expected FROM k)
SELECT event_id, event_type, partition, "offset", expected FROM g WHERE "offset" <> expected""")
def offset_gaps(spark, sf):
    return partition.gaps(_log(spark, sf).where("event_id % 50 <> 7"))


@query(f"WITH {_LOG} SELECT partition, count(*) AS count FROM l GROUP BY partition")
def replayed_append(spark, sf):
    log = _log(spark, sf)
    replay = log.unionByName(log.where("offset % 3 = 0"))
    return aggregates.count(partition.deduplicated(replay), "partition")


@query("SELECT CAST(user_id % 5 AS INTEGER) AS partition, count(*) FILTER (event_id % 97 = 0 AND user_id % 5 = 2) = 0 AS replicas_equal FROM events GROUP BY 1")
def replica_check(spark, sf):
    rows = events(spark, sf).select((F.col("user_id") % 5).cast("int").alias("partition"), F.length("event_type").alias("bytes"), "event_id")
    copies = rows.withColumn("replica", F.explode(F.array(*map(F.lit, range(3)))))
    return partition.replica_sizes(copies.where("NOT (replica = 1 AND partition = 2 AND event_id % 97 = 0)"))


@query("SELECT CAST(user_id % 8 AS INTEGER) AS shard, event_type, count(*) AS count FROM events GROUP BY ALL")
def shard_partial_counts(spark, sf):
    return aggregates.shard_counts(events(spark, sf), F.col("user_id") % 8, "event_type")


@query("SELECT event_type, count(*) AS count FROM events GROUP BY ALL")
def shard_total(spark, sf):
    return aggregates.total(shard_partial_counts(spark, sf), "event_type")


@query("""SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS win_start, count(*) AS count FROM events GROUP BY ALL""")
def windowed_shard_total(spark, sf):
    parts = windows.tumbling(events(spark, sf).withColumn("shard", F.col("user_id") % 8), ["shard", "event_type"], "ts", "1 hour")
    return aggregates.total(parts, "event_type", "win_start")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def latest_per_key(spark, sf):
    return aggregates.latest(events(spark, sf), ["user_id"], "event_id", "event_type", "value")


@query("""WITH t AS (SELECT regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') AS t FROM documents), n AS (SELECT len(list_filter(string_split(t, ' '), lambda w: w <> '')) AS n FROM t)
SELECT CAST(count(*) AS BIGINT) AS records_in, CAST(sum(n) AS BIGINT) AS records_out FROM n""")
def operator_counters(spark, sf):
    path = f"{sf}/documents.parquet"
    # a pattern, since a stream's path itself must be a folder
    lines = sinks.counted(stream_files(spark, f"{path}*", spark.read.parquet(path).select("text").schema), "records_in")
    out = sinks.counted(lines.select(F.explode(fn.words("text")).alias("word")), "records_out")
    got = sinks.statistics(sinks.drain(sinks.discard(out, f"{shared_folder(spark)}/counters-{uuid.uuid4().hex}")))
    return spark.createDataFrame([(got["records_in"], got["records_out"])], "records_in long, records_out long")


def _view(spark, kind: str) -> View:
    return View(spark, "query", f"{shared_folder(spark)}/view-{uuid.uuid4().hex}", kind)


def _halves(changes: DataFrame) -> list[DataFrame]:
    """All changes as two batches, earlier and later events."""
    half = (changes.agg(F.max("event_id")).first()[0] or 0) // 2
    return [changes.where(F.col("event_id") <= half), changes.where(F.col("event_id") > half)]


def _entries(spark, sf, view: View) -> DataFrame:
    return view.table().withColumn("key", F.col("key").cast(events(spark, sf).schema["user_id"].dataType))


@query("SELECT user_id AS key, value FROM (SELECT user_id, arg_max(event_type, event_id) AS value FROM events GROUP BY user_id) WHERE value <> 'error'")
def view_upsert(spark, sf):
    view = _view(spark, "string")
    changes = events(spark, sf).select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"), "event_id", (F.col("event_type") == "error").alias("gone"))
    for batch, part in enumerate(_halves(changes)):
        view.upsert(part, batch, "event_id", "gone")
    return _entries(spark, sf, view)


@query("SELECT user_id AS key, count(*) AS value FROM events GROUP BY 1")
def view_count(spark, sf):
    view = _view(spark, "long")
    for batch, part in enumerate(_halves(events(spark, sf).select(F.col("user_id").cast("string").alias("key"), "event_id"))):
        view.add(part, batch)
    return _entries(spark, sf, view)


@query("SELECT user_id AS key, CAST(sum(CAST(floor(value * 100) AS BIGINT) * CASE WHEN event_type = 'error' THEN -1 ELSE 1 END) AS BIGINT) AS value FROM events GROUP BY 1")
def view_sum(spark, sf):
    delta = F.floor(F.col("value") * 100).cast("long") * F.when(F.col("event_type") == "error", -1).otherwise(1)
    view = _view(spark, "long")
    for batch, part in enumerate(_halves(events(spark, sf).select(F.col("user_id").cast("string").alias("key"), "event_id", delta.alias("delta")))):
        view.add(part, batch, "delta")
    return _entries(spark, sf, view)


def _snapshots(spark, sf) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    changed = F.when(F.col("c_custkey") % 11 == 0, None).when(F.col("c_custkey") % 13 == 0, F.lit("NEW")).otherwise(F.col("c_mktsegment"))
    return c.where("c_custkey % 10 <> 1"), c.where("c_custkey % 10 <> 2").withColumn("c_mktsegment", changed)


_SNAPSHOTS = """b AS (SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 10 <> 1),
a AS (SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 10 <> 2)"""
_DIFF = f"""WITH {_SNAPSHOTS}, d AS (SELECT CASE WHEN b.c_custkey IS NULL THEN 'c' WHEN a.c_custkey IS NULL THEN 'd' WHEN b.c_mktsegment IS DISTINCT FROM a.c_mktsegment THEN 'u' END AS op,
  coalesce(a.c_custkey, b.c_custkey) AS k, b.c_mktsegment AS before_segment, a.c_mktsegment AS after_segment, a.c_acctbal AS balance FROM b FULL JOIN a ON a.c_custkey = b.c_custkey)"""


@query(_DIFF + " SELECT op, CAST(k AS VARCHAR) AS key, before_segment, after_segment FROM d WHERE op IS NOT NULL")
def cdc_diff(spark, sf):
    before, after = _snapshots(spark, sf)
    return cdc.diff(before, after, "c_custkey").select("op", "key", F.col("before.c_mktsegment").alias("before_segment"), F.col("after.c_mktsegment").alias("after_segment"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, 'c' AS op, c_name AS name, 1700000000000 AS ts_ms FROM customer")
def cdc_snapshot(spark, sf):
    rows = cdc.envelope(cdc.diff(None, table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey"), "shop", "customer", F.lit(1700000000000))
    read = lambda path: F.get_json_object("value", path)
    return rows.select("key", read("$.op").alias("op"), read("$.after.c_name").alias("name"), read("$.source.ts_ms").cast("long").alias("ts_ms"))


@query(_DIFF + """ SELECT CAST(e.event_id AS BIGINT) AS event_id, CAST(d.k AS VARCHAR) AS user_id, d.op FROM d JOIN events e ON e.user_id = d.k AND d.op IN ('c', 'u')
AND e.ts >= TIMESTAMP '2024-01-05' AND e.ts <= TIMESTAMP '2024-01-15'""")
def cdc_join_view(spark, sf):
    before, after = _snapshots(spark, sf)
    stamp = F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")
    rows = events(spark, sf).select("event_id", "user_id", "ts")
    out = jobs.changes_joined_to_view(before.withColumn("at", stamp), after.withColumn("at", stamp), "c_custkey", rows, "user_id", "ts", "at", "0 days", "10 days")
    return out.select("event_id", "user_id", "op")


@query("""SELECT event_id, lower(upper(event_type)) AS low, split_part(event_type || chr(9) || user_id, chr(9), 1) AS first, coalesce(TRY_CAST(CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE event_type END AS BIGINT), -1) AS parsed, (epoch_us(ts) // 1000) AS ms,
  make_timestamp((epoch_us(ts) // 1000) * 1000) AS back, base64(encode(event_type)) AS b64, decode(from_base64(base64(encode(event_type)))) AS unb64, json_extract_string(props, '$.k') AS k,
  lpad(lower(hex(event_id)), 16, '0') AS be, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS rfc FROM events""")
def scalar_functions(spark, sf):
    kind = F.col("event_type")
    return events(spark, sf).select(
        "event_id", F.lower(F.upper(kind)).alias("low"), F.split_part(F.concat_ws("\t", kind, "user_id"), F.lit("\t"), F.lit(1)).alias("first"), F.coalesce(F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string")).otherwise(kind).try_cast("long"), F.lit(-1).cast("long")).alias("parsed"),
        fn.millis("ts").alias("ms"), F.timestamp_millis(fn.millis("ts")).cast("timestamp_ntz").alias("back"), F.base64(F.encode(kind, "utf-8")).alias("b64"),
        F.decode(F.unbase64(F.base64(F.encode(kind, "utf-8"))), "utf-8").alias("unb64"), F.get_json_object("props", "$.k").alias("k"), F.lower(F.hex(fn.big_endian("event_id"))).alias("be"),
        fn.rfc3339(F.date_trunc("second", "ts")).alias("rfc"),
    )
