"""The ten operators as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, crf_quality, kdtree, line_rules, packing, secrets, simhash, token_store, url_filter, warc
from millrace.llm.common import table

URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.read_warc(warc.write_warc(table(spark, sf_dir, "pages"), min_bytes=0))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read_tokens(token_store.write_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json")))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = crf_quality.fit_quality(documents, table(spark, sf_dir, "labels"))
    scored = crf_quality.score_quality(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(crf_quality.fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), secrets.EntropyRules(parts=True))
    spans = F.col("secret_spans")
    base = secrets.spans_text(F.filter(spans, lambda x: x["kind"] < 3))

    def count(kind: int):
        return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")

    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(base, 256).alias("base_sha256"), secrets.spans_text(spans).alias("spans"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), capacity=2048)


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge_documents(table(spark, sf_dir, "documents")).drop("text_hash", "host")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash", "root")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_bpe, op2_warc, op3_urls, op4_tokens, op5_quality, op6_secrets, op7_topk, op8_packing, op9_rules, op10_simhash, pipeline)}

_PARTS = """parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts)"""

ORACLE_SQL: dict[str, str] = {
    "op2_warc": """
WITH sized AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first, sha1(html) AS hex FROM sized),
quints AS (SELECT *, list_transform(range(8), lambda k: ('0x' || substr(hex, CAST(5 * k + 1 AS BIGINT), 5))::BIGINT) AS q FROM firsts)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(q, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 15) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 10) & 31) + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN first = page_id OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first = page_id OR first IS NULL THEN NULL ELSE first END AS refers_to
FROM quints""",
    "op3_urls": f"""
WITH {_PARTS},
rules(kind, rule, h, p) AS (VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'), ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')),
fits AS (SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(kind, length(rule)) AS kind FROM split LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL),
listed AS (SELECT host, count(kind) > 0 AND host <> '' AND count(*) FILTER (kind = 'block') >= 0.5 * count(kind) AS on_list FROM fits GROUP BY host)
SELECT page_id, fits.host, path, rule, coalesce(kind, CASE WHEN on_list THEN 'block' ELSE 'allow' END) AS verdict FROM fits JOIN listed ON fits.host = listed.host""",
    "op9_rules": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[ \t-\r]+'), lambda x: x <> '') AS w FROM d),
windows AS (SELECT r, i, list_slice(w, i, i + 7) AS words FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, words) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS place FROM again) GROUP BY r),
lines AS (SELECT * FROM (SELECT r, host, t, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^ \t-\r]')),
even AS (SELECT r, host, t, line, regexp_replace(trim(regexp_replace(lower(line), '[ \t-\r]+', ' ', 'g')), '[0-9]', '0', 'g') AS x FROM lines),
removed AS (SELECT host, x FROM even GROUP BY host, x HAVING count(DISTINCT t) > 20),
lost AS (SELECT r, sum(len(string_split(x, ' '))) AS n FROM even JOIN removed USING (host, x) GROUP BY r),
twice AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r),
counted AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(twice.n, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words, coalesce(lost.n, 0) AS gone
  FROM w LEFT JOIN repeated USING (r) LEFT JOIN twice USING (r) LEFT JOIN lost USING (r)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted)
SELECT * EXCLUDE (gone), NOT base_failed AND NOT (gone > 0 AND n_words - gone < 0.2 * n_words) AS kept FROM judged""",
    "op7_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.w) = len(c.w)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scored)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM ranked WHERE n <= 5""",
}
