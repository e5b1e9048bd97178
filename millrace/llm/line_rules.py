"""Quality rules with DataFrame functions alone: counts within a text, and line frequency across texts.

Within a text: words, word characters, symbols, repeated lines, and words in repeated 8-word windows.
Across texts: normalised lines are hashed, and for each host the distinct documents of each line are
counted. A line in more documents than the limit is removed; a document of which too little is left is
rejected.

A document is a text: exact copies of one count once. Near copies and pages of one template differ, so
they are many documents, and what more of them share than the limit goes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import column, fresh, small_or_shuffled, text_column, written

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
#: Bits of a window's place where hashes and places are sorted as one number.
PLACE_BITS = 20


@dataclass(frozen=True)
class LineRules:
    min_words: int = 20
    max_repeat_percent: int = 30
    #: A line in more than so many distinct documents of a host is removed.
    max_documents: int = 20
    #: A document is rejected if less than this share of its words is left.
    least_left: float = 0.2


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _border(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns as those of a generated row: later expressions use their values, not copies of them."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _windows(words: Column) -> Column:
    """Hashes of all windows: of each word once, then of neighbouring halves, which doubles their length."""

    def doubled(half: int):
        return lambda h: F.zip_with(F.slice(h, F.lit(1), F.size(h) - half), F.slice(h, F.lit(half + 1), F.size(h) - half), lambda a, b: F.xxhash64(a, b))

    hashes = F.transform(words, lambda x: F.xxhash64(x))
    for half in (1, 2, 4):
        hashes = _let(hashes, doubled(half))
    return F.when(F.size(words) >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>"))


def _suspects(windows: Column) -> Column:
    """Columns (``packed``) by which ``_suspect_places`` finds the few windows that may be repeated: their
    hashes' upper bits and places, sorted as plain numbers; null where no window is repeated."""
    low = (1 << PLACE_BITS) - 1
    packed = F.sort_array(F.transform(windows, lambda h, i: h.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("bigint"))))
    return F.when((F.size(F.array_distinct(windows)) < F.size(windows)) & (F.size(windows) <= low), packed)


def _suspect_places(packed: Column, windows: Column) -> Column:
    low = (1 << PLACE_BITS) - 1

    def upper(x: Column) -> Column:
        return F.shiftright(x, PLACE_BITS)

    alike = F.filter(packed, lambda x, k: F.coalesce(upper(x) == upper(F.get(packed, k - 1)), F.lit(False)) | F.coalesce(upper(x) == upper(F.get(packed, k + 1)), F.lit(False)))
    few = F.transform(alike, lambda x: x.bitwiseAND(F.lit(low)).cast("int"))
    whole = F.when(F.size(windows) > low, F.sequence(F.lit(0), F.size(windows) - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(packed.isNotNull(), few).otherwise(whole)


def _repeat_words(windows: Column, places: Column) -> Column:
    """Words in windows, of those at ``places``, whose hash occurs twice or more."""

    def covered(sorted_pairs: Column) -> Column:
        n = F.size(sorted_pairs)
        same = F.zip_with(F.slice(sorted_pairs, F.lit(1), n - 1), F.slice(sorted_pairs, F.lit(2), n - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
        found = F.sort_array(F.array_distinct(F.flatten(same)))
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(found, start, lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")))["n"]

    pairs = F.transform(places, lambda i: F.struct(F.get(windows, i).alias("h"), i.alias("i")))
    return F.when(F.size(places) > 0, _let(F.sort_array(pairs), covered)).otherwise(F.lit(0))


def normalised(line: Column) -> Column:
    """Lower case, single spaces, every digit a 0."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(line), SPACE, " ")), "[0-9]", "0")


def text_counts(documents: DataFrame, rules: LineRules, host: str = "source") -> DataFrame:
    """A row for each document, without its text: counts and lines (hash, words)."""
    text = F.col("__text")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), _host(host).alias("host"), text_column().alias("__text"))
    # a whole text is normalised at once; its lines are those of ``normalised``
    even = F.regexp_replace(F.regexp_replace(F.lower(text), r"[\x20\x09\x0B-\x0D]+", " "), "[0-9]", "0")
    lines = F.filter(F.transform(F.split(even, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = _border(rows, w=_words(text), lines=F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    rows = _border(rows, win=_windows(F.col("w")))
    rows = _border(rows, packed=_suspects(F.col("win")))
    rows = _border(rows, places=_suspect_places(F.col("packed"), F.col("win")))
    word_chars = F.length(F.array_join("w", ""))
    symbols = F.length("__text") - F.length(F.regexp_replace("__text", r"[#*$%&|<>]", ""))
    counted = rows.select(
        "doc_id", "host", F.xxhash64("__text").alias("text_hash"),
        F.size("w").cast("long").alias("n_words"), word_chars.cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("win"), F.col("places")).cast("long").alias("n_repeat_words"),
        F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " ")).alias("n"))).alias("lines"),
    )
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    return counted.select("*", failed.alias("base_failed"), F.monotonically_increasing_id().alias("row"))


def _host(host: str) -> Column:
    return F.coalesce(F.col(host).cast("string"), F.lit(""))


def removed_lines(counts: DataFrame, rules: LineRules) -> DataFrame:
    """(host, h), written: the lines in more than ``max_documents`` distinct texts of their host.

    First a text's copies become one, then a line's texts are counted, both with partial sums.
    """
    texts = counts.dropDuplicates(["host", "text_hash"])
    each = texts.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    removed = each.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > rules.max_documents)
    return written(removed.select("host", "h"), "removed-lines")


def judge_documents(documents: DataFrame, rules: LineRules | None = None, host: str = "source") -> DataFrame:
    """A row for each document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, and text_hash (xxhash64 of the text) and host.

    A null or empty text has no words and fails; a null host is the empty one; a null doc_id stays null;
    repeated rows are judged each and alike, and count as one document for line frequency. Windows,
    lines and texts are compared by 64-bit hashes. No Python.

    The removed lines are joined back to all lines of their host, by broadcast if the rows are few by
    count, else by a join that the adaptive skew join splits.
    """
    rules = rules or LineRules()
    counts = written(text_counts(documents, rules, host), "line-counts")
    return _judged(counts, removed_lines(counts, rules), rules)


def _judged(counts: DataFrame, removed: DataFrame, rules: LineRules) -> DataFrame:
    lines = counts.select("row", "host", F.inline("lines"))
    lost = lines.join(small_or_shuffled(removed), ["host", "h"]).groupBy("row").agg(F.sum("n").alias("lost"))
    judged = counts.drop("lines").join(lost, "row", "left")
    depleted = F.coalesce(F.col("n_words") - F.col("lost") < rules.least_left * F.col("n_words"), F.lit(False))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~depleted).alias("kept"), "text_hash", "host")


def _keyed(documents: DataFrame, host: str, *names: str) -> tuple[list[str], Column]:
    """Names that ``documents`` lacks for a row's doc_id, host and text_hash (or the latter two), and the
    condition that a row of ``documents`` has these values."""
    own = fresh(documents, *names)
    of = {"doc": F.col("doc_id").cast("long"), "host": _host(host), "text": F.xxhash64(text_column())}
    same = F.lit(True)
    for name, kind in zip(own, names, strict=True):
        same = same & (of[kind].eqNullSafe(F.col(name)) if kind == "doc" else of[kind] == F.col(name))
    return own, same


def drop_rejected(documents: DataFrame, judged: DataFrame, host: str = "source") -> DataFrame:
    """The documents that ``judged`` keeps, with their columns. Rows are matched by (doc_id, host, text),
    so that rows that share a doc_id have verdicts of their own."""
    (doc, at, text), same = _keyed(documents, host, "doc", "host", "text")
    rejected = judged.where(~F.col("kept")).select(F.col("doc_id").alias(doc), F.col("host").alias(at), F.col("text_hash").alias(text)).distinct()
    return documents.join(small_or_shuffled(written(rejected, "rejected")), same, "left_anti")


def clean_documents(documents: DataFrame, rules: LineRules | None = None, host: str = "source") -> DataFrame:
    """The documents that ``judge_documents`` keeps, with their columns, without the lines that it removes.

    n_chars (where there is such a column) is that of what is left. Texts without such a line stay as they
    are. Verdicts and lines depend on (host, text) alone: those of texts that change or go are one table,
    joined once, by broadcast if it is small by count; else that join shuffles the texts once.
    """
    rules = rules or LineRules()
    counts = written(text_counts(documents, rules, host), "line-counts")
    removed = removed_lines(counts, rules)
    (at, text), same = _keyed(documents, host, "host", "text")
    gone, out, hit = fresh(documents, "gone", "out", "hit")
    keys = [F.col("host").alias(at), F.col("text_hash").alias(text)]
    lines = counts.select("host", "text_hash", F.inline("lines")).join(small_or_shuffled(removed), ["host", "h"])
    lists = lines.groupBy(*keys).agg(F.collect_set("h").alias(gone))
    rejected = _judged(counts, removed, rules).where(~F.col("kept")).select(*keys, F.lit(True).alias(out)).distinct()
    changes = small_or_shuffled(written(lists.join(rejected, [at, text], "full_outer"), "changes"))
    rows = documents.join(changes, same, "left").where(F.col(out).isNull())
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(gone, F.xxhash64(normalised(x)))), "\n")
    is_hit = F.col(gone).isNotNull()
    cleaned = rows.select(*(F.when(is_hit, left).otherwise(column(c)).alias(c) if c == "text" else column(c) for c in documents.columns), is_hit.alias(hit))
    return cleaned.select(*(F.when(F.col(hit), F.length("text").cast("long")).otherwise(column(c)).alias(c) if c == "n_chars" else column(c) for c in documents.columns))
