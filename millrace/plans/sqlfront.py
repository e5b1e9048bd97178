"""The streaming SQL dialect, lowered to the DataFrame API.

    SELECT key, COUNT(*) FROM source GROUP BY key, TUMBLE(ts, INTERVAL 'n' unit) EMIT ON WATERMARK [INTO sink] [;]

Keywords and units (millisecond, second, minute, singular or plural) are read in any case.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import event_time, payload_key, tsv
from millrace.operators.windows import tumbling

_TOKEN = re.compile(r"\s*(?:'([^']*)'|([A-Za-z_][A-Za-z0-9_]*)|([(),;*]))")
_UNITS = {"MILLISECOND": 1, "SECOND": 1000, "MINUTE": 60_000}


@dataclass(frozen=True)
class Query:
    key: str
    source: str
    ts: str
    size_ms: int
    sink: str | None = None


class SqlError(ValueError):
    pass


class _Tokens:
    def __init__(self, text: str):
        self.items, at = [], 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise SqlError(f"unexpected text at {at}: {text[at : at + 20]!r}")
            kind = "string" if m[1] is not None else "name" if m[2] else "sign"
            self.items.append((kind, m[1] if m[1] is not None else m[2] or m[3]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.items[self.at] if self.at < len(self.items) else ("end", "")

    def take(self, kind: str) -> str:
        got, text = self.peek()
        if got != kind:
            raise SqlError(f"expected a {kind}, got {text or 'the end'!r}")
        self.at += 1
        return text

    def expect(self, *wanted: str) -> None:
        for w in wanted:
            _, text = self.peek()
            if self.peek()[0] == "string" or text.upper() != w:
                raise SqlError(f"expected {w}, got {text or 'the end'!r}")
            self.at += 1

    def accept(self, wanted: str) -> bool:
        kind, text = self.peek()
        if kind != "string" and text.upper() == wanted:
            self.at += 1
            return True
        return False


def parse(text: str) -> Query:
    """Parse a statement; anything else is an SqlError, and so is an interval that isn't positive."""
    t = _Tokens(text)
    t.expect("SELECT")
    key = t.take("name")
    t.expect(",", "COUNT", "(", "*", ")", "FROM")
    source = t.take("name")
    t.expect("GROUP", "BY")
    grouped = t.take("name")
    if grouped.upper() != key.upper():
        raise SqlError(f"GROUP BY {grouped} doesn't fit SELECT {key}")
    t.expect(",", "TUMBLE", "(")
    ts = t.take("name")
    t.expect(",", "INTERVAL")
    number, unit = t.take("string").strip(), t.take("name").upper()
    if unit.removesuffix("S") not in _UNITS:
        raise SqlError(f"unknown unit {unit}")
    if not re.fullmatch(r"\d+", number) or int(number) == 0:
        raise SqlError(f"an interval must be a positive number, not {number!r}")
    t.expect(")", "EMIT", "ON", "WATERMARK")
    sink = t.take("name") if t.accept("INTO") else None
    t.accept(";")
    if t.peek()[0] != "end":
        raise SqlError(f"unexpected {t.peek()[1]!r} behind the statement")
    return Query(key, source, ts, int(number) * _UNITS[unit.removesuffix("S")], sink)


def lower(query: Query, source: DataFrame, out_of_order: str = "1 second") -> DataFrame:
    """Rows (key, win_start, win_end, count) of a query over a table or stream with its columns."""
    df = source.withWatermark(query.ts, out_of_order) if source.isStreaming else source
    return tumbling(df, [query.key], query.ts, f"{query.size_ms} milliseconds")


def lower_lines(query: Query, lines: DataFrame, out_of_order: str = "1 second") -> DataFrame:
    """The same over raw lines ``<ms> TAB key ...`` in column value: a row ``key TAB start TAB end TAB count``
    in column value. A line without a tab is an error."""
    parsed = lines.select(payload_key("value").alias(query.key), event_time("value").alias(query.ts))
    out = lower(query, parsed, out_of_order)
    return out.select(tsv(query.key, F.unix_millis("win_start"), F.unix_millis("win_end"), "count").alias("value"))


def sql(text: str, sources: dict[str, DataFrame], out_of_order: str = "1 second") -> tuple[DataFrame, str | None]:
    """Parse and lower over named sources; returns the rows and the sink's name."""
    query = parse(text)
    if query.source not in sources:
        raise SqlError(f"no source {query.source}")
    return lower(query, sources[query.source], out_of_order), query.sink
