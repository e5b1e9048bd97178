"""Column functions of the engine; all are built-in expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of 32-bit FNV-1a.
FNV_OFFSET, FNV_PRIME, WORD32 = 2166136261, 16777619, 4294967295


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """``names`` with as many underscores before them that none of ``columns`` has one of them."""
    taken, mark = {c.lower() for c in columns}, "__"
    while any((mark + n).lower() in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def words(text: Column | str) -> Column:
    """Array of the maximal runs of a-z and 0-9 of the text in lower case; null and empty texts have none."""
    parts = F.split(F.regexp_replace(F.lower(col(text)), "[^a-z0-9]+", " "), " ")
    return F.coalesce(F.array_remove(parts, ""), F.array().cast("array<string>"))


def fnv1a(key: Column | str) -> Column:
    """32-bit FNV-1a of the bytes of a string or binary key, as a long; null for null."""
    digits = F.hex(col(key).cast("binary"))
    n = F.octet_length(col(key).cast("binary"))
    byte = lambda i: F.conv(F.substring(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("long")
    step = lambda h, i: (h.bitwiseXOR(byte(i)) * FNV_PRIME).bitwiseAND(F.lit(WORD32))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.when(col(key).isNull(), None).otherwise(F.aggregate(places, F.lit(FNV_OFFSET).cast("long"), step))


def partition_of(key: Column | str, n: int, counter: Column | None = None) -> Column:
    """The key's partition of n; rows with a null or empty key go round by ``counter``, or to 0 without one."""
    empty = col(key).isNull() | (F.octet_length(col(key).cast("binary")) == 0)
    return F.when(empty, F.pmod(counter if counter is not None else F.lit(0), F.lit(n))).otherwise(fnv1a(key) % n).cast("int")


def event_ms(line: Column | str) -> Column:
    """Milliseconds before the first tab of a line; null if there are none."""
    return F.when(F.locate("\t", col(line)) > 0, F.split_part(col(line), F.lit("\t"), F.lit(1)).try_cast("long"))


def event_time(line: Column | str, fallback: Column | None = None) -> Column:
    """Event time of a line ``<ms> TAB ...``; lines without have the fallback, by default the present time."""
    return F.coalesce(F.timestamp_millis(event_ms(line)), fallback if fallback is not None else F.current_timestamp())


def payload(line: Column | str) -> Column:
    """What follows the first tab; null without a tab."""
    at = F.locate("\t", col(line))
    return F.when(at > 0, F.substring(col(line), at + 1, F.length(col(line))))


def payload_key(line: Column | str, strict: bool = True) -> Column:
    """The first token (up to a space or tab) after the first tab. A line without a tab is an error, or null unless ``strict``."""
    missing = F.raise_error(F.concat(F.lit("no tab in line: "), F.coalesce(col(line), F.lit("NULL")))) if strict else F.lit(None)
    return F.when(F.locate("\t", col(line)) > 0, F.regexp_extract(payload(line), "^([^\t ]*)", 1)).otherwise(missing.cast("string"))


def tsv(*columns: Column | str) -> Column:
    """Values joined by tabs, nulls as empty strings."""
    return F.concat_ws("\t", *(F.coalesce(col(c).cast("string"), F.lit("")) for c in columns))


def millis(time: Column | str) -> Column:
    return F.unix_millis(col(time).cast("timestamp"))


def big_endian(counter: Column | str) -> Column:
    """8 bytes, most significant first, of a long."""
    return F.unhex(F.lpad(F.hex(col(counter).cast("long")), 16, "0"))


def from_big_endian(data: Column | str) -> Column:
    """Unsigned number of 8 bytes as decimal(20,0); null unless there are 8."""
    return F.when(F.octet_length(col(data)) == 8, F.conv(F.hex(col(data)), 16, 10).cast("decimal(20,0)"))


def rfc3339(time: Column | str) -> Column:
    """UTC time as RFC 3339 with microseconds if there are any."""
    t = col(time).cast("timestamp")
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.regexp_replace(F.regexp_replace(F.date_format(t, ".SSSSSS"), "0+$", ""), "^\\.$", ""), F.lit("Z"))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
