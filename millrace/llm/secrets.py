"""Secret scans with DataFrame functions alone.

Three kinds have patterns of their own. The method adds "entropy" spans: within each candidate string
(a run of token characters) a window slides by one character; for each character class the counts of
the characters in the window are kept and changed by one entering and one leaving character, and with
them the sum of c*log2(c), which gives the window's Shannon entropy. A candidate whose greatest
windowed entropy reaches the class's limit is a span, unless the allow-list fits it. With ``parts``
spans of the three kinds end candidates, and what is left of a run beside them is judged by itself;
without, a candidate that touches such a span is dropped whole.

Spans are counted in code points, end exclusive. Positions come from splitting the text by the same
expression that finds the matches: lengths of gaps and matches add up to places.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import column, fresh, text_column

#: Fixed patterns of the three kinds; the last number is the least length of the given group.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12

CHUNK, _NONE = 128, (1 << 31) - 1


@dataclass(frozen=True)
class CharClass:
    """Candidates whose characters are all of ``alphabet``; ``limit`` is in bits over a window."""

    name: str
    alphabet: str
    limit: float


@dataclass(frozen=True)
class EntropyRules:
    least: int = 20
    window: int = 20
    classes: tuple[CharClass, ...] = (
        CharClass("hex", "0123456789ABCDEFabcdef", 3.0),
        CharClass("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.6),
    )
    #: A candidate that one of these finds is no secret: prose and paths (words of one case, a capital first
    #: at most, of under 20 letters between separators), ids with dashes, repeated placeholders.
    allow: tuple[str, ...] = (r"^(?!.*([a-z][A-Z]|[A-Z]{2}[a-z]|[A-Za-z]{20}))[^0-9]*$", r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", r"^[0-9_=+/-]*$", r"(?i)example|placeholder|x{6,}")
    #: Judge what base spans leave of a candidate.
    parts: bool = False


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _scan(values: Column, combine, zero: int) -> Column:
    """Running results of an associative ``combine`` over an array of ints.

    Appending to an array copies it, so values are run through in chunks and the chunks' results are
    put on top: the work for a text with very many spans stays near linear.
    """
    start = F.struct(F.lit(zero).alias("at"), F.array().cast("array<int>").alias("out"))

    def within(chunk: Column) -> Column:
        return F.aggregate(chunk, start, lambda acc, x: _let(combine(acc["at"], x), lambda v: F.struct(v.alias("at"), F.concat(acc["out"], F.array(v)).alias("out"))))

    def joined(chunks: Column) -> Column:
        bases = F.aggregate(chunks, start, lambda acc, c: F.struct(combine(acc["at"], c["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
        return F.flatten(F.zip_with(chunks, bases, lambda c, b: F.transform(c["out"], lambda v: combine(b, v))))

    return _let(values, lambda all_values: _let(F.transform(_chunks(all_values), within), joined))


def _chunks(values: Column) -> Column:
    """The array in slices of ``CHUNK``; an empty one is one empty slice."""
    last = F.floor(F.greatest(F.size(values) - 1, F.lit(0)) / CHUNK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(values, i * CHUNK + 1, F.lit(CHUNK)))


def _add(a: Column, b: Column) -> Column:
    return a + b


def _spans(text: Column, pattern: str, keep: tuple[int, int] | None = None) -> Column:
    """Array of (s, e, m) of the leftmost non-overlapping matches, m the matched string; ``keep``: (group, least length)."""
    full = F.regexp_extract_all(text, F.lit(pattern), 0)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    size = F.transform(F.regexp_extract_all(text, F.lit(pattern), keep[0]), F.length) if keep else F.transform(full, F.length)

    def placed(matches: Column) -> Column:
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: g + F.length(m))
        return F.zip_with(matches, _scan(steps, _add, 0), lambda m, end: F.struct((end - F.length(m)).alias("s"), end.alias("e"), m.alias("m")))

    found = _let(full, placed)
    if keep:
        sized = F.zip_with(found, size, lambda x, n: F.struct(x.alias("x"), n.alias("n")))
        found = F.transform(F.filter(sized, lambda y: y["n"] >= keep[1]), lambda y: y["x"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<s:int,e:int,m:string>>"))


def _apart(spans: Column, base: Column) -> Column:
    """Those of ``spans`` that touch none of ``base``: in order of starts, by the greatest end of base
    spans so far and the least start of those to come."""

    def tagged(xs: Column, own: int) -> Column:
        return F.transform(xs, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(own).alias("own"), (x["m"] if own else F.lit("")).alias("m")))

    def compared(rows: Column) -> Column:
        before = _scan(F.transform(rows, lambda x: F.when(x["own"] == 0, x["e"]).otherwise(F.lit(0))), F.greatest, 0)
        after = F.reverse(_scan(F.reverse(F.transform(rows, lambda x: F.when(x["own"] == 0, x["s"]).otherwise(F.lit(_NONE)))), F.least, _NONE))
        clear = F.zip_with(F.zip_with(rows, before, lambda x, b: F.when((x["own"] == 1) & (b <= x["s"]), x)), after, lambda x, a: F.when(a >= x["e"], x))
        return F.transform(F.filter(clear, lambda x: x.isNotNull()), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m")))

    return F.when((F.size(base) == 0) | (F.size(spans) == 0), spans).otherwise(_let(F.sort_array(F.concat(tagged(base, 0), tagged(spans, 1))), compared))


def max_entropy(text: Column, alphabet: str, window: int) -> Column:
    """Greatest Shannon entropy, in bits, of the windows of a string of characters of ``alphabet``.

    A string shorter than the window is one window. The state holds a count for each character and the
    sum of c*log2(c); each step changes one count up and, once the window is full, one count down.
    """
    codes = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(alphabet), c))

    def weight(c: Column) -> Column:
        return F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))

    def changed(counts: Column, code: Column, by: int) -> Column:
        return F.transform(counts, lambda c, i: F.when(i == code - 1, c + by).otherwise(c))

    def run(all_codes: Column) -> Column:
        leaving = F.concat(F.array_repeat(F.lit(0), window), all_codes)
        pairs = F.zip_with(all_codes, F.slice(leaving, F.lit(1), F.size(all_codes)), lambda new, old: F.struct(new.alias("new"), old.alias("old")))

        def step(acc, x):
            def entered(counts):
                c = F.element_at(counts, x["new"])
                total = acc["sum"] + weight(c.cast("double")) - weight((c - 1).cast("double"))

                def left(old_count):
                    total2 = F.when(x["old"] > 0, total + weight((old_count - 1).cast("double")) - weight(old_count.cast("double"))).otherwise(total)
                    n = F.least(acc["n"] + 1, F.lit(window))
                    h = F.log2(n.cast("double")) - total2 / n
                    return F.struct(
                        F.when(x["old"] > 0, changed(counts, x["old"], -1)).otherwise(counts).alias("counts"),
                        total2.alias("sum"),
                        n.alias("n"),
                        F.when(n == F.least(F.size(all_codes), F.lit(window)), F.greatest(acc["max"], h)).otherwise(acc["max"]).alias("max"),
                    )

                return _let(F.element_at(counts, F.greatest(x["old"], F.lit(1))), left)

            return _let(changed(acc["counts"], x["new"], 1), entered)

        zero = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(0.0).alias("max"))
        return F.aggregate(pairs, zero, step)["max"]

    return _let(codes, run)


def _entropy_spans(text: Column, base: Column, rules: EntropyRules) -> Column:
    alphabet = "".join(dict.fromkeys("".join(c.alphabet for c in rules.classes)))
    charset = "".join(sorted(alphabet.replace("-", ""))) + "-"
    pattern = "[" + charset.replace("\\", "\\\\").replace("]", "\\]").replace("^", "\\^") + "]{%d,}" % rules.least

    def secret(s: Column) -> Column:
        fits = F.lit(False)
        for c in reversed(rules.classes):
            inside = F.length(F.translate(s, c.alphabet, "")) == 0
            fits = F.when(inside, max_entropy(s, c.alphabet, rules.window) >= c.limit).otherwise(fits)
        allowed = F.lit(False)
        for p in rules.allow:
            allowed = allowed | s.rlike(p)
        return F.when(allowed, F.lit(False)).otherwise(fits)

    found = _spans(text, pattern) if rules.parts else _let(_spans(text, pattern), lambda spans: _apart(spans, base))
    return F.filter(found, lambda x: secret(x["m"]))


def find_secrets(documents: DataFrame, rules: EntropyRules | None = None) -> DataFrame:
    """All columns of ``documents`` and secret_spans: array of (s, e, kind, name) by start, then kind.

    Kinds: 0 assign, 1 access, 2 hex, 3 entropy. A null or empty text has none. Repeated rows have the
    same spans each. A column of the name secret_spans is replaced. No shuffle, no Python.
    """
    rules = rules or EntropyRules()
    text = text_column()

    def named(spans: Column, kind: int, name: str) -> Column:
        return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("kind"), F.lit(name).alias("name")))

    base = F.concat(named(_spans(text, ASSIGN, (2, ASSIGN_LEAST)), 0, "assign"), named(_spans(text, ACCESS), 1, "access"), named(_spans(text, HEX), 2, "hex"))
    order = [column(c) for c in documents.columns if c.lower() != "secret_spans"]
    of_base, of_blank = fresh(documents, "base", "blank")
    # A generated row is a border beyond which the optimiser doesn't copy the expressions of its columns.
    with_base = documents.select(*order, F.inline(F.array(F.struct(base.alias(of_base)))))
    searched = text
    if rules.parts:
        blank = _replaced(text, F.array_sort(F.col(of_base)), lambda x: F.repeat(F.lit(" "), F.greatest(x["e"] - F.greatest(x["s"], x["at"]), F.lit(0))))
        blank = F.when(F.size(of_base) > 0, blank).otherwise(text)
        with_base, searched = with_base.select("*", F.inline(F.array(F.struct(blank.alias(of_blank))))), F.col(of_blank)
    found = F.concat(F.col(of_base), named(_entropy_spans(searched, F.col(of_base), rules), 3, "entropy"))
    by_start = F.array_sort(found, lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).otherwise(a["kind"] - b["kind"]))
    return with_base.select(*order, F.inline(F.array(F.struct(by_start.alias("secret_spans")))))


def spans_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["name"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def _replaced(text: Column, spans: Column, put) -> Column:
    """``text`` with ``put`` of (s, e, at) for each of ``spans``, which are in order of starts; at is where the text goes on after all earlier spans."""
    until = _scan(F.transform(spans, lambda x: x["e"]), F.greatest, 0)
    rows = F.zip_with(spans, F.concat(F.array(F.lit(0)), until), lambda x, at: F.struct(x["s"].alias("s"), x["e"].alias("e"), at.alias("at")))

    def chunk_text(chunk: Column) -> Column:
        # one walk through the text for a chunk, then short ones within its part
        first, last = F.try_element_at(chunk, F.lit(1))["at"], F.try_element_at(chunk, F.lit(-1))["s"]
        part = text.substr(first + 1, F.greatest(last - first, F.lit(0)))
        return _let(part, lambda p: F.array_join(F.transform(chunk, lambda x: F.concat(F.when(x["s"] >= x["at"], p.substr(x["at"] - first + 1, x["s"] - x["at"])).otherwise(""), put(x))), ""))

    def all_text(rows: Column) -> Column:
        return F.array_join(F.transform(_chunks(rows), chunk_text), "")

    return F.concat(_let(F.filter(rows, lambda x: x["s"].isNotNull()), all_text), text.substr(F.array_max(until) + 1, F.length(text)))


def redact(found: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """Replace each span of ``find_secrets`` in text by a mark (overlapping spans by one) and set n_chars.

    Rows without spans, null texts among them, stay as they are.
    """
    text, spans = F.col("text"), F.col("secret_spans")
    done = _replaced(text, spans, lambda x: F.when(x["s"] >= x["at"], F.lit(mark)).otherwise(""))
    hit = F.size(spans) > 0
    out = found.select(*(F.when(hit, done).otherwise(text).alias("text") if c == "text" else column(c) for c in found.columns))
    out = out.select(*(F.when(hit, F.length("text").cast("long")).otherwise(column(c)).alias(c) if c == "n_chars" else column(c) for c in out.columns))
    return out.drop("secret_spans")
