"""Best-fit packing of token sequences after a Martello-Toth dominance reduction.

Only lengths matter, and there are at most ``capacity`` of them, so the packing problem is a table
of (length, count) however many documents there are. ``plan`` solves that small table: it fixes sets
that dominate every other set with the same item, many at once, and packs what is left by best fit
decreasing. Its answer is a list of runs: items number lo, lo+1, ... of a length go to consecutive
sequences. Each piece finds its number (its rank among pieces of its length) by a distributed prefix
sum, and from that its sequence and offset.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import slices, text_column, written
from millrace.llm.pieces import encoder


@dataclass(frozen=True)
class Run:
    """Items lo .. lo+n-1 of a length: ``per`` of them to each sequence from ``sequence`` on, from ``offset`` on."""

    length: int
    lo: int
    n: int
    sequence: int
    per: int
    offset: int


class _Packer:
    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = {s: n for s, n in counts.items() if n}
        self.sizes = sorted(self.left)
        self.capacity, self.given, self.runs, self.sequences = capacity, defaultdict(int), [], 0

    def take(self, size: int, n: int) -> int:
        lo = self.given[size]
        self.given[size] += n
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]
            self.sizes.pop(bisect.bisect_left(self.sizes, size))
        return lo

    def fix(self, members: list[int], times: int) -> None:
        """``times`` sequences with these lengths each."""
        offset, by = 0, defaultdict(int)
        for size in members:
            by[size] += 1
        for size, per in by.items():
            self.runs.append(Run(size, self.take(size, per * times), per * times, self.sequences, per, offset))
            offset += size * per
        self.sequences += times

    def largest(self, most: int, without: dict[int, int]) -> int | None:
        """The largest length up to ``most`` of which an item is left beside those of ``without``."""
        i = bisect.bisect_right(self.sizes, most) - 1
        while i >= 0 and self.left[self.sizes[i]] <= without.get(self.sizes[i], 0):
            i -= 1
        return self.sizes[i] if i >= 0 else None

    def smallest(self, size: int, n: int) -> list[int]:
        """The n smallest items beside one of ``size``."""
        out = []
        for s in self.sizes:
            out += [s] * min(n - len(out), self.left[s] - (s == size))
            if len(out) == n:
                break
        return out

    def pairs(self, size: int, room: int) -> tuple[int, int, int] | None:
        """Beside one of ``size``, of all pairs x >= y with x + y <= room: the greatest y, its greatest x, the greatest x + y."""
        found = None
        for y in reversed(self.sizes[: bisect.bisect_right(self.sizes, room // 2)]):
            if self.left[y] <= (y == size):
                continue
            x = self.largest(room - y, {size: 1, y: 1 + (y == size)})
            if x is not None and x >= y:
                found = (x, y, x + y) if found is None else (*found[:2], max(found[2], x + y))
        return found

    def times(self, members: list[int]) -> int:
        """How often these lengths can be taken together."""
        return min(self.left[m] // members.count(m) for m in set(members))

    def reduce(self) -> None:
        """For each length s from the largest: fix the sets that dominate all others with an item of s.

        With room r = capacity - s: an item that nothing fits beside stays alone; where at most one
        more fits, or the largest that fits fills r, that one goes with it; where at most two more
        fit, a pair does whose items are as large as either can be in any such pair and that no
        single item outdoes, or a single item at least as large as any pair.

        Taking items away leaves fewer other sets, so a set that dominates does so again while all its
        lengths are there: it is fixed as often at once. Each step uses up a length (all but one of it
        at most), so there are no more than three runs for each of twice as many steps as lengths.
        """
        for s in sorted(self.left, reverse=True):
            while s in self.left:
                room, small = self.capacity - s, self.smallest(s, 3)
                best = self.largest(room, {s: 1})
                if best is None:
                    members = [s]
                elif best == room or len(small) < 2 or small[0] + small[1] > room:
                    members = [s, best]
                elif len(small) < 3 or sum(small) > room:
                    pair = self.pairs(s, room)
                    if pair is None or pair[2] <= best:
                        members = [s, best]
                    elif pair[0] == best:
                        members = [s, best, pair[1]]
                    else:
                        break
                else:
                    break
                self.fix(members, self.times(members))

    def best_fit(self) -> None:
        """Largest first, each into the open sequence with the least room that suffices."""
        rooms: list[int] = []
        groups: dict[int, list[tuple[int, int]]] = {}

        def put(room: int, first: int, n: int) -> None:
            if room and n:
                if room not in groups:
                    bisect.insort(rooms, room)
                    groups[room] = []
                groups[room].append((first, n))

        for s in sorted(self.left, reverse=True):
            while n := self.left.get(s, 0):
                i = bisect.bisect_left(rooms, s)
                if i < len(rooms):
                    room = rooms[i]
                    first, size = groups[room].pop()
                    if not groups[room]:
                        del groups[room]
                        rooms.pop(i)
                else:
                    room, first, size = self.capacity, self.sequences, -(-n // (self.capacity // s))
                    self.sequences += size
                per = room // s
                full = min(size, n // per)
                if full:
                    self.runs.append(Run(s, self.take(s, full * per), full * per, first, per, self.capacity - room))
                    put(room - per * s, first, full)
                if full < size:
                    rest = n - full * per
                    if rest:
                        self.runs.append(Run(s, self.take(s, rest), rest, first + full, rest, self.capacity - room))
                        put(room - rest * s, first + full, 1)
                    put(room, first + full + bool(rest), size - full - bool(rest))


def plan(counts: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """Runs that place every item, and the number of sequences. ``counts``: items of each length."""
    if any(s < 1 or s > capacity for s in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    p = _Packer(counts, capacity)
    p.reduce()
    p.best_fit()
    return p.runs, p.sequences


def cut_documents(documents: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Tokenise whole texts and cut longer ones: doc_id, piece, start, length, ids_crc32[, ids], and
    (part, nth): the place among the pieces of this length that one task made. Written as a table."""

    def run(batches):
        end, tokens, seen = np.array([end_id], "<u4").tobytes(), encoder(tokenizer_path), defaultdict(int)
        part = TaskContext.get().partitionId()
        for batch in slices(batches):
            rows = []
            for doc, packed in zip(batch.column(0).to_pylist(), tokens.encode(batch.column(1).to_pylist()), strict=True):
                packed += end
                for k, at in enumerate(range(0, len(packed), 4 * capacity)):
                    ids = packed[at : at + 4 * capacity]
                    n = len(ids) // 4
                    rows.append((doc, k, at // 4, n, zlib.crc32(ids), part, seen[n], *([ids] if keep_ids else [])))
                    seen[n] += 1
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names[: len(cols)])

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", "ids"]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids binary" * keep_ids
    rows = documents.select(F.col("doc_id").cast("long"), text_column().alias("text"))
    return written(rows.mapInArrow(run, schema), "pieces")


def pack(documents: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pack all documents into few sequences of at most ``capacity`` tokens.

    A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, with
    ``keep_ids``, ids (little-endian unsigned 32-bit). A document is its ids and the end id; a null or
    empty text is the end id alone; only documents longer than ``capacity`` are cut. Repeated rows and
    doc_ids are packed each; an empty table gives no rows. Pieces that are as long as a sequence, and
    hot lengths, need no task of their own: ranks come from counts per (task, length), and the table
    of lengths that the driver solves has at most ``capacity`` rows.
    """
    pieces = cut_documents(documents, tokenizer_path, capacity, end_id, keep_ids)
    made = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = plan(counts, capacity)
    by: dict[int, list[Run]] = defaultdict(list)
    for r in sorted(runs, key=lambda r: (r.length, r.lo)):
        by[r.length].append(r)
    where = {s: tuple(np.array([getattr(r, k) for r in rs], np.int64) for k in ("lo", "sequence", "per", "offset")) for s, rs in by.items()}

    def place(batches):
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            length, rank = (batch.column(at[k]).to_numpy(zero_copy_only=False) for k in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for s in np.unique(length).tolist():
                rows = np.flatnonzero(length == s)
                lo, first, per, start = where[s]
                i = np.searchsorted(lo, rank[rows], "right") - 1
                k = rank[rows] - lo[i]
                sequence[rows], offset[rows] = first[i] + k // per[i], start[i] + k % per[i] * s
            keep = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(at[n]) for n in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = made.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    out = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    ranked = pieces.join(bases, ["part", "length"]).select(*out, (F.col("nth") + F.col("base")).alias("rank"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)
