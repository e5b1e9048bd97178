"""SimHash near-duplicates with pivot distance tables.

A text's fingerprint has 64 bits. For many reference fingerprints (pivots) the Hamming distance of each
fingerprint is computed once. By the triangle inequality two fingerprints within d bits have distances
to every pivot that differ by at most d, so a pair whose greatest coordinate difference is above d is
discarded by its table rows alone; pairs that survive are verified.

Which pairs meet at all: bits are cut into blocks; fingerprints within d bits agree in at least
``blocks - d`` of them, so each fingerprint goes to a cell for every choice of that many blocks, and
pairs meet in cells. A cell with more than ``cell_rows`` fingerprints is cut into parts, and every two
parts meet in a cell of their own, so no cell is large and no pair is lost. A cell doesn't return its
pairs but a spanning forest of its links; components then join the forests.

``near_copies`` links by similarity instead of bits. At a similarity of 0.8 a tenth of the bits or more
differ, too many for blocks, so its fingerprints have 256 bits and its cells are tables of sampled bits:
many enough that a pair at the bound meets in one with a chance of ``RECALL``. Pivots discard, distances
build the forests, nearest pairs first, and the exact Jaccard similarity of the forests' pairs decides.
What that leaves out is found by an exact prefix filter: with shingles in one order for all texts, two sets
at the bound share one among the first of each, so the texts that the links found so far don't join
meet by these shingles. Sizes, places and counts of shingles by hash discard pairs, none of them a similar one.
"""

from __future__ import annotations

import math
from fractions import Fraction
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import fresh, shuffle_partitions, slices, small_or_shuffled, text_column, written
from millrace.llm.components import components

BITS, SEED, CELL_ROWS, BATCH_ROWS = 64, 42, 512, 100_000
#: Words of a wide fingerprint, the chance that a pair at the bound meets, and standard deviations of its distance.
WORDS, RECALL, SPREAD = 4, 0.97, 2.33
#: Counters of a set's shingles, shingles in a part of a large cell, and for their order: texts whose shingles are
#: counted, the count that makes one frequent, the most frequent ones that are told from others.
COUNTERS, CELL_SHINGLES, ORDER_TEXTS, ORDER_COUNT, ORDER_SHINGLES = 128, 1 << 20, 20_000, 4, 1 << 17
#: Rows with counters that a worker holds at once, or one cell's.
WIDE_ROWS = 16_384


def shingle_hashes(text: str, shingle: int) -> list[np.ndarray]:
    """XXH64 of a text's shingles, repeats included, in parts: A-Z in lower case, words between ASCII white space."""
    words = text.encode().lower().split()
    if not words:
        return []
    k = min(shingle, len(words))
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n))
    starts = [0, *(e + 1 for e in ends[: len(words) - k])]
    return [
        np.array([digest(joined[s:e], SEED) for s, e in zip(starts[a : a + (1 << 16)], ends[a + k - 1 : a + (1 << 16) + k - 1], strict=True)], "<u8")
        for a in range(0, len(starts), 1 << 16)
    ]


def _majority(parts: list[np.ndarray]) -> int:
    """The bits that are set in over half of the hashes; 0 without any."""
    totals = np.zeros(BITS, np.int64)
    for hashes in parts:
        totals += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * totals > sum(map(len, parts)), bitorder="little").view("<u8")[0])


def fingerprint(text: str, shingle: int = 3) -> int:
    """SimHash of a text: A-Z in lower case, words between ASCII white space, shingles with repeats; 0 without words."""
    return _majority(shingle_hashes(text, shingle))


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """Sorted hashes of a text's different shingles."""
    return np.unique(np.concatenate(shingle_hashes(text, shingle) or [np.zeros(0, "<u8")]))


def _mixed(hashes: np.ndarray, word: int) -> np.ndarray:
    """Hashes for another word of a wide fingerprint (the 64-bit finaliser of a split-mix generator)."""
    h = hashes + np.uint64(word * 0x9E3779B97F4A7C15 % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def wide_fingerprint(hashes: np.ndarray, words: int = WORDS) -> list[int]:
    """SimHash of ``words`` times 64 bits of a set of hashes."""
    parts = [hashes[a : a + (1 << 16)] for a in range(0, len(hashes), 1 << 16)]
    return [_majority([_mixed(p, w) if w else p for p in parts]) for w in range(words)]


def fingerprints(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp long) for each row; map-only. A null text is an empty one, with fingerprint 0."""

    def run(batches):
        for batch in slices(batches):
            fp = np.array([fingerprint(t, shingle) for t in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    rows = documents.select(F.col("doc_id").cast("long"), F.xxhash64(text_column()).alias("text_hash"), text_column().alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def pivots(n: int) -> np.ndarray:
    """Reference fingerprints: the first n values of a seeded generator."""
    return np.random.default_rng(64).integers(0, 1 << 64, n, np.uint64, endpoint=False) if n else np.zeros(0, np.uint64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bits_differ(fp: Column, ref: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(_signed(ref)).cast("long"))).cast("long")


def pivot_table(fp: Column | list[Column], refs: np.ndarray) -> list[Column]:
    """A fingerprint's distances to ``refs``, a byte each (255 for more), eight to a long. A fingerprint of
    several words has references of as many."""
    words = fp if isinstance(fp, list) else [fp]
    each = [F.least(F.lit(255), reduce(Column.__add__, (_bits_differ(w, r) for w, r in zip(words, ref, strict=True)))).cast("long") for ref in refs.reshape(-1, len(words)).tolist()]
    return [reduce(Column.bitwiseOR, (F.shiftleft(d, 8 * i) for i, d in enumerate(each[a : a + 8]))) for a in range(0, len(each), 8)]


def block_masks(blocks: int) -> list[int]:
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    return [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:], strict=False)]


def blocks_for(rows: int, distance: int) -> int:
    """As many blocks that a cell has few of ``rows`` even fingerprints: the agreeing bits grow with them."""
    blocks = distance + 1
    while blocks < 2 * distance + 2 and rows >> (BITS * (blocks - distance) // blocks) > CELL_ROWS // 4:
        blocks += 1
    return blocks


def bound_of(similarity: float, bits: int) -> int:
    """Bits by which fingerprints of equally large sets of this Jaccard similarity differ, ``SPREAD`` deviations more."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return min(bits, math.ceil(bits * share + SPREAD * math.sqrt(bits * share * (1 - share))))


def sampled_tables(rows: int, similarity: float, bits: int) -> list[list[int]]:
    """Masks (a word each) of sampled bits for each table: so many bits that a cell has about 32 of ``rows`` even
    fingerprints, so many tables that a pair of this similarity agrees in one with a chance of ``RECALL``."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    width = min(bits, max(6, math.ceil(math.log2(max(1, rows) / 32))))
    count = math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - share) ** width)) if share else 1
    rng = np.random.default_rng(32)
    chosen = [rng.choice(bits, width, replace=False).tolist() for _ in range(count)]
    return [[sum(1 << (x % BITS) for x in c if x // BITS == w) for w in range(bits // BITS)] for c in chosen]


def _forest(cell: np.ndarray, fp: np.ndarray, table: np.ndarray, distance: int, steps: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links within cells, as row numbers; rows are sorted by cell number.

    ``fp`` has a row of words for each fingerprint, ``table`` its distances to pivots. With more ``steps``
    links of smaller distances are taken first.
    """
    root, out = np.arange(len(fp)), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = int(root[i])
        return i

    for limit in (distance * k // steps for k in range(1, steps + 1)):
        live, step = np.arange(len(fp) - 1), 1
        while len(live):
            live = live[live + step < len(fp)]
            live = live[cell[live] == cell[live + step]]
            a = live[root[live] != root[live + step]]
            b = a + step
            near = (np.abs(table[a] - table[b]) <= limit).all(1)
            a, b = a[near], b[near]
            near = np.bitwise_count(fp[a] ^ fp[b]).sum(1, dtype=np.int64) <= limit
            for i, j in zip(a[near].tolist(), b[near].tolist(), strict=True):
                x, y = find(i), find(j)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.append((i, j))
            if near.any():
                while not (root[root] == root).all():
                    root[:] = root[root]
            step += 1
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def links(distinct: DataFrame, distance: int = 3, n_pivots: int = 16, blocks: int | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (a long, b long) between distinct fingerprints (fp long, written) within ``distance`` bits:
    not all of them, but enough that components are the same."""
    blocks = blocks or blocks_for(distinct.count(), distance)
    chosen = [[sum(c)] for c in combinations(block_masks(blocks), blocks - distance)]
    return _meet(distinct, "fp", ["fp"], chosen, distance, n_pivots, cell_rows)


def _meet(distinct: DataFrame, node: str, words: list[str], chosen: list[list[int]], distance: int, n_pivots: int, cell_rows: int, steps: int = 1) -> DataFrame:
    """Links (a long, b long) between nodes whose fingerprints meet in a cell: rows that agree in the bits
    of one of the ``chosen`` masks."""
    fp = [F.col(w) for w in words]
    masked = [[w.bitwiseAND(F.lit(_signed(m)).cast("long")) for w, m in zip(fp, masks, strict=True)] for masks in chosen]
    keys = F.array(*(F.struct(F.lit(i).alias("t"), (m[0] if len(m) == 1 else F.xxhash64(*m)).alias("v")) for i, m in enumerate(masked)))
    # computed once for each fingerprint; the copies in cells carry the table
    table = pivot_table(fp, pivots(n_pivots * len(fp)))
    names = [f"d{i}" for i in range(len(table))]
    carried = [*dict.fromkeys([node, *words]), *names]
    first, last = carried.index(words[0]), len(carried) - len(names)
    rows = distinct.select(*carried[:last], *(d.alias(n) for n, d in zip(names, table, strict=True)), F.inline(keys))
    large = rows.groupBy("t", "v").agg(F.count("*").alias("n")).where(F.col("n") > cell_rows).select("t", "v", F.ceil(F.col("n") / cell_rows).cast("int").alias("parts"))
    large = small_or_shuffled(written(large, "large-cells"))
    parted = rows.join(large, ["t", "v"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64(node), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    cells = parted.select("t", "v", *carried, own.alias("own"), other.alias("other")).select("t", "v", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *carried)

    def run(batches):
        held, size = [], 0

        def done(cell, fp, near):
            edge = np.concatenate([[True], (cell[1:] != cell[:-1]).any(1)]) if len(fp) else np.zeros(0, bool)
            a, b = _forest(np.cumsum(edge), fp[:, first:].view(np.uint64), near.astype(np.int16), distance, steps)
            return pa.RecordBatch.from_arrays([pa.array(fp[a, 0]), pa.array(fp[b, 0])], names=["a", "b"])

        def joined():
            return tuple(np.concatenate([h[k] for h in held]) for k in range(3))

        for batch in batches:
            columns = [np.asarray(c, np.int64) for c in batch.columns]
            fp, tables = np.stack(columns[4 : 4 + last], 1), columns[4 + last :]
            near = np.stack(tables, 1).view(np.uint8) if tables else np.zeros((batch.num_rows, 0), np.uint8)
            held.append((np.stack(columns[:4], 1), fp, near))
            size += batch.num_rows
            if size >= BATCH_ROWS:
                cell, fp, near = joined()
                cut = len(fp) - int((cell == cell[-1]).all(1)[::-1].argmin()) if (cell[0] != cell[-1]).any() else 0
                if cut:
                    yield done(cell[:cut], fp[:cut], near[:cut])
                held, size = [(cell[cut:], fp[cut:], near[cut:])], len(fp) - cut
        if size:
            yield done(*joined())

    dealt = cells.repartition(shuffle_partitions(distinct.sparkSession), "t", "v", "i", "j").sortWithinPartitions("t", "v", "i", "j", node)
    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(documents: DataFrame, distance: int = 3, shingle: int = 3, n_pivots: int = 16, blocks: int | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """For each row: doc_id, fingerprint (16 hex digits), component_id, text_hash (xxhash64 of the text),
    root (the least fingerprint of the component).

    Fingerprints within ``distance`` bits are linked; component_id is the smallest doc_id that links
    reach, the row's own included. Texts without words (null and empty ones too) have fingerprint zero
    and are linked like others; repeated rows share a component; a null doc_id has the smallest doc_id
    of its component, or null if there is none. Copies are one fingerprint from the start, so a group
    of any size costs one row in the search.
    """
    rows = written(fingerprints(documents, shingle), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    found = written(links(classes.select("fp"), distance, n_pivots, blocks, cell_rows), "links")
    of_class = _rooted(classes, found)
    return rows.join(of_class, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "text_hash", "root")


def _rooted(classes: DataFrame, found: DataFrame) -> DataFrame:
    """(fp, root, component_id) of classes (fp, least doc_id) that ``found`` links."""
    roots = components(found).withColumnRenamed("node", "fp")
    joined = written(classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    smallest = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return joined.join(smallest, "root").select("fp", "root", "component_id")


def shingle_rows(documents: DataFrame, shingle: int, keep: bool) -> DataFrame:
    """(doc_id, text_hash, fp, w0 to w3) for each row, or with ``keep`` (fp, hashes): fp is a hash of the text's
    set of shingles, w0 to w3 its wide fingerprint, hashes the set itself. A null text is an empty one."""

    def run(batches):
        for batch in slices(batches):
            sets = [shingle_set(t, shingle) for t in batch.column(2).to_pylist()]
            fp = pa.array(np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in sets], np.uint64).view(np.int64))
            if keep:
                hashes = pa.ListArray.from_arrays(np.cumsum([0, *map(len, sets)]).astype(np.int32), np.concatenate([*sets, np.zeros(0, "<u8")]).view(np.int64))
                yield pa.RecordBatch.from_arrays([fp, hashes], names=["fp", "hashes"])
            else:
                wide = np.array([wide_fingerprint(h) for h in sets], np.uint64).reshape(-1, WORDS).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fp, *(pa.array(wide[:, w].copy()) for w in range(WORDS))], names=["doc_id", "text_hash", "fp", *names])

    names = [f"w{w}" for w in range(WORDS)]
    rows = documents.select(F.col("doc_id").cast("long"), F.xxhash64(text_column()).alias("text_hash"), text_column().alias("text"))
    return rows.mapInArrow(run, "fp long, hashes array<long>" if keep else "doc_id long, text_hash long, fp long, " + ", ".join(f"{n} long" for n in names))


def similar_links(documents: DataFrame, classes: DataFrame, similarity: float, shingle: int, n_pivots: int = 16, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (a long, b long) between classes (fp, w0 to w3, first: a row's doc_id and text_hash; written)
    whose sets of shingles have a Jaccard similarity of ``similarity`` or more, which is checked exactly:
    not all of them, but enough that components are the same."""
    near = written(near_links(documents, classes, similarity, shingle, n_pivots, cell_rows), "near-links")
    return near.unionByName(other_links(documents, classes, near, similarity, shingle, cell_rows))


def near_links(documents: DataFrame, classes: DataFrame, similarity: float, shingle: int, n_pivots: int, cell_rows: int) -> DataFrame:
    """Links between classes that the forests of wide fingerprints find; some may be missing."""
    words = [f"w{w}" for w in range(WORDS)]
    bits = BITS * WORDS
    met = _meet(classes, "fp", words, sampled_tables(classes.count(), similarity, bits), bound_of(similarity, bits), n_pivots, cell_rows, steps=4)
    pairs = written(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    sets = sets_of(documents, classes.join(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "fp", "left_semi"), shingle)
    of_a = sets.select(F.col("fp").alias("a"), F.col("hashes").alias("x"))
    of_b = sets.select(F.col("fp").alias("b"), F.col("hashes").alias("y"))
    both = F.size(F.array_intersect("x", "y")).cast("long")
    least = Fraction(str(similarity))
    alike = both * (least.numerator + least.denominator) >= (F.size("x").cast("long") + F.size("y")) * least.numerator
    return pairs.join(of_a, "a").join(of_b, "b").where(alike).select("a", "b")


def sets_of(documents: DataFrame, classes: DataFrame, shingle: int) -> DataFrame:
    """(fp, hashes) of classes; written."""
    doc, text = fresh(documents, "doc", "text")
    chosen = written(classes.select(F.col("first.doc_id").alias(doc), F.col("first.text_hash").alias(text)), "ends")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(text_column()) == F.col(text))
    return written(shingle_rows(documents.join(small_or_shuffled(chosen), same, "left_semi"), shingle, keep=True).dropDuplicates(["fp"]), "sets")


def frequent_shingles(documents: DataFrame, classes: DataFrame, shingle: int) -> np.ndarray:
    """Hashes of shingles that many of about ``ORDER_TEXTS`` classes have, rarer ones first. They only say which
    shingles come last in the order of the prefixes: links are the same in any order, cells are small in this one."""
    some = classes.where(F.pmod("fp", F.lit(max(1, classes.count() // ORDER_TEXTS))) == 0)
    counts = sets_of(documents, some, shingle).select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= ORDER_COUNT)
    top = counts.orderBy(F.desc("n"), "h").limit(ORDER_SHINGLES).select("h").toArrow()
    return np.asarray(top["h"], np.int64)[::-1].view(np.uint64).copy() if len(top) else np.zeros(0, np.uint64)


def prefix(hashes: np.ndarray, least: Fraction, known: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The first of a set's sorted hashes, so many that a set of a Jaccard similarity of ``least`` or more has one
    of them among its own first: by value, then those of ``known`` (sorted) by their ``place``."""
    n = len(hashes)
    first = n - math.ceil(least * n) + 1 if n else 0
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        hashes = hashes[np.argsort(np.where(known[at] == hashes, place[at], -1), kind="stable")]
    return hashes[:first]


def counters(hashes: np.ndarray, count: int = COUNTERS) -> np.ndarray:
    """How many of a set's hashes fall on each of ``count`` remainders, a byte each (255 for more). Sets that
    differ by d hashes have counters that differ by at most d in all."""
    return np.minimum(np.bincount((hashes % np.uint64(count)).astype(np.int64), minlength=count), 255).astype(np.uint8)


def _counters_for(size: int) -> int:
    """Counters, a power of two, that tell sets of ``size`` hashes that share little."""
    return max(COUNTERS, 1 << max(0, size // 4 - 1).bit_length())


def prefix_rows(documents: DataFrame, shingle: int, least: Fraction, frequent: np.ndarray) -> DataFrame:
    """(fp, size, tokens, c0 to c15, wide) for each row: its set's hash, number of shingles, prefix and counters;
    wide has more counters if the set is large, else it is empty."""
    known, place, names = np.sort(frequent), np.argsort(frequent), [f"c{i}" for i in range(COUNTERS // 8)]

    def run(batches):
        for batch in slices(batches):
            sets = [shingle_set(t, shingle) for t in batch.column(0).to_pylist()]
            fp = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in sets], np.uint64).view(np.int64)
            first = [prefix(h, least, known, place) for h in sets]
            tokens = pa.ListArray.from_arrays(np.cumsum([0, *map(len, first)]).astype(np.int32), np.concatenate([*first, np.zeros(0, "<u8")]).view(np.int64))
            counts = np.array([counters(h) for h in sets], np.uint8).reshape(-1, COUNTERS).view(np.int64)
            wide = [counters(h, _counters_for(len(h))).tobytes() if len(h) > 8 * COUNTERS else b"" for h in sets]
            yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(np.array([len(h) for h in sets], np.int64)), tokens, *(pa.array(c.copy()) for c in counts.T), pa.array(wide, pa.binary())], names=["fp", "size", "tokens", *names, "wide"])

    return documents.select(text_column().alias("text")).mapInArrow(run, "fp long, size long, tokens array<long>, " + ", ".join(f"{n} long" for n in names) + ", wide binary")


def _whole_cells(batches, keys: int):
    """Columns of longs, sorted by the first ``keys``, as matrices of about ``WIDE_ROWS`` rows that cut no cell,
    and a last column of bytes."""
    held, size = [], 0
    for batch in batches:
        last = np.empty(batch.num_rows, object)
        last[:] = batch.column(batch.num_columns - 1).to_pylist()
        held.append((np.stack([np.asarray(c, np.int64) for c in batch.columns[:-1]], 1), last))
        size += batch.num_rows
        if size >= WIDE_ROWS:
            rows, last = (np.concatenate([h[k] for h in held]) for k in range(2))
            same = (rows[:, :keys] == rows[-1, :keys]).all(1)
            cut = 0 if same.all() else len(rows) - int(same[::-1].argmin())
            if cut:
                yield rows[:cut], last[:cut]
            held, size = [(rows[cut:], last[cut:])], len(rows) - cut
    if size:
        yield tuple(np.concatenate([h[k] for h in held]) for k in range(2))


def _wide_differ(x: bytes, y: bytes) -> int:
    """By how much two sets' wide counters differ in all; the longer ones are folded. 0 if one is empty."""
    if not x or not y:
        return 0
    few = min(len(x), len(y))
    a, b = (np.frombuffer(c, np.uint8).reshape(-1, few).sum(0, dtype=np.int64) for c in (x, y))
    return int(np.abs(a - b).sum())


def _prefix_forest(rows: np.ndarray, wide: np.ndarray, least: Fraction) -> list[tuple[int, int]]:
    """Spanning forest, as row numbers, of the pairs in cells that may be similar; rows (token, i, j, own, fp, root,
    size, pos, c0 to c15) are sorted by the first three."""
    p, q = least.numerator, least.denominator
    cell, own, root, size, rest = rows[:, :3], rows[:, 3], rows[:, 5], rows[:, 6], rows[:, 6] - rows[:, 7]
    edge = np.concatenate([[True], (cell[1:] != cell[:-1]).any(1)])
    number, counts = np.cumsum(edge), rows[:, 8:].copy().view(np.uint8)
    tree, out = np.arange(len(rows)), []

    def find(n: int) -> int:
        while tree[n] != n:
            tree[n] = tree[tree[n]]
            n = int(tree[n])
        return n

    live, step = np.arange(len(rows) - 1), 1
    while len(live):
        live = live[live + step < len(rows)]
        live = live[number[live] == number[live + step]]
        a = live[tree[live] != tree[live + step]]
        b = a + step
        # rows of two parts meet in their common cell, rows of one part in its own
        ok = (root[a] != root[b]) & ((own[a] != own[b]) | (cell[a, 1] == cell[a, 2]))
        ok &= np.minimum(size[a], size[b]) * q >= np.maximum(size[a], size[b]) * p
        # nothing before the first shingle that they share is common
        ok &= np.minimum(rest[a], rest[b]) * (p + q) >= (size[a] + size[b]) * p
        a, b = a[ok], b[ok]
        differ = np.abs(counts[a].astype(np.int16) - counts[b]).sum(1, dtype=np.int64)
        ok = differ * (p + q) <= (size[a] + size[b]) * (q - p)
        for x, y in zip(a[ok].tolist(), b[ok].tolist(), strict=True):
            u, v = find(x), find(y)
            if u != v and _wide_differ(wide[x], wide[y]) * (p + q) <= int(size[x] + size[y]) * (q - p):
                tree[max(u, v)] = min(u, v)
                out.append((x, y))
        if ok.any():
            while not (tree[tree] == tree).all():
                tree[:] = tree[tree]
        step += 1
    return out


def _parts(rows: Column, shingles: Column, cell_rows: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(rows / cell_rows), F.ceil(shingles / CELL_SHINGLES)).cast("long")


def prefix_forest(prefixes: DataFrame, least: Fraction, cell_rows: int) -> DataFrame:
    """Edges (a long, b long) between classes of different roots that may be similar: not each such pair, but enough
    that the pairs' ends are connected. ``prefixes`` (written) has the columns of ``prefix_rows`` and root.

    A cell has the rows with one shingle in their prefix. One with more than ``cell_rows`` rows (or many shingles) is cut:
    the rows of its commonest root, which needn't meet, into some parts, the others into more; every two parts meet.
    """
    names = [*(f"c{i}" for i in range(COUNTERS // 8)), "wide"]
    of_token, of_root = Window.partitionBy("token"), Window.partitionBy("token", "root")
    tokens = prefixes.select("fp", "root", "size", F.posexplode("tokens").alias("pos", "token"))
    dealt = tokens.repartition(shuffle_partitions(prefixes.sparkSession), "token")
    live = dealt.select("*", F.min("root").over(of_token).alias("lo"), F.max("root").over(of_token).alias("hi")).where("lo <> hi").drop("lo", "hi")
    live = live.select("*", F.count("*").over(of_root).alias("m"), F.sum("size").over(of_root).alias("s"))
    live = live.select("*", F.max(F.struct("m", "s", "root")).over(of_token).alias("top"), F.count("*").over(of_token).alias("n"), F.sum("size").over(of_token).alias("total"))
    live = written(live, "live")

    small, major = (F.col("n") <= cell_rows) & (F.col("total") <= CELL_SHINGLES), F.col("root") == F.col("top.root")
    of_major = _parts(F.col("top.m"), F.col("top.s"), cell_rows)
    of_others = _parts(F.col("n") - F.col("top.m"), F.col("total") - F.col("top.s"), cell_rows)
    hashed, zero = F.xxhash64("fp"), F.lit(0).cast("long")
    own = F.when(small, zero).when(major, F.pmod(hashed, F.col("p"))).otherwise(F.col("p") + F.pmod(hashed, F.col("o")))
    others = F.when(small, F.array(zero)).when(major, F.sequence(F.col("p"), F.col("p") + F.col("o") - 1)).otherwise(F.sequence(zero, F.col("p") + F.col("o") - 1))
    cut = live.withColumn("p", of_major).withColumn("o", of_others).withColumn("own", own).withColumn("other", F.explode(others))
    cut = cut.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp", "root", "size", F.col("pos").cast("long").alias("pos"))
    rows = cut.join(prefixes.select("fp", *names), "fp").select(*cut.columns, *names)

    def run(batches):
        for cells, wide in _whole_cells(batches, 3):
            found = np.array(_prefix_forest(cells, wide, least), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(cells[found[:, k], 4]) for k in range(2)], names=["a", "b"])

    met = rows.repartition(shuffle_partitions(prefixes.sparkSession), "token", "i", "j").sortWithinPartitions("token", "i", "j")
    return met.mapInArrow(run, "a long, b long").distinct()


def _cell_links(own: np.ndarray, fp: list[int], root: list[int], sets: list[np.ndarray], whole: bool, least: Fraction) -> list[tuple[int, int]]:
    """Of the similar pairs in a cell so many that they connect the same roots; pairs of one part only if ``whole``."""
    p, q = least.numerator, least.denominator
    size = np.array([len(x) for x in sets])
    order = np.argsort(size, kind="stable")
    own, size, ends = own[order], size[order], np.array(root)[order]
    counts = np.array([counters(sets[k], min(4096, _counters_for(int(size[-1])))) for k in order]).astype(np.int16)
    tree, out = {r: r for r in root}, []

    def find(r: int) -> int:
        while tree[r] != r:
            tree[r] = tree[tree[r]]
            r = tree[r]
        return r

    for a in range(len(order)):
        b = np.arange(a + 1, int(np.searchsorted(size, int(size[a]) * q // p, "right")))
        b = b[(ends[b] != ends[a]) & (whole | (own[b] != own[a]))]
        b = b[np.abs(counts[b] - counts[a]).sum(1, dtype=np.int64) * (p + q) <= (size[b] + size[a]) * (q - p)]
        x = sets[order[a]]
        for k in b.tolist():
            u, v, y = find(int(ends[a])), find(int(ends[k])), sets[order[k]]
            if u != v:
                both = int(np.count_nonzero(x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y))
                if both * (p + q) >= (len(x) + len(y)) * p:
                    tree[u] = v
                    out.append((fp[order[a]], fp[order[k]]))
    return out


def other_links(documents: DataFrame, classes: DataFrame, near: DataFrame, similarity: float, shingle: int, cell_rows: int) -> DataFrame:
    """The links between components of ``near`` (written), by prefixes: with them components are exact.

    Pairs that may be similar make families, each a cell where a set comes once and all its pairs are compared;
    a family of more than ``cell_rows`` rows (or many shingles) is cut into parts, and every two parts meet."""
    least = Fraction(str(similarity))
    roots = small_or_shuffled(written(components(near).select(F.col("node").alias("fp"), "root"), "near-roots"))
    prefixes = prefix_rows(documents, shingle, least, frequent_shingles(documents, classes, shingle)).dropDuplicates(["fp"])
    prefixes = written(prefixes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "prefixes")
    families = components(prefix_forest(prefixes, least, cell_rows)).select(F.col("node").alias("fp"), F.col("root").alias("family"))
    families = written(families, "families")
    ends = written(prefixes.select("fp", "root", "size").join(small_or_shuffled(families), "fp"), "members")
    cells = ends.groupBy("family").agg(_parts(F.count("*"), F.sum("size"), cell_rows).alias("parts"))
    cells = ends.join(small_or_shuffled(written(cells, "family-parts")), "family").withColumn("own", F.pmod(F.xxhash64("fp"), "parts"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    cells = cells.select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp", "root")
    sets = sets_of(documents, classes.join(families.select("fp"), "fp", "left_semi"), shingle)

    def run(batches):
        at, cell = None, []
        for batch in batches:
            for part in slices([batch]):
                hashes = part.column(6)
                for n, row in enumerate(zip(*(c.to_pylist() for c in part.columns[:6]), strict=True)):
                    if row[:3] != at:
                        yield from done(at, cell)
                        at, cell = row[:3], []
                    cell.append((*row[3:], np.array(hashes[n].values).view(np.uint64)))
        yield from done(at, cell)

    def done(at, cell):
        if len(cell) > 1:
            own, fp, root, sets = zip(*cell, strict=True)
            found = np.array(_cell_links(np.array(own), fp, root, sets, at[1] == at[2], least), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, k].copy()) for k in range(2)], names=["a", "b"])

    rows = cells.join(sets, "fp").select("family", "i", "j", "own", "fp", "root", "hashes")
    dealt = rows.repartition(shuffle_partitions(documents.sparkSession), "family", "i", "j").sortWithinPartitions("family", "i", "j")
    return dealt.mapInArrow(run, "a long, b long")


def near_copies(documents: DataFrame, similarity: float = 0.8, shingle: int = 5, n_pivots: int = 16, cell_rows: int = CELL_ROWS) -> DataFrame:
    """For each row: doc_id, component_id, text_hash (xxhash64 of the text), root (of its component).

    Texts are linked if their sets of ``shingle``-word shingles (a text of fewer words is one shingle; A-Z in
    lower case, words between ASCII white space) have a Jaccard similarity of ``similarity`` or more; every link
    is checked exactly. Most are found by wide fingerprints; an exact search by prefixes finds those that they
    leave out, so components are those of all links. Texts without words, null and empty ones too, are one
    class; texts of the same shingles are one class too. component_id is the smallest doc_id that links reach,
    or null if there is none; an empty table gives no rows.
    """
    rows = written(shingle_rows(documents, shingle, keep=False), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    words = [F.min(f"w{w}").alias(f"w{w}") for w in range(WORDS)]
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), first, *words), "classes")
    found = written(similar_links(documents, classes, similarity, shingle, n_pivots, cell_rows), "links")
    return rows.join(_rooted(classes.select("fp", "least"), found), "fp").select("doc_id", "component_id", "text_hash", "root")


def keep_one(documents: DataFrame, groups: DataFrame) -> DataFrame:
    """Of each component of ``near_duplicates`` one row, with its columns: that with the smallest doc_id,
    nulls last, and of those the least text_hash.

    Rows are matched by (doc_id, text). Rows that repeat both are reduced to one.
    """
    groups = written(groups.select("doc_id", "text_hash", "root"), "groups")
    least = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("least"))
    groups = written(groups.join(least, "root").select("doc_id", "text_hash", (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash"))).alias("first")), "chosen")
    first = F.col("first")
    doc, text = fresh(documents, "doc", "text")

    def keys(rows: DataFrame) -> DataFrame:
        return small_or_shuffled(written(rows.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text)).distinct(), "row-keys"))

    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(text_column()) == F.col(text))
    kept = documents.join(keys(groups.where(~first)), same, "left_anti")
    alike = groups.where(first).groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1")
    if not alike.limit(1).count():
        return kept
    alike = keys(alike)  # only rows that are repeated are shuffled
    repeated = kept.join(alike, same, "left_semi").withColumn(text, F.xxhash64(text_column())).dropDuplicates(["doc_id", text]).drop(text)
    return kept.join(alike, same, "left_anti").unionByName(repeated)
