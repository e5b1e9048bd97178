"""Exact top-k by inner product with KD-trees per shard.

Each task reads its rows in shards of a bounded number of vectors and builds a KD-tree for each by
median splits, with tight bounding boxes. A query visits boxes best first by the greatest inner
product that any point of the box can have, and stops when that is below its k-th score. The k-th
score goes on from shard to shard of those that a task holds at a time, and starts from a lower bound
that the queries' own block gives.

Queries lie in blocks of a bounded number in the shared folder, with their lower bounds; a task reads
one block after another. Nothing goes through the driver, and the vectors are read once.

Boxes prune where vectors have structure. Of independent, even coordinates in many dimensions every box
of a few points reaches beyond the k-th score, so all points are scored, as a plain scan would.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import filesystem, new_folder, ship, shuffle_partitions, written

SHARD_ROWS, LEAF_ROWS, QUERY_BLOCK, HELD_SHARDS = 16_384, 64, 8_192, 8


class KdTree:
    """Nodes in arrays: children, tight box (lo, hi) and range of points."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF_ROWS):
        order = np.arange(len(ids))
        self.lo, self.hi, self.child, self.span = [], [], [], []
        todo = [(0, len(ids), None, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            part = points[order[a:b]]
            lo, hi = part.min(0), part.max(0)
            n = len(self.child)
            self.lo.append(lo)
            self.hi.append(hi)
            self.child.append([-1, -1])
            self.span.append((a, b))
            if parent is not None:
                self.child[parent][side] = n
            width = hi - lo
            if b - a > leaf and width.max() > 0:
                mid = (a + b) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, int(width.argmax())], mid - a)]
                todo += [(a, mid, n, 0), (mid, b, n, 1)]
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)
        self.ids, self.points = ids[order], points[order]

    def search(self, queries: np.ndarray, own: np.ndarray, best: TopK) -> None:
        """Offer to ``best`` the points of every box that may hold one of a query's k best."""
        bound = np.maximum(queries, 0) @ self.hi.T + np.minimum(queries, 0) @ self.lo.T
        for q in np.flatnonzero(bound[:, 0] >= best.floor).tolist():
            of = bound[q]
            heap = [(-of[0], 0)]
            while heap:
                top, node = heapq.heappop(heap)
                if -top < best.floor[q]:
                    break
                left, right = self.child[node]
                if left < 0:
                    a, b = self.span[node]
                    best.scored += b - a
                    best.offer(q, self.ids[a:b], self.points[a:b] @ queries[q], own[q])
                else:
                    for c in (left, right):
                        if of[c] >= best.floor[q]:
                            heapq.heappush(heap, (-of[c], c))


class TopK:
    """The k best (score, smaller id) of each query; ``floor``: known lower bounds of the k-th scores;
    ``scored``: points that were scored."""

    def __init__(self, k: int, floor: np.ndarray):
        self.k, self.floor, self.scored = k, floor.copy(), 0
        self.rows: list[list[tuple[float, int]]] = [[] for _ in range(len(floor))]  # (-score, id), ascending

    def offer(self, q: int, ids: np.ndarray, scores: np.ndarray, own: int) -> None:
        keep = np.flatnonzero((scores >= self.floor[q]) & (ids != own))
        if len(keep) > 4 * self.k:  # of many, those that can be among the k best, ties included
            least = np.partition(scores[keep], len(keep) - self.k)[len(keep) - self.k]
            keep = keep[scores[keep] >= least]
            if len(keep) > 4 * self.k:
                keep = keep[np.lexsort((ids[keep], -scores[keep]))[: self.k]]
        if len(keep):
            self.rows[q] = sorted(self.rows[q] + list(zip((-scores[keep]).tolist(), ids[keep].tolist(), strict=True)))[: self.k]
            if len(self.rows[q]) == self.k:
                self.floor[q] = max(self.floor[q], -self.rows[q][-1][0])


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, query_block: int = QUERY_BLOCK) -> DataFrame:
    """For each row whose vec_id is divisible by ``every``: the k rows with the highest inner product.

    Components become floor(scale * x). Columns: query_id, rank (from 1), vec_id, score; ties go to the
    smaller vec_id; a query has fewer rows if there are fewer candidates. Rows with a null vec_id or
    vector, or with a null or non-finite component, take no part, nor do vectors of no component. A
    query meets vectors of its own length only. Rows that share the query's vec_id are its own; other
    repeated rows are candidates each, and a repeated query row (its smallest vector counts) is one
    query. Sums are exact while they are below 2**53.

    Vectors are dealt by a hash of their row in even parts, whatever values are common. A task holds at
    most ``HELD_SHARDS`` trees and one block of queries (about ``query_block`` at most, dealt by a hash of
    vec_id), and returns k rows a query at most for as many trees.
    """
    spark = vectors.sparkSession
    ship(spark)
    x = F.col("embedding")
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double"))
    fine = F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))
    queries = written(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    blocks = max(1, -(-queries.count() // max(1, query_block // 2)))  # hashing deals them nearly evenly: half full on average
    folder = new_folder(spark, "query-blocks")
    in_blocks = queries.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "v")

    def with_floors(table: pa.Table) -> pa.Table:
        return pa.concat_tables([_block_table(table.column("block")[0].as_py(), *part, _floor(*part, k)) for part in _by_dims(table)])

    in_blocks.groupBy("block").applyInArrow(with_floors, "block int, vec_id long, v array<double>, floor double").write.partitionBy("block").parquet(folder)

    def run(batches):
        read: dict[int, list] = {}
        held: dict[int, list] = {}

        def block(b: int) -> list:
            if b not in read:
                read.clear()
                read[b] = _read_block(f"{folder}/block={b}")
            return read[b]

        def searched():
            trees = {}
            for dims, parts in held.items():
                ids, points = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                trees[dims] = [KdTree(ids[a : a + SHARD_ROWS], points[a : a + SHARD_ROWS]) for a in range(0, len(ids), SHARD_ROWS)]
            held.clear()
            for b in range(blocks):
                for ids, m, floor in block(b):
                    best = TopK(k, floor)
                    for tree in trees.get(m.shape[1], ()):
                        tree.search(m, ids, best)
                    flat = [(int(ids[q]), i, int(-s)) for q, rs in enumerate(best.rows) for s, i in rs]
                    if flat:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*flat, strict=True)], ["query_id", "vec_id", "score"])

        n = 0
        for batch in batches:
            for ids, m in _by_dims(batch):
                held.setdefault(m.shape[1], []).append((ids, m))
            n += batch.num_rows
            if n >= HELD_SHARDS * SHARD_ROWS:
                yield from searched()
                n = 0
        if n:
            yield from searched()

    dealt = rows.repartition(shuffle_partitions(spark), F.xxhash64("vec_id", "v"))
    out = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
    by_rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _by_dims(rows: pa.Table | pa.RecordBatch):
    """(ids, matrix) of the rows (vec_id, v) of each length."""
    ids, v = (rows.column(c) for c in ("vec_id", "v"))
    ids, v = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (ids, v))
    sizes = np.diff(np.asarray(v.offsets))
    for dims in np.unique(sizes).tolist():
        mine = pa.array(sizes == dims)
        yield np.asarray(ids.filter(mine)), np.asarray(v.filter(mine).flatten(), np.float64).reshape(-1, dims)


def _block_table(block: int, ids: np.ndarray, m: np.ndarray, floor: np.ndarray) -> pa.Table:
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))
    return pa.table({"block": pa.array(np.full(len(ids), block, np.int32)), "vec_id": pa.array(ids), "v": vectors, "floor": pa.array(floor)})


def _read_block(uri: str) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, matrix, floors) of a block's queries of each length; a block without queries has no folder."""
    import pyarrow.dataset as ds
    from pyarrow import fs as arrow_fs

    fs, path = filesystem(uri)
    if fs.get_file_info(path).type == arrow_fs.FileType.NotFound:
        return []
    table = ds.dataset(path, filesystem=fs, format="parquet").to_table(columns=["vec_id", "v", "floor"]).combine_chunks()
    floors = np.asarray(table.column("floor"))
    sizes = np.diff(np.asarray(table.column("v").chunk(0).offsets))
    return [(ids, m, floors[sizes == m.shape[1]]) for ids, m in _by_dims(table)]


def _floor(ids: np.ndarray, m: np.ndarray, k: int) -> np.ndarray:
    """Lower bounds of the queries' k-th scores: their k-th scores among the other queries."""
    floor = np.full(len(ids), -np.inf)
    if len(ids) > k:
        for a in range(0, len(ids), 512):
            s = m[a : a + 512] @ m.T
            s[ids[a : a + 512, None] == ids[None, :]] = -np.inf
            floor[a : a + 512] = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    return floor
