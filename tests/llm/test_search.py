import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import components, kdtree, queries, simhash
from tests.llm import brute


def vectors(seed, n, dims):
    rnd = np.random.default_rng(seed)
    v = rnd.normal(size=(n, dims)).round(1).astype(np.float32)
    v[n // 3 : n // 2] = v[0]  # many equal vectors
    return [(i, row.tolist()) for i, row in enumerate(v)]


def brute_top(rows, k, every):
    import math

    fine = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    queries_ = {}
    for i, v in fine:
        if i % every == 0:
            queries_[i] = min(v, queries_.get(i, v))
    for q, w in queries_.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, v in fine if i != q and len(v) == len(w))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [8, 8192])
def test_top_k(spark, block, monkeypatch):
    odd = [(600, None), (650, []), (700, [1.0, None]), (750, [float("nan")] * 4), (800, [float("inf")] * 4), (None, [9.0] * 4), (850, [1.0, 2.0]), (851, [1.0, 3.0]), (100, [5.0] * 4)]
    rows = vectors(1, 500, 4) + odd
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x")).withColumn("v", F.lit(1)).repartition(3)
    got = kdtree.top_k(df, k=5, every=50, query_block=block)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 5, 50)
    assert kdtree.top_k(df.limit(0)).collect() == []


def test_small_shards_and_leaves(spark, monkeypatch):
    rows = vectors(2, 300, 6)
    ids, m = np.array([i for i, _ in rows]), np.floor(256 * np.array([v for _, v in rows], np.float32).astype(np.float64))
    best = kdtree.TopK(3, np.full(6, -np.inf))
    for a in range(0, 300, 70):
        tree = kdtree.KdTree(ids[a : a + 70], m[a : a + 70], leaf=4)
        for n, (lo, hi) in enumerate(zip(tree.lo, tree.hi, strict=True)):
            s, e = tree.span[n]
            assert (tree.points[s:e].min(0) == lo).all() and (tree.points[s:e].max(0) == hi).all()
        tree.search(m[::50], ids[::50], best)
    got = sorted((int(ids[::50][q]), n + 1, i, int(-s)) for q, r in enumerate(best.rows) for n, (s, i) in enumerate(r))
    assert got == brute_top(rows, 3, 50)


def test_many_blocks_of_queries(spark, monkeypatch):
    """Hundreds of blocks are read by every task, and none goes through the driver."""
    rows = vectors(33, 900, 6)
    monkeypatch.setattr(kdtree, "SHARD_ROWS", 60)
    monkeypatch.setattr(kdtree, "HELD_SHARDS", 2)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    assert sorted(map(tuple, kdtree.top_k(df, k=4, every=5, query_block=2).collect())) == brute_top(rows, 4, 5)


def test_boxes_prune_where_vectors_have_structure():
    """Of clustered vectors under half the points are scored, and the result is exact."""
    rnd = np.random.default_rng(34)
    centres = rnd.normal(size=(40, 16))
    m = np.floor(256 * (centres[rnd.integers(0, 40, 4000)] + 0.05 * rnd.normal(size=(4000, 16))))
    ids, queries_at = np.arange(4000), np.arange(0, 4000, 50)
    best = kdtree.TopK(5, kdtree._floor(ids[queries_at], m[queries_at], 5))
    for a in (0, 2000):
        kdtree.KdTree(ids[a : a + 2000], m[a : a + 2000]).search(m[queries_at], ids[queries_at], best)
    for n, q in enumerate(queries_at.tolist()):
        s = m @ m[q]
        assert [(-x, i) for x, i in best.rows[n]] == sorted(((s[i], i) for i in range(4000) if i != q), key=lambda x: (-x[0], x[1]))[:5]
    assert best.scored < 0.5 * len(queries_at) * 4000


def test_fingerprints(spark, hard_documents):
    got = simhash.near_duplicates(hard_documents.withColumn("fp", F.lit("x"))).collect()
    docs = {(d["doc_id"], d["text"]): brute.simhash(d["text"] or "") for d in hard_documents.collect()}
    fps = {d: f for (d, _), f in docs.items() if d is not None}
    of = brute.simhash_components(fps)
    assert len(got) == hard_documents.count()
    for r in got:
        if r["doc_id"] is not None:
            assert (r["fingerprint"], r["component_id"]) == (f"{fps[r['doc_id']]:016x}", of[r["doc_id"]])
    assert {r["component_id"] for r in got if r["doc_id"] in (0, 1, 2, 3)} == {0}


def planted(seed, n):
    rnd = random.Random(seed)
    fps = {rnd.getrandbits(64) for _ in range(n)}
    for b in list(fps)[: n // 2]:
        for _ in range(8):
            for _ in range(rnd.randint(1, 4)):
                b ^= 1 << rnd.randrange(64)
            fps.add(b)
    centre = rnd.getrandbits(64)
    for _ in range(400):  # a large group around one fingerprint
        b = centre
        for _ in range(rnd.randint(1, 3)):
            b ^= 1 << rnd.randrange(64)
        fps.add(b)
    return sorted(fps)


@pytest.mark.parametrize(("blocks", "cell_rows"), [(4, 512), (4, 30), (5, 100), (6, 512)])
def test_links_keep_components(spark, blocks, cell_rows):
    fps = planted(3, 200)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long").repartition(3)
    rows = [(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in simhash.links(df, blocks=blocks, cell_rows=cell_rows).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in rows)
    assert brute.components(fps, rows) == brute.simhash_components({f: f for f in fps})
    assert len(rows) < 20 * len(fps)


def test_pivot_table_holds_distances(spark):
    fps = planted(6, 20)
    refs = simhash.pivots(11)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    got = np.array([list(r) for r in df.select("fp", *simhash.pivot_table(F.col("fp"), refs)).collect()], np.int64)
    assert (got[:, 1:].copy().view(np.int8)[:, :11] == np.bitwise_count(got[:, :1].view(np.uint64) ^ refs[None, :])).all()


def test_pivots_discard_only_far_pairs():
    fps = np.array(planted(4, 60), np.uint64)
    table = np.bitwise_count(fps[:, None] ^ simhash.pivots(16)[None, :]).astype(int)
    kept = far = 0
    for i in range(len(fps)):
        for j in range(i):
            passed = (abs(table[i] - table[j]) <= 3).all()
            if (int(fps[i]) ^ int(fps[j])).bit_count() <= 3:
                assert passed
            else:
                far += 1
                kept += passed
    assert kept < 0.9 * far


def test_components(spark):
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 100)] + [(3000 + rnd.randrange(80), 3000 + rnd.randrange(80)) for _ in range(60)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    fine = [(a, b) for a, b in edges if a is not None and a != b]
    want = brute.components({x for e in fine for x in e}, fine)
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_keep_one(spark, hard_documents, empty_documents):
    groups = simhash.near_duplicates(hard_documents)
    left = simhash.keep_one(hard_documents, groups).collect()
    ids = [r["doc_id"] for r in left if r["doc_id"] is not None]
    assert len(ids) == len(set(ids)) and set(ids) == {r["component_id"] for r in groups.collect() if r["component_id"] is not None}
    assert sum(r["doc_id"] is None for r in left) == 1
    clash = hard_documents.withColumn("__doc", F.lit(1)).withColumn("__TEXT", F.lit(2)).withColumn("a.b", F.lit(3))
    again = simhash.keep_one(clash, groups)
    assert again.columns == clash.columns and again.count() == len(left)
    assert simhash.keep_one(empty_documents, simhash.near_duplicates(empty_documents)).collect() == []


def test_sql(spark, small):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "embeddings", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    for name, sql in queries.ORACLE_SQL.items():
        got = queries.QUERIES[name](spark, small)
        want = con.execute(sql)
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(got.columns)
        assert sorted((tuple(r) for r in got.select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str), name


def test_keep_one_without_unique_ids(spark):
    """One row of each component also where doc_ids are null or repeated."""
    text = " ".join(f"word{i}" for i in range(400))
    texts = [text, text + " tail", text + " end", text]
    for ids in ([None] * 4, [7] * 4, [None, 7, 7, 9]):
        docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
        left = simhash.keep_one(docs, simhash.near_duplicates(docs, distance=12)).collect()
        assert len(left) == 1 and left[0]["doc_id"] == (None if ids[1] is None else 7)


def varied(seed):
    """Texts with copies at many similarities: some words replaced, some lines repeated, one large group."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for n in range(60):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(30, 400))]
        for edits in (0, 1, 2, 3, 5, 8) if n else [1] * 300:
            copy = list(words)
            for _ in range(edits):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("cell_rows", [512, 40])
def test_near_copies_by_brute_force(spark, cell_rows):
    texts = varied(8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs, cell_rows=cell_rows).collect()}
    sets = [brute.shingles(t) for t in texts]
    pairs = [(a, b) for b in range(len(sets)) for a in range(b) if brute.similar(sets[a], sets[b])]
    of = brute.components(range(len(texts)), pairs)
    assert all(of[d] == of[c] for d, c in got.items())  # every link is a true one
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.97 * len(pairs)
    assert len(set(got.values())) <= 1.05 * len(set(of.values()))


def exact_components(texts):
    sets = [brute.shingles(t) for t in texts]
    return brute.components(range(len(texts)), [(a, b) for b in range(len(sets)) for a in range(b) if brute.similar(sets[a], sets[b])])


@pytest.mark.parametrize("cell_rows", [512, 40])
def test_near_copies_leave_out_no_link(spark, cell_rows):
    """Pairs just at the bound too, and texts that only some of a large group's texts are similar to."""
    texts = [t for seed in (8, 9) for t in varied(seed)]
    rnd = random.Random(11)
    base = [f"u{rnd.randrange(3000)}" for _ in range(150)]
    for n in range(300):
        copy = list(base)
        for _ in range(n % 7):
            copy[rnd.randrange(len(copy))] = f"x{n}"
        texts.append(" ".join(copy))
    for n in range(400):  # 4m shingles of 5m are shared: a similarity of 0.8 itself
        m = rnd.randint(2, 30)
        words = [f"p{n}_{i}" for i in range(5 * m + 4)]
        texts += [" ".join(words[: 4 * m + 4]), " ".join(words)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs, cell_rows=cell_rows).collect()}
    assert got == exact_components(texts)


@pytest.mark.parametrize("cell_rows, shingles", [(512, 1 << 20), (20, 1 << 20), (512, 3000)])
def test_prefixes_find_all_links(spark, cell_rows, shingles, monkeypatch):
    """The exact search alone, with cells whole and cut, after none and after some of the links."""
    monkeypatch.setattr(simhash, "CELL_SHINGLES", shingles)
    texts = varied(10)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    classes = simhash.shingle_rows(docs, 5, keep=False).groupBy("fp").agg(F.min("doc_id").alias("least"), first).localCheckpoint()
    ids = {r["fp"]: r["least"] for r in classes.collect()}
    of = exact_components(texts)
    near = spark.createDataFrame([], "a long, b long")
    for part in (0, 1):
        found = [(ids[a], ids[b]) for a, b in simhash.other_links(docs, classes, near, 0.8, 5, cell_rows).collect()]
        known = [(ids[a], ids[b]) for a, b in near.collect()]
        joined = brute.components(ids.values(), found + known)
        assert all(joined[d] == of[d] for d in ids.values())
        fps = {d: f for f, d in ids.items()}
        near = spark.createDataFrame([(fps[a], fps[b]) for a, b in found[::2]], "a long, b long")


def test_prefix_holds_a_common_shingle():
    rng = np.random.default_rng(5)
    known = np.sort(rng.integers(0, 1 << 63, 300).astype(np.uint64))
    place = rng.permutation(len(known))
    for _ in range(300):
        n = int(rng.integers(1, 60))
        pool = np.unique(np.concatenate([rng.choice(known, n), rng.integers(0, 1 << 63, n).astype(np.uint64)]))
        x = np.sort(rng.choice(pool, min(n, len(pool)), replace=False))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.9], rng.integers(0, 1 << 63, int(rng.integers(0, 5))).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        a, b = (simhash.prefix(s, Fraction(4, 5), known, place) for s in (x, y))
        if 5 * both >= 4 * (len(x) + len(y) - both):
            assert len(np.intersect1d(a, b)) > 0
        differ = np.abs(simhash.counters(x).astype(int) - simhash.counters(y)).sum()
        assert differ <= len(x) + len(y) - 2 * both
    assert len(simhash.prefix(np.zeros(0, np.uint64), Fraction(4, 5), known, place)) == 0


def test_near_copies_similarity_is_exact(spark):
    """18 words are 14 shingles; 5 more shingles give 14/19 < 0.8, 3 more give 14/17, and 20 of 25 is 0.8 itself."""
    def doc(n):
        return " ".join(f"v{i}" for i in range(n))

    for a, b, alike in ((18, 23, False), (18, 21, True), (24, 29, True), (24, 30, False)):
        sets = brute.shingles(doc(a)), brute.shingles(doc(b))
        assert brute.similar(*sets) == alike
        docs = spark.createDataFrame([(1, doc(a)), (2, doc(b)), (3, doc(a).upper())], "doc_id long, text string")
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs).collect()}
        assert got[3] == 1 and (alike or got[2] == 2)


def test_near_copies_of_hard_rows(spark, hard_documents, empty_documents):
    clash = hard_documents.withColumn("fp", F.lit("x")).withColumn("w0", F.lit(1)).withColumn("__doc", F.lit(2)).withColumn("first", F.lit(3))
    groups = simhash.near_copies(clash)
    got = groups.collect()
    assert len(got) == hard_documents.count() and {r["component_id"] for r in got if r["doc_id"] in (0, 1, 2, 3)} == {0}
    left = simhash.keep_one(clash, groups)
    assert left.columns == clash.columns and left.count() == len({r["root"] for r in got})
    assert simhash.near_copies(empty_documents).collect() == []
    assert simhash.near_copies(spark.createDataFrame([(5, "only one")], "doc_id long, text string")).collect()[0]["component_id"] == 5
