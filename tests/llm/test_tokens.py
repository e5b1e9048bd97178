import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import bpe, packing, queries, token_store
from tests.llm import brute

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokenizer(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_transducer_equals_library(ranks, library, hard_texts):
    rnd, tokens = random.Random(1), [t for t in ranks if len(t) < 9]
    codec, small = bpe.ByteBpe(ranks, P.PATTERN), bpe.BpeTransducer(ranks, max_states=40)
    kinds = ["abcdefghij", " \n\t\r\x1c\x85\xa0\u3000", "aaaab", "é\u0308ñ漢字😀½²Ⅷ٣", "'s'll\"#_-=", "0123456789"]
    texts = [t or "" for t in hard_texts]
    texts += ["".join(rnd.choice(rnd.choice(kinds)) for _ in range(rnd.choice([3, 10, 40]))) for _ in range(3000)]
    texts += [b"".join(rnd.choice(tokens) for _ in range(4)).decode(errors="ignore") for _ in range(6000)]
    for text in texts:
        want = library.encode_ordinary(text)
        assert codec.encode(text) == want
        assert "".join(codec.decode_stream(want)) == text
        assert codec.decode_bytes(np.array(want, np.int64)) == text.encode()
    for text in texts[:400]:  # few states at a time
        assert [i for m in codec.split(text) for i in small.encode(m.encode())] == library.encode_ordinary(text)


def test_decoder_on_any_ids(ranks, library):
    codec, rnd = bpe.ByteBpe(ranks, P.PATTERN), random.Random(2)
    for _ in range(300):
        ids = [rnd.randrange(50256) for _ in range(rnd.randint(0, 60))]
        want = b"".join(library.decode_single_token_bytes(i) for i in ids).decode(errors="replace")
        assert codec.decode_bytes(np.array(ids, np.int64)) == want.encode()
        assert "".join(codec.decode_stream(ids)) == want


def test_encode_decode_rows(spark, library, hard_documents, empty_documents):
    rows = bpe.encode_decode(hard_documents, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, keep_ids=True).collect()
    want = [(r["doc_id"], library.encode_ordinary(r["text"] or ""), brute.sha((r["text"] or "").encode())) for r in hard_documents.collect()]
    assert sorted(((r["doc_id"], r["ids"], r["decoded_sha256"]) for r in rows), key=str) == sorted(want, key=str)
    assert all(r["n_tokens"] == len(r["ids"]) and r["ids_sha256"] == brute.sha(brute.packed(r["ids"])) for r in rows)
    assert bpe.encode_decode(empty_documents, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect() == []


def test_codes_random_access():
    rnd = random.Random(3)
    for n in (1, 7, 512, 513, 20_000):
        ids = np.array([rnd.choice([3, 255, 256, 5000, 65536, 2**32 - 1]) for _ in range(n)], np.uint32)
        segment = token_store.Segment(token_store.encode_segment(ids))
        assert (segment.all() == ids).all()
        assert all(segment[i] == ids[i] for i in range(0, n, 37))


def test_token_files(spark, hard_documents, empty_documents, monkeypatch):
    encode = tokenizer("byte_bpe_50k.json")
    clash = hard_documents.withColumn("start", F.lit("x")).withColumn("part", F.lit(1)).withColumn("base", F.lit(1))
    files = token_store.write_tokens(clash, P.path("byte_bpe_50k.json"))
    rows = token_store.read_tokens(files).collect()
    docs = sorted(hard_documents.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    at, want, stream = 0, [], []
    for d in docs:
        ids = [*encode(d["text"]), 0]
        want.append((d["doc_id"], at, len(ids), brute.crc(ids)))
        at += len(ids)
        stream += ids
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want
    first = files.orderBy("part").first()
    f = token_store.TokenFile(first["file"])
    assert [f.token(i) for i in range(0, f.n_ids, 11)] == stream[: f.n_ids : 11]
    assert token_store.read_tokens(token_store.write_tokens(empty_documents, P.path("byte_bpe_50k.json"))).collect() == []


def test_segments_split_documents(tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "SEGMENT_IDS", 64)
    rnd, w, want, at = random.Random(4), token_store.TokenWriter(f"{tmp_path}/x.dac"), [], 0
    for doc in [None, 3, 3, 9, 10]:
        ids = [rnd.randrange(60000) for _ in range(rnd.choice([1, 40, 300]))]
        w.add(doc, brute.packed(ids))
        want.append((doc, at, len(ids), brute.crc(ids)))
        at += len(ids)
    w.close()
    assert list(token_store.TokenFile(f"file://{tmp_path}/x.dac").documents()) == want


def placed(runs):
    return {(r.length, r.lo + k): (r.sequence + k // r.per, r.offset + k % r.per * r.length) for r in runs for k in range(r.n)}


def best(items, capacity):
    items, least = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= least[0]:
            return
        if i == len(items):
            least[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + items[i] <= capacity and bins[b] not in bins[:b]:
                bins[b] += items[i]
                go(i + 1, bins)
                bins[b] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return least[0]


def test_plan_is_a_packing():
    rnd, worse = random.Random(5), 0
    for case in range(600):
        capacity = rnd.choice([5, 10, 20, 100])
        counts = {}
        for _ in range(9 if case < 200 else 60):
            s = rnd.randint(1, capacity)
            counts[s] = counts.get(s, 0) + 1
        runs, n = packing.plan(counts, capacity)
        at = placed(runs)
        assert len(at) == sum(counts.values())
        assert brute.check_packing([(s, *v) for (s, _), v in at.items()], capacity) == n
        if case < 200:
            worse += n > best([s for s, m in counts.items() for _ in range(m)], capacity)
    assert worse <= 4
    assert packing.plan({}, 10) == ([], 0)


def test_reduction_alone_is_optimal():
    """Sets that the reduction fixes never cost a sequence: an exact solution of the rest is optimal."""
    rnd = random.Random(6)
    for _ in range(300):
        capacity, counts = 20, {}
        for _ in range(8):
            s = rnd.randint(2, capacity)
            counts[s] = counts.get(s, 0) + 1
        p = packing._Packer(dict(counts), capacity)
        p.reduce()
        rest = [s for s, m in p.left.items() for _ in range(m)]
        assert p.sequences + best(rest, capacity) == best([s for s, m in counts.items() for _ in range(m)], capacity)


def test_pack_rows(spark, hard_documents, empty_documents):
    encode = tokenizer("word_bpe_49k.json")
    clash = hard_documents.withColumn("offset", F.lit("x")).withColumn("part", F.lit("y"))
    rows = packing.pack(clash, P.path("word_bpe_49k.json"), capacity=128, keep_ids=True).collect()
    want = []
    for d in hard_documents.collect():
        ids = [*encode(d["text"]), 0]
        want += [(d["doc_id"], k // 128, k, len(ids[k : k + 128]), brute.crc(ids[k : k + 128])) for k in range(0, len(ids), 128)]
    assert sorted((tuple(r[:5]) for r in rows), key=str) == sorted(want, key=str)
    assert all(brute.crc(np.frombuffer(r["ids"], "<u4")) == r["ids_crc32"] for r in rows)
    n = brute.check_packing([(r["length"], r["sequence_id"], r["offset"]) for r in rows], 128)
    assert n <= -(-sum(r["length"] for r in rows) // 128) + 1
    assert packing.pack(empty_documents, P.path("word_bpe_49k.json")).collect() == []


def test_queries(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").count()
    assert queries.op1_bpe(spark, small).count() == docs
    assert queries.op4_tokens(spark, small).count() == docs
    assert queries.op8_packing(spark, small).select("doc_id").distinct().count() == docs


def test_pieces_equal_library(hard_texts):
    """Ids by chunks are the library's, for any memo, for the known tokenizers and for others."""
    from millrace.llm.pieces import PieceEncoder

    rnd = random.Random(24)
    kinds = ["abcdefghij", " \n\t\r", "   \n", "aaaab", "éñÜßÆŸſİ", "'s'll\"#_-=", "0123456789", "'S'LLABC", "¡¿»", "\x85\xa0漢"]
    texts = ["".join(rnd.choice(rnd.choice(kinds[: rnd.randint(5, 10)])) for _ in range(rnd.choice([0, 1, 2, 3, 10, 40]))) for _ in range(3000)]
    texts += [t or "" for t in hard_texts] + [" ".join(f"w{i * k % 97}" for i in range(k % 23)) + " common" for k in range(200)]
    for name, kind in (("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "bytes")):
        encode = tokenizer(name)
        want = [brute.packed(encode(t)) for t in texts]
        for most in (0, 5, 1000):
            e = PieceEncoder(P.path(name), most)
            assert e.kind == kind and [x for at in range(0, len(texts), 500) for x in e.encode(texts[at : at + 500])] == want
    assert PieceEncoder(P.path("byte_bpe_50k.json")).encode([]) == []


def test_other_tokenizers_get_whole_texts(tmp_path):
    from tokenizers import Tokenizer, normalizers

    from millrace.llm.pieces import PieceEncoder

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.normalizer = normalizers.Lowercase()
    t.save(str(tmp_path / "t.json"))
    e = PieceEncoder(str(tmp_path / "t.json"))
    assert e.kind is None and e.encode(["Some TEXT", ""]) == [brute.packed(t.encode(x).ids) for x in ("Some TEXT", "")]


def test_reduction_takes_few_runs():
    """Sets are fixed as often as they can be at once, however many documents have these lengths."""
    for n in (10, 10**6, 10**9):
        counts = {1400: n, 300: n, 610: n}
        runs, sequences = packing.plan(counts, 2048)
        assert len(runs) <= 20 and sum(r.n for r in runs) == 3 * n
        assert sequences <= n + -(-n // 6) + 2
