from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import common
from tests.llm import brute
from tests.llm.conftest import DOCUMENTS

pytest.importorskip("public_tokenizers")


def staged(spark, docs, sf_dir):
    """Every stage by itself: its input and its output as lists of rows."""
    for name, stage in corpus_pipeline.STAGES:
        out = common.written(stage(spark, docs, sf_dir), "test")
        yield name, docs.collect(), out.collect()
        docs = out


def test_stages_by_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    steps = {name: (before, after) for name, before, after in staged(spark, docs, small)}
    assert list(steps) == ["quality_rules", "quality_classifier", "simhash_near_dedup", "secret_scans", "best_fit_packing"]
    before, after = steps["quality_rules"]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r, kept in zip(before, brute.kept_documents([(r["source"], r["text"]) for r in before]), strict=True) if kept}
    before, after = steps["quality_classifier"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in after}
    judged = [r["doc_id"] for r in before if r["doc_id"] in labels]
    assert sum((d in kept) == (labels[d] == 1) for d in judged) >= 0.95 * len(judged)
    before, after = steps["simhash_near_dedup"]
    sets = {r["doc_id"]: brute.shingles(r["text"]) for r in before}
    of = brute.components(sets, [(a, b) for a, b in combinations(sets, 2) if brute.similar(sets[a], sets[b])])
    assert sorted(r["doc_id"] for r in after) == sorted(set(of.values()))
    before, after = steps["secret_scans"]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
    assert not any(brute.base_secrets(r["text"]) for r in after) and all(r["n_chars"] == len(r["text"]) for r in after)
    before, after = steps["best_fit_packing"]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
    n = brute.check_packing([(r["length"], r["sequence_id"], r["offset"]) for r in after], 2048)
    assert n <= -(-sum(r["length"] for r in after) // 2048) + 1
    whole, again = corpus_pipeline.run(spark, small), corpus_pipeline.run(spark, small)
    assert whole.count() == again.count() == len(after)  # a later run leaves an earlier one's result alone
    assert all(set(r.asDict()) == set(DOCUMENTS.names) for name in list(steps)[:-1] for r in steps[name][1][:1])


def test_hard_rows(spark, hard_documents, empty_documents, small):
    extra = hard_documents.withColumn("score", F.lit("x")).withColumn("root", F.lit(1))
    for docs in (extra, empty_documents):
        for name, _, after in staged(spark, docs, small):
            if name != "best_fit_packing" and after:
                assert set(after[0].asDict()) == set(docs.columns)
