"""From raw documents to packed training sequences.

Each stage takes all that the one before it kept, written as Parquet. The first four return the columns
of documents; the last returns a row for each packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import common, crf_quality, line_rules, packing, secrets, simhash
from millrace.llm.common import table
from millrace.llm.queries import tokenizer

def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the frequent lines of their host.

    Null and empty texts fail; an empty table stays empty; repeated rows are judged alike.
    """
    return line_rules.clean_documents(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from labelled ones among its input, predicts to be good.

    The chain learns from labels of both kinds that are left; a null or empty text is judged too.
    """
    model = crf_quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return crf_quality.score_quality(docs, model).where("predicted = 1").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8), that with the smallest doc_id.

    Null and empty texts are one group; repeated rows are reduced to one; null doc_ids come last.
    """
    return simhash.keep_one(docs, simhash.near_copies(docs, similarity=0.8, shingle=5))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret; null texts stay null."""
    return secrets.redact(secrets.find_secrets(docs, secrets.EntropyRules(parts=True))).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each packed piece; a null or empty text is a piece of the end id alone."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), capacity=2048)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", near_dedup),
    ("secret_scans", secret_scan),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result goes through a table in the shared folder.

    When a stage's result has been written, the folders that it and its input needed are deleted. What the
    returned rows are read from stays; ``common.drop_folders`` deletes it. Runs don't share folders.
    """
    docs, done = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        before = set(common.made())
        out = stage(spark, docs, sf_dir)
        path = common.new_folder(spark, name)
        out.write.parquet(path)
        common.drop_folders(spark, [*done, *(p for p in common.made() if p not in before and p != path)])
        docs, done = spark.read.schema(out.schema).parquet(path), [path]
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier, fingerprints, tokens and packing are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None
