"""Documents to packed batches: language ID, toxicity, near-duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the
columns of documents; the last returns the batches' rows. An empty table, or one of which nothing is left, goes through all stages and
gives no rows; columns beyond doc_id, text and lang are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import common, decontam, langid, near_dup, packing, tokens, toxicity

#: The stage links at 80 per cent (op3 alone has 85); at exactly 80 a pair meets in no band with probability 3e-6.
NEAR = near_dup.Params(threshold=80, bands=42, rows=6)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (und, so null and empty texts too) or whose language scores under one half. Repeated rows go alike."""
    return langid.stage(docs, langid.Params(tokens.public("piece_bpe_32k.model")))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that reach their language's toxicity threshold; texts without a letter have the score of the bias and stay. Repeated rows go alike."""
    return toxicity.stage(docs, common.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near copies, which are texts of similarity 0.8 or more."""
    return near_dup.keep_one(docs, p=NEAR)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; null and empty texts hold none and stay. An empty benchmark drops nothing."""
    return decontam.stage(docs, common.table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Assigns every row that is left to a length bucket and a batch; null and empty texts have the length of the end id."""
    return packing.pack(docs, packing.Params(tokens.public("word_bpe_49k.json")))


STAGES = [
    ("language ID", language),
    ("toxicity", toxic),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("packing", packed),
]

#: SQL cannot express the trained stages; tests/llm/test_documents.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.materialize(docs, f"stage{i}")
    return docs
