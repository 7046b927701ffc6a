"""The corpus pipeline: each stage works on all that its predecessor kept and is written as Parquet before the next.

toxicity -> SimHash near-dedup -> suffix-array dedup -> benchmark decontamination -> SentencePiece encoding
"""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from sondeline.llm import decontaminate, sentencepieces, simhash, suffix_dedup, toxicity
from sondeline.llm.common import materialize, release, table, written_tables


#: Words of a shingle of the near-duplicate stage, and the least similarity of two texts' sets of shingles.
SHINGLE, SIMILARITY = 5, 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go; the models learn from the table's labels."""
    return toxicity.remove_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates by shingles of five words, the document with the least doc_id stays."""
    return simhash.deduplicate(docs, shingle=SHINGLE, similarity=SIMILARITY)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out of the texts; n_chars follows."""
    return suffix_dedup.remove_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark items make up a twentieth or more go; out of the others, passages of a window or more are cut."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), least_words=decontaminate.WINDOW)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, its SentencePiece ids and how they decode."""
    return sentencepieces.encode_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: SQL can express neither the smoothing models nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), written_tables()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(held, keep=(docs,))  # what the stage wrote, its input included
        gc.collect()
        spark.sparkContext._jvm.System.gc()  # Spark deletes shuffles that nothing refers to any more, but only after a collection
    return STAGES[-1][1](spark, docs, sf_dir)
