"""Corpus pipeline over ``documents``: quality, exact copies, near copies, benchmark leaks, packing.

Every stage takes the rows its predecessor kept and returns the columns of documents; the last returns the packed
pieces (doc_id, piece, start, length, ids_crc32, sequence_id, offset). The classifier learns from the labels of the
rows it is given. Between stages run() writes a table below spark.checkpoint.dir, so a lost executor costs tasks and
not stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from frameloom.llm import decontaminate, exact_dedup, minhash_dedup, packing, quality
from frameloom.llm.queries import tokenizer_path
from frameloom.llm.storage import Scratch


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.drop_rejected(docs, quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.drop_near_copies(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_sequences(docs, tokenizer_path(), with_ids=False)


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("minhash_dedup", drop_near_copies),
    ("decontaminate", drop_benchmark_leaks),
    ("packing", pack_sequences),
]
#: A trained classifier is not SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.keep(docs, name)
            if k:
                scratch.drop(STAGES[k - 1][0])
    return docs
