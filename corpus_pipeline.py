"""The corpus pipeline: stages over the documents table, each written as Parquet and read again by the next.

All stages but the last return documents with the columns they came with; the last returns packed pieces. Each stage
works on all that its predecessor kept, and rejects only what its own rule says:

1. toxicity: documents that the counterfactual-regularised classifier scores 0.5 or more go;
2. quality rules: documents that fail the base rules or have a posterior under one half go;
3. near duplicates: of each group of documents linked by five-word shingles at similarity 0.8, the one with the smallest id stays;
4. decontamination: documents with a ten-word window of a benchmark item go;
5. packing: what is left becomes sequences of at most 2048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxwarden.llm import decontaminate, near_dup, packing, quality, queries, toxicity
from fluxwarden.llm.common import table, written


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sample = toxicity.labelled_sample(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    return toxicity.keep_clean(docs, toxicity.fit(sample))


def of_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = packing.pack(docs, queries.vocabulary("word_bpe_49k.json"))
    return out.select(F.col("id").cast("long").alias("doc_id"), *out.columns[1:])


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("quality rules", of_good_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("packing", packed),
]

#: No stage of a trained classifier, EM and tokens can be put in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
