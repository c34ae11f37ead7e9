"""Corpus cleaning from quality rules to packed sequences; each stage's result is written as Parquet and read by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apisight.llm.line_dedup import dedup_lines
from apisight.llm.ngram_join import keep_one
from apisight.llm.packing import pack
from apisight.llm.quality import quality_verdicts
from apisight.llm.shared import free_names, materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a certified cutoff reject go."""
    judged = quality_verdicts(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "lang")
    return judged.where("kept").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of repeated three-line windows go; a document without a line left goes as well. n_chars follows the text."""
    (removed,) = free_names(docs.columns, "_removed")
    found = dedup_lines(docs, removed).where((F.col(removed) == 0) | (F.length("text") > 0))
    return found.withColumn("n_chars", F.when(F.col(removed) == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.8 or more over five-word shingles, the one with the least doc_id stays."""
    return keep_one(docs, k=5, percent=80).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the windows that a training run reads."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("key")


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("n-gram Jaccard join", near_duplicates), ("packing", packing)]

#: SQL can express neither the exact binomial bounds nor the tokenizer; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
