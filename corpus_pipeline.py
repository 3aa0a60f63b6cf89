"""The corpus pipeline: toxicity, exact deduplication, near-duplicates, decontamination, SentencePiece encoding.

STAGES are (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which `run` writes
as Parquet and reads again as the next one's docs.  All but the last return the columns of docs.

Defined cases, in every stage: null text counts as empty and is kept unless it repeats; very long texts are read whole; null
ids are ids like any others; ties go to the largest id in `exact` and to the smallest in `near`, and one of repeated rows
stays; an empty table passes through as an empty table; further columns of docs keep their names and values, but in the last
stage, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import toxicity as toxic
from recordloom.llm.common import table, tokenizer_path
from recordloom.llm.decontaminate import decontaminate
from recordloom.llm.exact_dedup import exact_dedup
from recordloom.llm.near_dedup import near_duplicates
from recordloom.llm.rows import keep_rows
from recordloom.llm.sentencepiece_codec import encode
from recordloom.session import scratch_path

TOKENIZER = "piece_bpe_32k.model"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on the labelled ones among them, does not hold toxic."""
    scored = toxic.score(docs, toxic.fit(docs, table(spark, sf_dir, "labels")))
    return scored.filter(~F.col("toxic_pred")).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of equal texts: that with the largest doc_id."""
    return keep_rows(docs, exact_dedup(docs, keep="max").filter("NOT kept").select("doc_id", F.col("text_sha256").alias("digest")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of a group of near duplicates: that with the smallest doc_id."""
    groups = near_duplicates(docs, sources=True)
    return keep_rows(docs, groups.filter("NOT kept").select("doc_id", F.col("text_sha256").alias("digest")))


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is in passages of the benchmark."""
    judged = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return keep_rows(docs, judged.filter("contaminated").select("doc_id", F.col("text_sha256").alias("digest")))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, encoded: doc_id, ids, n_tokens, round_trip and parity."""
    return encode(docs, tokenizer_path(TOKENIZER), parity=True)


STAGES = [("toxicity", toxicity), ("exact", exact), ("near", near), ("contamination", contamination), ("sentencepiece", sentencepiece)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: A fitted classifier and a tokenizer are in it, which SQL cannot express.
ORACLE_SQL = None
