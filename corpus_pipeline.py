"""Training corpus from `documents` in five stages; part of the subpackage llm.

toxicity rejects documents; minhash keeps one document of each group of near copies; pii masks
personal data; mixing repeats and drops documents so that sources meet their targets;
sentencepiece turns each text into ids and checks that they decode to it.

Each stage takes and returns whole tables: null texts and rows without an id go through every
stage (a null text is an empty one to sentencepiece), empty tables give empty results, and extra columns
pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waveframe.llm import minhash, mixing, pieces, pii, toxicity
from waveframe.llm.common import table, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.dedup(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    both = pieces.encode(rows, decoded="decoded")
    return both.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES = [("toxicity", reject_toxic), ("minhash", drop_copies), ("pii", mask_personal_data), ("mixing", mix_sources), ("sentencepiece", encode_pieces)]
#: No SQL expresses a fitted classifier, signatures or segmentation; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents, each one's table written and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
