"""From raw documents to token numbers: quality, near-dedup, byte dedup, decontamination, encoding.

Every stage takes all that its predecessor kept, as Parquet. The first four give rows of the columns of `documents`:

quality           rows that the classifier scores below its cut go
near_dedup        of every class of near copies the row of least doc_id stays
suffix_dedup      stretches of 200 bytes or more that stand elsewhere too go from the texts; n_chars follows; rows stay
decontamination   rows that hold an item of `benchmark` go
byte_bpe          token numbers of every text, and the digest of what they decode to

The stages' own docstrings state what they do with nulls, empty texts and tables, ties and repeated rows. An empty table
goes through all of them.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm import byte_bpe, dart_minhash, decontamination, quality, suffix_dedup
from folium.session import checkpoint_dir, table

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dart_minhash.keep_one(docs)


def byte_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.clean_documents(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


STAGES = [("quality", keep_quality), ("near_dedup", near_dedup), ("suffix_dedup", byte_dedup), ("decontamination", decontaminate), ("byte_bpe", encode)]

#: Models, signatures and tokenizers are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage gives lies as Parquet in the shared folder for the next."""
    place = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
