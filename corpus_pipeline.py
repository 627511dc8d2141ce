"""A training-data pipeline: five operators in turn over `documents`, each reading what the one before it wrote.

run() writes every stage to the shared folder, so a lost executor costs at most the stage that is running.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labelforge.llm import jaccard_join, mixing, pieces, pii, toxicity
from labelforge.llm.common import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: One epoch, so no document comes twice; of the weights, only those that leave at least nine tenths of the tokens.
MIX = mixing.Mix(share=(9, 10), epochs=1)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic by a model trained on the labelled ones of this input."""
    return toxicity.clean_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by shingle Jaccard of 0.8 or more, the document with the least id."""
    return jaccard_join.one_of_each(docs.select(*COLUMNS))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by the names of its kinds."""
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of one epoch of the mix; documents without tokens go."""
    return mixing.mixed_documents(docs.select(*COLUMNS), MIX)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of every document, with its digest and the check that they decode to the text."""
    return pieces.encode_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: The learned and sampled stages have no SQL; tests hold each stage against its brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
