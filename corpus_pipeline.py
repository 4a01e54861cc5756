"""The corpus pipeline: documents in, token files out.

STAGES are run in order; each takes all documents that its predecessor kept,
and its result is written as Parquet and read again as the next one's input:

1. toxicity: documents that score as toxic go;
2. near_duplicates: one document of each SimHash class stays;
3. decontaminate: documents that hold a benchmark window go;
4. mix: each document is repeated, kept or left out by its rate;
5. token_output: the rest is written as token files and read back.

All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import decontam, mixing, simhash, tokens, toxicity
from ledgerlens.llm.common import materialize, table


def toxic_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.filter_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.survivors(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, table(spark, sf_dir, "labels"))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.token_output(spark, docs)


STAGES = [
    ("toxicity", toxic_filter),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("token_output", token_output),
]

# Trained models, SimHash classes and tokenization have no SQL; the tests hold
# the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
