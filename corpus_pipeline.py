"""From raw documents to a training mix: five stages, each written as Parquet and read again as the next one's input.

1. toxicity: documents predicted toxic go.
2. n-gram Jaccard join: of documents linked by five-word shingles at a similarity of 0.8, one of each group stays.
3. benchmark decontamination: documents that hold a benchmark passage go.
4. personal data: spans are replaced by their kind; all documents stay.
5. mixing: sources are brought to their target weights along the curriculum, a row per copy in training order.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession

from clausewise.llm import curriculum, decontaminate, partenum, private_data, toxicity
from clausewise.llm.textkit import prepare
from clausewise.session import materialise, tune

SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(tune(spark))
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(tune(spark))
    return partenum.one_of_each(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(tune(spark))
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return private_data.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return curriculum.mixed_documents(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_benchmark),
    ("private_data", redact_private_data),
    ("mixing", mix_sources),
]

#: Trained scores, signatures and bootstrapped patterns are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of ``documents`` after all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
