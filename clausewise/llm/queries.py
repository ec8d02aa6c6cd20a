"""The registered queries of the pipeline operators: thin views with production parameters over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.llm import curriculum, debruijn, decontaminate, forest, hilbert, licenses, partenum, ppm, private_data, quality, spelling, toxicity, warc
from clausewise.llm.sql import ORACLES
from clausewise.llm.textkit import prepare
from clausewise.session import materialise, shared_folder, tune

__all__ = ["ORACLES", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(tune(spark)), sf_dir)

    QUERIES[fn.__name__] = run
    return run


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.search(_table(spark, sf_dir, "embeddings"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query
def op3_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query
def op4_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    folder = folder if ":" in folder else f"file://{folder}"
    index = materialise(warc.write_archives(warc.dedupe(_table(spark, sf_dir, "pages")), folder))
    return warc.read_archives(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op5_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(_table(spark, sf_dir, "documents"))


@query
def op6_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.join(_table(spark, sf_dir, "documents"), n=3, percent=90)


@query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


@query
def op8_contextual_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.find(_table(spark, sf_dir, "documents"))


@query
def op9_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"))


@query
def op10_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = curriculum.mix(_table(spark, sf_dir, "documents"))
    ordered = mixed.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
    return ordered.select("doc_id", "size", "source_size", "target", "taken", "position")


@query
def op11_debruijn_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.removed(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op12_hilbert_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.codes(_table(spark, sf_dir, "embeddings"))


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))
