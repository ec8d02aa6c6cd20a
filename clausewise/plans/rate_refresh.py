"""Refreshing the rate table from landed series and extracted pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clausewise.sources import rate_feeds, reference_data, results


def refresh_rates(spark: SparkSession, base: str, series_answers: DataFrame, page_replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Upsert both feeds into the versioned rate table under ``base`` (seeded when empty); returns rates and errors."""
    stored = results.read_version(spark, base)
    existing = stored if stored is not None else reference_data.rates(spark)
    observed = rate_feeds.observations(series_answers)
    incoming = rate_feeds.good(observed).unionByName(rate_feeds.extracted_rates(page_replies))
    results.write_version(rate_feeds.upsert(existing, incoming), base)
    return results.read_version(spark, base), rate_feeds.errors(observed)
