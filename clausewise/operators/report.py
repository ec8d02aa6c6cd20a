"""What a report page shows, for all audits at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.functions.maths import clamp, half_up, lookup
from clausewise.functions.text import title_words
from clausewise.sources.reference_data import SEVERITY_RANK


def rank_name(rank: Column) -> Column:
    return lookup(rank, {v: k for k, v in SEVERITY_RANK.items()})


def worst_issues(issues: DataFrame, links: DataFrame) -> DataFrame:
    """The worst issue of every clause that has any; the first one in report order wins ties."""
    picked = F.struct("issue_id", "severity", "severity_rank", "title")
    order = F.struct("severity_rank", -F.col("pos"))
    best = links.select("issue_id", "clause_id").join(issues.drop("clause_id"), "issue_id").groupBy("clause_id").agg(F.max_by(picked, order).alias("w"))
    return best.select("clause_id", "w.*")


def worst_ranks(issues: DataFrame, links: DataFrame) -> DataFrame:
    """The highest severity rank of every clause that has an issue: ``worst_issues`` without the texts, counted in hash tables."""
    ranked = links.select("issue_id", "clause_id").join(issues.select("issue_id", "severity_rank"), "issue_id")
    return ranked.groupBy("clause_id").agg(F.max("severity_rank").alias("severity_rank"))


def category_rollup(clauses: DataFrame, worst: DataFrame) -> DataFrame:
    """Clauses of an audit by category: count, highest severity, whether the group opens by itself, display name."""
    joined = clauses.select("audit_id", "clause_id", "category").join(worst.select("clause_id", "severity_rank"), "clause_id", "left")
    grouped = joined.groupBy("audit_id", "category").agg(F.count("*").alias("n_clauses"), F.max("severity_rank").alias("_r"))
    return grouped.select(
        "audit_id", "category", title_words(F.col("category")).alias("category_name"), "n_clauses",
        rank_name(F.col("_r")).alias("highest_severity"),
        F.coalesce(F.col("_r") >= SEVERITY_RANK["MEDIUM"], F.lit(False)).alias("expanded"),
    )


def severity_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("audit_id").agg(
        F.count_if(F.col("severity").isin("HIGH", "CRITICAL")).alias("n_high"), F.count_if(F.col("severity") == "MEDIUM").alias("n_medium")
    )


def gauge_score(score: Column) -> Column:
    return clamp(half_up(score), 0.0, 100.0)


def fatal_warnings(warnings: DataFrame) -> DataFrame:
    return warnings.filter(~F.col("recoverable"))


def looks_unverified(confidence: Column) -> Column:
    return confidence < 0.5


def status_label(status: Column) -> Column:
    return F.when(status == "COMPLETE", "Complete").when(status == "FAILED", "Failed").otherwise("In Progress")


def risk_band(score: Column) -> Column:
    return F.when(score >= 70, "high").when(score >= 40, "elevated").when(score.isNotNull(), "low")


def owner_report(audits: DataFrame, owner_id=None) -> DataFrame:
    """Audits of one owner (or of all), newest first; filter and columns reach the scan."""
    chosen = audits if owner_id is None else audits.filter(F.col("owner_id") == owner_id)
    return chosen.select(
        "owner_id", "audit_id", "contract_type", "created_at", "risk_score",
        status_label(F.col("status")).alias("status_label"), risk_band(F.col("risk_score")).alias("risk_band"),
    ).orderBy("owner_id", F.col("created_at").desc(), "audit_id")
