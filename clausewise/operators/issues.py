"""Issues, excess cost, risk score, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clausewise.functions.maths import half_up, interest_delta, lookup, severity
from clausewise.functions.skew import HOT_ROWS, join_parent
from clausewise.functions.text import grouped_int, plain_number, readable_label, title_words, value_with_unit
from clausewise.sources.reference_data import (
    COST_MARGIN,
    FALLBACK_TERM_MONTHS,
    SEVERITY_RANK,
    SEVERITY_WEIGHT,
    SUMMARY_CLAUSES,
    SUMMARY_ISSUES,
)

EDGES = r"(?U)^[\s\uFEFF]+|[\s\uFEFF]+$"  # white space around a reply


def severity_rank(name: Column) -> Column:
    return lookup(name, SEVERITY_RANK, F.lit(0))


def issue_title(label: Column, direction: Column) -> Column:
    name = title_words(label)
    return (
        F.when(direction == "UNFAVORABLE", F.concat(F.lit("Above-Market "), name))
        .when(direction == "FAVORABLE", F.concat(F.lit("Below-Market "), name, F.lit(" (In Your Favour)")))
        .otherwise(F.concat(name, F.lit(" — Review Recommended")))
    )


def issue_description() -> Column:
    """Plain-language sentence on a comparison row, by direction."""
    unit = F.coalesce(F.col("unit"), F.lit(""))
    contract = value_with_unit(F.col("numeric_value"), unit)
    market = value_with_unit(F.col("rate_value"), F.col("rate_unit"))
    gap = value_with_unit(F.abs("delta"), unit)
    source = F.concat(F.lit(" ("), F.col("source_name"), F.lit(")"))
    head = F.concat(F.lit("Your contract's "), readable_label(F.col("label")), F.lit(" is "), contract, F.lit(", "))
    above = F.concat(
        head, F.lit("compared to the market benchmark of "), market, source, F.lit(". This is "), gap,
        F.lit(" above market, which may result in higher costs over the life of the contract."),
    )
    below = F.concat(
        head, F.lit("which is "), gap, F.lit(" below the market benchmark of "), market, source, F.lit(". This term is in your favour."),
    )
    level = F.concat(head, F.lit("in line with the market benchmark of "), market, source, F.lit("."))
    return F.when(F.col("direction") == "UNFAVORABLE", above).when(F.col("direction") == "FAVORABLE", below).otherwise(level)


def issue_detail() -> Column:
    reference = F.when(
        F.col("reference_url").isNotNull() & (F.col("reference_url") != ""),
        F.concat(F.lit("Reference: "), F.col("reference_url"), F.lit(".")),
    ).otherwise("No public reference URL available.")
    return F.concat(
        F.col("summary"), F.lit(" The clause was extracted from page "), F.col("page_no").cast("string"),
        F.lit(" of the document with "), half_up(F.col("confidence") * 100).cast("bigint").cast("string"),
        F.lit("% extraction confidence. Benchmark data sourced from "), F.col("source_name"), F.lit(" (as of "),
        F.date_format("as_of", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("). "), reference,
    )


def graded(compared: DataFrame, basis: str = "delta_percent") -> DataFrame:
    """Non-neutral comparisons with their severity; favourable ones are INFO."""
    sev = F.when(F.col("direction") == "FAVORABLE", "INFO").otherwise(severity(F.col(basis), F.col("category")))
    return compared.filter(F.col("direction") != "NEUTRAL").withColumn("severity", sev)


BRIEF = ["audit_id", "pos", "severity", "severity_rank", "title", "description", "direction", "numeric_value", "unit", "rate_value", "impact"]


def brief_issues(compared: DataFrame, basis: str = "delta_percent") -> DataFrame:
    """``issues`` as far as costs and summaries need them; ``compared`` may lack what only names and details an issue."""
    lacking = {c: F.lit(None).cast(t) for c, t in (("clause_id", "string"), ("summary", "string"), ("page_no", "int")) if c not in compared.columns}
    return issues(compared.withColumns(lacking), basis).select(BRIEF)


def issues(compared: DataFrame, basis: str = "delta_percent") -> DataFrame:
    """One issue per non-neutral comparison; ``basis`` names the deviation column that sets the severity.

    Rows carry ``severity_rank`` and ``pos``: reading an audit's issues in (rank desc, pos) order gives the
    report order, so nothing has to be sorted or numbered inside a task per audit.
    """
    cost = F.when((F.col("direction") == "UNFAVORABLE") & (F.col("impact") > 0), F.col("impact"))
    return (
        graded(compared, basis).select(
            "audit_id", "pos", "clause_id",
            F.concat(F.lit("issue_"), F.col("clause_id")).alias("issue_id"),
            "severity", severity_rank(F.col("severity")).alias("severity_rank"),
            issue_title(F.col("label"), F.col("direction")).alias("title"),
            issue_description().alias("description"), issue_detail().alias("detail"),
            "direction", "numeric_value", "unit", "rate_value", "rate_unit", "source_name", "delta", "delta_percent", "impact",
            cost.alias("lifetime_cost"),
            F.array("category", F.lower("severity"), F.lower("direction"), "label").alias("tags"),
            "confidence", "category", "label",
        )
    )


def in_report_order(found: DataFrame) -> DataFrame:
    """Issues of all audits, worst first within an audit: one range-partitioned sort that also splits big audits."""
    return found.orderBy("audit_id", F.col("severity_rank").desc(), "pos")


# --- excess cost ------------------------------------------------------------------------------------------


def cost_items(found: DataFrame, facts: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The breakdown: one row per unfavourable issue with its cost over the contract's term."""
    per_audit = facts.select(
        "audit_id", "n_clauses", F.coalesce("term_cost", F.lit(float(FALLBACK_TERM_MONTHS))).alias("term_months"), "principal_cost"
    )
    bad = found.filter(F.col("direction") == "UNFAVORABLE")
    joined = join_parent(bad, per_audit, "audit_id", F.col("pos"), "n_clauses", "inner", hot_rows)
    is_rate = (F.col("unit") == "percent") & F.col("principal_cost").isNotNull()
    amortised = interest_delta("principal_cost", "numeric_value", "rate_value", "term_months")
    return joined.select(
        "audit_id", "pos", F.col("title").alias("item"),
        F.when(is_rate, amortised).otherwise(F.col("impact")).alias("amount"),
        F.when(is_rate, F.concat(F.lit("Rate differential over "), plain_number(F.col("term_months")), F.lit(" months")))
        .otherwise(F.col("description"))
        .alias("item_text"),
    )


def cost_of_loyalty(items: DataFrame, facts: DataFrame) -> DataFrame:
    """Total excess cost per audit with a fixed 15 % margin; audits without items cost 0."""
    totals = items.groupBy("audit_id").agg(F.sum("amount").alias("raw_total"), F.count("*").alias("n_items"))
    term = F.coalesce("term_cost", F.lit(float(FALLBACK_TERM_MONTHS)))
    base = facts.join(totals, "audit_id", "left").withColumn("raw_total", F.coalesce("raw_total", F.lit(0.0)))
    total = F.col("raw_total")
    margin = total * F.lit(COST_MARGIN)
    principal = F.col("principal_cost")
    assumptions = F.filter(
        F.array(
            F.concat(F.lit("Assumes "), plain_number(term), F.lit("-month remaining term")),
            F.when(principal != 0, F.concat(F.lit("Based on principal of $"), F.regexp_replace(F.format_number(principal, 3), r"\.?0+$", ""), F.lit(" CAD"))),
            F.lit("Benchmark rates as of most recent available data"),
            F.lit("Does not account for potential rate changes during term"),
        ),
        lambda x: x.isNotNull(),
    )
    return base.select(
        "audit_id",
        half_up(total).alias("total_cost"),
        half_up(total - margin).alias("low"),
        half_up(total).alias("mid"),
        half_up(total + margin).alias("high"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        term.alias("term_months"),
        assumptions.alias("assumptions"),
    )


def no_term_warnings(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("term_cost").isNull()).select(
        "audit_id",
        F.lit("CALC_COST_NO_TERM").alias("code"),
        F.lit(f"No term clause found — defaulting to {FALLBACK_TERM_MONTHS} months for cost calculation").alias("message"),
        F.lit(True).alias("recoverable"),
        F.lit("EXTRACTING").alias("stage"),
    )


# --- score and summary ------------------------------------------------------------------------------------


def risk_scores(audits: DataFrame, found: DataFrame) -> DataFrame:
    """Per audit: weighted, capped risk score over all issues, and counts per severity; no issues give 0.

    ``found`` needs audit_id, severity and confidence only, so graded comparisons do as well as full issues.
    """
    weight = lookup(F.col("severity"), {k: float(v) for k, v in SEVERITY_WEIGHT.items()}, F.lit(0.0))
    per_audit = found.groupBy("audit_id").agg(
        F.sum(weight * F.col("confidence")).alias("raw"),
        F.count("*").alias("n_issues"),
        F.count_if(F.col("severity") == "CRITICAL").alias("n_critical"),
        F.count_if(F.col("severity") == "HIGH").alias("n_high"),
        F.count_if(F.col("severity") == "MEDIUM").alias("n_medium"),
    )
    joined = audits.join(per_audit, "audit_id", "left")
    zero = F.lit(0).cast("bigint")
    return joined.select(
        *audits.columns,
        F.least(F.lit(100.0), half_up(F.round(F.coalesce("raw", F.lit(0.0)), 9))).cast("int").alias("risk_score"),
        *[F.coalesce(F.col(c), zero).alias(c) for c in ("n_issues", "n_critical", "n_high", "n_medium")],
    )


def fallback_summary(contract_type: Column, n_issues: Column, n_critical: Column, n_high: Column, score: Column) -> Column:
    """The summary used when no written one is supplied."""
    return F.concat(
        F.lit("This "), F.coalesce(readable_label(contract_type), F.lit("financial")), F.lit(" contract was analysed. "),
        n_issues.cast("string"), F.lit(" issue(s) were identified ("), n_critical.cast("string"), F.lit(" critical, "),
        n_high.cast("string"), F.lit(" high severity). Risk score: "), score.cast("string"),
        F.lit("/100. Please review the detailed findings below."),
    )


def top_issues(found: DataFrame, k: int = 3) -> DataFrame:
    """The k worst issues per audit; the row limit per group is applied before the shuffle as well."""
    order = W.partitionBy("audit_id").orderBy(F.col("severity_rank").desc(), F.col("pos"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def summary_requests(audits: DataFrame, passed_issues: DataFrame, passed_clauses: DataFrame, costs: DataFrame) -> DataFrame:
    """Request text for a written summary: contract type, first 15 clauses, worst 10 issues, cost line."""
    clause_line = F.concat(
        F.lit("- "), readable_label(F.col("label")), F.lit(": "), F.col("raw_value"),
        F.when(
            F.col("numeric_value").isNotNull(),
            F.concat(F.lit(" ("), plain_number(F.col("numeric_value")), F.lit(" "), F.coalesce("unit", F.lit("")), F.lit(")")),
        ).otherwise(""),
    )
    first_clauses = (
        passed_clauses.withColumn("rank", F.row_number().over(W.partitionBy("audit_id").orderBy("pos")))
        .filter(F.col("rank") <= SUMMARY_CLAUSES)
        .groupBy("audit_id")
        .agg(F.sort_array(F.collect_list(F.struct("rank", clause_line.alias("line")))).alias("clause_lines"))
    )
    issue_line = F.concat(F.lit("- ["), F.col("severity"), F.lit("] "), F.col("title"), F.lit(": "), F.col("description"))
    worst = (
        top_issues(passed_issues, SUMMARY_ISSUES)
        .groupBy("audit_id")
        .agg(F.sort_array(F.collect_list(F.struct("rank", issue_line.alias("line")))).alias("issue_lines"))
    )
    counts = passed_issues.groupBy("audit_id").agg(F.count("*").alias("n_passed"))
    joined = (
        audits.join(first_clauses, "audit_id", "left")
        .join(worst, "audit_id", "left")
        .join(counts, "audit_id", "left")
        .join(costs.select("audit_id", "total_cost", "term_months"), "audit_id", "left")
    )

    def lines(name: str, empty: str) -> Column:
        text = F.array_join(F.col(name)["line"], "\n")
        return F.coalesce(F.when(F.size(name) > 0, text), F.lit(empty))

    cost = F.concat(
        F.lit("Estimated cost of staying with this contract: $"), grouped_int(F.col("total_cost")), F.lit(" CAD over "),
        plain_number(F.col("term_months")), F.lit(" months"),
    )
    return joined.select(
        "audit_id",
        F.concat_ws(
            "\n",
            F.concat(F.lit("Contract type: "), F.coalesce(readable_label(F.col("contract_type")), F.lit("Unknown"))),
            F.lit("Key clauses extracted:"),
            lines("clause_lines", "(none extracted)"),
            F.concat(F.lit("Issues found ("), F.coalesce("n_passed", F.lit(0)).cast("string"), F.lit(" total):")),
            lines("issue_lines", "(none found)"),
            cost,
            F.lit("Write the executive summary now:"),
        ).alias("request"),
    )


def settled_replies(written: DataFrame) -> DataFrame:
    """``written(audit_id, content, error)`` as one row per audit: a reply without an error wins, then the smallest."""
    pick = F.min(F.struct(F.col("error").isNotNull().alias("failed"), "content", "error"))
    return written.groupBy("audit_id").agg(pick.alias("reply")).select("audit_id", "reply.*")


def with_written(summaries: DataFrame, written: DataFrame) -> DataFrame:
    """Replace ``summary`` by the trimmed reply of its request; without a reply, or after a failed one, it stays as it is.

    An empty reply gives an empty summary.
    """
    reply = settled_replies(written).select("audit_id", F.when(~F.col("failed"), F.regexp_replace(F.coalesce("content", F.lit("")), EDGES, "")).alias("_reply"))
    return summaries.join(reply, "audit_id", "left").withColumn("summary", F.coalesce("_reply", "summary")).drop("_reply")


def summary_warnings(audits: DataFrame, written: DataFrame) -> DataFrame:
    """One warning per audit whose written summary failed."""
    failed = settled_replies(written).filter("failed").join(audits.select("audit_id"), "audit_id", "left_semi")
    message = F.concat(F.lit("The summary could not be written ("), F.col("error"), F.lit("); the fallback is shown"))
    return failed.select(
        "audit_id", F.lit("SYNTHESIZE_LLM_ERROR").alias("code"), message.alias("message"), F.lit(True).alias("recoverable"), F.lit("CITING").alias("stage")
    )
