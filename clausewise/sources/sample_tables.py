"""The audit tables read from the sample star schema: orders are audits, order lines are clauses, documents are texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.functions.skew import spread
from clausewise.sources.reference_data import CONTRACT_TYPES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One audit per order: ``audit_id, owner_id, created_at, contract_type, status``."""
    types = F.array(*[F.lit(t) for t in CONTRACT_TYPES])
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("audit_id"),
        F.col("o_custkey").alias("owner_id"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.element_at(types, (F.col("o_orderkey") % 9 + 1).cast("int")).alias("contract_type"),
        F.when(F.col("o_orderstatus") == "F", "COMPLETE")
        .when(F.col("o_orderstatus") == "O", "FAILED")
        .otherwise("EXTRACTING")
        .alias("status"),
    )


def _cents(x: Column) -> Column:
    return F.floor(x * 100 + 0.5).cast("bigint")


def _decimal_text(cents: Column) -> Column:
    whole = F.floor(cents / 100).cast("bigint").cast("string")
    return F.concat(whole, F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def _dealt(scan: DataFrame) -> DataFrame:
    """A table's rows dealt out before heavy work on each row, unless its files already come in a part for every core."""
    parts = scan._jdf.queryExecution().toRdd().getNumPartitions()
    return scan if parts >= scan.sparkSession.sparkContext.defaultParallelism else spread(scan)


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One clause per order line, plus one principal clause for two thirds of the orders.

    ``pos`` orders the clauses of an audit (line number, then a hash of the row), without any window.
    """
    n, discount, tax = F.col("l_linenumber"), _cents(F.col("l_discount")), _cents(F.col("l_tax"))
    quantity, price = F.col("l_quantity").cast("bigint"), _cents(F.col("l_extendedprice"))
    row_hash = F.conv(
        F.substring(
            F.md5(
                F.concat_ws(
                    "|", *[c.cast("string") for c in (F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), n, quantity, price, discount, tax)]
                ).cast("binary")
            ),
            1,
            15,
        ),
        16,
        10,
    ).cast("bigint")
    years = F.col("l_returnflag") == "R"
    cents = (
        F.when(n.isin(1, 3, 6), discount * 100 + quantity)
        .when(n == 2, F.when(years, quantity * 100).otherwise(quantity * 1200))
        .when(n == 4, discount * 10)
        .when(n == 5, F.floor(price / 100).cast("bigint"))
    )
    labels = ["interest_rate", "term_length", "prime_rate_spread", "management fee", "annual_fee", "Posted Variable Rate", "rate_type"]
    categories = ["interest_rate", "term_conditions", "variable_rate_terms", "fees", "fees", "variable_rate_terms", "interest_rate"]
    unit = F.when(n.isin(1, 3, 4, 6), "percent").when((n == 2) & years, "years").when(n == 2, "months").when(n == 5, "CAD")
    raw = (
        F.when(n.isin(1, 3, 4, 6), F.concat(_decimal_text(cents), F.lit("%")))
        .when(n == 2, F.concat((F.floor(cents / 100)).cast("bigint").cast("string"), F.lit(" "), unit))
        .when(n == 5, F.concat(F.lit("$"), _decimal_text(cents)))
        .when(F.col("l_returnflag") == "A", F.concat(F.lit("fixed for "), quantity.cast("string")))
        .otherwise("fixed")
    )
    label = F.element_at(F.array(*map(F.lit, labels)), n)
    verbatim = (
        F.when(tax == 8, "  ")
        .when(tax == 7, F.concat(F.lit("The "), F.replace(label, F.lit("_"), F.lit(" ")), F.lit(" is as posted.")))
        .otherwise(F.concat(F.lit("The "), F.replace(label, F.lit("_"), F.lit(" ")), F.lit(" is "), raw, F.lit(" here.")))
    )
    pos = n.cast("bigint") * F.lit(1 << 60) + row_hash
    lines = _dealt(table(spark, sf_dir, "lineitem")).select(
        F.col("l_orderkey").alias("audit_id"),
        pos.alias("pos"),
        F.concat(F.lit("c"), F.col("l_orderkey").cast("string"), F.lit("_"), pos.cast("string")).alias("clause_id"),
        label.alias("label"),
        F.element_at(F.array(*map(F.lit, categories)), n).alias("category"),
        raw.alias("raw_value"),
        (cents / F.lit(100.0)).alias("numeric_value"),
        unit.alias("unit"),
        F.concat(F.lit("Your "), F.replace(label, F.lit("_"), F.lit(" ")), F.lit(" is "), raw, F.lit(".")).alias("summary"),
        (F.col("l_suppkey") % 12).cast("int").alias("page_no"),
        verbatim.alias("verbatim"),
        (F.lit(1.0) - tax * F.lit(8) / F.lit(100.0)).alias("confidence"),
    )
    amount = _cents(F.col("o_totalprice"))
    text = F.concat(F.lit("$"), _decimal_text(amount))
    principals = (
        table(spark, sf_dir, "orders")
        .filter(F.col("o_orderstatus").isin("F", "O"))
        .select(
            F.col("o_orderkey").alias("audit_id"),
            F.lit(0).cast("bigint").alias("pos"),
            F.concat(F.lit("c"), F.col("o_orderkey").cast("string"), F.lit("_0")).alias("clause_id"),
            F.lit("principal_amount").alias("label"),
            F.lit("term_conditions").alias("category"),
            text.alias("raw_value"),
            (amount / F.lit(100.0)).alias("numeric_value"),
            F.lit("CAD").alias("unit"),
            F.concat(F.lit("You borrow "), text, F.lit(".")).alias("summary"),
            F.lit(1).alias("page_no"),
            F.concat(F.lit("The principal amount is "), text, F.lit(" here.")).alias("verbatim"),
            F.lit(0.95).alias("confidence"),
        )
    )
    return lines.unionByName(principals)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("audit_id"), "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a document is a page: ``audit_id, page_no, text``."""
    return documents(spark, sf_dir).select(
        "audit_id", F.posexplode(F.split("text", "\n", -1)).alias("page_no", "text")
    ).withColumn("page_no", F.col("page_no") + 1)


def progress_events(events: DataFrame) -> DataFrame:
    """Stream or table of raw events as progress events of an audit (one audit per user)."""
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "COMPLETE").when(kind == "error", "FAILED").otherwise("EXTRACTING")
    return events.select(
        F.col("user_id").alias("audit_id"),
        F.col("event_id").alias("seq"),
        F.col("ts"),
        F.when(kind == "click", "clause_found")
        .when(kind == "view", "issue_flagged")
        .when(kind == "purchase", "complete")
        .when(kind == "error", "error")
        .otherwise("status_change")
        .alias("type"),
        F.when(kind == "signup", "EXTRACTING").otherwise(status).alias("status"),
        (F.floor(F.col("value")).cast("int") % 101).alias("progress"),
        F.col("props").alias("payload"),
    )
