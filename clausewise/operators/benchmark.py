"""Which market rate belongs to a clause, and how the clause compares with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.functions.maths import half_up, interest_delta, lookup
from clausewise.functions.skew import HOT_ROWS, join_parent
from clausewise.sources.reference_data import (
    CATEGORY_KEYS,
    COST_PRINCIPAL_LABELS,
    DEFAULT_PRINCIPAL,
    DEFAULT_TERM_MONTHS,
    FALLBACK_TERM_MONTHS,
    KEY_UNIT,
    LABEL_KEYS,
    NEUTRAL_BAND,
    OTHER_SOURCE_PRIORITY,
    PRINCIPAL_LABEL,
    SOURCE_PRIORITY,
    TERM_LABELS,
)


def lookup_label(label: Column, normalise_underscores: bool = False) -> Column:
    """A clause label as it is compared with the lookup keys."""
    text = F.lower(F.trim(label))
    return F.replace(text, F.lit("_"), F.lit(" ")) if normalise_underscores else text


def lookup_key(category: Column, text: Column) -> Column:
    """Rate category of a clause: exact label, then the first key containing or contained in it, then category.

    The key lists are fixed and short, so this is one expression: no join, no shuffle, no skew. ``text`` is a
    ``lookup_label``. It is bound once for all comparisons, because the optimiser repeats this expression in
    pushed-down filters with its inputs spelled out.
    """
    keys = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in LABEL_KEYS.items()])
    exact = F.create_map(*[F.lit(x) for pair in LABEL_KEYS.items() for x in pair])

    def resolved(label: Column) -> Column:
        near = F.filter(keys, lambda k: F.contains(label, k["key"]) | F.contains(k["key"], label))
        return F.coalesce(F.try_element_at(exact, label), F.get(near, F.lit(0))["value"])

    return F.coalesce(F.transform(F.array(text), resolved)[0], lookup(category, CATEGORY_KEYS))


def with_lookup_key(clauses: DataFrame, out: str = "rate_key", normalise_underscores: bool = False) -> DataFrame:
    """Add the rate category of every clause (null where there is none)."""
    return clauses.withColumn(out, lookup_key(F.col("category"), lookup_label(F.col("label"), normalise_underscores)))


def source_prefix(source_name: Column) -> Column:
    return F.trim(F.split_part(source_name, F.lit("|"), F.lit(1)))


def source_priority(source_name: Column) -> Column:
    return lookup(source_prefix(source_name), SOURCE_PRIORITY, F.lit(OTHER_SOURCE_PRIORITY))


def matches_category(source_name: Column, category: Column) -> Column:
    """The part after the bar equals the category; names without a bar match by containment."""
    rest = F.lower(F.trim(F.regexp_replace(source_name, r"^[^|]*\|", "")))
    return F.when(F.instr(source_name, "|") > 0, rest == F.lower(category)).otherwise(
        F.contains(F.lower(source_name), F.lower(category))
    )


def canonical_unit(unit: Column) -> Column:
    """Letters only; the percent and dollar synonyms each become one name."""
    letters = F.replace(F.regexp_replace(F.lower(unit), "[^a-z]", ""), F.lit("annualizedpercent"), F.lit("percent"))
    return (
        F.when(letters.isin("percent", "pct", ""), "percent").when(letters.isin("cad", "dollar", "dollars"), "cad").otherwise(letters)
    )


def unit_compatible(rate_unit: Column, wanted: Column) -> Column:
    return wanted.isNull() | (wanted == "") | (canonical_unit(rate_unit) == canonical_unit(wanted))


def best_rates(rates: DataFrame, wanted: list[str] | None = None, unit: str | None = KEY_UNIT) -> DataFrame:
    """Best rate per rate category: source priority, then the newest; aggregated map-side, one row per category.

    ``wanted`` defaults to the categories the lookup keys can produce, so the result has at most that many rows.
    """
    names = sorted(set(wanted or [*LABEL_KEYS.values(), *CATEGORY_KEYS.values()]))
    keys = F.explode(F.array(*map(F.lit, names)))
    candidates = (
        rates.select("*", keys.alias("rate_key"))
        .filter(matches_category(F.col("source_name"), F.col("rate_key")))
        .filter(unit_compatible(F.col("unit"), F.lit(unit)))
    )
    picked = F.struct("source_name", "value", F.col("unit").alias("rate_unit"), "as_of", "reference_url")
    order = F.struct(source_priority(F.col("source_name")), -F.unix_micros("as_of"), F.col("source_name"))
    best = candidates.groupBy("rate_key").agg(F.min_by(picked, order).alias("best"))
    return best.select("rate_key", "best.*").withColumnRenamed("value", "rate_value")


def terms_and_principal(clauses: DataFrame) -> DataFrame:
    """One pass over the clauses, one row per audit.

    ``term_cmp``: first term in months; ``term_cost``: first term in any unit, years times 12;
    ``principal_cmp``/``principal_cost``: first principal (the latter also takes a capitalised cost).
    """
    value = F.col("numeric_value")
    is_term = F.col("label").isin(TERM_LABELS) & value.isNotNull()

    def first(condition: Column, result: Column) -> Column:
        return F.min_by(result, F.when(condition, F.col("pos")))

    return clauses.groupBy("audit_id").agg(
        F.count("*").alias("n_clauses"),
        first(is_term & (F.col("unit") == "months"), value).alias("term_cmp"),
        first(is_term, F.when(F.col("unit") == "years", value * 12).otherwise(value)).alias("term_cost"),
        first((F.col("label") == PRINCIPAL_LABEL) & value.isNotNull(), value).alias("principal_cmp"),
        first(F.col("label").isin(COST_PRINCIPAL_LABELS) & value.isNotNull(), value).alias("principal_cost"),
    )


def default_term(contract_type: Column) -> Column:
    return lookup(contract_type, {k: float(v) for k, v in DEFAULT_TERM_MONTHS.items()}, F.lit(float(FALLBACK_TERM_MONTHS)))


def audit_facts(audits: DataFrame, clauses: DataFrame) -> DataFrame:
    """Per audit: its contract type with the facts of ``terms_and_principal`` (zero clauses give nulls)."""
    return audits.join(terms_and_principal(clauses), "audit_id", "left").withColumn(
        "n_clauses", F.coalesce("n_clauses", F.lit(0))
    )


def deltas(clauses: DataFrame, rates: DataFrame) -> DataFrame:
    """Clauses that have a number and a market rate, with delta, delta_percent and direction. No shuffle of clauses.

    The rates are at most as many as there are lookup keys, so they are broadcast. ``unit_mismatch`` marks
    clauses whose own unit is not that of the rate.
    """
    keyed = with_lookup_key(clauses.filter(F.col("numeric_value").isNotNull()))
    rate = F.col("rate_value")
    delta = F.col("numeric_value") - rate
    percent = F.when(rate != 0, delta / F.nullif(rate, F.lit(0.0)) * 100).otherwise(F.lit(0.0))
    return keyed.join(F.broadcast(best_rates(rates)), "rate_key").withColumns(
        {
            "direction": F.when(delta > NEUTRAL_BAND, "UNFAVORABLE").when(delta < -NEUTRAL_BAND, "FAVORABLE").otherwise("NEUTRAL"),
            "delta": half_up(delta, 2),
            "delta_percent": half_up(percent, 2),
            "unit_mismatch": ~unit_compatible(F.col("rate_unit"), F.coalesce("unit", F.lit("none"))),
        }
    )


def with_impact(compared: DataFrame, facts: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add the projected cost impact: amortised for rates (term and principal of the audit), else the difference."""
    typed = facts.filter(F.col("contract_type").isNotNull())
    joined = join_parent(compared, typed, "audit_id", F.col("pos"), "n_clauses", "inner", hot_rows)
    used = joined.withColumns(
        {
            "term_used": F.coalesce("term_cmp", default_term(F.col("contract_type"))),
            "principal_used": F.coalesce(F.col("principal_cmp"), F.lit(DEFAULT_PRINCIPAL)),
        }
    )
    is_rate = F.coalesce(F.col("unit").isin("percent", "%"), F.lit(False)) | F.col("rate_unit").isin("percent", "%")
    gap = F.abs(F.col("numeric_value") - F.col("rate_value"))
    impact = (
        F.when(
            is_rate & (F.col("principal_used") > 0) & (F.col("term_used") > 0),
            F.abs(interest_delta("principal_used", "numeric_value", "rate_value", "term_used")),
        )
        .when(is_rate, gap * F.col("term_used"))
        .otherwise(gap)
    )
    return used.withColumn("impact", half_up(impact))


def comparisons(clauses: DataFrame, audits: DataFrame, rates: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every comparable clause of the audits that have a contract type, with its impact.

    Clauses without a key drop out before anything is shuffled; only the audit facts need a shuffle, and that
    join is protected against audits with very many clauses.
    """
    facts = audit_facts(audits.select("audit_id", "contract_type"), clauses)
    return with_impact(deltas(clauses, rates), facts, hot_rows)


def no_type_warnings(audits: DataFrame) -> DataFrame:
    return audits.filter(F.col("contract_type").isNull()).select(
        "audit_id",
        F.lit("BENCHMARK_NO_CONTRACT_TYPE").alias("code"),
        F.lit("No contract type, comparison with market rates skipped").alias("message"),
        F.lit(True).alias("recoverable"),
        F.lit("BENCHMARKING").alias("stage"),
    )
