"""What the physical plans must and must not contain."""

import pytest

from clausewise.operators import benchmark, issues, pii
from clausewise.plans import catalog
from clausewise.sources import reference_data as ref
from clausewise.sources import sample_tables
from clausewise.streaming import events

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_outside_window_scoring(spark):
    for name in ("risk_score", "clause_comparison", "pii_redact", "clause_validation", "anchor_first_page", "hallucination_report", "event_replay", "audit_nested"):
        text = plan(catalog.QUERIES[name](spark, SF))
        assert "ArrowEvalPython" not in text and "BatchEvalPython" not in text and "MapInPandas" not in text, name


def test_rates_are_broadcast_and_clauses_not_shuffled(spark):
    text = plan(benchmark.deltas(sample_tables.table(spark, SF, "lineitem").selectExpr("'rate_type' label", "'interest_rate' category", "l_tax numeric_value", "'percent' unit"), ref.rates(spark)))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_detection_and_redaction_never_shuffle(spark):
    docs = sample_tables.documents(spark, SF)
    assert "Exchange" not in plan(pii.redact(pii.detect(docs)))


@pytest.mark.parametrize("kind", ["issues", "events"])
def test_top_k_is_limited_before_the_shuffle(spark, kind):
    if kind == "issues":
        found = spark.range(10).selectExpr("id % 2 audit_id", "id pos", "1 severity_rank")
        text = plan(issues.top_issues(found, 3))
    else:
        text = plan(events.history(spark.range(10).selectExpr("id % 2 audit_id", "id seq"), 5))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_scans_read_only_what_is_needed(spark):
    text = plan(catalog.QUERIES["severity_counts"](spark, SF))
    assert "l_returnflag" not in text.split("ReadSchema")[1].split("\n")[0]


def test_owner_filter_reaches_the_scan(spark):
    from clausewise.operators import report

    audits = sample_tables.audits(spark, SF).selectExpr("*", "1 risk_score")
    assert "EqualTo(o_custkey,7)" in plan(report.owner_report(audits, 7))


def test_every_document_is_quoted(spark):
    """Approximate anchoring is asked for a passage of every document, short ones and places after the first line included."""
    from clausewise.plans import catalog
    from clausewise.sources import sample_tables

    docs = {r.audit_id: r.text for r in sample_tables.documents(spark, SF).collect() if r.text and r.text.strip()}
    passages = {r.audit_id: r.t for r in catalog._passages(spark, SF).collect()}
    quotes = {r.audit_id: r.quote for r in catalog._fuzzy_quotes(spark, SF).collect()}
    assert set(passages) == set(quotes) == set(docs)
    assert all(any(t in line and len(t) == min(20, len(line.strip(" "))) for line in docs[i].split("\n")) for i, t in passages.items())
    assert any(t not in docs[i].split("\n")[0] for i, t in passages.items())
    assert all(len(quotes[i]) == len(t) - (len(t) >= 6) for i, t in passages.items())
    exact = {r.audit_id for r in catalog.QUERIES["tiered_verify"](spark, SF).filter("clause_id like '%_0' and match_tier = 'exact'").collect()}
    assert exact == set(docs)
