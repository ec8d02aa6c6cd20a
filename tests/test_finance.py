from datetime import datetime

import pytest
from pyspark.sql import functions as F

from clausewise.functions import maths, text
from clausewise.operators import benchmark, gate, issues, report, validate
from clausewise.sources import rate_feeds, reference_data as ref


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("x,want", [(-2.5, -2.0), (2.5, 3.0), (-2.51, -3.0), (0.49, 0.0)])
def test_rounding(spark, x, want):
    assert one(spark, maths.half_up(F.lit(x))) == want


@pytest.mark.parametrize("p,r,n,want", [(1200.0, 0.0, 12.0, 100.0), (0.0, 5.0, 12.0, 0.0), (100000.0, 6.0, 360.0, 599.5505), (1000.0, 5.0, 0.0, 0.0), (float("inf"), 5.0, 12.0, 0.0), (1000.0, float("nan"), 12.0, 0.0), (1000.0, 1e9, 1e6, 0.0)])
def test_payment(spark, p, r, n, want):
    df = spark.createDataFrame([(p, r, n)], "p double, r double, n double")
    assert df.select(maths.monthly_payment("p", "r", "n")).first()[0] == pytest.approx(want, abs=1e-3)


def test_interest_delta_is_antisymmetric(spark):
    df = spark.createDataFrame([(250000.0, 5.0, 3.94, 300.0)], "p double, a double, b double, n double")
    x, y = df.select(maths.interest_delta("p", "a", "b", "n"), maths.interest_delta("p", "b", "a", "n")).first()
    assert x == pytest.approx(-y) and x > 0


@pytest.mark.parametrize("dev,cat,want", [(0.0, "fees", "INFO"), (50.0, "fees", "LOW"), (50.01, "fees", "MEDIUM"), (500.0, "fees", "HIGH"), (501.0, "fees", "CRITICAL"), (0.25, "interest_rate", "LOW"), (200.0, "collateral", "MEDIUM"), (1001.0, "unheard of", "CRITICAL")])
def test_severity(spark, dev, cat, want):
    assert one(spark, maths.severity(F.lit(dev), F.lit(cat))) == want


@pytest.mark.parametrize(
    "label,category,want",
    [
        ("interest_rate", "interest_rate", "mortgage_fixed_5yr"),
        (" Interest Rate ", "fees", "mortgage_fixed_5yr"),
        ("prime_rate_spread", "variable_rate_terms", "prime_rate"),
        ("Posted Variable Rate", "other", "mortgage_variable"),
        ("annual_fee", "fees", None),
        ("", "fees", "mortgage_fixed_5yr"),
        ("is", "fees", "savings"),
        ("wear policy", "fees", None),
        ("summer note", "fees", "managed_investing_mer"),
    ],
)
def test_lookup_key(spark, label, category, want):
    assert one(spark, benchmark.lookup_key(F.lit(category), benchmark.lookup_label(F.lit(label)))) == want


@pytest.mark.parametrize("a,b,same", [("percent", "%", True), ("pct", "percent", True), ("Annualized_Percent", "percent", True), ("CAD", "dollars", True), ("CAD", "percent", False), ("months", "months", True), ("km", None, True)])
def test_units(spark, a, b, same):
    assert one(spark, benchmark.unit_compatible(F.lit(a), F.lit(b).cast("string"))) is same


def test_best_rate_prefers_source_then_date(spark):
    rows = [("Bank of Canada | savings", "savings", 9.0, "percent", datetime(2026, 2, 1), None), ("Wealthsimple | savings", "savings", 1.0, "percent", datetime(2020, 1, 1), None),
            ("Wealthsimple | savings", "savings", 2.0, "percent", datetime(2021, 1, 1), None), ("Wealthsimple | savings", "savings", 3.0, "CAD", datetime(2022, 1, 1), None)]
    df = spark.createDataFrame(rows, "source_name string, category string, value double, unit string, as_of timestamp, reference_url string")
    assert benchmark.best_rates(df, ["savings"]).first().rate_value == 2.0


def _audit(spark, rows):
    schema = "audit_id int, pos long, clause_id string, label string, category string, raw_value string, numeric_value double, unit string, summary string, page_no int, verbatim string, confidence double"
    return spark.createDataFrame([(1, i, f"c{i}", *r, "s", 1, "v", conf) for i, (*r, conf) in enumerate(rows)], schema)


def test_one_audit_end_to_end(spark):
    clauses = _audit(
        spark,
        [
            ("principal_amount", "term_conditions", "$100,000", 100000.0, "CAD", 0.9),
            ("term_length", "term_conditions", "5 years", 5.0, "years", 0.9),
            ("interest_rate", "interest_rate", "5.94%", 5.94, "percent", 0.9),
            ("management fee", "fees", "0.4%", 0.4, "percent", 0.9),
            ("prime_rate_spread", "variable_rate_terms", "3%", 3.0, "percent", 0.5),
        ],
    )
    audits = spark.createDataFrame([(1, "MORTGAGE"), (2, "MORTGAGE"), (3, None)], "audit_id int, contract_type string")
    facts = benchmark.audit_facts(audits, clauses)
    f = {r.audit_id: r for r in facts.collect()}
    assert (f[1].term_cmp, f[1].term_cost, f[1].principal_cost) == (None, 60.0, 100000.0) and f[2].n_clauses == 0
    compared = benchmark.comparisons(clauses, audits, ref.rates(spark))
    by_label = {r.label: r for r in compared.collect()}
    assert by_label["interest_rate"].direction == "UNFAVORABLE" and by_label["interest_rate"].term_used == 300.0
    assert by_label["management fee"].direction == "NEUTRAL" and by_label["prime_rate_spread"].direction == "FAVORABLE"
    found = issues.issues(compared)
    ranked = [(r.label, r.severity) for r in issues.in_report_order(found).collect()]
    assert ranked == [("interest_rate", "CRITICAL"), ("prime_rate_spread", "INFO")]
    items = issues.cost_items(found, facts)
    cost = {r.audit_id: r for r in issues.cost_of_loyalty(items, facts).collect()}
    total = sum(r.amount for r in items.collect())
    assert cost[1].total_cost == pytest.approx(total, abs=0.5) and cost[1].low == pytest.approx(total * 0.85, abs=0.5)
    assert cost[2].total_cost == 0 and cost[2].term_months == 60.0
    scores = {r.audit_id: r.risk_score for r in issues.risk_scores(audits, found).collect()}
    assert scores == {1: 45, 2: 0, 3: 0}
    assert [r.audit_id for r in benchmark.no_type_warnings(audits).collect()] == [3]


def test_wording(spark):
    assert one(spark, issues.issue_title(F.lit("late_payment fee"), F.lit("UNFAVORABLE"))) == "Above-Market Late Payment Fee"
    assert one(spark, issues.issue_title(F.lit("x-ray_fee"), F.lit("NEUTRAL"))) == "X-Ray Fee — Review Recommended"
    assert one(spark, text.money(F.lit(-1234.56))) == "$1,235 CAD"
    assert one(spark, text.value_with_unit(F.lit(4.99), F.lit("percent"))) == "4.99%"
    assert one(spark, text.cell_delta(F.lit(-1.5), F.lit("CAD"))) == "-$2"
    assert one(spark, text.cell_delta(F.lit(0.5), F.lit("percent"))) == "+0.50 pp"
    assert one(spark, text.cell_money(F.lit(None).cast("double"))) == "$0 CAD"
    assert one(spark, text.strip_html(F.lit("<p>a</p><SCRIPT>x</script>  <b>b</b>"))) == "a b"


def test_validation_reports_every_failure(spark):
    clauses = _audit(spark, [("interest_rate", "interest_rate", "31%", 31.0, "percent", 0.9), ("rate_type", "interest_rate", "5 fixed", None, None, 0.2), ("term_length", "term_conditions", "x", 601.0, "months", 0.9)])
    clauses = clauses.withColumn("verbatim", F.when(F.col("pos") == 1, "  ").otherwise(F.col("verbatim")))
    got = {r.pos: (len(r.failures), r.confidence) for r in validate.validate(clauses).collect()}
    assert got == {0: (1, 0.3), 1: (2, 0.2), 2: (1, 0.3)}


def test_gate_bands_and_idempotence(spark):
    found = spark.createDataFrame([("i1", 0.9, "t", "LOW", 1), ("i2", 0.6, "t", "LOW", 1), ("i3", 0.9, "t", "LOW", 1), ("i4", 0.7, "t", "LOW", 1), ("i5", 0.5, "t", "LOW", 1)], "issue_id string, confidence double, title string, severity string, audit_id int")
    links = spark.createDataFrame([("i1", "c1", 0.9), ("i2", "c1", 0.9), ("i3", "c2", 0.9), ("i3", "gone", 0.1), ("i4", "c1", 0.1)], "issue_id string, clause_id string, snapshot double")
    clauses = spark.createDataFrame([("c1", 0.8), ("c2", 0.45)], "clause_id string, confidence double")
    gated = gate.gate_issues(gate.adjusted_confidence(found, links, clauses))
    got = {r.issue_id: (r.adjusted, r.gate) for r in gated.collect()}
    assert got == {"i1": (0.8, "passed"), "i2": (0.6, "suppressed"), "i3": (0.1, "demoted"), "i4": (0.7, "passed"), "i5": (0.5, "suppressed")}
    again = gate.gate_issues(gated.drop("gate"))
    assert {r.issue_id: r.gate for r in again.collect()} == {k: v[1] for k, v in got.items()}
    assert "adjusted confidence 0.100 fell" in gate.demotion_warnings(gated).first().message


def test_upsert_is_idempotent(spark):
    seed = ref.rates(spark)
    assert seed.count() == 15 and ref.templates(spark).count() == 98
    once = rate_feeds.upsert(seed, seed.withColumn("value", F.col("value") + 1))
    twice = rate_feeds.upsert(once, seed.withColumn("value", F.col("value") + 1))
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect())) and once.count() == 15
    assert rate_feeds.stale(seed, datetime(2026, 3, 5)).count() == 1
    audits = spark.createDataFrame([(1,), (2,)], "audit_id int")
    assert [r.message[:1] for r in rate_feeds.stale_warnings(audits, seed, datetime(2026, 3, 5)).collect()] == ["1", "1"]
    assert rate_feeds.stale_warnings(audits, seed, datetime(2026, 3, 1)).count() == 0


def test_bands(spark):
    got = spark.createDataFrame([(70,), (40,), (39,), (None,)], "s int").select(report.risk_band(F.col("s"))).collect()
    assert [r[0] for r in got] == ["high", "elevated", "low", None]
