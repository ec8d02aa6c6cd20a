"""What the queries of large tables move: rows dealt once, clauses read once."""

import pytest
from pyspark.sql import functions as F

from clausewise.functions import spans, text
from clausewise.operators import cite, extract
from clausewise.plans import catalog
from clausewise.sources import results, sample_tables

SF = "/root/testdata/sf0.001"


def test_append_deals_incoming_rows_once(spark):
    """The removal of repeats follows the look-up in the same tasks: no sort or aggregate runs before the rows are dealt."""
    incoming = spark.range(100).selectExpr("cast(id % 60 as string) as k", "cast(id as string) as v")
    stored = spark.range(30).selectExpr("cast(id as string) as k", "'old' as v")
    out = results.append_if_absent(stored, incoming, ["k"])
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.rindex("Aggregate") < plan.index("Exchange" if "Exchange" in plan else "RepartitionByExpression")
    rows = out.collect()
    assert sorted(int(r.k) for r in rows) == list(range(30, 60)) and all(int(r.v) % 60 == int(r.k) for r in rows)
    assert {r.k for r in results.append_if_absent(None, incoming, ["k"]).collect()} == {str(i) for i in range(60)}


@pytest.mark.parametrize("name", ["stored_results", "audit_nested", "category_rollup"])
def test_clauses_are_read_once(spark, monkeypatch, name):
    read = []
    whole = sample_tables.clauses
    monkeypatch.setattr(sample_tables, "clauses", lambda s, d: read.append(d) or whole(s, d))
    monkeypatch.setattr(results, "save_results", lambda *a: None)
    try:
        catalog.QUERIES[name](spark, SF)
    except Exception as e:  # the tables that save_results would have written are absent
        assert name == "stored_results" and "PATH_NOT_FOUND" in str(e)
    assert len(read) == 1


def test_rollup_moves_no_texts(spark):
    plan = catalog.QUERIES["category_rollup"](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert "max_by" not in plan and "title" not in plan


def test_replies_to_pieces_are_read_once(spark):
    """Both sides of the comparison with the piece before would else cut the texts and read the replies again."""
    call = "named_struct('name', 'extract_interest_rate', 'arguments', '{\"rawValue\": \"5%\", \"charOffsetStart\": 3, \"charOffsetEnd\": 5}')"
    replies = spark.range(1).selectExpr("id as audit_id", "explode(array(0L, 1L)) as piece_no", f"array({call}) as calls").selectExpr("*", "piece_no * 100 as piece_start")
    got = extract.clauses_from_replies(replies, spark.range(1).selectExpr("id as audit_id", "'MORTGAGE' as contract_type"))
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.off_start for r in got.select("source.off_start").collect()) == [3, 103]


def test_summary_requests_write_only_what_they_use(spark, monkeypatch):
    """Passages, details and names of issues went to disk and back with every clause."""
    written = []
    real = catalog.materialise
    monkeypatch.setattr(catalog, "materialise", lambda df: (written.extend(df.columns), real(df))[1])
    assert catalog.QUERIES["summary_requests"](spark, SF).columns == ["audit_id", "n_lines", "digest"]
    assert written and not {"verbatim", "summary", "clause_id", "issue_id", "detail", "tags"} & set(written)


def test_plain_numbers_without_a_format(spark):
    """The digits are those of a format with six places, for numbers of all sizes; no such call is made for them."""
    values = [0.5, -0.5, 1e-7, -1e-7, 5e-7, 1e-6, 0.1234565, 2.675, 100.10, -3.000001, 12345678.9, 7.0, -0.0, 4503599627370495.5, float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values + [k / 700 for k in range(-400, 900)]], "x double")
    whole = F.floor("x").cast("bigint").cast("string")
    formed = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", "x"), r"\.?0+$", ""), "^-0$", "0")
    both = df.select("x", text.plain_number(F.col("x")).alias("got"), F.when(F.col("x") == F.floor("x"), whole).otherwise(formed).alias("wanted"))
    assert both.filter(~F.col("got").eqNullSafe(F.col("wanted"))).collect() == []
    assert "regexp" not in str(text.plain_number(F.col("x")))


def test_a_text_is_cut_once_for_all_its_stretches(spark):
    """Long pages were cut again for every 128 of their pieces, and for each of the two offsets of a quote."""
    n = 20_000
    page = spark.createDataFrame([(1, 1, "  ".join(f"w{i}" for i in range(n)))], "audit_id long, page_no int, text string")
    plan = page.select(spans.find(F.col("text"), text.WORD).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    quotes = spark.createDataFrame([(1, f"w{n - 3}x w{n - 2} w{n - 1}")], "audit_id long, quote string")
    got = cite.anchor_fuzzy(quotes, page)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert got.first().matched == f"w{n - 3}  w{n - 2}  w{n - 1}"


def test_a_search_for_nothing_reads_no_page(spark):
    """All pages were normalised, cut and joined where every quote had an exact place already."""
    pages = spark.range(5).selectExpr("id as audit_id", "1 as page_no", "'some text' as text")
    quotes = spark.createDataFrame([(1, " ")], "audit_id long, quote string")
    got = cite.anchor_fuzzy(quotes, pages)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan and "Join" not in plan
    assert got.columns[:3] == ["audit_id", "q", "page_no"] and got.collect() == []
