"""SQL twins of the registered queries, for DuckDB over the same parquet tables."""

from __future__ import annotations

from clausewise.operators import pii
from clausewise.sources import reference_data as ref

ORACLES: dict[str, str] = {}


def _list(items) -> str:
    return "[" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in items) + "]"


def _case(key: str, table: dict, other: str = "NULL") -> str:
    def lit(v):
        return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    return "CASE " + " ".join(f"WHEN {key} = {lit(k)} THEN {lit(v)}" for k, v in table.items()) + f" ELSE {other} END"


# --- shared views -----------------------------------------------------------------------------------------

TWO = "(({0}) // 100)::VARCHAR || '.' || lpad((({0}) % 100)::VARCHAR, 2, '0')"
LABELS = ["interest_rate", "term_length", "prime_rate_spread", "management fee", "annual_fee", "Posted Variable Rate", "rate_type"]
CATEGORIES = ["interest_rate", "term_conditions", "variable_rate_terms", "fees", "fees", "variable_rate_terms", "interest_rate"]

AUDITS = f"""audits AS (
  SELECT o_orderkey AS audit_id, o_custkey AS owner_id, o_orderdate::TIMESTAMP AS created_at,
         ({_list(ref.CONTRACT_TYPES)})[(o_orderkey % 9 + 1)::INT] AS contract_type,
         CASE o_orderstatus WHEN 'F' THEN 'COMPLETE' WHEN 'O' THEN 'FAILED' ELSE 'EXTRACTING' END AS status FROM orders)"""

CLAUSES = f"""line_parts AS (
  SELECT *, floor(l_discount * 100 + 0.5)::BIGINT AS disc, floor(l_tax * 100 + 0.5)::BIGINT AS tax,
         l_quantity::BIGINT AS qty, floor(l_extendedprice * 100 + 0.5)::BIGINT AS price FROM lineitem),
line_values AS (
  SELECT *, CASE WHEN l_linenumber IN (1, 3, 6) THEN disc * 100 + qty
                 WHEN l_linenumber = 2 THEN CASE WHEN l_returnflag = 'R' THEN qty * 100 ELSE qty * 1200 END
                 WHEN l_linenumber = 4 THEN disc * 10 WHEN l_linenumber = 5 THEN price // 100 END AS cents,
         CASE WHEN l_linenumber IN (1, 3, 4, 6) THEN 'percent' WHEN l_linenumber = 2 AND l_returnflag = 'R' THEN 'years'
              WHEN l_linenumber = 2 THEN 'months' WHEN l_linenumber = 5 THEN 'CAD' END AS unit,
         l_linenumber::BIGINT * 1152921504606846976 + ('0x' || substr(md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, qty, price, disc, tax)), 1, 15))::BIGINT AS pos,
         ({_list(LABELS)})[l_linenumber] AS label, ({_list(CATEGORIES)})[l_linenumber] AS category FROM line_parts),
line_raw AS (
  SELECT *, CASE WHEN l_linenumber IN (1, 3, 4, 6) THEN {TWO.format('cents')} || '%' WHEN l_linenumber = 2 THEN (cents // 100)::VARCHAR || ' ' || unit
                 WHEN l_linenumber = 5 THEN '$' || {TWO.format('cents')} WHEN l_returnflag = 'A' THEN 'fixed for ' || qty ELSE 'fixed' END AS raw_value FROM line_values),
principal_raw AS (
  SELECT o_orderkey AS k, floor(o_totalprice * 100 + 0.5)::BIGINT AS cents FROM orders WHERE o_orderstatus IN ('F', 'O')),
clauses AS (
  SELECT l_orderkey AS audit_id, pos, 'c' || l_orderkey || '_' || pos AS clause_id, label, category, raw_value, cents / 100.0 AS numeric_value, unit,
         'Your ' || replace(label, '_', ' ') || ' is ' || raw_value || '.' AS summary, (l_suppkey % 12)::INT AS page_no,
         CASE WHEN tax = 8 THEN '  ' WHEN tax = 7 THEN 'The ' || replace(label, '_', ' ') || ' is as posted.'
              ELSE 'The ' || replace(label, '_', ' ') || ' is ' || raw_value || ' here.' END AS verbatim,
         1.0::DOUBLE - (tax * 8)::DOUBLE / 100.0::DOUBLE AS confidence FROM line_raw
  UNION ALL
  SELECT k, 0, 'c' || k || '_0', 'principal_amount', 'term_conditions', '$' || {TWO.format('cents')}, cents / 100.0, 'CAD',
         'You borrow $' || {TWO.format('cents')} || '.', 1, 'The principal amount is $' || {TWO.format('cents')} || ' here.', 0.95::DOUBLE FROM principal_raw)"""


def _key(category: str, label: str) -> str:
    text = f"lower(trim({label}))"
    near = " ".join(f"WHEN contains({text}, '{k}') OR contains('{k}', {text}) THEN '{v}'" for k, v in ref.LABEL_KEYS.items())
    return f"coalesce({_case(text, ref.LABEL_KEYS)}, CASE {near} END, {_case(category, ref.CATEGORY_KEYS)})"


BEST = {}
for source, category, value, as_of, url in ref.RATES:
    BEST[category] = (f"{source} | {category}", value, as_of, url)
RATE_ROWS = ", ".join(f"('{c}', '{n}', {v}::DOUBLE, '{t}T00:00:00Z', '{u}')" for c, (n, v, t, u) in BEST.items())

DELTAS = f"""keyed AS (SELECT *, {_key('category', 'label')} AS rate_key FROM clauses WHERE numeric_value IS NOT NULL),
deltas AS (
  SELECT k.*, rate_value, source_name, as_of, url, numeric_value - rate_value AS gap,
         floor((numeric_value - rate_value) * 100 + 0.5) / 100 AS delta, floor((numeric_value - rate_value) / rate_value * 100 * 100 + 0.5) / 100 AS delta_percent,
         CASE WHEN numeric_value - rate_value > 0.001 THEN 'UNFAVORABLE' WHEN numeric_value - rate_value < -0.001 THEN 'FAVORABLE' ELSE 'NEUTRAL' END AS direction
  FROM keyed k JOIN (VALUES {RATE_ROWS}) r(rate_key, source_name, rate_value, as_of, url) USING (rate_key))"""


def _severity(x: str) -> str:
    def limit(i):
        return _case("category", {k: float(v[i]) for k, v in ref.SEVERITY_THRESHOLDS.items() if k != "other"}, str(float(ref.SEVERITY_THRESHOLDS["other"][i])))

    return f"CASE WHEN {x} <= 0 THEN 'INFO' WHEN {x} <= {limit(0)} THEN 'LOW' WHEN {x} <= {limit(1)} THEN 'MEDIUM' WHEN {x} <= {limit(2)} THEN 'HIGH' ELSE 'CRITICAL' END"


def _words_up(x: str) -> str:
    return f"array_to_string(list_transform(string_split(replace({x}, '_', ' '), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ')"


GRADED = f"""graded AS (
  SELECT *, CASE WHEN direction = 'FAVORABLE' THEN 'INFO' ELSE {_severity('delta_percent')} END AS severity,
         CASE WHEN direction = 'UNFAVORABLE' THEN 'Above-Market ' || {_words_up('label')} ELSE 'Below-Market ' || {_words_up('label')} || ' (In Your Favour)' END AS title,
         'issue_' || clause_id AS issue_id FROM deltas WHERE direction <> 'NEUTRAL'),
ranked AS (SELECT *, {_case('severity', ref.SEVERITY_RANK)} AS severity_rank FROM graded)"""

FACTS = f"""facts AS (
  SELECT audit_id, contract_type, count(clause_id) AS n_clauses,
    arg_min(numeric_value, pos) FILTER (label IN ('term_length', 'amortization_period', 'lease_term', 'policy_term', 'lock_up_period') AND numeric_value IS NOT NULL AND unit = 'months') AS term_cmp,
    arg_min(CASE WHEN unit = 'years' THEN numeric_value * 12 ELSE numeric_value END, pos) FILTER (label IN ('term_length', 'amortization_period', 'lease_term', 'policy_term', 'lock_up_period') AND numeric_value IS NOT NULL) AS term_cost,
    arg_min(numeric_value, pos) FILTER (label = 'principal_amount' AND numeric_value IS NOT NULL) AS principal_cmp,
    arg_min(numeric_value, pos) FILTER (label IN ('principal_amount', 'capitalized_cost') AND numeric_value IS NOT NULL) AS principal_cost
  FROM audits LEFT JOIN clauses USING (audit_id) GROUP BY ALL),
facts_used AS (SELECT *, coalesce(term_cmp, {_case('contract_type', {k: float(v) for k, v in ref.DEFAULT_TERM_MONTHS.items()}, '60.0')}) AS term_used FROM facts)"""


def _pay(p, r, n):
    return f"CASE WHEN {p} <= 0 OR {n} <= 0 THEN 0 WHEN {r} = 0 THEN {p} / {n} ELSE {p} * ({r} / 1200.0 * pow(1 + {r} / 1200.0, {n})) / (pow(1 + {r} / 1200.0, {n}) - 1) END"


def _interest(p, r, n):
    return f"CASE WHEN {p} <= 0 OR {n} <= 0 THEN 0 ELSE greatest(0, ({_pay(p, r, n)}) * {n} - {p}) END"


def _extra(p, a, b, n):
    return f"(({_interest(p, a, n)}) - ({_interest(p, b, n)}))"


def _grown(p, r, n, growth):
    """Interest over all payments, from the growth of 1 over ``n`` months."""
    return f"CASE WHEN {p} <= 0 OR {n} <= 0 THEN 0 ELSE greatest(0, CASE WHEN {r} = 0 THEN {p} ELSE {p} * ({r} / 1200.0 * {growth}) / ({growth} - 1) * {n} END - {p}) END"


COMPARED = f"""terms AS MATERIALIZED (
  SELECT d.*, term_used, coalesce(principal_cmp, 500000.0) AS p, principal_cost, coalesce(term_cost, 60.0) AS n,
         pow(1 + numeric_value / 1200.0, term_used) AS g, pow(1 + rate_value / 1200.0, term_used) AS h, pow(1 + numeric_value / 1200.0, coalesce(term_cost, 60.0)) AS g2, pow(1 + rate_value / 1200.0, coalesce(term_cost, 60.0)) AS h2
  FROM deltas d JOIN facts_used USING (audit_id)),
compared AS (
  SELECT *, floor(abs(({_grown('p', 'numeric_value', 'term_used', 'g')}) - ({_grown('p', 'rate_value', 'term_used', 'h')})) + 0.5) AS impact FROM terms)"""
COMPARED_GRADED = f"""compared_graded AS (
  SELECT *, CASE WHEN direction = 'FAVORABLE' THEN 'INFO' ELSE {_severity('delta_percent')} END AS severity,
         CASE WHEN direction = 'UNFAVORABLE' THEN 'Above-Market ' || {_words_up('label')} ELSE 'Below-Market ' || {_words_up('label')} || ' (In Your Favour)' END AS title
  FROM compared WHERE direction <> 'NEUTRAL')"""

PCT = "regexp_replace(regexp_replace(printf('%.6f', {0}::DOUBLE), '0+$', ''), '\\.$', '') || '%'"
DESCRIBED = f"""described AS (
  SELECT *, CASE WHEN direction = 'UNFAVORABLE' THEN 'Your contract''s ' || replace(label, '_', ' ') || ' is ' || {PCT.format('numeric_value')} || ', compared to the market benchmark of '
        || {PCT.format('rate_value')} || ' (' || source_name || '). This is ' || {PCT.format('abs(delta)')} || ' above market, which may result in higher costs over the life of the contract.'
      ELSE 'Your contract''s ' || replace(label, '_', ' ') || ' is ' || {PCT.format('numeric_value')} || ', which is ' || {PCT.format('abs(delta)')} || ' below the market benchmark of '
        || {PCT.format('rate_value')} || ' (' || source_name || '). This term is in your favour.' END AS description FROM compared_graded)"""

ITEMS = f"""items AS (
  SELECT audit_id, pos, title AS item, CASE WHEN principal_cost IS NOT NULL THEN ({_grown('principal_cost', 'numeric_value', 'n', 'g2')}) - ({_grown('principal_cost', 'rate_value', 'n', 'h2')}) ELSE impact END AS amount
  FROM compared_graded WHERE direction = 'UNFAVORABLE')"""

SCORES = f"""scores AS (
  SELECT a.*, least(100, floor(round(coalesce(raw, 0), 9) + 0.5))::BIGINT AS risk_score, coalesce(n_issues, 0) AS n_issues, coalesce(n_critical, 0) AS n_critical, coalesce(n_high, 0) AS n_high, coalesce(n_medium, 0) AS n_medium
  FROM audits a LEFT JOIN (SELECT audit_id, sum({_case('severity', ref.SEVERITY_WEIGHT)} * confidence) AS raw, count(*) AS n_issues, count(*) FILTER (severity = 'CRITICAL') AS n_critical,
    count(*) FILTER (severity = 'HIGH') AS n_high, count(*) FILTER (severity = 'MEDIUM') AS n_medium FROM graded GROUP BY audit_id) USING (audit_id))"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


BASE = (AUDITS, CLAUSES)
SCORED = _with(*BASE, DELTAS, GRADED, SCORES)
FULL = _with(*BASE, DELTAS, FACTS, COMPARED, COMPARED_GRADED, DESCRIBED, ITEMS)
TOLD = _with(*BASE, DELTAS, FACTS, COMPARED, COMPARED_GRADED, DESCRIBED)
CL = _with(CLAUSES)

# --- comparison, issues, cost, score ----------------------------------------------------------------------

ORACLES["risk_score"] = SCORED + "SELECT audit_id, contract_type, risk_score, n_issues, n_critical, n_high, n_medium FROM scores"
CATS = [r[1] for r in ref.RATES]
HISTORY = f"""history0 AS (
  SELECT *, ({_list(CATS)})[(p_partkey % 15 + 1)::INT] AS category, ({_list([ref.RETAIL, ref.CENTRAL_BANK, 'Historical Average', 'Survey'])})[((p_partkey // 15) % 4 + 1)::INT] AS src,
         (['percent', '%', 'pct', 'CAD'])[(p_size % 4 + 1)::INT] AS unit FROM part),
history AS (
  SELECT src, CASE WHEN p_partkey % 7 = 0 THEN src || ' ' || category ELSE src || ' | ' || category END AS source_name, category, floor(p_retailprice * 100 + 0.5) / 10000 AS value, unit,
         make_timestamp((1767225600 + p_size * 86400)::BIGINT * 1000000) AS as_of, 'https://rates.example/' || p_partkey AS reference_url, p_partkey AS load_seq, p_partkey % 7 = 0 AS bare FROM history0)"""
ORACLES["rate_best_candidate"] = _with(HISTORY) + f"""SELECT rate_key, source_name, CASE WHEN bare THEN source_name ELSE src END AS prefix, as_of FROM (
  SELECT w.rate_key, h.*, row_number() OVER (PARTITION BY w.rate_key ORDER BY CASE WHEN bare THEN 99 ELSE {_case('src', ref.SOURCE_PRIORITY, '99')} END, as_of DESC, source_name) AS rn
  FROM history h JOIN (SELECT unnest({_list(CATS)}) AS rate_key) w ON (CASE WHEN bare THEN contains(lower(source_name), w.rate_key) ELSE h.category = w.rate_key END) WHERE unit <> 'CAD') WHERE rn = 1"""
ORACLES["lookup_key_resolution"] = CL + f""", both_labels AS (SELECT label, category FROM clauses UNION ALL SELECT p_name || ' ' || p_type, 'fees' FROM part)
SELECT label, category, {_key('category', 'label')} AS rate_key, {_key('category', "replace(label, '_', ' ')")} AS rate_key_clean, count(*) AS n FROM both_labels GROUP BY ALL"""
ORACLES["clause_comparison"] = _with(*BASE, DELTAS, FACTS, COMPARED) + "SELECT audit_id, clause_id, rate_key, rate_value, delta, delta_percent, direction, impact, term_used, unit <> 'percent' AS unit_mismatch FROM compared"
ORACLES["amortisation"] = f"""WITH o AS (SELECT o_orderkey AS audit_id, o_totalprice AS p, (o_orderkey % 13) * 0.5::DOUBLE AS ra, (o_orderkey % 11) * 0.7::DOUBLE AS rb, ((o_orderkey % 7) * 60)::DOUBLE AS n FROM orders)
SELECT audit_id, floor(({_pay('p', 'ra', 'n')}) * 100 + 0.5) / 100 AS payment, floor(({_interest('p', 'ra', 'n')}) * 100 + 0.5) / 100 AS interest, floor({_extra('p', 'ra', 'rb', 'n')} * 100 + 0.5) / 100 AS extra FROM o"""
ORACLES["term_and_principal"] = _with(*BASE, FACTS) + "SELECT audit_id, n_clauses, term_cmp, term_cost, principal_cmp, principal_cost, term_used FROM facts_used"
ORACLES["cost_of_loyalty"] = FULL + """SELECT audit_id, floor(t + 0.5) AS total_cost, floor(t - t * 0.15 + 0.5) AS low, floor(t + 0.5) AS mid, floor(t + t * 0.15 + 0.5) AS high, n_items, coalesce(term_cost, 60.0) AS term_months,
  CASE WHEN principal_cost <> 0 THEN 4 ELSE 3 END::BIGINT AS n_assumptions FROM (SELECT f.*, coalesce(t0, 0) AS t, coalesce(n0, 0) AS n_items FROM facts f LEFT JOIN (SELECT audit_id, sum(amount) AS t0, count(*) AS n0 FROM items GROUP BY 1) USING (audit_id))"""
ORACLES["cost_breakdown"] = _with(*BASE, DELTAS, FACTS, COMPARED, COMPARED_GRADED, ITEMS) + "SELECT audit_id, pos, item, floor(amount * 10 + 0.5) / 10 AS amount FROM items"
ORACLES["severity_matrix"] = _with(CLAUSES, DELTAS) + f"SELECT category, {_severity('delta_percent')} AS by_percent, {_severity('delta')} AS by_points, count(*) AS n FROM deltas WHERE direction = 'UNFAVORABLE' GROUP BY ALL"
ORACLES["issue_titles"] = TOLD + """SELECT 'issue_' || clause_id AS issue_id, severity, title, description, category || '|' || lower(severity) || '|' || lower(direction) || '|' || label AS tags,
  CASE WHEN direction = 'UNFAVORABLE' AND impact > 0 THEN impact END AS lifetime_cost FROM described"""
ORACLES["issue_details"] = TOLD + """SELECT 'issue_' || clause_id AS issue_id, summary || ' The clause was extracted from page ' || page_no || ' of the document with ' || floor(confidence * 100 + 0.5)::BIGINT
  || '% extraction confidence. Benchmark data sourced from ' || source_name || ' (as of ' || as_of || '). Reference: ' || url || '.' AS detail FROM described"""
ORACLES["fallback_summaries"] = SCORED + """SELECT audit_id, 'This ' || replace(contract_type, '_', ' ') || ' contract was analysed. ' || n_issues || ' issue(s) were identified (' || n_critical || ' critical, ' || n_high
  || ' high severity). Risk score: ' || risk_score || '/100. Please review the detailed findings below.' AS summary FROM scores"""
ORACLES["written_summaries"] = f"""SELECT f.audit_id, CASE WHEN o_orderkey % 4 >= 2 THEN 'Order ' || o_orderkey || ': ' || o_orderpriority ELSE summary END AS summary
  FROM ({ORACLES['fallback_summaries']}) f JOIN orders ON o_orderkey = f.audit_id"""
ORACLES["summary_warnings"] = """SELECT o_orderkey AS audit_id, 'SYNTHESIZE_LLM_ERROR' AS code, 'The summary could not be written (timeout ' || o_orderkey || '); the fallback is shown' AS message, TRUE AS recoverable, 'CITING' AS stage
  FROM orders WHERE o_orderkey % 4 = 1"""
NUM = "regexp_replace(regexp_replace(printf('%.6f', {0}::DOUBLE), '0+$', ''), '\\.$', '')"
ORACLES["summary_requests"] = FULL + f""", c15 AS (SELECT audit_id, string_agg('- ' || replace(label, '_', ' ') || ': ' || raw_value || CASE WHEN numeric_value IS NOT NULL THEN ' (' || {NUM.format('numeric_value')} || ' ' || coalesce(unit, '') || ')' ELSE '' END, chr(10) ORDER BY pos) AS t
  FROM (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY pos) AS rn FROM clauses WHERE confidence >= 0.6) WHERE rn <= 15 GROUP BY 1),
i10 AS (SELECT audit_id, string_agg('- [' || severity || '] ' || title || ': ' || description, chr(10) ORDER BY rn) AS t FROM (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY {_case('severity', ref.SEVERITY_RANK)} DESC, pos) AS rn FROM described) WHERE rn <= 10 GROUP BY 1),
n_all AS (SELECT audit_id, count(*) AS n FROM described GROUP BY 1), totals AS (SELECT audit_id, sum(amount) AS t FROM items GROUP BY 1),
asked AS (SELECT f.audit_id, 'Contract type: ' || replace(contract_type, '_', ' ') || chr(10) || 'Key clauses extracted:' || chr(10) || coalesce(c15.t, '(none extracted)') || chr(10) || 'Issues found (' || coalesce(n, 0) || ' total):' || chr(10)
  || coalesce(i10.t, '(none found)') || chr(10) || 'Estimated cost of staying with this contract: $' || format('{{:,}}', floor(coalesce(totals.t, 0) + 0.5)::BIGINT) || ' CAD over ' || {NUM.format('coalesce(term_cost, 60.0)')} || ' months' || chr(10) || 'Write the executive summary now:' AS request
  FROM facts f LEFT JOIN c15 USING (audit_id) LEFT JOIN i10 USING (audit_id) LEFT JOIN n_all USING (audit_id) LEFT JOIN totals USING (audit_id))
SELECT audit_id, len(string_split(request, chr(10)))::BIGINT AS n_lines, md5(request) AS digest FROM asked"""

# --- validation, checks, gates ----------------------------------------------------------------------------

FAILURES = """fails AS (SELECT *, list_filter([
  CASE WHEN label = 'interest_rate' AND (numeric_value < 0 OR numeric_value > 30) THEN 'Interest rate outside plausible range (0-30%)' END,
  CASE WHEN label = 'principal_amount' AND numeric_value < 100 THEN 'Principal amount implausibly low (< $100)' END,
  CASE WHEN label IN ('term_length', 'amortization_period', 'lease_term') AND unit = 'months' AND numeric_value > 600 THEN 'Term exceeds 50 years — likely extraction error' END,
  CASE WHEN label = 'monthly_payment' AND numeric_value < 0 THEN 'Negative payment amount' END,
  CASE WHEN label = 'mileage_allowance' AND unit = 'km' AND numeric_value > 200000 THEN 'Annual mileage allowance exceeds 200,000 km' END,
  CASE WHEN trim(verbatim) = '' THEN 'Empty verbatim text — extraction likely failed' END,
  CASE WHEN numeric_value IS NULL AND regexp_matches(raw_value, '[0-9]') THEN 'rawValue contains digits but numericValue is null — parsing may have failed' END], lambda x: x IS NOT NULL) AS f FROM clauses)"""
ORACLES["clause_validation"] = _with(CLAUSES, FAILURES) + "SELECT clause_id, array_to_string(f, '; ') AS failures, least(confidence, 0.3) AS confidence FROM fails WHERE len(f) > 0"
ORACLES["validation_warnings"] = _with(CLAUSES, FAILURES) + """SELECT audit_id, 'VALIDATE_CLAUSE_FAILED' AS code, 'Clause "' || label || '" (id: ' || clause_id || ') failed validation: ' || reason AS message, true AS recoverable, 'EXTRACTING' AS stage
  FROM (SELECT audit_id, label, clause_id, unnest(f) AS reason FROM fails)"""
CONTRA = "contra AS (SELECT audit_id, clause_id FROM clauses a WHERE EXISTS (SELECT 1 FROM clauses b WHERE a.audit_id = b.audit_id AND a.label = b.label AND abs(a.numeric_value - b.numeric_value) / nullif(greatest(abs(a.numeric_value), abs(b.numeric_value)), 0) > 0.01))"
DRIFT = """drift AS (SELECT audit_id, clause_id FROM clauses WHERE numeric_value IS NOT NULL AND len(list_filter(list_transform(regexp_extract_all(verbatim, '[\\d,]+\\.?\\d*'), lambda s: try_cast(replace(s, ',', '') AS DOUBLE)),
  lambda n: CASE WHEN numeric_value = 0 THEN n = 0 ELSE abs(n - numeric_value) / abs(numeric_value) <= 0.01 END)) = 0)"""
PAGES = "page_rows AS (SELECT doc_id AS audit_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS page_no FROM documents)"
GHOST = "ghosts AS (SELECT c.audit_id, clause_id, c.page_no, coalesce(n, 0) AS n FROM clauses c LEFT JOIN (SELECT audit_id, count(*) AS n FROM page_rows GROUP BY 1) USING (audit_id) WHERE c.page_no < 1 OR c.page_no > coalesce(n, 0))"
ORACLES["self_contradiction"] = _with(CLAUSES, CONTRA) + "SELECT audit_id, clause_id, 'SELF_CONTRADICTION' AS check_name FROM contra"
ORACLES["numeric_drift"] = _with(CLAUSES, DRIFT) + "SELECT audit_id, clause_id, 'NUMERIC_DRIFT' AS check_name FROM drift"
ORACLES["ghost_pages"] = _with(CLAUSES, PAGES, GHOST) + "SELECT audit_id, clause_id, 'source.pageNumber ' || page_no || ' exceeds actual document page count (' || n || ' pages)' AS reason FROM ghosts"
ORACLES["hallucination_report"] = _with(CLAUSES, CONTRA, DRIFT, PAGES, GHOST) + """SELECT audit_id, count(*) AS total_flags, count(DISTINCT clause_id) AS n_flagged_clauses, count(*) FILTER (c = 1) AS numeric_drift, count(*) FILTER (c = 2) AS ghost_page,
  count(*) FILTER (c = 3) AS self_contradiction, count(*) FILTER (c = 4) AS empty_verbatim FROM (SELECT audit_id, clause_id, 1 AS c FROM drift UNION ALL SELECT audit_id, clause_id, 2 FROM ghosts
  UNION ALL SELECT audit_id, clause_id, 3 FROM contra UNION ALL SELECT audit_id, clause_id, 4 FROM clauses WHERE trim(verbatim) = '') GROUP BY 1"""
FACTOR = "CASE page_no % 4 WHEN 0 THEN 0.4::DOUBLE WHEN 1 THEN 1.0 WHEN 2 THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END"
GATED = f"""gated AS (SELECT *, least(confidence, 1.0, confidence * {FACTOR}) AS adjusted FROM graded)"""
GATE = _with(CLAUSES, DELTAS, GRADED, GATED)
ORACLES["confidence_gate"] = GATE + "SELECT issue_id, floor(adjusted * 1000000 + 0.5) / 1000000 AS adjusted, CASE WHEN adjusted >= 0.7 THEN 'passed' WHEN adjusted < 0.5 THEN 'demoted' ELSE 'suppressed' END AS gate FROM gated"
ORACLES["demotion_warnings"] = GATE + """SELECT audit_id, 'L5_CONFIDENCE_DEMOTION' AS code, 'Issue "' || title || '" (issueId: ' || issue_id || ', severity: ' || severity || ') was demoted from AuditIssue to AuditWarning — adjusted confidence fell below warningThreshold 0.5' AS message FROM gated WHERE adjusted < 0.5"""
ORACLES["clause_gate"] = CL + f"SELECT category, count(*) AS n FROM clauses WHERE confidence * {FACTOR} >= 0.6 GROUP BY 1"

# --- report and results -----------------------------------------------------------------------------------

RANKED = _with(*BASE, DELTAS, GRADED)
ORACLES["worst_issue"] = RANKED + """SELECT clause_id, issue_id, severity, severity_rank::BIGINT AS severity_rank FROM (SELECT l.clause_id, r.issue_id, severity, severity_rank, row_number() OVER (PARTITION BY l.clause_id ORDER BY severity_rank DESC, pos) AS rn
  FROM (SELECT issue_id, clause_id FROM ranked UNION ALL SELECT issue_id, 'c' || audit_id || '_0' FROM ranked) l JOIN ranked r ON l.issue_id = r.issue_id) WHERE rn = 1"""
ORACLES["category_rollup"] = RANKED + f"""SELECT audit_id, category, {_words_up('category')} AS category_name, n_clauses, {_case('r', {v: k for k, v in ref.SEVERITY_RANK.items()})} AS highest_severity, coalesce(r >= 3, false) AS expanded
  FROM (SELECT c.audit_id, c.category, count(*) AS n_clauses, max(severity_rank) AS r FROM clauses c LEFT JOIN ranked USING (clause_id) GROUP BY 1, 2)"""
ORACLES["top3_issues"] = RANKED + "SELECT audit_id, issue_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY severity_rank DESC, pos) AS rank FROM ranked) WHERE rank <= 3"
ORACLES["issues_in_order"] = RANKED + "SELECT audit_id, issue_id, severity_rank::BIGINT AS severity_rank FROM ranked ORDER BY audit_id, severity_rank DESC, pos"
ORACLES["severity_counts"] = RANKED + "SELECT audit_id, count(*) FILTER (severity IN ('HIGH', 'CRITICAL')) AS n_high, count(*) FILTER (severity = 'MEDIUM') AS n_medium FROM graded GROUP BY 1"
ORACLES["owner_report"] = SCORED + """SELECT owner_id, audit_id, contract_type, created_at, risk_score, CASE status WHEN 'COMPLETE' THEN 'Complete' WHEN 'FAILED' THEN 'Failed' ELSE 'In Progress' END AS status_label,
  CASE WHEN risk_score >= 70 THEN 'high' WHEN risk_score >= 40 THEN 'elevated' ELSE 'low' END AS risk_band, c_name AS owner FROM scores LEFT JOIN customer ON owner_id = c_custkey"""
ORACLES["report_cells"] = _with(CLAUSES, DELTAS) + """SELECT clause_id, '$' || format('{:,}', floor(numeric_value * 100 + 0.5)::BIGINT) || ' CAD' AS money, printf('%.2f', numeric_value::DOUBLE) || '%' AS percent,
  CASE WHEN delta > 0 THEN '+' ELSE '' END || printf('%.2f', delta::DOUBLE) || ' pp' AS delta_cell, confidence < 0.5 AS unverified, greatest(0.0, least(100.0, floor(delta_percent + 0.5))) AS gauge FROM deltas"""
ORACLES["summary_paragraphs"] = """SELECT conv_id, turn, (i - 1)::BIGINT AS p_no, md5(ps[i]) AS digest FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM (
  SELECT conv_id, turn, list_filter(regexp_split_to_array(text || chr(10) || ' ' || chr(10) || role || chr(10) || chr(10) || '  ' || chr(10) || chr(10) || 'end', '\\n\\s*\\n'), lambda p: regexp_matches(p, '\\S')) AS ps FROM conversations))"""
ORACLES["audit_nested"] = RANKED + """SELECT audit_id, greatest(ceil((coalesce(c, 0) + coalesce(i, 0)) / 5.0), 1)::BIGINT AS n_parts, coalesce(c, 0)::BIGINT AS n_clauses, coalesce(i, 0)::BIGINT AS n_issues, coalesce(i, 0)::BIGINT AS n_links
  FROM audits LEFT JOIN (SELECT audit_id, count(*) AS c FROM clauses GROUP BY 1) USING (audit_id) LEFT JOIN (SELECT audit_id, count(*) AS i FROM graded GROUP BY 1) USING (audit_id)"""
ORACLES["append_if_absent"] = CL + "SELECT audit_id, clause_id, label FROM clauses WHERE label NOT IN ('interest_rate', 'annual_fee')"
ORACLES["stored_results"] = _with(*BASE, DELTAS, GRADED, FAILURES) + """, done AS (SELECT audit_id FROM audits WHERE status = 'COMPLETE')
SELECT 'audits ' || status AS table_name, count(*) AS n FROM audits GROUP BY status UNION ALL SELECT 'clauses', count(*) FROM clauses WHERE audit_id IN (FROM done) UNION ALL SELECT 'issues', count(*) FROM graded WHERE audit_id IN (FROM done)
UNION ALL SELECT 'links', count(*) FROM graded WHERE audit_id IN (FROM done) UNION ALL SELECT 'warnings', sum(len(f))::BIGINT FROM fails"""
ORACLES["rate_upsert"] = _with(HISTORY) + """SELECT source_name, category, value, unit, as_of, reference_url FROM (SELECT *, row_number() OVER (PARTITION BY source_name, category, as_of ORDER BY (load_seq % 3 <> 0) DESC, load_seq DESC) AS rn
  FROM history WHERE load_seq % 3 = 0 OR load_seq % 50 <> 1) WHERE rn = 1"""
ORACLES["stale_rates"] = _with(HISTORY) + "SELECT source_name, category, as_of, count(*) AS n FROM history WHERE as_of < TIMESTAMP '2026-01-28' - INTERVAL 7 DAY GROUP BY ALL"
ORACLES["stale_report"] = _with(HISTORY) + "SELECT count(*) AS n_stale, count(*) > 0 AS has_stale_data, 7::BIGINT AS threshold_days FROM history WHERE as_of < TIMESTAMP '2026-01-28' - INTERVAL 7 DAY"
SERIES = list(ref.RATE_SERIES) + ["V0"]
ORACLES["rate_series"] = f"""WITH a AS (SELECT p_partkey % 10 AS kind, ({_list(SERIES)})[(p_partkey % 6 + 1)::INT] AS series, (floor(p_retailprice)::BIGINT % 9)::VARCHAR || '.' || lpad((p_size % 100)::VARCHAR, 2, '0') AS v, p_size FROM part)
SELECT series, {_case('series', ref.RATE_SERIES)} AS category, CASE WHEN kind NOT IN (0, 1, 2) THEN v::DOUBLE END AS value,
  CASE WHEN kind NOT IN (0, 1, 2) THEN make_timestamp(2026, 2, (p_size % 28 + 1)::BIGINT, 0, 0, 0) WHEN kind = 1 THEN TIMESTAMP '2026-02-01' END AS as_of,
  'BOC ' || series || ': ' || CASE WHEN kind = 3 THEN 'HTTP 500' WHEN kind IN (0, 2) THEN 'no observations in response' WHEN kind = 1 THEN 'unparseable value "n/a"' END AS error, count(*) AS n FROM a WHERE series <> 'V0' GROUP BY ALL"""
ORACLES["page_rates"] = f"""WITH a AS (SELECT ({_list(list(ref.RATE_PAGES))})[(p_partkey % 5 + 1)::INT] AS url, (p_size % 9)::DOUBLE + 0.25 AS value FROM part),
b AS (SELECT a.*, unnest(['savings', 'gic_1yr', 'mortgage_variable']) AS category FROM a)
SELECT 'Wealthsimple | ' || category AS source_name, category, value, url AS reference_url, count(*) AS n FROM b WHERE (url LIKE '%/mortgage' AND category = 'mortgage_variable') OR (url LIKE '%/save' AND category = 'savings') OR (url LIKE '%/gic' AND category = 'gic_1yr') GROUP BY ALL"""

# --- uploads and texts ------------------------------------------------------------------------------------

ORACLES["upload_validation"] = f"""WITH u AS (SELECT doc_id AS k, CASE WHEN doc_id % 9 = 0 THEN 'text/plain' ELSE ({_list(ref.MIME_TYPES)})[(doc_id % 4 + 1)::INT] END AS mime FROM documents),
v AS (SELECT *, CASE WHEN mime = 'text/plain' THEN 'INVALID_MIME_TYPE' WHEN k % 13 = 0 THEN 'EMPTY_FILE' WHEN k % 7 = 0 THEN 'MAGIC_BYTES_MISMATCH' WHEN k % 11 = 0 THEN 'MAGIC_BYTES_MISMATCH' END AS code FROM u)
SELECT k AS upload_id, mime, code IS NULL AS valid, code, CASE WHEN code IS NULL THEN 'documents/' || k || '/' || k || '.' || {_case('mime', {m: e for m, (_, e) in ref.MIME_TYPES.items()})} END AS key FROM v"""
ORACLES["duplicate_documents"] = "SELECT sha256(text) AS hash, min(doc_id) AS first_key, count(*) - 1 AS surplus FROM documents GROUP BY 1 HAVING count(*) > 1"
ORACLES["document_route"] = "SELECT doc_id AS audit_id, CASE WHEN doc_id % 5 <> 0 AND n_chars >= 200 THEN 'text' ELSE 'ocr' END AS route, doc_id % 5 <> 0 AND n_chars < 200 AS low_yield FROM documents"
ORACLES["route_from_pages"] = _with(PAGES) + "SELECT audit_id, CASE WHEN sum(length(text)) >= 200 THEN 'text' ELSE 'ocr' END AS route, sum(length(text))::BIGINT AS n_chars, count(*) AS n_pages, count(*) > 100 AS too_long FROM page_rows GROUP BY 1"
ORACLES["document_assemble"] = "SELECT doc_id AS audit_id, length(text) AS n_chars, md5(text) AS digest FROM documents"
ORACLES["html_strip"] = """SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', '', 'g'), '(?is)<style.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '\\s{2,}', ' ', 'g')) AS text FROM pages"""
RUNS = f"""run_rows AS (SELECT audit_id, page_no, unnest(string_split(text, '. ')) AS str0, generate_subscripts(string_split(text, '. '), 1) - 1 AS run_no FROM page_rows),
run_text AS (SELECT audit_id, page_no, run_no, CASE WHEN run_no % 3 = 2 THEN ' ' ELSE str0 END AS str FROM run_rows WHERE run_no % 5 <> 4),
run_added AS (SELECT *, CASE WHEN NOT regexp_matches(str, '\\S') THEN CASE WHEN str = ' ' THEN ' ' ELSE '' END ELSE str || ' ' END AS added FROM run_text),
run_at AS (SELECT *, coalesce(sum(length(added)) OVER (PARTITION BY audit_id, page_no ORDER BY run_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base,
  greatest(0, least(1, (792 - run_no * 10.0) / 792)) - greatest(0, least(1, (792 - run_no * 10.0 - CASE WHEN run_no % 2 > 0 THEN 9.0 ELSE 12.0 END) / 792)) AS h FROM run_added),
run_words AS (SELECT audit_id, page_no, base, h, unnest(string_split(str, ' ')) AS w, generate_subscripts(string_split(str, ' '), 1) AS i, string_split(str, ' ') AS ws FROM run_at WHERE regexp_matches(str, '\\S')),
run_placed AS (SELECT *, base + list_sum(list_transform(ws[1:i - 1], lambda x: length(x) + 1)) AS off FROM run_words WHERE w <> '')"""
ORACLES["text_runs"] = _with(PAGES, RUNS) + """SELECT t.audit_id, t.page_no, digest, coalesce(n, 0) AS n_words, coalesce(o, 0)::BIGINT AS sum_off, floor(coalesce(hs, 0) * 10000 + 0.5) / 10000 AS sum_height FROM
  (SELECT audit_id, page_no, md5(string_agg(added, '' ORDER BY run_no)) AS digest FROM run_at GROUP BY 1, 2) t LEFT JOIN (SELECT audit_id, page_no, count(*) AS n, sum(coalesce(off, base)) AS o, sum(h) AS hs FROM run_placed GROUP BY 1, 2) USING (audit_id, page_no)"""
ORACLES["ocr_lines"] = """WITH l AS (SELECT doc_id AS audit_id, list_transform(string_split(text, chr(10)), lambda t: regexp_replace(t, '\\s+', ' ', 'g')) AS ls FROM documents WHERE doc_id % 10 <> 3),
e AS (SELECT audit_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i, ls FROM l),
b AS (SELECT *, coalesce(list_sum(list_transform(ls[1:i - 1], lambda x: length(x) + 1)), 0) AS base, list_filter(string_split(line, ' '), lambda w: w <> '') AS ws FROM e),
s AS (SELECT audit_id, sum(length(line) + 1) AS n_chars, sum(len(ws)) AS n_words, sum(len(ws) * base + coalesce(list_sum(list_transform(range(1, len(ws) + 1), lambda j: (len(ws) - j) * (length(ws[j]) + 1))), 0)) AS o,
  sum(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) / greatest(length(line), 1) * 0.9) AS wd FROM b GROUP BY 1)
SELECT doc_id AS audit_id, coalesce(s.n_chars, 0)::BIGINT AS n_chars, coalesce(n_words, 0)::BIGINT AS n_words, doc_id % 10 <> 3 AND doc_id % 2 = 0 AS estimated, coalesce(o, 0)::BIGINT AS sum_off, floor((coalesce(wd, 0) + 1e-9) * 1000 + 0.5) / 1000 AS sum_width FROM documents LEFT JOIN s ON doc_id = s.audit_id"""

# --- personal data ----------------------------------------------------------------------------------------


def _found(entity: str, pattern: str, score: str) -> str:
    cut = f"string_split(regexp_replace(text, '(?i){pattern}', chr(1) || '\\0' || chr(1), 'g'), chr(1))"
    return f"SELECT audit_id, '{entity}' AS entity, ps[i] AS value, coalesce(list_sum(list_transform(ps[1:i - 1], lambda x: length(x))), 0)::BIGINT AS s, {score} AS score FROM (SELECT audit_id, ps, unnest(range(2, len(ps) + 1, 2)) AS i FROM (SELECT audit_id, {cut} AS ps FROM docs))"


def _luhn(digits: str) -> str:
    return f"list_sum(list_transform(range(1, length({digits}) + 1), lambda j: CASE WHEN j % 2 = 1 THEN ({digits})[-j:-j]::INT WHEN ({digits})[-j:-j]::INT > 4 THEN ({digits})[-j:-j]::INT * 2 - 9 ELSE ({digits})[-j:-j]::INT * 2 END)) % 10 = 0"


EMAIL, PHONE, CARD, IP = (next(iter(r.patterns)) for r in (pii.EMAIL, pii.PHONE, pii.CREDIT_CARD, pii.IP))
SPANS = f"""docs AS (SELECT doc_id AS audit_id, text FROM documents),
raw_spans AS ({_found('EMAIL_ADDRESS', EMAIL, '1.0')} UNION ALL {_found('PHONE_NUMBER', PHONE, '0.75')} UNION ALL {_found('IP_ADDRESS', IP, '0.95')}
  UNION ALL SELECT * FROM ({_found('CREDIT_CARD', CARD, '1.0')}) WHERE {_luhn("regexp_replace(value, '[^0-9]', '', 'g')")}),
pii_all AS (SELECT *, s + length(value) AS e, CASE entity WHEN 'CREDIT_CARD' THEN 'CREDIT_CARD_NUMBER' ELSE entity END AS kind FROM raw_spans),
pii_ranked AS (SELECT a.*, row_number() OVER (PARTITION BY audit_id ORDER BY s DESC) AS n, right(regexp_replace(value, '[^0-9]', '', 'g'), 4) AS last4 FROM pii_all a
  WHERE NOT EXISTS (SELECT 1 FROM pii_all b WHERE a.audit_id = b.audit_id AND a.s < b.e AND b.s < a.e AND (b.score > a.score OR (b.score = a.score AND b.e - b.s > a.e - a.s)))),
pii_named AS (SELECT *, CASE entity WHEN 'EMAIL_ADDRESS' THEN '[EMAIL_' || n || ']' WHEN 'PHONE_NUMBER' THEN '[PHONE_' || n || ']' WHEN 'CREDIT_CARD' THEN '[CARD_***' || last4 || ']' ELSE '[REDACTED_' || n || ']' END AS ph FROM pii_ranked)"""
PII = _with(SPANS)
ORACLES["pii_spans"] = PII + "SELECT audit_id, entity, s AS start_at, e AS end_at, value FROM pii_named"
ORACLES["pii_counts"] = PII + f"SELECT audit_id, kind, {_case('kind', ref.DISPLAY_NAMES, chr(39) + 'Unknown' + chr(39))} AS display_name, count(*) AS n FROM pii_named GROUP BY ALL"
ORACLES["pii_counts_wide"] = PII + "SELECT audit_id, count(*) FILTER (kind = 'PHONE_NUMBER') AS phone_number, count(*) FILTER (kind = 'EMAIL_ADDRESS') AS email_address, count(*) FILTER (kind = 'CREDIT_CARD_NUMBER') AS credit_card_number, count(*) AS total_redacted FROM pii_named GROUP BY 1"
SPLICED = """pieces AS (SELECT audit_id, s, e, ph, coalesce(lag(e) OVER (PARTITION BY audit_id ORDER BY s), 0) AS prev FROM pii_named),
spliced AS (SELECT p.audit_id, string_agg(substr(text, prev + 1, s - prev) || ph, '' ORDER BY s) || substr(any_value(text), max(e) + 1) AS t FROM pieces p JOIN docs USING (audit_id) GROUP BY 1)"""
ORACLES["pii_redact"] = _with(SPANS, SPLICED) + "SELECT audit_id, md5(t) AS digest, length(t) AS n_chars FROM spliced"
ORACLES["pii_map"] = PII + "SELECT audit_id, ph AS placeholder, arg_min(value, s) AS value FROM pii_named GROUP BY 1, 2"
ORACLES["pii_map_sealed"] = ORACLES["pii_map"]
ORACLES["pii_skipped"] = PII + "SELECT audit_id, 'UNKNOWN_PII_ENTITY_TYPES' AS code, count(*) || ' detection(s) were skipped because their entity type is not recognised' AS message FROM pii_named WHERE entity = 'IP_ADDRESS' GROUP BY 1"
ORACLES["pii_anonymise"] = f"""WITH docs AS (SELECT doc_id AS audit_id, text FROM documents), raw_spans AS ({_found('EMAIL_ADDRESS', EMAIL, '1.0')} UNION ALL {_found('IP_ADDRESS', IP, '0.95')}),
a AS (SELECT *, s + length(value) AS e, CASE entity WHEN 'IP_ADDRESS' THEN '<ip>' ELSE '####' || substr(value, 5) END AS ph FROM raw_spans), b AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY audit_id ORDER BY s), 0) AS prev FROM a)
SELECT audit_id, md5(string_agg(substr(text, prev + 1, s - prev) || ph, '' ORDER BY s) || substr(any_value(text), max(e) + 1)) AS digest, count(*) AS n_items FROM b JOIN docs USING (audit_id) GROUP BY 1"""
ORACLES["pii_financial"] = f"""WITH k AS (SELECT o_orderkey AS audit_id, lpad((o_orderkey * 7919 % 1000000000)::VARCHAR, 9, '0') AS nine FROM orders),
o AS (SELECT *, 'Mortgage account 123-' || lpad(audit_id::VARCHAR, 7, '0') || '. SIN ' || nine[1:3] || ' ' || nine[4:6] || ' ' || nine[7:9] || '. Nothing near here at all but 12345-' || lpad((audit_id % 1000)::VARCHAR, 3, '0') || ' and mailing address M5V 3A8' AS t FROM k)
SELECT audit_id, unnest(['FINANCIAL_ACCOUNT', 'CA_SIN', 'CA_BANK_TRANSIT', 'ADDRESS']) AS entity, unnest([strpos(t, '123-') - 1, strpos(t, 'SIN ') + 3, strpos(t, 'but ') + 3, strpos(t, 'M5V') - 1]) AS start_at,
  unnest([strpos(t, '. SIN') - 1, strpos(t, '. Nothing') - 1, strpos(t, ' and mailing') - 1, length(t)]) AS end_at,
  unnest([0.85, CASE WHEN {_luhn('nine')} THEN 1.0 ELSE 0.95 END, 0.5, 1.0])::DOUBLE AS score FROM o"""
STARTS = "starts AS (SELECT audit_id, page_no, (sum(length(text) + 1) OVER (PARTITION BY audit_id ORDER BY page_no) - length(text) - 1)::BIGINT AS ps, text FROM page_rows)"


def _moved(offset: str) -> str:
    shift = f"coalesce((SELECT sum(length(ph) - (e - s)) FROM pii_named n WHERE n.audit_id = q.audit_id AND n.e <= {offset}), 0)"
    return f"(coalesce((SELECT min(s) FROM pii_named n WHERE n.audit_id = q.audit_id AND n.s < {offset} AND {offset} < n.e), {offset}) + {shift})::BIGINT"


ORACLES["offset_rebase"] = _with(SPANS, PAGES, STARTS) + f"SELECT audit_id, page_no, ps AS page_start, {_moved('ps')} AS new_start FROM starts q WHERE audit_id IN (SELECT audit_id FROM pii_named)"
ORACLES["word_rebase"] = _with(SPANS, PAGES, STARTS) + f""", ws AS (SELECT audit_id, page_no, ps, string_split(text, ' ') AS w, unnest(range(1, len(string_split(text, ' ')) + 1)) AS i FROM starts WHERE audit_id IN (SELECT audit_id FROM pii_named)),
q AS (SELECT *, ps + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x) + 1)), 0)::BIGINT AS off FROM ws WHERE w[i] <> '')
SELECT s.audit_id, s.page_no, coalesce(sum_off, 0)::BIGINT AS sum_off FROM starts s LEFT JOIN (SELECT audit_id, page_no, sum({_moved('off')} - {_moved('ps')}) AS sum_off FROM q GROUP BY 1, 2) USING (audit_id, page_no) WHERE audit_id IN (SELECT audit_id FROM pii_named)"""
ORACLES["span_page"] = _with(SPANS, PAGES, STARTS) + "SELECT n.audit_id, s AS start_at, kind, coalesce(p.page_no, 1) AS page_no FROM pii_named n LEFT JOIN starts p ON n.audit_id = p.audit_id AND s BETWEEN ps AND ps + length(p.text)"
ORACLES["luhn"] = f"WITH o AS (SELECT lpad((o_orderkey * 7919 % 1000000000)::VARCHAR, 9, '0') AS number FROM orders) SELECT number, {_luhn('number')} AS valid FROM o"

# --- anchoring --------------------------------------------------------------------------------------------


def _norm(x: str) -> str:
    return f"lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"


ORACLES["exact_anchor"] = f"SELECT item_id, doc_id FROM (SELECT item_id, {_norm('text')} AS q FROM benchmark) JOIN (SELECT doc_id, {_norm('text')} AS t FROM documents) ON contains(t, q)"
QUOTES = f"""page_norm AS (SELECT *, {_norm('text')} AS t FROM page_rows),
cut AS (SELECT audit_id, CASE WHEN length(text) > 50 THEN substr(text, 11, 40) ELSE text END AS part FROM page_rows),
wanted AS (SELECT DISTINCT audit_id, {_norm('part')} AS norm FROM cut WHERE regexp_matches(part, '\\S')),
firsts AS (SELECT w.audit_id, norm, min(page_no) AS page_no FROM wanted w JOIN page_norm p ON w.audit_id = p.audit_id AND contains(t, norm) GROUP BY 1, 2)"""
ORACLES["anchor_first_page"] = _with(PAGES, QUOTES) + "SELECT audit_id, md5(norm) AS q, page_no FROM firsts"
ORACLES["raw_offsets"] = _with(PAGES, QUOTES) + """SELECT f.audit_id, md5(norm) AS q, strpos(lower(text), norm) - 1 AS off_start, strpos(lower(text), norm) - 1 + length(norm) AS off_end, sha256(substr(text, strpos(lower(text), norm), length(norm))) AS text_hash
  FROM firsts f JOIN page_norm p ON f.audit_id = p.audit_id AND f.page_no = p.page_no"""
ORACLES["anchor_boxes"] = _with(PAGES) + """, ws AS (SELECT audit_id, page_no, length(text) AS n, string_split(text, ' ') AS w, unnest(range(1, len(string_split(text, ' ')) + 1)) AS i FROM page_rows),
placed AS (SELECT *, coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x) + 1)), 0)::BIGINT AS off FROM ws WHERE w[i] <> ''),
hit AS (SELECT audit_id, page_no, min(off / n) AS x0, max((off + length(w[i])) / n) AS x1 FROM placed WHERE off < 40 AND off + length(w[i]) > 10 GROUP BY 1, 2)
SELECT audit_id, page_no, x0 IS NULL AS full_page, floor(coalesce(x0, 0) * 1000000 + 0.5) / 1000000 AS x0, floor(coalesce(x1, 1) * 1000000 + 0.5) / 1000000 AS x1 FROM page_rows LEFT JOIN hit USING (audit_id, page_no)"""
# Answers known by construction: the best window of a passage with one strange character in it is the passage itself.
PARTS = f"""page_norm AS (SELECT *, {_norm('text')} AS t FROM page_rows),
cuts AS (SELECT audit_id, page_no, trim(CASE WHEN length(t) > 50 THEN substr(t, 11, 30) ELSE substr(t, 1, 30) END) AS part FROM page_norm WHERE t <> ''),
parts AS (SELECT audit_id, max(page_no) AS page_no, max_by(part, page_no) AS part FROM cuts WHERE part <> '' GROUP BY 1),
firsts AS (SELECT w.audit_id, part, min(page_no) AS page_no FROM (SELECT DISTINCT audit_id, part FROM parts WHERE part <> '') w JOIN page_norm p ON w.audit_id = p.audit_id AND contains(t, part) GROUP BY 1, 2)"""
ORACLES["fuzzy_known"] = _with(PAGES, PARTS) + """, j AS (SELECT f.*, strpos(t, part) - 1 AS norm_start, length(part) AS n, (length(part) / (length(part) + 1.0)::DOUBLE + 2) / 3 AS jaro FROM firsts f JOIN page_norm p ON f.audit_id = p.audit_id AND f.page_no = p.page_no)
SELECT audit_id, md5(CASE WHEN n > 8 THEN substr(part, 1, 6) || '\u00a4' || substr(part, 7) ELSE part || '\u00a4' END) AS q, page_no, norm_start, norm_start + n AS norm_end,
  floor((jaro + least(4, n) * 0.1::DOUBLE * (1 - jaro)) * 1000000 + 0.5) / 1000000 AS similarity FROM j"""
ORACLES["tiers_known"] = _with(PAGES, PARTS) + """, c AS (SELECT p.audit_id, p.page_no AS cited, f.page_no AS found, unnest(range(4)) AS pos FROM parts p JOIN firsts f ON p.audit_id = f.audit_id AND p.part = f.part)
SELECT audit_id, audit_id || '_' || cited || '_' || pos AS clause_id, pos <> 2 AS verified, ['exact', 'fuzzy', 'unverified', 'reextracted'][pos + 1] AS match_tier,
  CASE WHEN pos < 2 THEN found ELSE cited END AS page_no, [0.9, 0.81, 0.36, 0.63][pos + 1]::DOUBLE AS confidence FROM c"""
ORACLES["phantom_report"] = _with(PAGES, PARTS) + "SELECT audit_id, 3 * count(*) AS total_flags, 2 * count(*) AS n_flagged_clauses, 2 * count(*) AS phantom_clause, count(*) AS numeric_drift FROM parts WHERE part <> '' GROUP BY 1"
ORACLES["levenshtein"] = "SELECT DISTINCT l_partkey, l_suppkey, levenshtein(p_name, s_name) AS distance FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"

# --- model replies and rules ------------------------------------------------------------------------------

ORACLES["classify_replies"] = f"""WITH r AS (SELECT doc_id AS k, ({_list([*ref.CONTRACT_TYPES, 'LEASE'])})[(doc_id % 10 + 1)::INT] AS t, CASE WHEN toxic = 1 THEN 0.0 WHEN quality = 1 THEN 0.9 ELSE 0.55 END::DOUBLE AS c, doc_id % 7 = 2 AS failed FROM labels)
SELECT k AS audit_id, CASE WHEN failed THEN NULL WHEN t = 'LEASE' OR c < 0.6 THEN 'UNKNOWN' ELSE t END AS contract_type, CASE WHEN NOT failed THEN c END AS confidence, failed,
  CASE WHEN failed THEN 'CLASSIFY_UNREADABLE' WHEN t = 'LEASE' THEN 'CLASSIFY_INVALID_TYPE' WHEN c < 0.6 THEN 'CLASSIFY_LOW_CONFIDENCE' END AS warning_code FROM r"""
ORACLES["classify_warnings"] = f"SELECT audit_id, warning_code AS code, warning_code <> 'CLASSIFY_UNREADABLE' AS recoverable, 'CLASSIFYING' AS stage FROM ({ORACLES['classify_replies']}) WHERE warning_code IS NOT NULL"
ORACLES["tool_replies"] = """WITH c AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations)
SELECT conv_id AS audit_id, pos, CASE turn % 3 WHEN 0 THEN 'interest_rate' ELSE 'principal_amount' END AS label, CASE turn % 3 WHEN 0 THEN 'interest_rate' ELSE 'term_conditions' END AS category, n || '%' AS raw_value, n::DOUBLE AS numeric_value,
  CASE turn % 3 WHEN 0 THEN 'percent' ELSE 'CAD' END AS unit, CASE WHEN n % 10 = 0 THEN 1.0 ELSE (n % 100) / 100.0 END::DOUBLE AS confidence, greatest(1, turn - 1) AS page_no, length(n || '%') AS off_end, sha256(n || '%') AS text_hash
  FROM c WHERE turn % 3 <> 2 AND turn % 4 <> 3 AND n % 11 <> 0"""
REPEATED = "The interest rate is 5% a year."
ORACLES["piece_replies"] = f"""WITH parts AS (SELECT doc_id, string_split('{REPEATED}' || replace(text, '. ', '. {REPEATED} ') || '{REPEATED}', '{REPEATED}') AS p FROM documents),
cut AS (SELECT doc_id, unnest(p) AS part, generate_subscripts(p, 1) AS i, len(p) AS k FROM parts),
placed AS (SELECT *, (sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i) + (i - 1) * {len(REPEATED)})::BIGINT AS off_start FROM cut)
SELECT doc_id AS audit_id, 'interest_rate' AS label, '5%' AS raw_value, off_start, off_start + {len(REPEATED)} AS off_end FROM placed WHERE i < k"""
ORACLES["weak_clause_warnings"] = CL + "SELECT audit_id, 'EXTRACT_LOW_CONFIDENCE' AS code, count(*) AS n FROM clauses WHERE confidence < 0.5 GROUP BY 1"
ORACLES["no_clause_warnings"] = "SELECT o_orderkey AS audit_id, 'EXTRACT_NO_CLAUSES' AS code, 'EXTRACTING' AS stage FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"
COUNTS = {t: len(v) for t, v in ref.TEMPLATES.items()}
ORACLES["classify_rules"] = f"""SELECT o_orderkey AS audit_id, CASE WHEN o_orderkey % 2 = 0 THEN 'MORTGAGE' ELSE 'AUTO_LOAN' END AS contract_type,
  floor((CASE WHEN o_orderkey % 2 = 0 THEN 5.0 / {COUNTS['MORTGAGE']} ELSE 5.0 / {COUNTS['AUTO_LOAN']} END) * 10000 + 0.5) / 10000 AS confidence FROM orders"""
ORACLES["extract_rules"] = """WITH o AS (SELECT o_orderkey AS k, floor(o_totalprice)::BIGINT AS p FROM orders)
SELECT k AS audit_id, 0::BIGINT AS pos, 'principal_amount' AS label, 'CAD' AS unit, p::DOUBLE AS numeric_value, format('{:,}', p) AS raw_value FROM o
UNION ALL SELECT k, 1, 'interest_rate', 'percent', (k % 9 * 100 + k % 100) / 100.0, (k % 9) || '.' || lpad((k % 100)::VARCHAR, 2, '0') FROM o
UNION ALL SELECT k, CASE WHEN k % 2 = 0 THEN 3 ELSE 2 END, 'term_length', 'months', (k % 30 * 12)::DOUBLE, (k % 30 * 12)::VARCHAR FROM o
UNION ALL SELECT k, 4, 'down_payment', 'CAD', 500.0, '500' FROM o WHERE k % 2 = 1"""
ORACLES["model_requests"] = f"""WITH p AS (SELECT doc_id, 'classify' AS kind, text, unnest(range(greatest(1, ceil(length(text) / 7500.0))::BIGINT)) AS piece_no, 7500 AS step, 500 AS again FROM documents
  UNION ALL SELECT doc_id, 'extract', text, unnest(range(greatest(1, ceil(length(text) / 15500.0))::BIGINT)), 15500, 500 FROM documents),
c AS (SELECT *, '---BEGIN DOCUMENT---' || chr(10) || CASE WHEN piece_no = 0 THEN substr(text, 1, step) ELSE substr(text, piece_no * step + 1 - again, step + again) END || chr(10) || '---END DOCUMENT---' AS content FROM p)
SELECT doc_id AS audit_id, kind, piece_no, md5(content) AS digest, length(content) AS n_chars, CASE WHEN kind = 'extract' THEN ([{', '.join(str(COUNTS[t]) for t in ref.CONTRACT_TYPES)}])[(doc_id % 9 + 1)::INT]::BIGINT ELSE 0 END AS n_tools FROM c"""
ORACLES["extract_every_hit"] = """SELECT doc_id AS audit_id, 1::BIGINT AS pos, 'interest_rate' AS label, (doc_id % 9 + 1)::DOUBLE AS numeric_value, 'interest rate is ' || (doc_id % 9 + 1) || ' percent' AS verbatim FROM documents
UNION ALL SELECT doc_id, 1001, 'interest_rate', (doc_id % 7 + 10)::DOUBLE, 'Interest Rate is ' || (doc_id % 7 + 10) || ' percent' FROM documents"""
TEMPLATE_ROWS = ", ".join(f"('{t}', '{label}', '{cat}', {'NULL' if unit is None else chr(39) + unit + chr(39)})" for t, _, label, cat, unit, _ in ref.template_rows())
ORACLES["wanted_templates"] = _with(AUDITS) + f"""SELECT label, category, expected_unit, count(*) AS n FROM audits a JOIN (VALUES {TEMPLATE_ROWS}) t(ct, label, category, expected_unit)
  ON ct = CASE WHEN a.audit_id % 10 = 9 THEN 'UNKNOWN' ELSE contract_type END GROUP BY ALL"""

# --- citations without a place, stored audits ---------------------------------------------------------------

LINES = "lines AS (SELECT doc_id AS audit_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS page_no FROM documents)"
OPEN = _with(CLAUSES, LINES, """open_ AS (SELECT c.*, EXISTS (SELECT 1 FROM lines l WHERE l.audit_id = c.audit_id AND l.page_no = c.page_no AND line <> '') AS has_text FROM clauses c WHERE confidence < 0.7)""")
ORACLES["reextract_requests"] = OPEN + """SELECT audit_id, clause_id, page_no::BIGINT AS page_no, 'Quote, letter for letter, the passage of this page that states "' || label || '" as "' || raw_value
  || '". Answer with the quote alone, or with NOT_FOUND where the page does not state it.' AS instruction FROM open_ WHERE has_text"""
ORACLES["reextract_warnings"] = OPEN + """SELECT audit_id, 'L3_CITE_REEXTRACT_FAILED' AS code, message, count(*) AS n FROM (
  SELECT audit_id, 'No text to look for "' || label || '" on page ' || page_no AS message FROM open_ WHERE NOT has_text
  UNION ALL SELECT audit_id, 'Asking for "' || label || '" on page ' || page_no || ' failed: timeout' FROM open_ WHERE length(raw_value) % 4 = 3
  UNION ALL SELECT audit_id, 'Citation re-extraction returned an unanchorable quote for "' || label || '" on page ' || page_no || '.' FROM open_ WHERE length(raw_value) % 4 = 2) GROUP BY ALL"""
ORACLES["citation_warnings"] = _with(CLAUSES) + """SELECT audit_id, code, message, TRUE AS recoverable, 'CITING' AS stage, count(*) AS n FROM (
  SELECT audit_id, 'L3_CITE_NO_MATCH' AS code, 'Could not verify "' || label || '" in source document' AS message FROM clauses WHERE confidence < 0.7
  UNION ALL SELECT audit_id, 'CITE_UNVERIFIED_SUMMARY', count(*) || ' clause(s) could not be verified in the source document' FROM clauses WHERE confidence < 0.7 GROUP BY audit_id
  UNION ALL SELECT o_orderkey, 'CITE_NO_CLAUSES', 'No clauses to verify — citations node is a no-op' FROM orders WHERE o_orderkey NOT IN (SELECT audit_id FROM clauses)) GROUP BY ALL"""
ORACLES["search_candidates"] = _with(CLAUSES) + """, c AS (SELECT clause_id, trim(CASE WHEN page_no % 3 = 0 THEN substr(verbatim, 1, 7) ELSE verbatim END) AS v, raw_value AS r FROM clauses),
tried AS (SELECT clause_id, CASE WHEN length(v) >= 8 AND v <> r THEN [v, r] WHEN v <> '' AND v <> r THEN [r, v] ELSE [r] END AS q FROM c)
SELECT clause_id, generate_subscripts(q, 1)::BIGINT - 1 AS try_no, unnest(q) AS quote FROM tried"""
ORACLES["no_type_warnings"] = """SELECT o_orderkey AS audit_id, 'BENCHMARK_NO_CONTRACT_TYPE' AS code, 'No contract type, comparison with market rates skipped' AS message, TRUE AS recoverable, 'BENCHMARKING' AS stage
  FROM orders WHERE o_orderkey % 10 = 9"""
ORACLES["rehydrated"] = """WITH k AS (SELECT *, doc_id % 5 >= 2 AS readable FROM documents)
SELECT doc_id AS audit_id, CASE WHEN doc_id % 2 = 0 THEN doc_id % 7 ELSE 0 END AS total_redacted, CASE WHEN doc_id % 2 = 0 THEN doc_id % 7 ELSE -1 END AS n_email,
  CASE WHEN readable THEN len(string_split(text, chr(10))) ELSE 0 END::BIGINT AS n_pages, CASE WHEN readable THEN length(replace(text, chr(10), '')) ELSE 0 END::BIGINT AS page_chars,
  md5(CASE WHEN doc_id % 3 <> 1 THEN text ELSE '' END) AS digest FROM k"""

# --- progress events --------------------------------------------------------------------------------------

EVENTS = """ev AS (SELECT user_id AS audit_id, event_id AS seq, ts, CASE event_type WHEN 'click' THEN 'clause_found' WHEN 'view' THEN 'issue_flagged' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'error' ELSE 'status_change' END AS type,
  CASE event_type WHEN 'purchase' THEN 'COMPLETE' WHEN 'error' THEN 'FAILED' ELSE 'EXTRACTING' END AS status, floor(value)::BIGINT % 101 AS progress FROM events),
last_status AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY ts DESC, seq DESC) AS rn FROM ev WHERE type = 'status_change') WHERE rn = 1)"""
EV = _with(EVENTS)
ORACLES["event_latest"] = EV + "SELECT audit_id, status, progress FROM last_status"
ORACLES["event_unexpired"] = EV + "SELECT audit_id, status, progress FROM last_status WHERE ts > TIMESTAMP '2024-01-30' - INTERVAL 3600 SECOND"
ORACLES["event_history100"] = EV + "SELECT audit_id, seq, type, age FROM (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY seq DESC) AS age FROM ev) WHERE age <= 100"
ORACLES["event_terminal"] = EV + "SELECT audit_id, min(seq) FILTER (type = 'complete') AS end_seq, count(*) AS n_events, count(*) FILTER (type = 'complete') > 0 AS closed FROM ev GROUP BY 1"
ORACLES["event_eta"] = EV + """SELECT c_custkey AS audit_id, coalesce(p, 0) AS progress, CASE WHEN coalesce(p, 0) >= 100 THEN 0 ELSE floor(90.0 * (1.0 - coalesce(p, 0) / 100.0) + 0.5) END::BIGINT AS seconds_left
  FROM customer LEFT JOIN (SELECT audit_id, arg_max(progress, seq) AS p FROM ev WHERE type = 'status_change' GROUP BY 1) ON c_custkey = audit_id"""
ORACLES["event_feed"] = EV + "SELECT audit_id, type, count(*) AS n FROM ev WHERE type <> 'complete' GROUP BY 1, 2"
ORACLES["event_replay"] = EV + """SELECT audit_id, seq, type, status, progress FROM (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY seq DESC) AS age FROM ev) WHERE age <= 20"""
ORACLES["stream_open_state"] = EV + "SELECT audit_id * 10 + seq % 10 AS audit_id, least(count(*), 100) AS n_kept FROM ev GROUP BY ev.audit_id * 10 + seq % 10 HAVING count(*) FILTER (type = 'complete') = 0"
ORACLES["event_live_tail"] = EV + "SELECT audit_id, seq, type, status, progress, CASE WHEN floor(seq * 4 / ((SELECT max(seq) FROM ev) + 1)) < 2 THEN 'snapshot' ELSE 'tail' END AS read_from FROM ev"
STAGE_LIST = list(ref.STAGES)
ORACLES["event_payloads"] = f"""SELECT CASE WHEN event_id % 10 = 7 THEN 'COMPLETE' ELSE 'CLASSIFYING' END AS status, ({_list([v[1] for v in ref.STAGES.values()] + [ref.DEFAULT_STAGE_MESSAGE])})[(event_id % 10 + 1)::INT] AS message,
  ([{', '.join(str(v[0]) for v in ref.STAGES.values())}, 0])[(event_id % 10 + 1)::INT]::BIGINT AS progress, count(*) AS n, count(*) FILTER (event_id % 10 = 7) AS n_terminal FROM events WHERE event_id % 9 <> 0 GROUP BY ALL"""
ORACLES["item_events"] = CL + "SELECT 'clause_found' AS type, label, count(*) AS n FROM clauses GROUP BY 2"
PRIOR = "prior AS (SELECT l_orderkey AS audit_id, NOT (l_quantity = 50 AND l_linenumber = 1) AS recoverable FROM lineitem WHERE l_quantity > 40)"
ORACLES["failed_routing"] = _with(AUDITS, PRIOR) + """, per_audit AS (SELECT audit_id, count(*) AS n, count(*) FILTER (NOT recoverable) AS f FROM prior GROUP BY 1)
SELECT a.audit_id, CASE WHEN f > 0 THEN 'FAILED' ELSE status END AS status, CASE WHEN f > 0 THEN n ELSE 0 END AS n_warnings, coalesce(f, 0) AS n_fatal FROM audits a LEFT JOIN per_audit USING (audit_id)"""
ORACLES["fatal_warnings"] = _with(PRIOR) + "SELECT audit_id, count(*) AS n FROM prior WHERE NOT recoverable GROUP BY 1"
ORACLES["state_merge"] = """SELECT user_id AS audit_id, arg_max(event_type, event_id) FILTER (event_type <> 'view') AS stage, max(event_id) FILTER (event_id % 3 = 0) AS score,
  arg_max(event_id % 5, event_id) FILTER (event_type = 'click') AS clicks, count(DISTINCT event_type) AS n_counters FROM events GROUP BY 1"""
ORACLES["stream_progress"] = EV + "SELECT audit_id, arg_max(progress, seq) AS progress FROM ev WHERE type = 'status_change' GROUP BY 1"
ORACLES["stream_history"] = EV + """SELECT e.audit_id, seq, closed FROM (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY seq DESC) AS age FROM ev) e
  JOIN (SELECT audit_id, count(*) FILTER (type = 'complete') > 0 AS closed FROM ev GROUP BY 1) USING (audit_id) WHERE age <= 100"""

# --- everything -------------------------------------------------------------------------------------------

ORACLES["audit_flow"] = f"""WITH o AS (SELECT o_orderkey AS audit_id, floor(o_totalprice)::DOUBLE AS p, (o_orderkey % 9 * 100 + o_orderkey % 100) / 100.0 AS rate, (o_orderkey % 30 * 12)::DOUBLE AS n, 'interest_rate' AS category FROM orders),
c AS (SELECT *, rate - 3.94 AS gap, CASE WHEN rate - 3.94 > 0.001 THEN {_severity('floor((rate - 3.94) / 3.94 * 100 * 100 + 0.5) / 100')} WHEN rate - 3.94 < -0.001 THEN 'INFO' END AS severity FROM o)
SELECT audit_id, CASE WHEN audit_id % 2 = 0 THEN 'MORTGAGE' ELSE 'AUTO_LOAN' END AS contract_type, floor(coalesce({_case('severity', ref.SEVERITY_WEIGHT)}, 0) * 0.7 + 0.5)::BIGINT AS risk_score, (severity IS NOT NULL)::BIGINT AS n_issues,
  CASE WHEN gap > 0.001 THEN floor({_extra('p', 'rate', '3.94', 'n')} + 0.5) ELSE 0 END AS total_cost, 1::BIGINT AS total_redacted, CASE WHEN audit_id % 2 = 0 THEN 3 ELSE 4 END::BIGINT AS n_verified, 0::BIGINT AS n_full_page,
  (severity IS NOT NULL)::BIGINT AS n_passed, 0::BIGINT AS n_warnings FROM c"""
