"""The same queries as SQL, for comparison on small tables."""

from __future__ import annotations

from reckoner.sources import catalog
from reckoner.sources.views import CODES, TYPES

_values = lambda rows: ",".join("(" + ",".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)

LINES = f"""dim_type AS (SELECT * FROM (VALUES {_values(enumerate(TYPES))}) AS t(type_no, expense_type)),
dim_ccy AS (SELECT * FROM (VALUES {_values(enumerate(CODES))}) AS t(ccy_no, ccy)),
lines AS (SELECT l.l_orderkey AS report_id,
 CAST(row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice) - 1 AS BIGINT) AS line_idx,
 t.expense_type, CAST(CAST(l.l_shipdate AS DATE) AS VARCHAR) AS date_text, c.ccy AS original_currency,
 CASE WHEN c.ccy IS NOT NULL THEN l.l_extendedprice END AS original_amount,
 CASE WHEN c.ccy IS NULL AND t.expense_type <> 'personal_mileage' THEN l.l_extendedprice END AS line_amount_usd,
 CASE l.l_returnflag WHEN 'A' THEN 'high' WHEN 'N' THEN 'medium' ELSE 'low' END AS confidence,
 CASE WHEN s.s_nationkey % 5 = 1 THEN 'United States' WHEN s.s_nationkey % 5 = 2 THEN NULL ELSE n.n_name END AS country,
 CASE WHEN t.expense_type = 'personal_mileage' THEN l.l_quantity END AS distance_miles,
 CASE WHEN t.expense_type IN ('business_meal','group_travel_meal','ground_transportation_domestic','ground_transportation_foreign') THEN l.l_extendedprice * l.l_discount * 3 END AS tip,
 CASE WHEN l.l_partkey % 2 = 0 THEN l.l_extendedprice * (1 - l.l_discount) END AS pre_tax,
 CASE WHEN l.l_partkey % 3 <> 0 THEN l.l_extendedprice * l.l_tax END AS tax,
 CASE WHEN t.expense_type = 'car_rental' THEN l.l_quantity * 60 END AS miles_driven,
 CASE WHEN t.expense_type = 'car_rental' AND l.l_partkey % 4 <> 0 THEN CAST(CAST(l.l_shipdate AS DATE) AS VARCHAR) END AS rental_start_date,
 CASE WHEN t.expense_type = 'car_rental' THEN CAST(CAST(l.l_shipdate AS DATE) + CAST(l.l_quantity % 5 AS INT) AS VARCHAR) END AS rental_end_date,
 CASE WHEN t.expense_type LIKE 'lodging%' THEN CAST(CAST(l.l_shipdate AS DATE) AS VARCHAR) END AS check_in_date,
 CASE WHEN t.expense_type LIKE 'lodging%' AND l.l_partkey % 4 <> 0 THEN CAST(CAST(l.l_shipdate AS DATE) + CAST(l.l_quantity % 6 - 1 AS INT) AS VARCHAR) END AS check_out_date,
 CASE WHEN t.expense_type LIKE 'lodging%' THEN [l.l_extendedprice, l.l_extendedprice * (1 - l.l_discount), l.l_extendedprice * (1 + l.l_tax)][1:CAST(l.l_quantity % 4 AS INT)] END AS nightly_rates
 FROM lineitem l JOIN dim_type t ON t.type_no = l.l_partkey % 18 JOIN dim_ccy c ON c.ccy_no = l.l_suppkey % 6
 JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN nation n ON n.n_nationkey = s.s_nationkey)"""
REPORTS = """reports AS (SELECT o_orderkey AS report_id, o_custkey AS filer_id,
 CASE o_orderstatus WHEN 'F' THEN 'expenses_foreign' WHEN 'O' THEN 'expenses_domestic' ELSE 'relocation' END AS category,
 CASE WHEN o_custkey % 4 = 0 THEN NULL WHEN o_custkey % 4 = 1 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) WHEN o_custkey % 4 = 2 THEN 'spring trip'
 ELSE concat(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), ' to ', CAST(CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) + 1 AS VARCHAR), '-01-31') END AS when_text,
 CASE WHEN o_custkey % 7 <> 0 THEN concat('Payee ', o_custkey) END AS payee_name, nullif(o_orderpriority, '4-NOT SPECIFIED') AS payment_method,
 CASE WHEN o_orderkey % 9 <> 0 THEN concat('Event ', o_orderkey) END AS event_name,
 CASE WHEN o_orderkey % 11 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS transaction_date, CASE WHEN o_totalprice >= 5000 THEN o_totalprice END AS stated_usd FROM orders)"""
FX = """fx AS (SELECT CASE CAST(o_orderkey % 4 AS BIGINT) WHEN 0 THEN 'INR' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' ELSE 'JPY' END AS currency,
 CAST(o_orderdate AS DATE) AS rate_date, round(CAST(min(o_totalprice) AS DOUBLE) / 100000, 4) AS usd_per_unit FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1, 2)"""
_years = {k: v for k, v in catalog.MILEAGE_RATES.items() if k.isdigit()}
RATES = f"dim_rate AS (SELECT * FROM (VALUES {_values(_years.items())}) AS t(y, cents)), dim_mock AS (SELECT * FROM (VALUES {_values(catalog.PLACEHOLDER_RATES.items())}) AS t(code, rate))"
DERIVED = f"""{LINES}, {RATES}, derived AS (SELECT l.*, m.rate AS rate,
 l.line_amount_usd IS NULL AND l.original_amount IS NOT NULL AND m.rate IS NOT NULL AS by_rate,
 coalesce(r.cents, 70.0) / 100 AS usd_per_mile,
 coalesce(l.line_amount_usd, CASE WHEN l.original_amount IS NOT NULL AND m.rate IS NOT NULL THEN l.original_amount * m.rate
  WHEN l.distance_miles IS NOT NULL THEN round(l.distance_miles * (coalesce(r.cents, 70.0) / 100) * 100) / 100 END) AS amount_usd
 FROM lines l LEFT JOIN dim_mock m ON m.code = l.original_currency LEFT JOIN dim_rate r ON r.y = substr(l.date_text, 1, 4))"""
_kind = "CASE expense_type " + " ".join(f"WHEN '{t}' THEN '{k}'" for t, k in catalog.KIND_OF_TYPE.items()) + " ELSE 'other' END"
_in = lambda xs: "(" + ",".join(f"'{x}'" for x in xs) + ")"
_foreign = f"CASE WHEN expense_type IN {_in(catalog.ALWAYS_FOREIGN)} THEN true WHEN expense_type IN {_in(catalog.ALWAYS_DOMESTIC)} THEN false ELSE coalesce(category = 'expenses_foreign', false) END"
ROUTED = f"""{LINES}, {REPORTS}, page AS (SELECT l.*, r.category, {_foreign} AS is_foreign FROM lines l JOIN reports r USING (report_id)),
routed AS (SELECT *, CAST(row_number() OVER (PARTITION BY report_id, is_foreign ORDER BY line_idx) AS BIGINT) AS line_no FROM page)"""
_money = lambda c: f"CAST(round(sum(CAST({c} AS DECIMAL(24,6))), 2) AS DOUBLE)"
_home = "upper(country) IN ('UNITED STATES','US','USA')"
_rank = "CASE confidence WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END"
_name = lambda c: f"CASE coalesce({c}, 0) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END"
ROLLUP = f"""{DERIVED}, {REPORTS}, per AS (SELECT report_id, count(*) AS n_lines, {_money('amount_usd')} AS total_usd, min(date_text) AS earliest_date,
 bool_or(coalesce(upper(original_currency) <> 'USD', false)) AS f, min({_rank}) AS floor_, min(CASE WHEN by_rate THEN 1 ELSE {_rank} END) AS amount_floor,
 bool_and(coalesce(confidence = 'high' AND {_home}, false)) AS all_home, bool_and(coalesce(confidence = 'high' AND NOT {_home}, false)) AS all_away FROM derived GROUP BY 1),
rollup_ AS (SELECT r.report_id, coalesce(n_lines, 0) AS n_lines, coalesce(total_usd, 0.0) AS total_usd, earliest_date,
 CASE WHEN f THEN 'expenses_foreign' ELSE 'expenses_domestic' END AS inferred_category, {_name('amount_floor')} AS amount_confidence, {_name('floor_')} AS date_confidence,
 CASE WHEN CASE WHEN f THEN all_away ELSE all_home END THEN 'high' ELSE {_name('floor_')} END AS category_confidence FROM reports r LEFT JOIN per USING (report_id))"""
_window = "regexp_extract(when_text, '^([0-9]{4}-[0-9]{2}-[0-9]{2})( to [0-9]{4}-[0-9]{2}-[0-9]{2})?$', 1)"
_end = "regexp_extract(when_text, '([0-9]{4}-[0-9]{2}-[0-9]{2})$', 1)"
WINDOWS = f"windows AS (SELECT report_id, nullif({_window}, '') AS from_date, CASE WHEN {_window} <> '' THEN {_end} END AS to_date FROM reports)"
_path = lambda tail: f"concat('expense_report.transaction_lines[', CAST(line_idx AS VARCHAR), '].{tail}')"
_cap = "CASE WHEN tip > 0 THEN CASE WHEN pre_tax IS NOT NULL AND tax IS NOT NULL AND pre_tax + tax > 0 THEN (pre_tax + tax) * 0.2 WHEN line_amount_usd - tip > 0 THEN (line_amount_usd - tip) * 0.2 END END"
_precise = "coalesce(pre_tax IS NOT NULL AND tax IS NOT NULL AND pre_tax + tax > 0, false)"
_issue = lambda no, sev, kind, path, msg, line="CAST(-1 AS BIGINT)": f"report_id, {no} AS pass_no, {line} AS line_idx, '{sev}' AS severity, '{kind}' AS kind, {path} AS path, {msg} AS message"
_quoted = lambda t: "'" + t + "'"
_missing = _quoted("Required field is missing")
_general = "expense_report.general_information."
V01 = " UNION ALL ".join(
    f"SELECT {_issue(1, 'error', 'MissingRequiredField', _quoted(_general + p), _missing)} FROM reports WHERE {c} IS NULL"
    for p, c in (("category", "category"), ("payee.name", "payee_name"), ("payment_method", "payment_method"), ("business_purpose.when", "when_text"), ("event_name", "event_name"))
)
SUMMARY = " UNION ALL ".join(
    f"SELECT {_issue(2, 'error', 'MissingRequiredField', _quoted('expense_report.transaction_summary.' + p), _missing)} FROM reports WHERE {c} IS NULL" for p, c in (("transaction_date", "transaction_date"), ("total_usd", "stated_usd"))
)
V02 = " UNION ALL ".join(
    f"SELECT {_issue(3, 'error', 'MissingRequiredField', _path(p), _missing, 'line_idx')} FROM lines WHERE {w}"
    for p, w in (
        ("common.date", "date_text IS NULL"),
        ("common.line_amount_usd", "line_amount_usd IS NULL"),
        ("common.expense_type", "expense_type IS NULL"),
        ("lodging_details.check_out_date", "expense_type LIKE 'lodging%' AND check_out_date IS NULL"),
    )
)
_targets = {"original_currency": "original_currency IS NULL", "original_amount": "original_amount IS NULL", "exchange_rate": "true", "country_of_activity": "country IS NULL", "foreign_activity_type": "true"}
_away = "airfare_foreign, gift_card_employee_foreign, gifts_foreign_activity, ground_transportation_foreign, lodging_foreign"
V03 = " UNION ALL ".join(
    "SELECT " + _issue(4, "error", "MissingRequiredField", _path("common." + t), f"concat('Required when expense_type in [{_away}] (in line ', line_idx + 1, ')')", "line_idx") + f" FROM lines WHERE list_contains(string_split('{_away}', ', '), expense_type) AND {c}"
    for t, c in _targets.items()
)
V04 = f"""SELECT {_issue(5, 'warning', 'ManualReviewRequired', _path('common.country_of_activity'), "concat('Report is domestic but the line is in ', country)", 'line_idx')} FROM (SELECT l.*, category FROM lines l JOIN reports r USING (report_id)) WHERE category = 'expenses_domestic' AND NOT {_home}
 UNION ALL SELECT {_issue(5, 'warning', 'ManualReviewRequired', "'expense_report.general_information.category'", "'Report is foreign but no line has a foreign country or currency'")} FROM reports WHERE category = 'expenses_foreign'
 AND report_id NOT IN (SELECT report_id FROM lines WHERE coalesce(NOT {_home}, false) OR coalesce(upper(original_currency) <> 'USD', false))"""
V05 = f"""SELECT {_issue(6, 'warning', 'ManualReviewRequired', _path('common.date'), "concat('Transaction date ', date_text, ' is ', CASE WHEN date_text < from_date THEN concat('before trip start ', from_date) ELSE concat('after trip end ', to_date) END, '. Was this purchased ahead of the trip, or is the wrong receipt attached?')", 'line_idx')}
 FROM lines JOIN windows USING (report_id) WHERE from_date IS NOT NULL AND (date_text < from_date OR date_text > to_date)"""
_tip_path = f"CASE WHEN expense_type IN ('business_meal','group_travel_meal') THEN {_path('meal_details.tip_amount')} ELSE {_path('ground_transport_details.tip_amount')} END"
V06 = f"SELECT report_id, 7 AS pass_no, line_idx, 'warning' AS severity, 'ManualReviewRequired' AS kind, {_tip_path} AS path, '' AS message FROM lines WHERE tip > {_cap} + 0.005 AND expense_type IN ('business_meal','group_travel_meal','ground_transportation_domestic','ground_transportation_foreign')"
_days = "greatest(1, CAST(rental_end_date AS DATE) - CAST(rental_start_date AS DATE) + 1)"
V07 = f"""SELECT {_issue(8, 'warning', 'ManualReviewRequired', _path('car_rental_details.miles_driven'), f"concat(CAST(miles_driven AS INT), ' miles over ', {_days}, ' day(s) exceeds the institution''s 350 mi/day cap (max ', {_days} * 350, ' mi). Verify with the FA — excess may need special approval or won''t be reimbursed.')", 'line_idx')}
 FROM lines WHERE miles_driven > 0 AND rental_start_date IS NOT NULL AND miles_driven > {_days} * 350 + 0.5"""
ALL = f"{LINES}, {REPORTS}, {WINDOWS}, issues AS ({V01} UNION ALL {SUMMARY} UNION ALL {V03} UNION ALL {V04} UNION ALL {V05} UNION ALL {V06} UNION ALL {V07})"
_names = ",".join(f"('{k}','{v}')" for k, v in catalog.CURRENCIES.items())
NAMES = f"dim_currency AS (SELECT * FROM (VALUES {_names}) AS t(code, name))"
_display = "concat(coalesce(original_currency, 'USD'), ' - ', coalesce(name, original_currency, 'USD'))"
_month = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][CAST(substr(date_text, 6, 2) AS INT)]"
_portal = f"concat(substr(date_text, 9, 2), '-', {_month}, '-', substr(date_text, 1, 4))"
_two = lambda c: f"coalesce(printf('%.2f', round({c}, 2)), '')"
_amount = f"CASE WHEN original_currency IS NOT NULL THEN {_two('original_amount')} ELSE {_two('line_amount_usd')} END"
_label = lambda k: "CASE expense_type " + " ".join(f"WHEN '{r[0]}' THEN '{r[k]}'" for r in catalog.EXPENSE_LABELS) + " END"
JOBS = "job_events AS (SELECT user_id AS job_id, CASE event_type WHEN 'signup' THEN 'extract' WHEN 'view' THEN 'reduce' WHEN 'click' THEN 'fx' WHEN 'purchase' THEN 'done' ELSE 'error' END AS phase, ts, event_id FROM events)"
KEYS = "keys AS (SELECT DISTINCT upper(trim(original_currency)) AS currency, CAST(date_text AS DATE) AS day FROM lines WHERE original_currency IS NOT NULL)"
ASOF = f"{LINES}, {FX}, {KEYS}, asof_ AS (SELECT k.currency, k.day, max_by(f.usd_per_unit, f.rate_date) AS usd_per_unit FROM keys k LEFT JOIN fx f ON f.currency = k.currency AND f.rate_date <= k.day GROUP BY 1, 2)"
ENRICHED = f"""{ASOF}, enriched AS (SELECT l.*, CASE WHEN original_currency IS NULL OR original_amount IS NULL THEN 'skipped' WHEN usd_per_unit IS NULL THEN 'failed' ELSE 'fetched' END AS fx_status,
 CASE WHEN original_currency IS NOT NULL AND original_amount IS NOT NULL THEN usd_per_unit END AS fx_rate FROM lines l LEFT JOIN asof_ a ON a.currency = l.original_currency AND a.day = CAST(l.date_text AS DATE))"""
_codes = "USD|EUR|GBP|JPY|CNY|INR|SGD|AUD|CAD|HKD|CHF|NZD|SEK|NOK|DKK|MXN|ZAR|KRW|THB|MYR|IDR|PHP|VND|BRL|ARS|TWD|AED|SAR"
_norm = lambda c: f"lower(trim(regexp_replace(translate(regexp_replace({c}, '[$₹€£¥]|\\b({_codes})\\b', '', 'g'), ':;,()[]{{}}<>''\"!?\\|*+=&^~`-/%', '{' ' * 29}'), '\\s+', ' ', 'g')))"

ORACLE = {
    "A01": f"WITH {LINES} SELECT report_id, coalesce({_money('line_amount_usd')}, 0.0) AS total_usd FROM lines GROUP BY 1",
    "A03": f"WITH {ENRICHED} SELECT report_id, coalesce({_money('coalesce(CAST(round(CAST(original_amount * fx_rate AS DECIMAL(24,6)), 2) AS DOUBLE), line_amount_usd)')}, 0.0) AS total_usd, count(*) FILTER (fx_status = 'fetched') AS n_fetched, count(*) FILTER (fx_status = 'skipped') AS n_skipped, count(*) FILTER (fx_status = 'failed') AS n_failed FROM enriched GROUP BY 1",
    "A05": f"WITH {LINES} SELECT report_id, min(date_text) AS earliest_date FROM lines GROUP BY 1",
    "A06": f"WITH {ROLLUP} SELECT inferred_category, category_confidence, count(*) AS n FROM rollup_ GROUP BY 1, 2",
    "A09": f"WITH {ROLLUP} SELECT * FROM rollup_",
    "A11": f"WITH {DERIVED}, k AS (SELECT report_id, {_kind} AS kind, {_money('amount_usd')} AS spend FROM derived GROUP BY 1, 2), p AS (SELECT * FROM k WHERE spend > 0) SELECT report_id, kind, CAST(list_position({list(catalog.KINDS)}, kind) - 1 AS INT) AS kind_no, spend, round(spend / CAST(round(sum(CAST(spend AS DECIMAL(24,2))) OVER (PARTITION BY report_id), 2) AS DOUBLE) * 100, 4) AS share_pct FROM p",
    "A12": f"WITH {ROUTED} SELECT report_id, count(*) FILTER (NOT is_foreign) AS n_domestic, count(*) FILTER (is_foreign) AS n_foreign FROM routed GROUP BY 1",
    "A13": f"WITH {LINES} SELECT report_id, count(*) FILTER (confidence = 'high') AS n_high, count(*) FILTER (confidence = 'medium') AS n_medium, count(*) FILTER (confidence = 'low') AS n_low FROM lines GROUP BY 1",
    "A14": f"WITH {ALL} SELECT report_id, CASE kind WHEN 'MissingRequiredField' THEN 'Missing' WHEN 'ManualReviewRequired' THEN 'Needs review' ELSE 'Other' END AS bucket, count(*) AS n FROM issues GROUP BY 1, 2",
    "A16": f"WITH {ALL}, n AS (SELECT report_id, count(*) AS n FROM lines GROUP BY 1), i AS (SELECT report_id, count(*) AS n, count(*) FILTER (severity = 'error') AS e FROM issues GROUP BY 1) SELECT report_id, coalesce(n.n, 0) AS n_lines, coalesce(i.n, 0) AS n_issues, coalesce(i.e, 0) AS n_errors, coalesce(i.e, 0) > 0 AS has_errors, CASE WHEN coalesce(i.n, 0) = 0 THEN 'ready to file' ELSE concat(CAST(i.n AS VARCHAR), ' to review') END AS status FROM reports LEFT JOIN n USING (report_id) LEFT JOIN i USING (report_id)",
    "A18": f"WITH {JOBS} SELECT job_id, count(*) FILTER (phase = 'done') AS n_done, count(*) FILTER (phase = 'error') AS n_failed, count(*) AS n_total, count(*) FILTER (phase = 'done') = 0 AND count(*) FILTER (phase = 'error') > 0 AS all_failed FROM job_events GROUP BY 1",
    "A19": f"WITH {JOBS}, s AS (SELECT job_id, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS seconds, count(*) AS n FROM job_events GROUP BY 1) SELECT job_id, seconds, round(seconds / greatest(1, n), 3) AS seconds_per_update FROM s",
    "W07": f"WITH {JOBS} SELECT job_id, max_by(phase, (ts, event_id)) AS phase, count(*) AS n_updates FROM job_events GROUP BY 1",
    "P02": f"WITH {LINES} SELECT {_kind} AS kind, original_currency, count(*) AS n FROM lines GROUP BY 1, 2",
    "P03": f"WITH {ROUTED} SELECT report_id, line_idx, is_foreign, line_no FROM routed",
    "P04": f"WITH {LINES} SELECT expense_type, bool_or(expense_type LIKE '%\\_foreign' ESCAPE '\\') AS is_foreign, count(*) AS n FROM lines GROUP BY 1",
    "J05": f"WITH {DERIVED} SELECT report_id, line_idx, round(usd_per_mile, 4) AS usd_per_mile, round(round(distance_miles * usd_per_mile * 100) / 100, 2) AS amount FROM derived WHERE distance_miles IS NOT NULL",
    "J06": f"WITH {DERIVED} SELECT report_id, line_idx, CAST(rate AS DOUBLE) AS exchange_rate, round(amount_usd, 4) AS amount_usd, by_rate AS needs_review FROM derived WHERE by_rate",
    "J07": f"WITH {ASOF} SELECT currency, CAST(day AS VARCHAR) AS day, usd_per_unit FROM asof_",
    "J07_range": f"WITH {ASOF} SELECT currency, CAST(day AS VARCHAR) AS day, usd_per_unit FROM asof_",
    "J10": f"WITH {LINES}, {NAMES} SELECT {_display} AS currency_display, count(*) AS n FROM lines LEFT JOIN dim_currency ON code = coalesce(original_currency, 'USD') GROUP BY 1",
    "D01": f"WITH {DERIVED} SELECT report_id, line_idx, round(amount_usd, 4) AS amount_usd, CASE WHEN by_rate THEN 'placeholder_fx' WHEN line_amount_usd IS NULL AND distance_miles IS NOT NULL THEN 'mileage_rate' END AS origin, CASE WHEN by_rate THEN 'medium' ELSE confidence END AS amount_confidence, by_rate AS needs_review FROM derived",
    "D05": f"WITH {ENRICHED} SELECT report_id, line_idx, fx_status, fx_rate FROM enriched",
    "V01": f"WITH {REPORTS} {V01} UNION ALL {SUMMARY}",
    "V02": f"WITH {LINES} {V02}",
    "V03": f"WITH {LINES} {V03}",
    "V04": f"WITH {LINES}, {REPORTS} {V04}",
    "V05": f"WITH {LINES}, {REPORTS}, {WINDOWS} {V05}",
    "V06": f"WITH {LINES}, v AS ({V06}) SELECT report_id, line_idx, path, severity FROM v",
    "V07": f"WITH {LINES} {V07}",
    "V08": f"WITH {ALL} SELECT pass_no, severity, kind, count(*) AS n, count(DISTINCT report_id) AS n_reports FROM issues GROUP BY 1, 2, 3",
    "X01": f"WITH {ROUTED}, {NAMES} SELECT report_id, line_no AS line, {_portal} AS expense_date, {_display} AS expense_currency, {_amount} AS expense_amount, {_two('line_amount_usd')} AS usd_amount, {_label(1)} AS expense_type, '' AS remarks FROM routed LEFT JOIN dim_currency ON code = coalesce(original_currency, 'USD') WHERE NOT is_foreign",
    "X02": f"WITH {ROUTED}, {NAMES} SELECT report_id, line_no AS line, 'Expenses (Foreign)' AS category, {_portal} AS expense_date, {_display} AS expense_currency, {_amount} AS expense_amount, {_label(2)} AS expense_type, '' AS remarks, coalesce(country, '') AS country, '' AS activity_type, '' AS affiliation, '' AS traveler_id, '' AS traveler_name, '' AS ticket_number, '' AS travel_booking_method, '' AS airline, '' AS class_of_ticket, '' AS departure_airport, '' AS destination_airport, '' AS number_of_nights, '' AS location, CASE WHEN expense_type IN ('lodging_domestic','lodging_foreign') THEN 'No' ELSE '' END AS conference_hotel FROM routed LEFT JOIN dim_currency ON code = coalesce(original_currency, 'USD') WHERE is_foreign",
    "X03": f"WITH {LINES} SELECT report_id, line_idx, {_portal} AS expense_date, coalesce(original_currency, 'USD') AS currency, {_amount} AS expense_amount, {_two('line_amount_usd')} AS currency_amount, {_label(1)} AS expense_type, '' AS remarks FROM lines",
    "E01": "SELECT user_id AS report_id, event_type AS path, count(*) AS n_edits, round(max_by(value, (ts, event_id)), 6) AS value FROM events GROUP BY 1, 2",
    "E03": "WITH e AS (SELECT *, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS old, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id AS report_id, event_type AS path, event_id, round(old, 6) AS old_value FROM e WHERE k = 1",
    "W05": "WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age FROM events) SELECT user_id AS report_id, age, event_id, event_type AS path FROM e WHERE age <= 20",
    "W06": "WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations) SELECT conv_id, turn, age, role FROM c WHERE age <= 3",
    "K02": f"WITH {REPORTS} SELECT report_id AS upload_id, filer_id AS filed_by, when_text AS updated_at FROM reports ORDER BY when_text DESC NULLS LAST, report_id LIMIT 100",
    "E06": f"WITH {ROLLUP} SELECT filer_id, CAST(row_number() OVER (PARTITION BY filer_id ORDER BY when_text DESC NULLS LAST, report_id) AS BIGINT) AS place, report_id, n_lines, total_usd FROM reports JOIN rollup_ USING (report_id)",
    "F01": f"WITH {LINES} SELECT {_portal} AS shown, count(*) AS n FROM lines GROUP BY 1",
    "F02": f"WITH {REPORTS}, {WINDOWS} SELECT report_id, from_date, to_date, CAST(to_date AS DATE) - CAST(from_date AS DATE) + 1 AS days, CASE WHEN to_date >= from_date THEN CAST(to_date AS DATE) - CAST(from_date AS DATE) END AS nights FROM windows",
    "F07": f"WITH {LINES} SELECT report_id, line_idx, round({_cap}, 7) AS cap, {_precise} AS precise FROM lines WHERE {_cap} IS NOT NULL",
    "F09": f"WITH {LINES} SELECT report_id, line_idx, CASE WHEN original_amount IS NOT NULL THEN concat(CASE original_currency WHEN 'EUR' THEN '€' WHEN 'GBP' THEN '£' WHEN 'JPY' THEN '¥' WHEN 'INR' THEN '₹' ELSE concat(original_currency, ' ') END, printf('%.2f', original_amount)) WHEN line_amount_usd IS NOT NULL THEN concat('$', printf('%.2f', line_amount_usd)) END AS shown FROM lines",
    "F11": f"WITH {LINES} SELECT array_to_string([concat(upper(w[1]), w[2:]) for w in string_split(expense_type, '_')], ' ') AS title, count(*) AS n FROM lines GROUP BY 1",
    "F15": "SELECT page_id, lower(regexp_replace(url, '[^A-Za-z0-9]', '-', 'g')) AS anchor FROM pages",
    "F24": "WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN url || '/' WHEN 2 THEN url || '/re ç(' || page_id || ').pdf' ELSE '' END AS raw FROM pages) SELECT page_id, coalesce(nullif(regexp_replace(string_split(rtrim(raw, '/'), '/')[-1], '[^A-Za-z0-9._-]+', '_', 'g'), ''), 'upload') AS name, regexp_full_match(url, '[A-Za-z0-9_-]+') AS is_id FROM pages JOIN p USING (page_id)",
    "F25": f"SELECT item_id, {_norm('text')} AS norm FROM benchmark",
    "J15": "SELECT CASE WHEN l.doc_id IS NULL THEN 'missing path' WHEN CAST(l.quality AS INT) = CASE WHEN d.n_chars > 200 THEN 1 ELSE 0 END THEN 'pass' ELSE 'failed' END AS outcome, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1",
    "J17": "SELECT 'toxic' AS path, 'DROPPED' AS difference, count(*) AS n FROM labels UNION ALL SELECT 'quality', 'VALUE', count(*) FROM labels WHERE quality <> toxic",
    "J19": f"WITH b AS (SELECT item_id, {_norm('text')} AS q FROM benchmark), d AS (SELECT doc_id, {_norm('text')} AS t FROM documents) SELECT item_id AS evidence_id, doc_id, CAST((length(t) - length(replace(t, q, ''))) / length(q) AS BIGINT) AS n_found FROM b JOIN d ON contains(t, q)",
}
