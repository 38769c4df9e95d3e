"""Further registered queries of the expense domain, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reckoner.functions import scalars as S
from reckoner.operators import edits, fx, grounding, intake, jobs, quality, reduce, store, validate
from reckoner.plans import oracle as O
from reckoner.plans.queries import derived
from reckoner.sources import catalog
from reckoner.sources import views as V

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return add


@query("A02", f"WITH {O.DERIVED} SELECT report_id, coalesce({O._money('amount_usd')}, 0.0) AS total_usd FROM derived GROUP BY 1")
def derived_total(spark: SparkSession, d: str) -> DataFrame:
    return derived(spark, d).groupBy("report_id").agg(F.coalesce(reduce.money(F.col("amount_usd")), F.lit(0.0)).alias("total_usd"))


@query("A07", f"WITH {O.LINES} SELECT report_id, {O._name('min(' + O._rank + ')')} AS floor FROM lines GROUP BY 1")
def floors(spark: SparkSession, d: str) -> DataFrame:
    return V.lines(spark, d).groupBy("report_id").agg(S.confidence_name(F.min(S.confidence_rank(F.col("confidence")))).alias("floor"))


@query("A15", f"WITH {O.ALL} SELECT report_id, bool_or(severity = 'error') AS has_errors, bool_or(severity = 'warning') AS has_warnings FROM issues GROUP BY 1")
def severities(spark: SparkSession, d: str) -> DataFrame:
    issues = validate.all_issues(V.reports(spark, d), V.lines(spark, d))
    return issues.groupBy("report_id").agg(F.bool_or(F.col("severity") == "error").alias("has_errors"), F.bool_or(F.col("severity") == "warning").alias("has_warnings"))


@query("A23", f"WITH {O.ENRICHED} SELECT fx_status, count(*) AS n FROM enriched GROUP BY 1")
def fx_statuses(spark: SparkSession, d: str) -> DataFrame:
    return fx.enrich(V.lines(spark, d), V.fx_rates(spark, d)).groupBy("fx_status").agg(F.count("*").alias("n"))


@query("A26", f"WITH {O.REPORTS} SELECT report_id, concat_ws('; ', concat('Category: ' || category), 'When: ' || when_text) AS purpose FROM reports")
def purposes(spark: SparkSession, d: str) -> DataFrame:
    """Labelled fields in order, missing ones skipped."""
    parts = [F.concat(F.lit(f"{label}: "), F.col(c)) for label, c in (("Category", "category"), ("When", "when_text"))]
    return V.reports(spark, d).select("report_id", F.array_join(F.array_compact(F.array(*parts)), "; ").alias("purpose"))


@query("J03", f"WITH {O.REPORTS} SELECT report_id, CASE WHEN filer_id % 3 = 0 THEN 'relocation' ELSE category END AS category, when_text FROM reports")
def overlaid(spark: SparkSession, d: str) -> DataFrame:
    reports = V.reports(spark, d)
    form = reports.where("filer_id % 3 = 0").select("report_id", F.lit("relocation").alias("category"), F.lit(None).cast("string").alias("when_text"))
    return reduce.overlay_form(reports, form, ["category", "when_text"]).select("report_id", "category", "when_text")


@query("J04", f"WITH {O.LINES}, {O.REPORTS} SELECT report_id, line_idx, CASE WHEN suffix(expense_type, '_foreign') THEN category END AS foreign_activity_type FROM lines LEFT JOIN reports USING (report_id)")
def activities(spark: SparkSession, d: str) -> DataFrame:
    reports = V.reports(spark, d).withColumnRenamed("category", "foreign_activity_type")
    return reduce.propagate_activity(V.lines(spark, d), reports).select("report_id", "line_idx", "foreign_activity_type")


@query("F08", f"WITH {O.REPORTS}, {O.WINDOWS} SELECT report_id, greatest(1, CAST(to_date AS DATE) - CAST(from_date AS DATE) + 1) * 350 AS cap FROM windows WHERE from_date IS NOT NULL")
def mileage_caps(spark: SparkSession, d: str) -> DataFrame:
    w = S.when_window(F.col("when_text"))
    return V.reports(spark, d).where(w.isNotNull()).select("report_id", S.mileage_cap(S.days_inclusive(w["start"], w["end"])).alias("cap"))


@query("F17", f"WITH {O.ALL} SELECT regexp_replace(path, '\\[[0-9]+\\]', '[]', 'g') AS template, count(*) AS n FROM issues GROUP BY 1")
def templates(spark: SparkSession, d: str) -> DataFrame:
    issues = validate.all_issues(V.reports(spark, d), V.lines(spark, d))
    return issues.groupBy(S.path_template(F.col("path")).alias("template")).agg(F.count("*").alias("n"))


@query("F19", "SELECT event_type, CASE WHEN event_type IN ('yes','true','1','y','t') THEN true WHEN event_type IN ('no','false','0','n','f') THEN false END AS value, event_type NOT IN ('yes','true','1','y','t','no','false','0','n','f') AS error, count(*) AS n FROM events GROUP BY ALL")
def booleans(spark: SparkSession, d: str) -> DataFrame:
    c = S.coerce_bool(F.col("event_type"))
    return V.read(spark, d, "events").groupBy("event_type", c["value"].alias("value"), c["error"].alias("error")).agg(F.count("*").alias("n"))


@query("F20", "SELECT event_id, value AS number, false AS error FROM events")
def numbers(spark: SparkSession, d: str) -> DataFrame:
    c = S.coerce_number(F.concat(F.lit(" $"), F.col("value").cast("string")))
    return V.read(spark, d, "events").select("event_id", c["value"].alias("number"), c["error"].alias("error"))


@query("F22", f"WITH {O.LINES} SELECT expense_type, CASE WHEN expense_type NOT IN {O._in(catalog.ALWAYS_FOREIGN + catalog.ALWAYS_DOMESTIC)} THEN 'must be one of: airfare_foreign, gift_card_employee_foreign, gifts_foreign_activity, ground_transportation_foreign, lodging_foreign, … (8 total)' END AS message, count(*) AS n FROM lines GROUP BY 1, 2")
def enums(spark: SparkSession, d: str) -> DataFrame:
    allowed = F.array(*[F.lit(x) for x in catalog.ALWAYS_FOREIGN + catalog.ALWAYS_DOMESTIC])
    return V.lines(spark, d, country=False).groupBy("expense_type").agg(F.count("*").alias("n")).withColumn("message", S.validate_enum(F.col("expense_type"), allowed))


@query("F23", f"WITH {O.LINES}, t AS (SELECT report_id, line_idx, [' Research Collaboration', 'FIELDWORK ', 'other', 'Conf erence', 'Yes', ' no'][1 + report_id % 6] AS said FROM lines) SELECT report_id, line_idx, CASE said WHEN ' Research Collaboration' THEN 'research_collaboration' WHEN 'FIELDWORK ' THEN 'fieldwork' WHEN 'other' THEN 'other' END AS activity, CASE said WHEN 'Yes' THEN 'yes' WHEN ' no' THEN 'no' END AS rush, CASE said WHEN 'other' THEN 'other' END AS affiliation FROM t")
def normal_enums(spark: SparkSession, d: str) -> DataFrame:
    texts = F.array(*[F.lit(x) for x in (" Research Collaboration", "FIELDWORK ", "other", "Conf erence", "Yes", " no")])
    said = F.get(texts, (F.col("report_id") % 6).cast("int"))
    return V.lines(spark, d, country=False).select(
        "report_id", "line_idx", S.normalize_enum(said, S.ACTIVITY_CODES).alias("activity"), S.normalize_enum(said, S.RUSH_CODES).alias("rush"), S.normalize_enum(said, S.affiliation_codes("institute")).alias("affiliation")
    )


@query("F14", f"WITH {O.ALL} SELECT label, count(*) AS n FROM (SELECT CASE WHEN suffix(path, 'general_information.category') THEN 'Category' WHEN suffix(path, 'payee.name') THEN 'Payee: Name' WHEN suffix(path, 'business_purpose.when') THEN 'Business Purpose: When' WHEN suffix(path, 'payment_method') THEN 'Payment Method' WHEN suffix(path, 'event_name') THEN 'Event Name' WHEN suffix(path, 'transaction_date') THEN 'Trip Date' WHEN suffix(path, 'total_usd') THEN 'Total USD' ELSE concat('Line ', line_idx + 1, ': ', CASE string_split(path, '.')[-1] WHEN 'country_of_activity' THEN 'Country Of Activity' WHEN 'date' THEN 'Date' WHEN 'tip_amount' THEN 'Tip Amount' WHEN 'miles_driven' THEN 'Miles Driven' WHEN 'original_currency' THEN 'Original Currency' WHEN 'original_amount' THEN 'Original Amount' WHEN 'exchange_rate' THEN 'Exchange Rate' WHEN 'foreign_activity_type' THEN 'Foreign Activity Type' END) END AS label FROM issues) GROUP BY 1")
def labels(spark: SparkSession, d: str) -> DataFrame:
    issues = validate.all_issues(V.reports(spark, d), V.lines(spark, d))
    return issues.groupBy(S.friendly_label(F.col("path")).alias("label")).agg(F.count("*").alias("n"))


@query("F16", f"WITH {O.DERIVED} SELECT text, count(*) AS n FROM (SELECT CASE WHEN by_rate THEN 'converted via mock FX rate (placeholder; real-time tool TBD)' WHEN expense_type LIKE 'lodging%' THEN 'average of per-night rates' END AS text FROM derived) GROUP BY 1")
def origins(spark: SparkSession, d: str) -> DataFrame:
    code = F.when(F.col("origin") == "placeholder_fx", "reduce.fx.mock").when(F.startswith("expense_type", F.lit("lodging")), "reduce.lodging.daily_rate").otherwise("not_present_in_receipt")
    return derived(spark, d).groupBy(S.origin_text(code).alias("text")).agg(F.count("*").alias("n"))


_says = "CASE WHEN line_idx % 3 = 0 THEN NULL WHEN line_idx % 3 = 1 THEN 'Name ' || report_id ELSE '' END"


@query("F13", f"WITH {O.LINES}, s AS (SELECT report_id, line_idx, {O._kind} AS kind, {_says} AS said, report_id % 2 = 0 AS both_ways FROM lines) SELECT report_id, line_idx, CASE kind WHEN 'meal' THEN coalesce(nullif(said, ''), '(no venue)') WHEN 'transport' THEN coalesce(nullif(said, ''), '(no service provider)') WHEN 'lodging' THEN coalesce(nullif(said, ''), '(no hotel name)') WHEN 'conference' THEN coalesce(nullif(said, ''), '(conference)') WHEN 'airfare' THEN CASE WHEN said <> '' THEN said || ' BOM' || CASE WHEN both_ways THEN '↔' ELSE '→' END || 'SFO' ELSE '(airfare)' END WHEN 'ancillary' THEN CASE WHEN said <> '' THEN said || ' — Checked Bag fee' ELSE '(ancillary fee)' END ELSE '—' END AS headline FROM s")
def headlines(spark: SparkSession, d: str) -> DataFrame:
    """Lines whose names are there, missing or empty in turn."""
    kind = F.coalesce(F.try_element_at(catalog.literal_map(catalog.KIND_OF_TYPE), F.col("expense_type")), F.lit("other"))
    said = F.when(F.col("line_idx") % 3 == 1, F.concat(F.lit("Name "), F.col("report_id").cast("string"))).when(F.col("line_idx") % 3 == 2, "")
    text = S.line_headline(kind, said, said, said, F.lit("BOM"), F.lit("SFO"), F.col("report_id") % 2 == 0, said, said, F.lit("checked_bag"))
    return V.lines(spark, d, country=False).select("report_id", "line_idx", text.alias("headline"))


@query("D02", f"WITH {O.LINES} SELECT report_id, line_idx, round(list_avg(nightly_rates), 6) AS daily_rate, CASE WHEN len(nightly_rates) > 0 THEN 'high' END AS daily_rate_confidence, CASE WHEN check_out_date >= check_in_date THEN date_diff('day', CAST(check_in_date AS DATE), CAST(check_out_date AS DATE)) END AS number_of_nights FROM lines WHERE expense_type LIKE 'lodging%'")
def lodging(spark: SparkSession, d: str) -> DataFrame:
    lines = V.lines(spark, d, country=False).where(F.startswith("expense_type", F.lit("lodging")))
    return reduce.derive_lodging(lines).select("report_id", "line_idx", F.round("daily_rate", 6).alias("daily_rate"), "daily_rate_confidence", "number_of_nights")


# The same as a table of letters would give: SQL has no matching blocks, so equal texts and
# texts without a common letter stand here, and tests compare others with a plain version.
@query("F26", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1.0 WHEN doc_id % 3 = 1 THEN 0.0 ELSE 2 * 9 / (2 * 9 + 3) END::DOUBLE AS likeness FROM documents")
def likenesses(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("item "), F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "0"))
    other = F.when(F.col("doc_id") % 3 == 0, text).when(F.col("doc_id") % 3 == 1, "xyz").otherwise(F.concat(text, F.lit("xyz")))
    return V.read(spark, d, "documents").select("doc_id", S.similarity(text, other).alias("likeness"))


@query("F28", "SELECT doc_id, length(CASE WHEN contains(text, '\"') OR contains(text, ',') OR contains(text, chr(10)) OR contains(text, chr(13)) THEN '\"' || replace(text, '\"', '\"\"') || '\"' ELSE text END) AS n_chars FROM documents")
def csv_fields(spark: SparkSession, d: str) -> DataFrame:
    return V.read(spark, d, "documents").select("doc_id", F.length(S.csv_field(F.col("text"))).cast("long").alias("n_chars"))


@query("P09", f"WITH {O.REPORTS} SELECT report_id, coalesce(regexp_full_match(when_text, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}'), false) AS is_date FROM reports")
def iso_dates(spark: SparkSession, d: str) -> DataFrame:
    return V.reports(spark, d).select("report_id", F.coalesce(S.is_iso_date(F.col("when_text")), F.lit(False)).alias("is_date"))


@query("U03", "SELECT event_type AS template, min(event_id) AS first_pos FROM events GROUP BY 1")
def first_paths(spark: SparkSession, d: str) -> DataFrame:
    return quality.first_seen(V.read(spark, d, "events").select(F.col("event_id").alias("pos"), F.col("event_type").alias("path")))


@query("U05", "SELECT DISTINCT event_type AS member FROM events WHERE event_type <> 'view' AND event_type NOT IN (SELECT event_type FROM events WHERE event_id % 7 = 3 AND event_type = 'click')")
def unknown(spark: SparkSession, d: str) -> DataFrame:
    """Types in use, many times each, against a master list that has some of them once."""
    used = V.read(spark, d, "events").select(F.col("event_type").alias("member"), "event_id")
    master = used.where("event_id % 7 = 3 and member = 'click'").select("member").distinct()
    return quality.unknown_members(used, master.union(spark.createDataFrame([("view",)], "member string")))


@query("E04", f"WITH {O.LINES} SELECT report_id, CAST(row_number() OVER (PARTITION BY report_id ORDER BY line_idx) - 1 AS BIGINT) AS line_idx, expense_type FROM lines WHERE NOT (report_id % 2 = 0 AND line_idx = 0)")
def without_first_line(spark: SparkSession, d: str) -> DataFrame:
    lines = V.lines(spark, d)
    left, _ = edits.delete_lines(lines, lines.where("report_id % 2 = 0 and line_idx = 0"))
    return left.select("report_id", "line_idx", "expense_type")


@query("A04", f"WITH {O.DERIVED}, {O.REPORTS}, t AS (SELECT report_id, {O._money('amount_usd')} AS s, min(date_text) AS m FROM derived WHERE line_idx > 0 GROUP BY 1) SELECT report_id, coalesce(s, -1.0) AS total_usd, coalesce(m, 'none') AS earliest_date FROM reports LEFT JOIN t USING (report_id)")
def recomputed(spark: SparkSession, d: str) -> DataFrame:
    old = V.reports(spark, d).select("report_id", F.lit(-1.0).alias("total_usd"), F.lit("none").alias("earliest_date"))
    return edits.summaries(derived(spark, d).where("line_idx > 0"), old)


@query("U01", f"WITH {O.LINES}, f AS (SELECT report_id, line_idx, expense_type AS stem FROM lines), fresh AS (SELECT DISTINCT report_id, stem FROM f WHERE line_idx = 0) SELECT report_id, stem || '.pdf' AS source_filename FROM f WHERE (report_id, stem) NOT IN (SELECT (report_id, stem) FROM fresh) UNION ALL SELECT report_id, stem || '.png' FROM f WHERE line_idx = 0")
def added(spark: SparkSession, d: str) -> DataFrame:
    lines = V.lines(spark, d)
    named = lambda df, end: df.select("report_id", F.concat("expense_type", F.lit(end)).alias("source_filename"))
    return store.add_receipts(named(lines, ".pdf"), named(lines.where("line_idx = 0"), ".png"))


_w04 = """f AS (SELECT report_id AS upload_id, line_idx AS seq, CASE line_idx % 3 WHEN 0 THEN 'bill.pdf' WHEN 1 THEN 'bill_2.pdf' ELSE expense_type || '.pdf' END AS name FROM lines),
r AS (SELECT upload_id, seq, name AS unique_name, [name] AS seen FROM f WHERE seq = 0 UNION ALL
 SELECT upload_id, seq, u, list_append(seen, u) FROM (SELECT f.upload_id, f.seq, r.seen, CASE WHEN NOT list_contains(r.seen, f.name) THEN f.name
  ELSE list_filter(list_transform(range(2, 99), lambda k: replace(f.name, '.pdf', '_' || k || '.pdf')), lambda c: NOT list_contains(r.seen, c))[1] END AS u FROM r JOIN f ON f.upload_id = r.upload_id AND f.seq = r.seq + 1))"""


@query("W04", f"WITH RECURSIVE {O.LINES}, {_w04} SELECT upload_id, seq, unique_name FROM r")
def suffixes(spark: SparkSession, d: str) -> DataFrame:
    """Files of which some repeat a name, and some have the name that a repeated one would get."""
    name = F.when(F.col("line_idx") % 3 == 0, "bill.pdf").when(F.col("line_idx") % 3 == 1, "bill_2.pdf").otherwise(F.concat("expense_type", F.lit(".pdf")))
    files = V.lines(spark, d, country=False).select(F.col("report_id").alias("upload_id"), F.col("line_idx").alias("seq"), name.alias("name"))
    return store.with_collision_suffix(files).select("upload_id", "seq", "unique_name")


@query("T05", "WITH e AS (SELECT user_id, event_type, ts, event_id FROM events), s AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e WHERE event_type = 'view'), f AS (SELECT user_id, ts, event_type = 'click' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e WHERE event_type IN ('purchase', 'click')) SELECT s.user_id AS label, CAST(s.k AS BIGINT) AS turn, f.failed, CAST(floor(epoch(f.ts)) - floor(epoch(s.ts)) AS BIGINT) AS seconds FROM s LEFT JOIN f ON s.user_id = f.user_id AND s.k = f.k")
def pairs(spark: SparkSession, d: str) -> DataFrame:
    names = F.when(F.col("event_type") == "view", "subprocess.start").when(F.col("event_type") == "purchase", "subprocess.done").when(F.col("event_type") == "click", "subprocess.fail")
    log = V.read(spark, d, "events").select(F.col("user_id").alias("label"), F.lit("file").alias("filename"), names.alias("event"), "ts")
    return jobs.paired(log).select("label", F.col("turn").cast("long").alias("turn"), "failed", "seconds")


@query("K03", "SELECT doc_id AS document_id, path, difference, place FROM (SELECT doc_id, 'quality' AS path, 'VALUE' AS difference, CAST(row_number() OVER (ORDER BY doc_id) AS BIGINT) AS place FROM labels WHERE quality <> toxic) WHERE place <= 20 UNION ALL SELECT * FROM (SELECT doc_id, 'toxic' AS path, 'DROPPED' AS difference, CAST(row_number() OVER (ORDER BY doc_id) AS BIGINT) AS place FROM labels) WHERE place <= 20")
def first_mismatches(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 differences of each class, by top-k of each class and path."""
    labels = V.read(spark, d, "labels")
    pair = lambda c, x: F.struct(F.lit(c).alias("path"), x.cast("string").alias("value"))
    left = labels.select(F.col("doc_id").alias("document_id"), F.inline(F.array(pair("quality", F.col("quality")), pair("toxic", F.col("toxic")))))
    right = labels.select(F.col("doc_id").alias("document_id"), F.inline(F.array(pair("quality", F.col("toxic")))))
    diff = quality.tree_diff(left, right).select("document_id", "path", "difference")
    parts = [diff.where((F.col("path") == p) & (F.col("difference") == k)).orderBy("document_id").limit(20) for p, k in (("quality", "VALUE"), ("toxic", "DROPPED"))]
    top = parts[0].unionByName(parts[1])
    from pyspark.sql import Window

    return top.withColumn("place", F.row_number().over(Window.partitionBy("path").orderBy("document_id")).cast("long"))


@query("G02", "WITH w AS (SELECT item_id, unnest(string_split(text, ' ')) AS t FROM benchmark) SELECT item_id AS doc_id, count(*) AS n_tokens, count(*) AS last_id FROM w WHERE trim(t) <> '' GROUP BY 1")
def token_numbers(spark: SparkSession, d: str) -> DataFrame:
    words = V.read(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(0).alias("page"), F.posexplode(F.split("text", " ")).alias("pos", "text"))
    at = F.col("pos").cast("double")
    boxed = words.withColumn("box", F.array(at, F.lit(0.0), at + 1, F.lit(1.0)))
    return grounding.number_tokens(boxed).groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.max("token_id").alias("last_id"))


@query("O04", f"WITH {O.REPORTS}, {O.WINDOWS}, e AS (SELECT report_id, unnest(generate_series(CAST(from_date AS DATE), CAST(to_date AS DATE), INTERVAL 1 DAY)) AS day FROM windows WHERE from_date IS NOT NULL) SELECT report_id, CAST(month(day) AS INT) AS month_no, count(*) AS n_days FROM e GROUP BY 1, 2")
def per_diem_days(spark: SparkSession, d: str) -> DataFrame:
    """Days of each report's window, one row a day, counted by month."""
    w = S.when_window(F.col("when_text"))
    days = V.reports(spark, d).where(w.isNotNull()).select("report_id", F.explode(F.sequence(F.to_date(w["start"]), F.to_date(w["end"]))).alias("day"))
    return days.groupBy("report_id", F.month("day").alias("month_no")).agg(F.count("*").alias("n_days"))


@query("A24", "WITH o AS (SELECT d.doc_id, coalesce(CAST(l.quality AS INT) <> CASE WHEN d.n_chars > 200 THEN 1 ELSE 0 END, true) AS failed FROM documents d LEFT JOIN labels l USING (doc_id)) SELECT doc_id AS document_id, count(*) FILTER (failed) AS n_failed, count(*) AS n_checked FROM o GROUP BY ROLLUP (doc_id)")
def failed(spark: SparkSession, d: str) -> DataFrame:
    labels, docs = V.read(spark, d, "labels"), V.read(spark, d, "documents")
    expected = docs.select(F.col("doc_id").alias("document_id"), F.lit("quality").alias("path"), F.lit("eq").alias("op"), F.when(F.col("n_chars") > 200, "1").otherwise("0").alias("value"))
    found = labels.select(F.col("doc_id").alias("document_id"), F.lit("quality").alias("path"), F.col("quality").cast("string").alias("value"))
    return quality.failures(quality.expectations(expected, found))


@query("A25", "SELECT CASE event_id % 6 WHEN 0 THEN 'PASS' WHEN 1 THEN 'WALK' WHEN 2 THEN 'COERCE' WHEN 3 THEN 'ENUM' WHEN 4 THEN 'RENDER' ELSE 'OTHER' END AS class, count(*) AS n FROM events GROUP BY 1")
def edit_classes(spark: SparkSession, d: str) -> DataFrame:
    k = (F.col("event_id") % 6).cast("int")
    status = F.get(F.array(*[F.lit(x) for x in (200, 400, 400, 400, 500, 404)]), k)
    body = F.get(F.array(*[F.lit(x) for x in ("path and type", "path did not resolve", "must be yes or no", "must be one of: a", "render failed: path", "must be a number")]), k)
    return quality.audit_counts(V.read(spark, d, "events").select(status.alias("status"), body.alias("body")))


@query("L01", "SELECT event_id AS document_id, '$.k' AS path, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def json_leaves(spark: SparkSession, d: str) -> DataFrame:
    return quality.leaves(V.read(spark, d, "events").select(F.col("event_id").alias("document_id"), F.col("props").alias("json"))).select("document_id", "path", "value")


_typed = "WITH e AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL)"


@query("J17_typed", f"{_typed} SELECT difference, count(*) AS n FROM (SELECT CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'TYPE' WHEN 2 THEN 'VALUE' WHEN 3 THEN 'NULL MISMATCH' WHEN 4 THEN 'DROPPED' ELSE 'ARRAY LENGTH' END AS difference FROM e UNION ALL SELECT 'ADDED' FROM e WHERE event_id % 6 = 4) WHERE difference IS NOT NULL GROUP BY 1")
def json_diff(spark: SparkSession, d: str) -> DataFrame:
    """Trees of the events' properties, changed in one way for each event."""
    events = V.read(spark, d, "events").select(F.col("event_id").alias("document_id"), F.get_json_object("props", "$.k").alias("k")).where("k is not null")
    way = (F.col("document_id") % 6).cast("int")
    tree = lambda *parts: F.concat(*[F.lit(p) if p != "k" else F.col("k") for p in parts])
    left = F.when(way == 5, tree('{"a": [', "k", ", 1]}")).otherwise(tree('{"a": ', "k", "}"))
    ways = (tree('{"a": ', "k", ".0}"), tree('{"a": "', "k", '"}'), tree('{"a": 1', "k", "}"), tree('{"a": null}'), tree('{"b": ', "k", "}"), tree('{"a": [', "k", "]}"))
    right = F.get(F.array(*ways), way)
    a, b = (quality.leaves(events.select("document_id", c.alias("json"))) for c in (left, right))
    return quality.tree_diff(a, b).groupBy("difference").agg(F.count("*").alias("n"))


@query("T06", "SELECT event_type AS filename, CAST(user_id AS VARCHAR) AS label, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS input_tokens, CAST(sum(event_id % 10) AS BIGINT) AS output_tokens, count(*) AS n_calls FROM events GROUP BY 1, 2")
def token_usage(spark: SparkSession, d: str) -> DataFrame:
    log = V.read(spark, d, "events").select(F.col("event_type").alias("filename"), F.col("user_id").cast("string").alias("label"), F.floor("value").alias("input_tokens"), (F.col("event_id") % 10).alias("output_tokens"))
    return jobs.usage(log)


_store = """WITH s AS (SELECT o_orderkey AS upload_id, 'old' AS report_json, 'form' AS fa_input, CASE WHEN o_custkey % 5 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS filed_by FROM orders WHERE o_orderkey % 3 <> 0),
b AS (SELECT o_orderkey AS upload_id, o_orderpriority AS report_json, CASE WHEN o_orderkey % 4 = 0 THEN 'new form' END AS fa_input, CASE WHEN o_custkey % 2 = 0 THEN 'batch' END AS filed_by FROM orders WHERE o_orderkey % 2 = 0)"""


@query("S24", f"{_store} SELECT coalesce(s.upload_id, b.upload_id) AS upload_id, coalesce(b.report_json, s.report_json) AS report_json, coalesce(b.fa_input, s.fa_input) AS fa_input, coalesce(b.filed_by, s.filed_by) AS filed_by, CASE WHEN s.upload_id IS NULL THEN '2026-02-01' ELSE '2026-01-01' END AS created, CASE WHEN b.upload_id IS NULL THEN '2026-01-01' ELSE '2026-02-01' END AS updated FROM s FULL JOIN b ON s.upload_id = b.upload_id")
def stored(spark: SparkSession, d: str) -> DataFrame:
    """A store of two thirds of the reports after a batch of half of them."""
    o = V.read(spark, d, "orders")
    at = lambda day: F.to_timestamp(F.lit(day))
    history = F.array().cast("array<string>").alias("history")
    old = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("upload_id"), F.lit("old").alias("report_json"), F.lit("form").alias("fa_input"), history, F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey").cast("string")).alias("filed_by"), at("2026-01-01").alias("created_at"), at("2026-01-01").alias("updated_at"), at("2026-04-01").alias("ttl"))
    batch = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("upload_id"), F.col("o_orderpriority").alias("report_json"), F.when(F.col("o_orderkey") % 4 == 0, "new form").alias("fa_input"), history, F.when(F.col("o_custkey") % 2 == 0, "batch").alias("filed_by"))
    after = store.upsert_reports(old, batch, at("2026-02-01"))
    day = lambda c: F.to_date(c).cast("string")
    return after.select("upload_id", "report_json", "fa_input", "filed_by", day("created_at").alias("created"), day("updated_at").alias("updated"))


@query("J18", "WITH w AS (SELECT item_id, list_filter(string_split(text, ' '), lambda x: trim(x) <> '') AS w FROM benchmark) SELECT item_id AS evidence_id, 0.0::DOUBLE AS x0, CAST(least(3, len(w)) AS DOUBLE) AS x1, array_to_string(w[1:3], ' ') AS claimed FROM w WHERE len(w) > 0")
def claimed_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The first three tokens of each benchmark passage, by their ids."""
    words = V.read(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(0).alias("page"), F.posexplode(F.filter(F.split("text", " "), lambda x: F.trim(x) != "")).alias("pos", "text"))
    at = F.col("pos").cast("double")
    tokens = grounding.number_tokens(words.withColumn("box", F.array(at, F.lit(0.0), at + 1, F.lit(1.0))))
    evidence = V.read(spark, d, "benchmark").select(F.col("item_id").alias("evidence_id"), F.col("item_id").alias("doc_id"), F.array(*[F.lit(k).cast("long") for k in (1, 2, 3)]).alias("token_ids"))
    found = grounding.by_token_ids(evidence, tokens)
    return found.select("evidence_id", F.get("box", F.lit(0)).alias("x0"), F.get("box", F.lit(2)).alias("x1"), "claimed")


@query("G01", "WITH w AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: trim(x) <> '')AS w FROM documents) SELECT doc_id AS evidence_id, 'tokens' AS how, 0.0::DOUBLE AS x0, 5.0::DOUBLE AS x1 FROM w WHERE len(w) >= 5")
def grounded(spark: SparkSession, d: str) -> DataFrame:
    """The first five tokens of every document's first page as evidence, by their ids."""
    page = V.read(spark, d, "documents").select("doc_id", F.filter(F.split("text", " "), lambda x: F.trim(x) != "").alias("w")).where("size(w) >= 5")
    words = page.select("doc_id", F.lit(0).alias("page"), F.posexplode(F.slice("w", 1, 40)).alias("pos", "text"))
    at = F.col("pos").cast("double")
    tokens = grounding.number_tokens(words.withColumn("box", F.array(at, F.lit(0.0), at + 1, F.lit(1.0))))
    quote = F.array_join(F.slice("w", 1, 5), " ")
    evidence = page.select(F.col("doc_id").alias("evidence_id"), "doc_id", F.lit(0).alias("page"), quote.alias("quote"), F.array(*[F.lit(k).cast("long") for k in range(1, 6)]).alias("token_ids"))
    found = grounding.ground(evidence, tokens)
    box = F.get("boxes", F.lit(0))
    return found.select("evidence_id", "how", F.get(box, F.lit(0)).alias("x0"), F.get(box, F.lit(2)).alias("x1"))


_e02 = """e AS (SELECT user_id AS report_id, 'expense_report.' || event_type AS path, event_type, event_id, ts FROM events),
c AS (SELECT *, CASE event_type WHEN 'view' THEN CAST(event_id AS VARCHAR) WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'true' END WHEN 'purchase' THEN 'note ' || event_id END AS v,
 CASE event_type WHEN 'click' THEN event_id % 2 = 0 WHEN 'view' THEN true WHEN 'purchase' THEN true ELSE false END AS good FROM e),
n AS (SELECT report_id, path, max_by(v, (ts, event_id)) AS v FROM c WHERE good GROUP BY 1, 2),
l AS (SELECT DISTINCT user_id AS report_id, 'expense_report.view' AS path, '0' AS value FROM events)"""


@query("E02", f"WITH {_e02} SELECT coalesce(n.report_id, l.report_id) AS report_id, coalesce(n.path, l.path) AS path, coalesce(v, l.value) AS value, n.path IS NOT NULL AS edited FROM n FULL JOIN l ON n.report_id = l.report_id AND n.path = l.path")
def edits_applied(spark: SparkSession, d: str) -> DataFrame:
    """Edits of number, boolean and text fields and of unknown ones, some of the wrong type."""
    events = V.read(spark, d, "events")
    said = F.when(F.col("event_type") == "view", F.concat(F.lit(" $"), "event_id")).when(F.col("event_type") == "click", F.when(F.col("event_id") % 2 == 0, "Yes").otherwise("maybe")).otherwise(F.concat(F.lit(" note "), "event_id"))
    e = events.select(F.col("user_id").alias("report_id"), F.concat(F.lit("expense_report."), "event_type").alias("path"), said.alias("new_text"), "ts", "event_id")
    leaves = events.select(F.col("user_id").alias("report_id"), F.lit("expense_report.view").alias("path"), F.lit("0").alias("value"), F.lit("number").alias("kind")).distinct()
    # The catalogue takes the first for text; its old value says number.
    types = spark.createDataFrame([("expense_report.view", "string", None), ("expense_report.click", "boolean", None), ("expense_report.purchase", "string", None)], "template string, type string, allowed array<string>")
    return edits.applied(e, leaves, types)[0]


_p06 = "f AS (SELECT page_id, 'f' || page_id || ['.pdf', '.PNG', '.tif', ''][1 + page_id % 4] AS name, [' meal', '', 'taxi'][1 + page_id % 3] AS kind, CASE WHEN page_id % 5 > 0 THEN 'Event' ELSE ' ' END AS event, CASE WHEN page_id % 7 > 0 THEN 'me' END AS payee FROM pages)"


@query("P06", f"WITH {_p06} SELECT page_id, name, CASE WHEN trim(kind) = '' THEN 'kind' WHEN kind = 'taxi' THEN 'unknown' WHEN page_id % 4 > 1 THEN 'type' WHEN trim(event) = '' THEN 'event' WHEN payee IS NULL THEN 'payee' ELSE 'accepted' END AS outcome, CASE page_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/tiff' END AS mime, CASE page_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' END AS extracted_mime FROM f")
def admissions(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda *xs: F.get(F.array(*[F.lit(x) for x in xs]), (F.col("page_id") % len(xs)).cast("int"))
    files = V.read(spark, d, "pages").select("page_id", F.concat(F.lit("f"), "page_id", pick(".pdf", ".PNG", ".tif", "")).alias("name"), pick(" meal", "", "taxi").alias("kind"))
    why = intake.rejection(F.col("name"), F.col("kind"), F.when(F.col("page_id") % 5 > 0, "Event").otherwise(" "), F.when(F.col("page_id") % 7 > 0, "me"))
    says = lambda text: F.startswith(why, F.lit(text))
    outcome = F.when(why.isNull(), "accepted").when(says("Missing kind"), "kind").when(says("Unknown kind"), "unknown").when(says("Unsupported"), "type").when(says("Missing required field: Event"), "event").otherwise("payee")
    return files.select("page_id", "name", outcome.alias("outcome"), intake.mime_type(F.col("name")).alias("mime"), intake.mime_type(F.col("name"), extracted=True).alias("extracted_mime"))


@query("P08", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN lower(replace(c_name, '#', '_'))[1:16] WHEN 1 THEN NULL ELSE NULL END AS signed_in FROM customer")
def users(spark: SparkSession, d: str) -> DataFrame:
    name = F.substring(F.replace("c_name", F.lit("#"), F.lit("_")), 1, 16)
    header = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("accounts:"), name, F.lit("@example.org"))).when(F.col("c_custkey") % 3 == 1, F.lit("accounts:nobody")).otherwise(F.lit("accounts:a b@example.org"))
    return V.read(spark, d, "customer").select("c_custkey", intake.signed_in(header).alias("signed_in"))


@query("P10", f"WITH {O.LINES} SELECT report_id, line_idx, CASE WHEN line_idx % 3 = 1 THEN source END AS spot, CASE line_idx % 3 WHEN 0 THEN 'converted via mock FX rate (placeholder; real-time tool TBD)' WHEN 1 THEN source END AS shown FROM (SELECT report_id, line_idx, 'quote ' || report_id AS source FROM lines)")
def evidence_shown(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of an origin, of a page, and of a page without a quote, in turn (with P11)."""
    quote = F.concat(F.lit("quote "), F.col("report_id").cast("string"))
    third = F.col("line_idx") % 3
    said = F.when(third == 1, quote).when(third == 2, "")
    one = F.struct(F.when(third == 0, "derived").otherwise("document_span").alias("kind"), F.lit("a.pdf").alias("filename"), F.lit(1).alias("page"), said.alias("quote"), F.when(third == 0, "reduce.fx.mock").alias("origin"))
    lines = V.lines(spark, d, country=False).withColumn("evidence", F.array(one))
    return lines.select("report_id", "line_idx", intake.spot(F.col("evidence"))["quote"].alias("spot"), intake.provenance(F.col("evidence")).alias("shown"))


@query("J16", f"WITH {O.LINES}, k AS (SELECT *, {O._kind} AS kind FROM lines) SELECT kind, count(*) FILTER (line_idx % 2 = 0 OR kind NOT IN ('meal', 'transport', 'lodging', 'airfare', 'ancillary')) AS n_right, count(*) AS n FROM k GROUP BY 1")
def blocks_of_kinds(spark: SparkSession, d: str) -> DataFrame:
    kind = F.coalesce(F.try_element_at(catalog.literal_map(catalog.KIND_OF_TYPE), F.col("expense_type")), F.lit("other"))
    blocks = F.when(F.col("line_idx") % 2 == 0, F.array(*[F.lit(x) for x in intake.BLOCK_OF_KIND.values()])).otherwise(F.array(F.lit("common")))
    lines = V.lines(spark, d, country=False).select(kind.alias("kind"), intake.block_matches(kind, blocks).alias("right"))
    return lines.groupBy("kind").agg(F.count_if("right").alias("n_right"), F.count("*").alias("n"))


_master = "('business_meal','lodging_foreign','airfare_domestic','airfare_foreign','personal_mileage')"


@query("A27", f"WITH {O.LINES}, m AS (SELECT DISTINCT expense_type FROM lines WHERE expense_type IN {_master}) SELECT kind, count(*) FILTER (t NOT IN (SELECT expense_type FROM m)) AS n_unknown FROM (VALUES ('meal','business_meal'),('meal','group_travel_meal'),('transport','ground_transportation_domestic'),('transport','ground_transportation_foreign'),('lodging','lodging_domestic'),('lodging','lodging_foreign'),('airfare','airfare_domestic'),('airfare','airfare_foreign'),('conference_registration','conference_registration'),('miscellaneous','other_business_expense'),('membership','membership_dues'),('mileage','personal_mileage'),('ancillary','ancillary_airline_fee')) AS c(kind, t) GROUP BY 1")
def catalogue_drift(spark: SparkSession, d: str) -> DataFrame:
    master = V.lines(spark, d, country=False).where(f"expense_type in {_master}").select("expense_type").distinct()
    return intake.drift(intake.kinds(spark), master)


@query("J20", f"WITH {O.LINES}, f AS (SELECT DISTINCT report_id, expense_type FROM lines WHERE line_idx % 2 = 0) SELECT l.report_id AS upload_id, l.line_idx, CASE WHEN l.line_idx % 5 = 4 THEN 'unnamed' WHEN f.report_id IS NULL THEN 'missing' ELSE 'there' END AS state FROM lines l LEFT JOIN f ON f.report_id = l.report_id AND f.expense_type = l.expense_type")
def files_there(spark: SparkSession, d: str) -> DataFrame:
    lines = V.lines(spark, d, country=False)
    name = F.concat("expense_type", F.lit(".pdf"))
    extractions = lines.select(F.col("report_id").alias("upload_id"), "line_idx", F.when(F.col("line_idx") % 5 != 4, name).alias("source_filename"))
    files = lines.where("line_idx % 2 = 0").select(F.col("report_id").alias("upload_id"), name.alias("name"))
    return intake.availability(extractions, files).select("upload_id", "line_idx", "state")


@query("J21", f"WITH {O.LINES}, {O.REPORTS} SELECT r.report_id AS upload_id, count(*) FILTER (line_idx % 2 = 0) AS n_receipts, count(*) FILTER (line_idx % 2 = 1) AS n_extractions FROM reports r LEFT JOIN lines l ON l.report_id = r.report_id GROUP BY 1")
def rehydrations(spark: SparkSession, d: str) -> DataFrame:
    lines = V.lines(spark, d, country=False)
    files = lines.select(F.col("report_id").alias("upload_id"), F.when(F.col("line_idx") % 2 == 0, "receipt").otherwise("extraction").alias("category"), F.concat("expense_type", F.lit(".pdf")).alias("name"))
    reports = V.reports(spark, d).select(F.col("report_id").alias("upload_id"))
    size = lambda c: F.size(c).cast("long")
    return intake.rehydrated(reports, files).select("upload_id", size("receipts").alias("n_receipts"), size("extractions").alias("n_extractions"))


@query("J22", f"WITH {O.REPORTS} SELECT report_id FROM reports WHERE NOT (report_id % 10 = 0 OR filer_id % 6 = 0)")
def cleaned(spark: SparkSession, d: str) -> DataFrame:
    """What stays when test uploads and those of test users go."""
    upload = F.concat(F.when(F.col("report_id") % 10 == 0, "test_").otherwise("up_"), F.col("report_id").cast("string"))
    user = F.when(F.col("filer_id") % 6 == 0, F.concat(F.lit("pipelinetest"), F.col("filer_id").cast("string"))).otherwise("someone")
    reports = V.reports(spark, d).select("report_id", upload.alias("upload_id"), user.alias("payee_id"), F.lit(None).cast("string").alias("filed_by"))
    return intake.cleanup(reports, reports.select("upload_id"), ("^pipelinetest[0-9]*$",))[1].select("report_id")


@query("E07", f"WITH {O.REPORTS} SELECT report_id AS upload_id, coalesce(payee_name, CAST(filer_id AS VARCHAR)) AS payee, coalesce(event_name, '—') AS event, coalesce('$' || format('{{:,.2f}}', stated_usd), '—') AS total FROM reports")
def listed(spark: SparkSession, d: str) -> DataFrame:
    r = V.reports(spark, d).select(F.col("report_id").alias("upload_id"), "payee_name", F.col("filer_id").cast("string").alias("payee_id"), "event_name", F.col("stated_usd").alias("total_usd"))
    return intake.shown(r)


@query("O01", f"WITH {O.LINES} SELECT report_id, min(date_text) AS conference_start_date, max(date_text) AS conference_end_date, CASE WHEN min(date_text) = max(date_text) THEN min(date_text) ELSE min(date_text) || ' to ' || max(date_text) END AS when_text, CAST(count(DISTINCT expense_type) AS BIGINT) AS n_venues FROM lines GROUP BY 1")
def conferences(spark: SparkSession, d: str) -> DataFrame:
    """Lines as supporting documents: their dates as schedules, their types as venues (with O02)."""
    documents = V.lines(spark, d, country=False).select("report_id", F.array("date_text").alias("scheduled_dates"), F.array("expense_type").alias("venues_mentioned"))
    return intake.conference(documents).select("report_id", "conference_start_date", "conference_end_date", "when_text", F.size("venues").cast("long").alias("n_venues"))


@query("O05", f"WITH {O.LINES} SELECT report_id, line_idx, CASE WHEN check_out_date >= check_in_date THEN date_diff('day', CAST(check_in_date AS DATE), CAST(check_out_date AS DATE)) - greatest(0, least(2, date_diff('day', CAST(check_in_date AS DATE), CAST(check_out_date AS DATE)) - 1)) END AS nights FROM lines WHERE expense_type LIKE 'lodging%'")
def nights_apart(spark: SparkSession, d: str) -> DataFrame:
    """A conference from the day after arrival for two nights."""
    day = lambda n: F.date_add(F.to_date("check_in_date"), n).cast("string")
    lines = V.lines(spark, d, country=False).where(F.startswith("expense_type", F.lit("lodging")))
    return lines.select("report_id", "line_idx", intake.personal_nights(F.col("check_in_date"), F.col("check_out_date"), day(1), day(3)).alias("nights"))


@query("O04_net", f"WITH {O.REPORTS}, {O.WINDOWS}, e AS (SELECT report_id, from_date, CAST(unnest(generate_series(CAST(from_date AS DATE), CAST(to_date AS DATE), INTERVAL 1 DAY)) AS DATE) AS day FROM windows WHERE from_date IS NOT NULL) SELECT report_id, count(*) AS n_days, sum(CASE WHEN day = CAST(from_date AS DATE) THEN 40.0 ELSE 60.0 END)::DOUBLE AS net_amount FROM e GROUP BY 1")
def per_diem_net(spark: SparkSession, d: str) -> DataFrame:
    """Each window at 60 a day, with a meal of 20 on its first day."""
    w = S.when_window(F.col("when_text"))
    deduction = F.array(F.struct(w["start"].alias("date"), F.lit(20.0).alias("deduction_amount")))
    entries = V.reports(spark, d).where(w.isNotNull()).select("report_id", w["start"].alias("start_date"), w["end"].alias("end_date"), F.lit(60.0).alias("per_diem_rate"), deduction.alias("meal_deductions"))
    return intake.per_diem(entries).groupBy("report_id").agg(F.count("*").alias("n_days"), F.sum("net_amount").alias("net_amount"))


@query("J11", f"WITH {O.LINES}, c AS (SELECT report_id, line_idx, ['uni_staff', 'other', 'x'][1 + report_id % 3] AS a, ['uni_travel_connect_dl', 'uni_travel_egencia', 'uni_travel_key_travel', 'other'][1 + report_id % 4] AS b, ['coach', 'business', 'premium_economy', 'first', 'bed'][1 + report_id % 5] AS t FROM lines) SELECT report_id, line_idx, CASE a WHEN 'uni_staff' THEN 'Uni Traveler' WHEN 'other' THEN 'Visitor' END AS affiliation, CASE b WHEN 'uni_travel_connect_dl' THEN 'Uni Travel Connect (UA, DL, AA, AS and HA)' WHEN 'uni_travel_egencia' THEN 'Uni Travel - Egencia' WHEN 'other' THEN 'Other (Not a Uni Travel Booking Method)' ELSE 'Uni Travel - Key Travel' END AS booking, CASE WHEN t IN ('business', 'premium_economy') THEN 'Premium Economy/Business' WHEN t = 'bed' THEN NULL ELSE upper(t[1]) || t[2:] END AS class FROM c")
def foreign_labels(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda *xs: F.get(F.array(*[F.lit(x) for x in xs]), (F.col("report_id") % len(xs)).cast("int"))
    return V.lines(spark, d, country=False).select(
        "report_id",
        "line_idx",
        intake.affiliation_label(pick("uni_staff", "other", "x"), "Uni").alias("affiliation"),
        intake.booking_label(pick("uni_travel_connect_dl", "uni_travel_egencia", "uni_travel_key_travel", "other"), "Uni").alias("booking"),
        intake.ticket_class_label(pick("coach", "business", "premium_economy", "first", "bed")).alias("class"),
    )


_f29 = "t AS (SELECT page_id, ['enum', 'boolean', 'date', 'number', 'number', 'string', 'string'][1 + page_id % 7] AS kind, ['general.category', 'a.is_shared', 'common.date', 'x.total_usd', 'x.days', 'payee.name', 'b.purpose'][1 + page_id % 7] AS path, ['T1', 'T2', 'T3', 'T4', NULL][1 + page_id % 5] AS tier, page_id % 2 = 0 AS required FROM pages)"


@query("F29", f"WITH {_f29} SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'select' WHEN 1 THEN 'checkbox' WHEN 2 THEN 'date' WHEN 3 THEN 'currency' WHEN 4 THEN 'number' WHEN 5 THEN 'text' ELSE 'textarea' END AS control, CASE page_id % 5 WHEN 0 THEN 'user_confirmed_input' WHEN 1 THEN 'computed_readonly' WHEN 4 THEN 'structural' ELSE 'model_prefill_review' END AS mode, CASE WHEN NOT required THEN 'low' WHEN path IN ('common.date', 'payee.name') THEN 'high' ELSE 'medium' END AS priority, coalesce(tier, 'T3') AS inherited FROM t")
def field_controls(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda *xs: F.get(F.array(*[F.lit(x) for x in xs]), (F.col("page_id") % len(xs)).cast("int"))
    path = pick("general.category", "a.is_shared", "common.date", "x.total_usd", "x.days", "payee.name", "b.purpose")
    tier = pick("T1", "T2", "T3", "T4", None)
    kind = pick("enum", "boolean", "date", "number", "number", "string", "string")
    return V.read(spark, d, "pages").select(
        "page_id", S.control_type(kind, path).alias("control"), S.entry_mode(tier).alias("mode"), S.review_priority(path, F.col("page_id") % 2 == 0, F.lit(None).cast("string")).alias("priority"), S.inherited_tier(F.array(F.lit("T3"), tier)).alias("inherited")
    )


@query("O03", f"WITH {O.LINES} SELECT report_id, line_idx, line_idx % 2 = 0 AS presents FROM lines")
def presenters(spark: SparkSession, d: str) -> DataFrame:
    """Whether a name stands in a list of authors."""
    papers = F.array(F.struct(F.lit("t").alias("title"), F.concat(F.lit("B. Other, "), F.when(F.col("line_idx") % 2 == 0, F.concat(F.lit("ANN "), F.col("report_id").cast("string"), F.lit("x")))).alias("authors_string")), F.struct(F.lit("u").alias("title"), F.lit("C. Else").alias("authors_string")))
    name = F.concat(F.lit(" Ann "), F.col("report_id").cast("string"))
    lines = V.lines(spark, d, country=False)
    return lines.select("report_id", "line_idx", F.coalesce(intake.is_presenting(name, papers), F.lit(False)).alias("presents"))


@query("T04", "SELECT o_orderkey AS upload_id FROM orders WHERE CAST(o_orderdate AS DATE) + INTERVAL 90 DAY > DATE '1998-01-01'")
def kept_reports(spark: SparkSession, d: str) -> DataFrame:
    o = V.read(spark, d, "orders").select(F.col("o_orderkey").alias("upload_id"), (F.to_date("o_orderdate") + F.expr("interval 90 days")).alias("ttl"))
    return store.retained(o, F.to_date(F.lit("1998-01-01"))).select("upload_id")


@query("S27", "WITH s AS (SELECT DISTINCT user_id AS job_id FROM events), u AS (SELECT user_id AS job_id, max_by(event_type, (ts, event_id)) AS phase, max(CASE WHEN event_type = 'click' THEN 'bad' END) AS error FROM events WHERE user_id % 3 = 0 GROUP BY 1) SELECT job_id, coalesce(u.phase, 'extract') AS phase, coalesce(u.error, 'none') AS error FROM s LEFT JOIN u USING (job_id)")
def merged_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Job state after updates of a third of the jobs; what they leave out keeps its value."""
    events = V.read(spark, d, "events")
    old = events.select(F.col("user_id").alias("job_id")).distinct().select("job_id", F.lit("extract").alias("phase"), F.lit("none").alias("error"), F.to_timestamp(F.lit("2026-01-01")).alias("ttl"))
    updates = events.where("user_id % 3 = 0").groupBy(F.col("user_id").alias("job_id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("phase"), F.max(F.when(F.col("event_type") == "click", "bad")).alias("error"))
    return store.upsert_jobs(old, updates, F.to_timestamp(F.lit("2026-02-01"))).select("job_id", "phase", "error")
