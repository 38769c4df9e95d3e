"""The registered queries of the expense domain over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reckoner.functions import scalars as S
from reckoner.operators import edits as E
from reckoner.operators import export, fx, grounding, jobs, quality, reduce, store, validate
from reckoner.sources import catalog
from reckoner.sources import views as V

QUERIES = {}


def query(name: str):
    def add(f):
        QUERIES[name] = f
        return f

    return add


def derived(spark: SparkSession, d: str) -> DataFrame:
    return reduce.derive_lines(V.lines(spark, d), catalog.dim_mileage_rate(spark))


@query("A01")
def raw_total(spark: SparkSession, d: str) -> DataFrame:
    return V.lines(spark, d, country=False).groupBy("report_id").agg(F.coalesce(reduce.money(F.col("line_amount_usd")), F.lit(0.0)).alias("total_usd"))


@query("A09")
def reports_rollup(spark: SparkSession, d: str) -> DataFrame:
    return reduce.assemble_reports(V.reports(spark, d), derived(spark, d))


@query("A03")
def fx_totals(spark: SparkSession, d: str) -> DataFrame:
    return fx.totals(fx.enrich(V.lines(spark, d, country=False), V.fx_rates(spark, d)))


@query("A11")
def spend(spark: SparkSession, d: str) -> DataFrame:
    return reduce.spend_by_kind(derived(spark, d))


@query("A12")
def page_counts(spark: SparkSession, d: str) -> DataFrame:
    return export.line_counts(V.lines(spark, d, country=False), V.reports(spark, d))


@query("A13")
def confidence_counts(spark: SparkSession, d: str) -> DataFrame:
    return quality.confidence_histogram(V.lines(spark, d, country=False).select("report_id", "confidence"))


@query("A16")
def status(spark: SparkSession, d: str) -> DataFrame:
    lines, reports = V.lines(spark, d), V.reports(spark, d)
    return validate.review_status(reports, lines, validate.all_issues(reports, lines))


@query("A14")
def buckets(spark: SparkSession, d: str) -> DataFrame:
    return quality.issue_buckets(validate.all_issues(V.reports(spark, d), V.lines(spark, d)))


@query("A18")
def job_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return jobs.outcomes(V.job_events(spark, d))


@query("A19")
def job_clock(spark: SparkSession, d: str) -> DataFrame:
    return jobs.wall_clock(V.job_events(spark, d))


@query("W07")
def job_latest(spark: SparkSession, d: str) -> DataFrame:
    return jobs.latest(V.job_events(spark, d)).select("job_id", "phase", "n_updates")


@query("P02")
def kinds(spark: SparkSession, d: str) -> DataFrame:
    kind = F.coalesce(F.try_element_at(catalog.literal_map(catalog.KIND_OF_TYPE), F.col("expense_type")), F.lit("other"))
    return V.lines(spark, d, country=False).groupBy(kind.alias("kind"), "original_currency").agg(F.count("*").alias("n"))


@query("P03")
def routing(spark: SparkSession, d: str) -> DataFrame:
    return export.routed(V.lines(spark, d, country=False), V.reports(spark, d)).select("report_id", "line_idx", "is_foreign", "line_no")


@query("P04")
def foreign_types(spark: SparkSession, d: str) -> DataFrame:
    return V.lines(spark, d, country=False).groupBy("expense_type").agg(F.bool_or(F.col("expense_type").endswith("_foreign")).alias("is_foreign"), F.count("*").alias("n"))


@query("J05")
def mileage(spark: SparkSession, d: str) -> DataFrame:
    lines = V.lines(spark, d, country=False).where("distance_miles is not null")
    rated = reduce.mileage_rates(lines, catalog.dim_mileage_rate(spark))
    return rated.select("report_id", "line_idx", F.round("usd_per_mile", 4).alias("usd_per_mile"), F.round(S.mileage_amount(F.col("distance_miles"), F.col("usd_per_mile")), 2).alias("amount"))


@query("J06")
def placeholder_fx(spark: SparkSession, d: str) -> DataFrame:
    return derived(spark, d).where("origin = 'placeholder_fx'").select("report_id", "line_idx", "exchange_rate", F.round("amount_usd", 4).alias("amount_usd"), "needs_review")


@query("J07")
def as_of(spark: SparkSession, d: str) -> DataFrame:
    return fx.as_of(fx._keys(V.lines(spark, d, country=False)), V.fx_rates(spark, d)).select("currency", F.col("day").cast("string").alias("day"), "usd_per_unit")


@query("J07_range")
def as_of_range(spark: SparkSession, d: str) -> DataFrame:
    return fx.as_of_range(fx._keys(V.lines(spark, d, country=False)), V.fx_rates(spark, d)).select("currency", F.col("day").cast("string").alias("day"), "usd_per_unit")


@query("J10")
def currency_names(spark: SparkSession, d: str) -> DataFrame:
    return export.with_currency_name(V.lines(spark, d, country=False).select("original_currency")).groupBy("currency_display").agg(F.count("*").alias("n"))


@query("D01")
def derived_lines(spark: SparkSession, d: str) -> DataFrame:
    return derived(spark, d).select("report_id", "line_idx", F.round("amount_usd", 4).alias("amount_usd"), "origin", "amount_confidence", "needs_review")


@query("D05")
def enriched(spark: SparkSession, d: str) -> DataFrame:
    return fx.enrich(V.lines(spark, d, country=False), V.fx_rates(spark, d)).select("report_id", "line_idx", "fx_status", "fx_rate")


@query("V01")
def v_report(spark: SparkSession, d: str) -> DataFrame:
    return validate.required_report_fields(V.reports(spark, d), V.lines(spark, d, country=False))


@query("V02")
def v_lines(spark: SparkSession, d: str) -> DataFrame:
    return validate.required_line_fields(V.reports(spark, d), V.lines(spark, d, country=False), parity=False)


@query("V03")
def v_conditional(spark: SparkSession, d: str) -> DataFrame:
    return validate.conditional_required(V.reports(spark, d), V.lines(spark, d))


@query("V04")
def v_category(spark: SparkSession, d: str) -> DataFrame:
    return validate.category_consistency(V.reports(spark, d), V.lines(spark, d))


@query("V05")
def v_window(spark: SparkSession, d: str) -> DataFrame:
    return validate.trip_window(V.reports(spark, d), V.lines(spark, d, country=False))


@query("V06")
def v_tips(spark: SparkSession, d: str) -> DataFrame:
    return validate.tips(V.reports(spark, d), V.lines(spark, d, country=False)).select("report_id", "line_idx", "path", "severity")


@query("V07")
def v_mileage(spark: SparkSession, d: str) -> DataFrame:
    return validate.car_mileage(V.reports(spark, d), V.lines(spark, d, country=False))


@query("V08")
def v_all(spark: SparkSession, d: str) -> DataFrame:
    issues = validate.all_issues(V.reports(spark, d), V.lines(spark, d))
    return issues.groupBy("pass_no", "severity", "kind").agg(F.count("*").alias("n"), F.countDistinct("report_id").alias("n_reports"))


@query("X01")
def x_domestic(spark: SparkSession, d: str) -> DataFrame:
    return export.domestic_rows(V.lines(spark, d, country=False), V.reports(spark, d))


@query("X02")
def x_foreign(spark: SparkSession, d: str) -> DataFrame:
    return export.foreign_rows(V.lines(spark, d), V.reports(spark, d))


@query("X03")
def x_combined(spark: SparkSession, d: str) -> DataFrame:
    return export.combined_rows(V.lines(spark, d, country=False))


@query("E01")
def edit_state(spark: SparkSession, d: str) -> DataFrame:
    return E.current(V.edits(spark, d)).select("report_id", "path", "n_edits", F.round(F.col("value").cast("double"), 6).alias("value"))


@query("E03")
def edit_undo(spark: SparkSession, d: str) -> DataFrame:
    return E.undone(V.edits(spark, d)).select("report_id", "path", "event_id", F.round(F.col("old_text").cast("double"), 6).alias("old_value"))


@query("W05")
def edit_history(spark: SparkSession, d: str) -> DataFrame:
    return E.history(V.edits(spark, d)).select("report_id", "age", "event_id", "path")


@query("K02")
def newest_reports(spark: SparkSession, d: str) -> DataFrame:
    r = V.reports(spark, d).select(F.col("report_id").alias("upload_id"), F.col("filer_id").alias("filed_by"), F.col("when_text").alias("updated_at"))
    return store.listing(r)


@query("E06")
def filer_listing(spark: SparkSession, d: str) -> DataFrame:
    """Each filer's reports, newest first, and their totals."""
    totals = reports_rollup(spark, d).select("report_id", "n_lines", "total_usd")
    at = Window.partitionBy("filer_id").orderBy(F.desc_nulls_last("when_text"), "report_id")
    return V.reports(spark, d).select("report_id", "filer_id", "when_text").join(totals, "report_id").withColumn("place", F.row_number().over(at).cast("long")).select("filer_id", "place", "report_id", "n_lines", "total_usd")


@query("F01")
def portal_dates(spark: SparkSession, d: str) -> DataFrame:
    return V.lines(spark, d, country=False).groupBy(S.portal_date(F.col("date_text")).alias("shown")).agg(F.count("*").alias("n"))


@query("F02")
def windows(spark: SparkSession, d: str) -> DataFrame:
    w = S.when_window(F.col("when_text"))
    return V.reports(spark, d).select("report_id", w["start"].alias("from_date"), w["end"].alias("to_date"), S.days_inclusive(w["start"], w["end"]).alias("days"), S.nights_between(w["start"], w["end"]).alias("nights"))


@query("F07")
def caps(spark: SparkSession, d: str) -> DataFrame:
    cap = S.tip_cap(F.col("tip"), F.col("pre_tax"), F.col("tax"), F.col("line_amount_usd"))
    df = V.lines(spark, d, country=False).withColumn("c", cap).where("c is not null")
    return df.select("report_id", "line_idx", F.round("c.cap", 7).alias("cap"), F.col("c.precise").alias("precise"))


@query("F09")
def money_texts(spark: SparkSession, d: str) -> DataFrame:
    lines = V.lines(spark, d, country=False)
    return lines.select("report_id", "line_idx", S.original_amount_display(F.col("original_amount"), F.col("original_currency"), F.col("line_amount_usd")).alias("shown"))


@query("F11")
def titles(spark: SparkSession, d: str) -> DataFrame:
    return V.lines(spark, d, country=False).groupBy("expense_type").agg(F.count("*").alias("n")).select(S.title_case(F.col("expense_type")).alias("title"), "n")


@query("F15")
def anchors(spark: SparkSession, d: str) -> DataFrame:
    return V.read(spark, d, "pages").select("page_id", S.field_anchor(F.col("url")).alias("anchor"))


@query("F24")
def safe_names(spark: SparkSession, d: str) -> DataFrame:
    end = F.when(F.col("page_id") % 4 == 0, F.col("url")).when(F.col("page_id") % 4 == 1, F.concat("url", F.lit("/"))).when(F.col("page_id") % 4 == 2, F.concat("url", F.lit("/re ç("), "page_id", F.lit(").pdf"))).otherwise("")
    return V.read(spark, d, "pages").select("page_id", S.sanitize_filename(end).alias("name"), S.valid_id(F.col("url")).alias("is_id"))


@query("F25")
def normalised_quotes(spark: SparkSession, d: str) -> DataFrame:
    return V.read(spark, d, "benchmark").select("item_id", S.quote_norm(F.col("text")).alias("norm"))


@query("J17")
def label_diff(spark: SparkSession, d: str) -> DataFrame:
    """Two projections of the labels as leaves, one without label 0, compared."""
    labels = V.read(spark, d, "labels")
    left = labels.select(F.col("doc_id").alias("document_id"), F.inline(F.array(*[F.struct(F.lit(c).alias("path"), F.col(c).cast("string").alias("value")) for c in ("quality", "toxic")])))
    right = labels.select(F.col("doc_id").alias("document_id"), F.inline(F.array(F.struct(F.lit("quality").alias("path"), F.col("toxic").cast("double").cast("string").alias("value")))))
    return quality.tree_diff(left, right).groupBy("path", "difference").agg(F.count("*").alias("n"))


@query("J15")
def expected_labels(spark: SparkSession, d: str) -> DataFrame:
    labels, docs = V.read(spark, d, "labels"), V.read(spark, d, "documents")
    expected = docs.select(F.col("doc_id").alias("document_id"), F.lit("quality").alias("path"), F.lit("eq").alias("op"), F.when(F.col("n_chars") > 200, "1").otherwise("0").alias("value"))
    found = labels.select(F.col("doc_id").alias("document_id"), F.lit("quality").alias("path"), F.col("quality").cast("string").alias("value"))
    return quality.expectations(expected, found).groupBy("outcome").agg(F.count("*").alias("n"))


@query("W06")
def last_turns(spark: SparkSession, d: str) -> DataFrame:
    """The newest three turns of each conversation, 1 being the newest."""
    at = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return V.read(spark, d, "conversations").withColumn("age", F.row_number().over(at).cast("long")).where("age <= 3").select("conv_id", "turn", "age", "role")


@query("A05")
def earliest(spark: SparkSession, d: str) -> DataFrame:
    return V.lines(spark, d, country=False).groupBy("report_id").agg(F.min("date_text").alias("earliest_date"))


@query("A06")
def inferred(spark: SparkSession, d: str) -> DataFrame:
    return reports_rollup(spark, d).groupBy("inferred_category", "category_confidence").agg(F.count("*").alias("n"))


@query("J19")
def quote_search(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark passages as quotes, searched in all documents."""
    quotes = V.read(spark, d, "benchmark").select(F.col("item_id").alias("evidence_id"), F.col("text").alias("quote"))
    return grounding.search(quotes, V.read(spark, d, "documents"))
