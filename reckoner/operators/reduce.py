"""From receipts to reports: derived amounts and one consolidated row per report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reckoner.functions import scalars as S
from reckoner.sources import catalog

DEFAULT_YEAR = 2025


def money(column: Column) -> Column:
    """A sum that doesn't depend on the order of its rows, to cents."""
    return F.round(F.sum(column.cast("decimal(24,6)")), 2).cast("double")


def mileage_rates(lines: DataFrame, rates: DataFrame) -> DataFrame:
    """``lines`` with usd_per_mile: the label that is the trip's year, else the rate of
    the latest year that a label begins with. Labels of parts of years don't match."""
    year = F.coalesce(F.substring("date_text", 1, 4), F.lit(str(DEFAULT_YEAR)))
    latest = rates.where("year is not null").agg(F.max_by("cents", "year").alias("latest_cents"))
    exact = rates.select(F.col("label").alias("_year"), F.col("cents").alias("_cents"))
    joined = lines.withColumn("_year", year).join(F.broadcast(exact), "_year", "left").join(F.broadcast(latest), how="left")
    return joined.withColumn("usd_per_mile", F.coalesce("_cents", "latest_cents") / 100).drop("_year", "_cents", "latest_cents")


def derive_lines(lines: DataFrame, rates: DataFrame) -> DataFrame:
    """``lines`` with amount_usd, exchange_rate, origin, derived confidence and needs_review.

    A stated USD amount stays. Else a known placeholder rate is applied to the original
    amount, else a distance is paid by the mile.
    """
    rate = F.try_element_at(catalog.literal_map(catalog.PLACEHOLDER_RATES), F.col("original_currency"))
    df = mileage_rates(lines.withColumn("_rate", rate), rates)
    by_rate = F.col("line_amount_usd").isNull() & F.col("original_amount").isNotNull() & F.col("_rate").isNotNull()
    by_mile = F.col("line_amount_usd").isNull() & ~by_rate & F.col("distance_miles").isNotNull()
    amount = F.when(by_rate, F.col("original_amount") * F.col("_rate")).when(by_mile, S.mileage_amount(F.col("distance_miles"), F.col("usd_per_mile")))
    return df.withColumns(
        {
            "amount_usd": F.coalesce("line_amount_usd", amount),
            "exchange_rate": F.when(by_rate, F.col("_rate")),
            "origin": F.when(by_rate, "placeholder_fx").when(by_mile, "mileage_rate"),
            "amount_confidence": F.when(by_rate, "medium").otherwise(F.col("confidence")),
            "needs_review": by_rate,
        }
    ).drop("_rate")


def derive_lodging(lines: DataFrame) -> DataFrame:
    """``lines`` with daily_rate (mean of nightly_rates; null for none), its confidence, and
    number_of_nights (check_out_date - check_in_date; null if malformed or reversed)."""
    mean = F.aggregate("nightly_rates", F.lit(0.0), lambda total, x: total + x) / F.size("nightly_rates")
    has = F.coalesce(F.size("nightly_rates") > 0, F.lit(False))
    return lines.withColumns({"daily_rate": F.when(has, mean), "daily_rate_confidence": F.when(has, "high"), "number_of_nights": S.nights_between(F.col("check_in_date"), F.col("check_out_date"))})


def is_foreign_currency(code: Column) -> Column:
    return F.coalesce(F.upper(code) != "USD", F.lit(False))


def is_home(country: Column) -> Column:
    return F.upper(country).isin("UNITED STATES", "US", "USA")


def assemble_reports(reports: DataFrame, derived: DataFrame) -> DataFrame:
    """One row per report, also for reports without lines."""
    foreign, home = is_foreign_currency(F.col("original_currency")), is_home(F.col("country"))
    low = F.min(S.confidence_rank(F.col("confidence")))
    high = F.col("confidence") == "high"
    per = derived.groupBy("report_id").agg(
        F.count("*").alias("n_lines"),
        money(F.col("amount_usd")).alias("total_usd"),
        F.min("date_text").alias("earliest_date"),
        F.bool_or(foreign).alias("_foreign"),
        low.alias("_floor"),
        F.min(S.confidence_rank(F.col("amount_confidence"))).alias("_amount_floor"),
        F.bool_and(F.coalesce(high & home, F.lit(False))).alias("_all_home"),
        F.bool_and(F.coalesce(high & ~home, F.lit(False))).alias("_all_away"),
    )
    joined = reports.select("report_id").join(per, "report_id", "left")
    agree = F.when(F.col("_foreign"), F.col("_all_away")).otherwise(F.col("_all_home"))
    return joined.select(
        "report_id",
        F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
        F.coalesce("total_usd", F.lit(0.0)).alias("total_usd"),
        "earliest_date",
        F.when(F.col("_foreign"), "expenses_foreign").otherwise("expenses_domestic").alias("inferred_category"),
        S.confidence_name(F.coalesce("_amount_floor", F.lit(0))).alias("amount_confidence"),
        S.confidence_name(F.coalesce("_floor", F.lit(0))).alias("date_confidence"),
        F.when(agree, "high").otherwise(S.confidence_name(F.coalesce("_floor", F.lit(0)))).alias("category_confidence"),
    )


def overlay_form(reports: DataFrame, form: DataFrame, fields: list[str]) -> DataFrame:
    """Form values replace a report's where they are not null."""
    renamed = form.select("report_id", *[F.col(c).alias(f"_form_{c}") for c in fields])
    return reports.join(renamed, "report_id", "left").withColumns({c: F.coalesce(f"_form_{c}", c) for c in fields}).drop(*[f"_form_{c}" for c in fields])


def propagate_activity(lines: DataFrame, reports: DataFrame) -> DataFrame:
    """Lines whose type ends in _foreign get their report's activity."""
    activity = reports.select("report_id", F.col("foreign_activity_type").alias("_activity"))
    joined = lines.join(activity, "report_id", "left")
    return joined.withColumn("foreign_activity_type", F.when(F.col("expense_type").endswith("_foreign"), F.col("_activity"))).drop("_activity")


def merge_extractions(main: DataFrame, extra: DataFrame, key: str = "document_id", nested: tuple[str, ...] = (), present: str | None = None) -> DataFrame:
    """Two partial extractions of a document; columns of ``extra`` win where not null.

    Where a row of ``extra`` says which keys it has, in the array column ``present``, those win
    even if they are null, and others don't. Struct columns in ``nested`` are merged field
    by field, one level deep. A document that isn't in both exactly once is an error.
    """
    shared = [c for c in extra.columns if c in main.columns and c not in (key, present)]
    count = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    sizes = count(main, "_n").join(count(extra, "_m"), key, "full_outer")
    wrong = ~(F.col("_n").eqNullSafe(F.lit(1)) & F.col("_m").eqNullSafe(F.lit(1)))
    checked = sizes.select(key, F.when(wrong, F.raise_error(F.concat(F.lit("not one extraction on each side: "), F.col(key).cast("string")))).otherwise(True).alias("_ok")).where("_ok")
    renamed = extra.withColumnsRenamed({c: f"_extra_{c}" for c in shared})

    def merged(c: str) -> Column:
        if c not in nested:
            return F.coalesce(f"_extra_{c}", c) if present is None else F.when(F.array_contains(present, c), F.col(f"_extra_{c}")).otherwise(F.col(c))
        left, right = main.schema[c].dataType.names, extra.schema[c].dataType.names
        a, b = F.col(c), F.col(f"_extra_{c}")
        fields = [(F.coalesce(b[n], a[n]) if n in left and n in right else (a if n in left else b)[n]).alias(n) for n in dict.fromkeys([*left, *right])]
        return F.when(a.isNotNull() | b.isNotNull(), F.struct(*fields))

    return checked.join(main, key).join(renamed, key).withColumns({c: merged(c) for c in shared}).drop("_ok", *([present] if present else []), *[f"_extra_{c}" for c in shared])


def spend_by_kind(derived: DataFrame) -> DataFrame:
    """Spend and share per kind and report, kinds in display order, empty ones left out."""
    kind = F.coalesce(F.try_element_at(catalog.literal_map(catalog.KIND_OF_TYPE), F.col("expense_type")), F.lit("other"))
    per = derived.groupBy("report_id", kind.alias("kind")).agg(money(F.col("amount_usd")).alias("spend")).where("spend > 0")
    total = per.groupBy("report_id").agg(F.round(F.sum(F.col("spend").cast("decimal(24,2)")), 2).cast("double").alias("_total"))
    order = catalog.literal_map({k: i for i, k in enumerate(catalog.KINDS)})
    shared = per.join(total, "report_id")
    return shared.select("report_id", "kind", F.element_at(order, F.col("kind")).alias("kind_no"), "spend", F.round(F.col("spend") / F.col("_total") * 100, 4).alias("share_pct"))
