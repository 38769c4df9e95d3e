"""Portal-ready projections of report lines, and their CSV sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reckoner.functions import scalars as S
from reckoner.operators import intake
from reckoner.sources import catalog

# The header of the foreign page.
FOREIGN_HEADER = [
    "category",
    "expense_date",
    "expense_currency",
    "expense_amount",
    "expense_type",
    "remarks",
    "country of activity",
    "activity type",
    "affiliation",
    "traveler_id",
    "traveler_name",
    "ticket_number  (not required)",
    "travel_booking_method",
    "airline",
    "class_of_ticket",
    "departure_airport",
    "destination_airport",
    "number_of_nights",
    "location",
    "Conference Hotel",
]
ORDINARY = ["remarks", "country", "foreign_activity_type"]


def goes_foreign(kind: Column, category: Column) -> Column:
    """Page of a line: by its type, else by the report's category."""
    return F.when(kind.isin(*catalog.ALWAYS_FOREIGN), True).when(kind.isin(*catalog.ALWAYS_DOMESTIC), False).otherwise(F.coalesce(category == "expenses_foreign", F.lit(False)))


def routed(lines: DataFrame, reports: DataFrame) -> DataFrame:
    """``lines`` with is_foreign and line_no, which restarts at 1 on each page."""
    joined = lines.join(reports.select("report_id", "category"), "report_id")
    page = joined.withColumn("is_foreign", goes_foreign(F.col("expense_type"), F.col("category")))
    at = Window.partitionBy("report_id", "is_foreign").orderBy("line_idx")
    return page.withColumn("line_no", F.row_number().over(at).cast("long"))


def _labels(df: DataFrame, page: str) -> Column:
    """The label of a type on a page; alcohol on the receipt is noted for meals."""
    names = {t: d if page == "domestic" else f for t, d, f in catalog.EXPENSE_LABELS}
    label = F.coalesce(F.try_element_at(catalog.literal_map(names), F.col("expense_type")), F.lit(""))
    if "alcohol_amount" not in df.columns:
        return label
    # The foreign page spells it shorter for groups.
    short = (F.col("expense_type") == "group_travel_meal") & F.lit(page != "domestic")
    said = F.concat(label, F.when(short, " w Alcohol").otherwise(" with Alcohol"))
    return F.when(F.col("expense_type").isin("business_meal", "group_travel_meal") & (F.col("alcohol_amount") > 0), said).otherwise(label)


def with_currency_name(df: DataFrame, column: str = "original_currency") -> DataFrame:
    """``df`` with currency_display, "CODE - Name"; an unknown code stands for its name."""
    dim = catalog.dim_currency(df.sparkSession).select(F.col("code").alias("_code"), F.col("name").alias("_name"))
    code = F.coalesce(F.col(column), F.lit("USD"))
    joined = df.withColumn("_code", code).join(F.broadcast(dim), "_code", "left")
    return joined.withColumn("currency_display", F.concat("_code", F.lit(" - "), F.coalesce("_name", "_code"))).drop("_code", "_name")


def _two(column: Column) -> Column:
    return F.when(column.isNotNull(), F.format_string("%.2f", F.round(column, 2))).otherwise("")


def _optional(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


def _amount() -> Column:
    return F.when(F.col("original_currency").isNotNull(), _two(F.col("original_amount"))).otherwise(_two(F.col("line_amount_usd")))


def domestic_rows(lines: DataFrame, reports: DataFrame) -> DataFrame:
    df = with_currency_name(routed(lines, reports).where("not is_foreign"))
    return df.select(
        "report_id",
        F.col("line_no").alias("line"),
        F.coalesce(S.portal_date(F.col("date_text")), F.lit("")).alias("expense_date"),
        F.col("currency_display").alias("expense_currency"),
        _amount().alias("expense_amount"),
        _two(F.col("line_amount_usd")).alias("usd_amount"),
        _labels(df, "domestic").alias("expense_type"),
        _optional(df, "remarks").alias("remarks"),
    )


def foreign_rows(lines: DataFrame, reports: DataFrame) -> DataFrame:
    """The 20 columns of the foreign page; payee columns on airfare rows only."""
    df = with_currency_name(routed(lines, reports).where("is_foreign"))
    air = F.col("expense_type").isin("airfare_domestic", "airfare_foreign")
    only_air = lambda name: F.when(air, _optional(df, name)).otherwise("")
    lodging = F.col("expense_type").isin("lodging_domestic", "lodging_foreign")
    activity = F.coalesce(F.try_element_at(catalog.literal_map(intake.ACTIVITIES), _optional(df, "foreign_activity_type")), F.lit(""))
    ticket = F.coalesce(F.try_element_at(catalog.literal_map(intake.TICKET_CLASSES), _optional(df, "class_of_ticket")), F.lit(""))
    hotel = F.when(lodging, F.when(_optional(df, "lodging_booking_method") == "conference_hotel", "Yes").otherwise("No")).otherwise("")
    return df.select(
        "report_id",
        F.col("line_no").alias("line"),
        F.lit("Expenses (Foreign)").alias("category"),
        F.coalesce(S.portal_date(F.col("date_text")), F.lit("")).alias("expense_date"),
        F.col("currency_display").alias("expense_currency"),
        _amount().alias("expense_amount"),
        _labels(df, "foreign").alias("expense_type"),
        _optional(df, "remarks").alias("remarks"),
        _optional(df, "country").alias("country"),
        activity.alias("activity_type"),
        only_air("affiliation").alias("affiliation"),
        only_air("traveler_id").alias("traveler_id"),
        only_air("traveler_name").alias("traveler_name"),
        *[_optional(df, c).alias(c) for c in ("ticket_number", "travel_booking_method", "airline")],
        ticket.alias("class_of_ticket"),
        *[_optional(df, c).alias(c) for c in ("departure_airport", "destination_airport")],
        _optional(df, "number_of_nights").alias("number_of_nights"),
        _optional(df, "location").alias("location"),
        hotel.alias("conference_hotel"),
    )


def combined_rows(lines: DataFrame) -> DataFrame:
    """Six columns, all lines, the bare currency code."""
    return lines.select(
        "report_id",
        "line_idx",
        F.coalesce(S.portal_date(F.col("date_text")), F.lit("")).alias("expense_date"),
        F.coalesce("original_currency", F.lit("USD")).alias("currency"),
        _amount().alias("expense_amount"),
        _two(F.col("line_amount_usd")).alias("currency_amount"),
        _labels(lines, "domestic").alias("expense_type"),
        _optional(lines, "remarks").alias("remarks"),
    )


def write_csv(rows: DataFrame, path: str, header: list[str] | None = None, order: str = "line", by_report: bool = False) -> None:
    """CSV in the order of reports and lines; header always there, quoting after RFC 4180.

    Few large files with a report_id column, or, for as many reports as a folder can hold,
    a folder of its own for each.
    """
    names = [c for c in rows.columns if c != "report_id"]
    placed = rows.repartitionByRange("report_id").sortWithinPartitions("report_id", *([order] if order in names else []))
    shown = placed if header is None else placed.withColumnsRenamed(dict(zip(names, header, strict=False)))
    writer = shown.write.partitionBy("report_id") if by_report else shown.write
    writer.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def airport_names(df: DataFrame, airports: DataFrame, columns: tuple[str, ...] = ("departure_airport", "destination_airport")) -> DataFrame:
    """``df`` with airport codes replaced by display names; unknown codes stay."""
    for c in columns:
        dim = airports.select(F.col("code").alias("_airport"), F.col("display").alias("_display"))
        df = df.withColumn("_airport", F.upper(F.trim(c))).join(dim, "_airport", "left").withColumn(c, F.coalesce("_display", c)).drop("_airport", "_display")
    return df


def line_counts(lines: DataFrame, reports: DataFrame) -> DataFrame:
    page = lines.join(reports.select("report_id", "category"), "report_id")
    foreign = goes_foreign(F.col("expense_type"), F.col("category"))
    return page.groupBy("report_id").agg(F.count_if(~foreign).alias("n_domestic"), F.count_if(foreign).alias("n_foreign"))
