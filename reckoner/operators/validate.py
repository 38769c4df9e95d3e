"""Validation: issues per report, never a change of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reckoner.functions import scalars as S
from reckoner.operators.reduce import is_foreign_currency, is_home
from reckoner.sources import catalog

COLUMNS = ("report_id", "pass_no", "line_idx", "severity", "kind", "path", "message")
INSTITUTION = "the institution"
MEALS = ("business_meal", "group_travel_meal")
RIDES = ("ground_transportation_domestic", "ground_transportation_foreign")
PASSES = (1, 2, 3, 4, 5, 6, 7, 8)
# Columns of the report and line tables, by the path of the field that they hold. Other
# fields are read from a column named like the last part of their path.
REPORT_COLUMNS = {"payee.name": "payee_name", "payee.affiliation": "affiliation", "business_purpose.when": "when_text", "total_usd": "stated_usd"}
LINE_COLUMNS = {"common.date": "date_text", "common.country_of_activity": "country"}
# Blocks of a line, by the kind of its type.
BLOCK_OF_KIND = {"meal": "meal_details", "transport": "ground_transport_details", "lodging": "lodging_details", "conference": "conference_registration_details", "ancillary": "ancillary_details"}


def _issue(pass_no: int, severity: str, kind: str, path: Column, message: Column, line: bool) -> Column:
    at = F.col("line_idx") if line else F.lit(-1).cast("long")
    return F.struct(F.lit(pass_no).alias("pass_no"), at.alias("line_idx"), F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), path.alias("path"), message.alias("message"))


def _line_path(tail: str) -> Column:
    return F.concat(F.lit("expense_report.transaction_lines["), F.col("line_idx").cast("string"), F.lit(f"].{tail}"))


def _missing(pass_no: int, path: Column, line: bool, message: Column | None = None) -> Column:
    return _issue(pass_no, "error", "MissingRequiredField", path, F.lit("Required field is missing") if message is None else message, line)


def _review(pass_no: int, path: Column, message: Column, line: bool = True) -> Column:
    return _issue(pass_no, "warning", "ManualReviewRequired", path, message, line)


def _report_fields(pass_no: int, section: str, columns: list[str]) -> list[Column]:
    """Required fields of a section; those without a column aren't judged."""
    found = []
    for field in catalog.REQUIRED_FIELDS[section]:
        column = REPORT_COLUMNS.get(field, field)
        if column in columns:
            found.append(F.when(F.col(column).isNull(), _missing(pass_no, F.lit(f"expense_report.{section}.{field}"), False)))
    return found


def _line_fields(columns: list[str], parity: bool) -> list[Column]:
    found = []
    kind = F.try_element_at(catalog.literal_map(catalog.KIND_OF_TYPE), F.col("expense_type"))
    block_of = F.when(F.col("expense_type") == "personal_mileage", "mileage_details").otherwise(F.try_element_at(catalog.literal_map(BLOCK_OF_KIND), kind))
    for block in () if parity else catalog.WALKED_BLOCKS:
        for field in catalog.REQUIRED_FIELDS[f"transaction_lines[].{block}"]:
            path = f"{block}.{field}"
            column = LINE_COLUMNS.get(path, field)
            if column in columns and path not in catalog.NOT_WALKED:
                there = F.lit(True) if block == "common" else block_of == block
                found.append(F.when(there & F.col(column).isNull(), _missing(3, _line_path(path), True)))
    return found


def _conditional(columns: list[str]) -> list[Column]:
    """Rules on lines, compiled to one expression each; no join of lines with rules."""
    found = []
    for target, text in catalog.REQUIRED_WHEN:
        field, values = catalog.condition(text)
        tail = target.removeprefix("transaction_lines[].")
        on, column = LINE_COLUMNS.get(field, field.split(".")[-1]), LINE_COLUMNS.get(tail, tail.split(".")[-1])
        if tail == target or target in catalog.UNCHECKED_TARGETS or field in catalog.UNRESOLVED or on not in columns or column not in columns:
            continue
        message = F.concat(F.lit(f"Required when {text} (in line "), (F.col("line_idx") + 1).cast("string"), F.lit(")"))
        found.append(F.when(F.col(on).cast("string").isin(*values) & F.col(column).isNull(), _missing(4, _line_path(tail), True, message)))
    return found


def _tip(institution: str) -> Column:
    cap = S.tip_cap(F.col("tip"), F.col("pre_tax"), F.col("tax"), F.col("line_amount_usd"))
    meal = F.col("expense_type").isin(*MEALS)
    f2 = lambda c: F.format_string("%.2f", c)
    basis = F.concat(F.lit("20% × $"), f2(cap["base"]), F.when(cap["precise"], " post-tax").otherwise(" (total − tip)"))
    message = F.concat(F.when(meal, "Tip $").otherwise("Driver tip $"), f2(F.col("tip")), F.lit(f" exceeds {institution}'s 20% guideline (cap $"), f2(cap["cap"]), F.lit(", "), basis, F.lit("). Verify with the FA before filing."))
    path = F.when(meal, _line_path("meal_details.tip_amount")).otherwise(_line_path("ground_transport_details.tip_amount"))
    return F.when(F.col("expense_type").isin(*MEALS, *RIDES) & (F.col("tip") > cap["cap"] + 0.005), _review(7, path, message))


def _mileage(institution: str) -> Column:
    days = F.greatest(F.lit(1), S.days_inclusive(F.col("rental_start_date"), F.col("rental_end_date")))
    cap = S.mileage_cap(days)
    miles = F.col("miles_driven")
    message = F.concat(
        F.format_string("%.0f", miles.cast("double")), F.lit(" miles over "), days.cast("string"), F.lit(f" day(s) exceeds {institution}'s 350 mi/day cap (max "), cap.cast("string"), F.lit(" mi). Verify with the FA — excess may need special approval or won't be reimbursed.")
    )
    known = F.col("rental_start_date").isNotNull() & F.col("rental_end_date").isNotNull() & S.days_inclusive(F.col("rental_start_date"), F.col("rental_end_date")).isNotNull()
    return F.when(known & (miles > 0) & (miles > cap + 0.5), _review(8, _line_path("car_rental_details.miles_driven"), message))


def _window() -> Column:
    w, date = S.when_window(F.col("_when")), F.col("date_text")
    where = F.when(date < w["start"], F.concat(F.lit("before trip start "), w["start"])).when(date > w["end"], F.concat(F.lit("after trip end "), w["end"]))
    message = F.concat(F.lit("Transaction date "), date, F.lit(" is "), where, F.lit(". Was this purchased ahead of the trip, or is the wrong receipt attached?"))
    return F.when((F.length(date) == 10) & date.contains("-") & where.isNotNull(), _review(6, _line_path("common.date"), message))


def all_issues(reports: DataFrame, lines: DataFrame, parity: bool = True, institution: str = INSTITUTION, passes: tuple[int, ...] = PASSES) -> DataFrame:
    """Issues of all passes; pass_no and line_idx (-1: of the report) give their order.

    1 and 2: required report fields; 3: required line fields; 4: fields required under a
    condition; 5: category against countries and currencies; 6: dates outside the trip;
    7: tips; 8: miles of rented cars. Rules on a report are applied to the reports alone, each
    once, whatever lines it has and however they are numbered. Rules on lines meet the two
    columns of the report that they need; a line of an unknown report has no issues.
    Whether a report has a line abroad is summed up beside them. Rules on fields without a
    column aren't applied. With ``parity`` pass 3 reports nothing: the catalogue's keys name no
    line, so these checks never fire there.

    Defined results: repeated lines each have their issues; lines with a null line_idx have
    none; a repeated report has its issues once for each of its rows.
    """
    columns, known = lines.columns, reports.columns
    of_line, of_report = [], []
    if 1 in passes:
        of_report += _report_fields(1, "general_information", known)
    if 2 in passes:
        of_report += _report_fields(2, "transaction_summary", known)
    if 3 in passes:
        of_line += _line_fields(columns, parity)
    if 4 in passes:
        of_line += _conditional(columns)
    judged = reports
    if 5 in passes and {"country", "original_currency"} <= set(columns) and "category" in known:
        away = F.coalesce(~is_home(F.col("country")), F.lit(False)) | (is_foreign_currency(F.col("original_currency")) & (F.col("original_currency") != ""))
        message = F.concat(F.lit("Report is domestic but the line is in "), F.col("country"))
        of_line.append(F.when((F.col("_category") == "expenses_domestic") & ~is_home(F.col("country")), _review(5, _line_path("common.country_of_activity"), message)))
        abroad = lines.where(away).select("report_id", F.lit(True).alias("_away")).distinct()
        judged = reports.join(abroad, "report_id", "left")
        foreign = (F.col("category") == "expenses_foreign") & F.col("_away").isNull()
        of_report.append(F.when(foreign, _review(5, F.lit("expense_report.general_information.category"), F.lit("Report is foreign but no line has a foreign country or currency"), False)))
    if 6 in passes and "when_text" in known:
        of_line.append(_window())
    if 7 in passes and {"tip", "pre_tax", "tax"} <= set(columns):
        of_line.append(_tip(institution))
    if 8 in passes and {"miles_driven", "rental_start_date", "rental_end_date"} <= set(columns):
        of_line.append(_mileage(institution))
    none = F.lit(None).cast("struct<pass_no:int,line_idx:bigint,severity:string,kind:string,path:string,message:string>")
    found = lambda df, issues: df.select("report_id", F.inline(F.array_compact(F.array(none, *issues)))).select(*COLUMNS)
    # By names of their own, so that neither side's columns hide the other's.
    given = {"_category": "category", "_when": "when_text"}
    about = reports.select("report_id", *[F.col(c).alias(n) for n, c in given.items() if c in known])
    met = lines.where("line_idx is not null").join(about, "report_id")
    parts = [found(judged, of_report)] * bool(of_report) + [found(met, of_line)] * bool(of_line)
    return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0] if parts else found(reports, [])


def required_report_fields(reports: DataFrame, lines: DataFrame) -> DataFrame:
    """Report fields that must be there (passes 1 and 2)."""
    return all_issues(reports, lines, passes=(1, 2))


def required_line_fields(reports: DataFrame, lines: DataFrame, parity: bool = True) -> DataFrame:
    return all_issues(reports, lines, parity, passes=(3,))


def conditional_required(reports: DataFrame, lines: DataFrame) -> DataFrame:
    return all_issues(reports, lines, passes=(4,))


def category_consistency(reports: DataFrame, lines: DataFrame) -> DataFrame:
    return all_issues(reports, lines, passes=(5,))


def trip_window(reports: DataFrame, lines: DataFrame) -> DataFrame:
    return all_issues(reports, lines, passes=(6,))


def tips(reports: DataFrame, lines: DataFrame, institution: str = INSTITUTION) -> DataFrame:
    return all_issues(reports, lines, institution=institution, passes=(7,))


def car_mileage(reports: DataFrame, lines: DataFrame, institution: str = INSTITUTION) -> DataFrame:
    return all_issues(reports, lines, institution=institution, passes=(8,))


def review_status(reports: DataFrame, lines: DataFrame, issues: DataFrame) -> DataFrame:
    """Per report: lines, issues, errors and whether it is ready to file."""
    n = lines.groupBy("report_id").agg(F.count("*").alias("n_lines"))
    i = issues.groupBy("report_id").agg(F.count("*").alias("n_issues"), F.count_if(F.col("severity") == "error").alias("n_errors"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    joined = reports.select("report_id").join(n, "report_id", "left").join(i, "report_id", "left")
    status = F.when(zero("n_issues") == 0, "ready to file").otherwise(F.concat(F.col("n_issues").cast("string"), F.lit(" to review")))
    return joined.select("report_id", zero("n_lines").alias("n_lines"), zero("n_issues").alias("n_issues"), zero("n_errors").alias("n_errors"), (zero("n_errors") > 0).alias("has_errors"), status.alias("status"))


def advisory(rules: DataFrame) -> DataFrame:
    """Rules that nothing enforces (rule_type depends_on and validation_expression), as notes."""
    noted = rules.where(F.col("rule_type").isin("depends_on", "validation_expression"))
    text = F.coalesce("expression", F.concat(F.lit("depends on "), F.array_join("depends_on", ", ")))
    return noted.select("target_path", F.lit("info").alias("severity"), text.alias("message"))
