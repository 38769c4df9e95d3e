"""What comes in: checks of uploads, kinds and their types, evidence shown, conferences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reckoner.functions import scalars as S
from reckoner.operators.store import TEST_USERS, is_test_report

# Kinds of files and the expense types that each may have.
TYPES_OF_KIND = {
    "meal": ("business_meal", "group_travel_meal"),
    "transport": ("ground_transportation_domestic", "ground_transportation_foreign"),
    "lodging": ("lodging_domestic", "lodging_foreign"),
    "airfare": ("airfare_domestic", "airfare_foreign"),
    "conference_registration": ("conference_registration",),
    "miscellaneous": ("other_business_expense",),
    "membership": ("membership_dues",),
    "mileage": ("personal_mileage",),
    "ancillary": ("ancillary_airline_fee",),
}
# The detail block that a kind's lines must have.
BLOCK_OF_KIND = {
    "meal": "meal_details",
    "transport": "ground_transport_details",
    "lodging": "lodging_details",
    "airfare": "airfare_details",
    "conference_registration": "conference_registration_details",
    "ancillary": "ancillary_details",
}
# File types that may be uploaded, that can be recognised, and that are extracted.
UPLOAD_ENDINGS = (".heic", ".heif", ".jpeg", ".jpg", ".pdf", ".png")
MIME_OF_ENDING = {
    ".pdf": "application/pdf",
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".tif": "image/tiff",
    ".tiff": "image/tiff",
    ".gif": "image/gif",
    ".bmp": "image/bmp",
    ".webp": "image/webp",
}
EXTRACTED_ENDINGS = (".pdf", ".png", ".jpg", ".jpeg")
# Labels of the foreign page.
TICKET_CLASSES = {"coach": "Coach", "first": "First", "premium_economy": "Premium Economy/Business", "business": "Premium Economy/Business"}
ACTIVITIES = {"conference": "Conferences", "research_collaboration": "Collaborations/Meetings", "fieldwork": "Research: Field work", "other": "Other"}
CONNECTED_AIRLINES = ("ua", "dl", "aa", "as", "ha")


def _looked_up(values: dict[str, str], key: Column) -> Column:
    found = F.lit(None).cast("string")
    for k, v in values.items():
        found = F.when(key == k, v).otherwise(found)
    return found


def affiliation_label(code: Column, institution: str) -> Column:
    """Members of the institution, whatever their role, travel alike; others visit."""
    mine = F.startswith(code, F.lit(f"{institution.lower()}_"))
    return F.when(code == "other", "Visitor").when(mine, f"{institution} Traveler")


def booking_label(code: Column, institution: str) -> Column:
    base = f"{institution.lower()}_travel"
    connect = {f"{base}_connect_{a}": f"{institution} Travel Connect (UA, DL, AA, AS and HA)" for a in CONNECTED_AIRLINES}
    return _looked_up({f"{base}_egencia": f"{institution} Travel - Egencia", f"{base}_key_travel": f"{institution} Travel - Key Travel", "other": f"Other (Not a {institution} Travel Booking Method)", **connect}, code)


def ticket_class_label(code: Column) -> Column:
    return _looked_up(TICKET_CLASSES, code)


def activity_label(code: Column) -> Column:
    return _looked_up(ACTIVITIES, code)


def ending(name: Column) -> Column:
    """A file name's ending in lower case, with its point; "" without one."""
    return F.lower(F.regexp_extract(name, r"[^/](\.[^./]+)$", 1))


def mime_type(name: Column, extracted: bool = False) -> Column:
    """By the ending; null if it is not known, or with ``extracted`` not extracted."""
    values = {k: v for k, v in MIME_OF_ENDING.items() if not extracted or k in EXTRACTED_ENDINGS}
    return _looked_up(values, ending(name))


def rejection(name: Column, kind: Column, event_name: Column, payee_id: Column) -> Column:
    """Why an upload's file is turned away; the first reason counts, null if it is accepted."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    quoted = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    listed = lambda xs: "[" + ", ".join(f"'{x}'" for x in sorted(xs)) + "]"
    known = F.trim(kind).isin(*TYPES_OF_KIND)
    return (
        F.when(blank(kind), F.concat(F.lit("Missing kind for file "), quoted(name), F.lit(".")))
        .when(~known, F.concat(F.lit("Unknown kind "), quoted(F.trim(kind)), F.lit(" for file "), quoted(name), F.lit(f" (known: {listed(TYPES_OF_KIND)}).")))
        .when(~ending(name).isin(*UPLOAD_ENDINGS), F.concat(F.lit("Unsupported file type "), quoted(ending(name)), F.lit(" for "), quoted(name), F.lit(f". Allowed: {listed(UPLOAD_ENDINGS)}.")))
        .when(blank(event_name), "Missing required field: Event name.")
        .when(blank(payee_id), "Missing required field: payee id.")
    )


def is_user_id(text: Column) -> Column:
    return text.rlike(r"^[A-Za-z0-9_-]{2,16}\z")


def signed_in(header: Column) -> Column:
    """The user of "provider:local@domain" in lower case; null if it isn't shaped like one."""
    local = F.lower(F.trim(F.regexp_extract(header, r"^[^:]*:([^@]*)@", 1)))
    return F.when(is_user_id(local), local)


def block_matches(kind: Column, blocks: Column) -> Column:
    """Whether a line of a kind has its detail block; true for kinds without one."""
    block = _looked_up(BLOCK_OF_KIND, kind)
    return block.isNull() | F.coalesce(F.array_contains(blocks, block), F.lit(False))


def kinds(spark: SparkSession) -> DataFrame:
    """(kind, expense_type) of the catalogue."""
    return spark.createDataFrame([(k, t) for k, ts in TYPES_OF_KIND.items() for t in ts], "kind string, expense_type string")


def drift(catalogue: DataFrame, master: DataFrame) -> DataFrame:
    """Per kind, how many of its types the master list (expense_type) doesn't have; none left out."""
    known = master.select("expense_type", F.lit(True).alias("_known")).distinct()
    return catalogue.join(known, "expense_type", "left").groupBy("kind").agg(F.count_if(F.col("_known").isNull()).alias("n_unknown"))


def spot(evidence: Column) -> Column:
    """The first evidence that stands on a page: a span with file, page and quote."""
    stands = lambda e: (e["kind"] == "document_span") & e["filename"].isNotNull() & e["page"].isNotNull() & (e["quote"] != "")
    return F.get(F.filter(evidence, lambda e: F.coalesce(stands(e), F.lit(False))), F.lit(0))


def provenance(evidence: Column) -> Column:
    """What is shown as a value's source: its first quote, or what its first origin means."""
    first = lambda name: F.get(F.filter(F.transform(evidence, lambda e: e[name]), lambda x: x.isNotNull()), F.lit(0))
    quote = first("quote")
    return F.when(quote != "", quote).otherwise(S.origin_text(first("origin")))


def is_unknown(value: Column, meta: Column, default_confidence: str = "low") -> Column:
    """A leaf without a value and with nothing in its metadata."""
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    plain = F.coalesce(meta["confidence"] == default_confidence, F.lit(True)) & empty(meta["evidence"]) & ~F.coalesce(meta["needs_review"], F.lit(False)) & empty(meta["flags"])
    return value.isNull() & (meta.isNull() | (plain & meta["confidence_reason"].isNull()))


def availability(extractions: DataFrame, files: DataFrame) -> DataFrame:
    """Each extraction (upload_id, source_filename) with the state of its file: unnamed, missing or there."""
    have = files.select("upload_id", F.col("name").alias("source_filename"), F.lit(True).alias("_there")).distinct()
    joined = extractions.join(have, ["upload_id", "source_filename"], "left")
    state = F.when(F.coalesce("source_filename", F.lit("")) == "", "unnamed").when(F.col("_there").isNull(), "missing").otherwise("there")
    return joined.withColumn("state", state).drop("_there")


def rehydrated(reports: DataFrame, files: DataFrame) -> DataFrame:
    """Stored reports with the names of their files by category, in order."""
    named = files.groupBy("upload_id").agg(F.array_sort(F.collect_list(F.struct("category", "name"))).alias("_files"))
    of = lambda c: F.transform(F.filter("_files", lambda f: f["category"] == c), lambda f: f["name"])
    joined = reports.join(named, "upload_id", "left")
    return joined.select(*reports.columns, *[F.coalesce(of(c), F.array().cast("array<string>")).alias(f"{c}s") for c in ("receipt", "extraction")])


def cleanup(reports: DataFrame, files: DataFrame, patterns: tuple[str, ...] = TEST_USERS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reports that go, reports that stay, files that stay); ``patterns``: of test users."""
    test = F.coalesce(is_test_report(F.col("upload_id"), F.col("payee_id"), patterns) | is_test_report(F.col("upload_id"), F.col("filed_by"), patterns), F.lit(False))
    gone = reports.where(test)
    return gone, reports.where(~test), files.join(gone.select("upload_id"), "upload_id", "left_anti")


def shown(reports: DataFrame) -> DataFrame:
    """A listing's columns: who is paid, for what, and how much; a dash for what is missing."""
    text = lambda *cs: F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in cs], F.lit("—"))
    total = F.when(F.col("total_usd").isNotNull(), F.concat(F.lit("$"), F.format_number("total_usd", 2))).otherwise("—")
    return reports.select("upload_id", text("payee_name", "payee_id").alias("payee"), text("event_name").alias("event"), total.alias("total"))


def conference(documents: DataFrame) -> DataFrame:
    """Per report, of its supporting documents (scheduled_dates, venues_mentioned): first and
    last date, the text of the window, and all venues in order."""
    dates = documents.groupBy("report_id").agg(F.min(F.array_min("scheduled_dates")).alias("conference_start_date"), F.max(F.array_max("scheduled_dates")).alias("conference_end_date"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("venues_mentioned")))).alias("venues"))
    start, end = F.col("conference_start_date"), F.col("conference_end_date")
    return dates.withColumn("when_text", F.when(start == end, start).otherwise(F.concat(start, F.lit(" to "), end)))


def is_presenting(attendee: Column, papers: Column) -> Column:
    """Whether an attendee's name stands in the authors of any paper."""
    name = F.lower(F.trim(attendee))
    return (name != "") & F.exists(papers, lambda p: F.contains(F.lower(p["authors_string"]), name))


def personal_nights(check_in: Column, check_out: Column, start: Column, end: Column) -> Column:
    """Nights of a stay outside a conference, whose last night is that before its end."""
    nights = S.nights_between(check_in, check_out)
    common = F.greatest(F.lit(0), S.nights_between(F.greatest(check_in, start), F.least(check_out, end)))
    return nights - F.coalesce(common, F.lit(0))


def per_diem(entries: DataFrame) -> DataFrame:
    """One row per day of per-diem entries (start_date, end_date, per_diem_rate,
    meal_deductions: date and amount): rate, deduction and what is left, not below 0."""
    days = entries.where("start_date is not null and end_date >= start_date").withColumn("day", F.explode(F.sequence(F.to_date("start_date"), F.to_date("end_date"))))
    taken = F.aggregate(F.filter("meal_deductions", lambda m: F.to_date(m["date"]) == F.col("day")), F.lit(0.0), lambda total, m: total + m["deduction_amount"])
    out = days.withColumn("meal_deduction", F.coalesce(taken, F.lit(0.0)))
    return out.withColumn("net_amount", F.greatest(F.lit(0.0), F.col("per_diem_rate") - F.col("meal_deduction"))).drop("meal_deductions")
