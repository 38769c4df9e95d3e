"""Scalar functions of the expense domain, as built-in Column expressions."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Month names of portal dates.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
_DATE = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def portal_date(iso: Column) -> Column:
    """YYYY-MM-DD as DD-Mon-YYYY; other text unchanged. The day isn't checked."""
    month = F.substring(iso, 6, 2).try_cast("int")
    name = F.get(F.array(*[F.lit(m) for m in MONTHS]), month - 1)
    good = iso.rlike(_DATE) & month.between(1, 12)
    return F.when(good, F.concat(F.substring(iso, 9, 2), F.lit("-"), name, F.lit("-"), F.substring(iso, 1, 4))).otherwise(iso)


def is_iso_date(text: Column) -> Column:
    """Shape only: Feb 30 passes."""
    return text.rlike(_DATE)


def when_window(text: Column) -> Column:
    """struct(start, end) of "a to b" or of a single day; null for other text."""
    parts = F.split(text, " to ")
    start, end = F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))
    good = (F.size(parts) <= 2) & is_iso_date(start) & is_iso_date(end)
    return F.when(good, F.struct(start.alias("start"), end.alias("end")))


def day_number(date: Column) -> Column:
    """Gregorian day number of y-m-d with or without leading zeros; null if malformed."""
    p = F.split(date, "-")
    y, m, d = (F.get(p, F.lit(k)).try_cast("long") for k in range(3))
    good = (F.size(p) == 3) & m.between(1, 12) & d.between(1, 31)
    yy = y - F.when(m <= 2, 1).otherwise(0)
    era = F.floor(yy / 400)
    yoe = yy - era * 400
    doy = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    return F.when(good, era * 146097 + yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy)


def nights_between(check_in: Column, check_out: Column) -> Column:
    n = day_number(check_out) - day_number(check_in)
    return F.when(n >= 0, n)


def days_inclusive(start: Column, end: Column) -> Column:
    """end - start + 1 for strict ten-character dates."""
    return F.when((F.length(start) == 10) & (F.length(end) == 10), day_number(end) - day_number(start) + 1)


def mileage_amount(distance: Column, usd_per_mile: Column) -> Column:
    return F.round(distance * usd_per_mile * 100) / 100


def tip_cap(tip: Column, pre_tax: Column, tax: Column, total: Column) -> Column:
    """struct(cap, base, precise) where a tip has one, else null."""
    precise = pre_tax.isNotNull() & tax.isNotNull() & (pre_tax + tax > 0)
    base = F.when(precise, pre_tax + tax).otherwise(total - tip)
    return F.when((tip > 0) & (base > 0), F.struct((base * 0.20).alias("cap"), base.alias("base"), F.coalesce(precise, F.lit(False)).alias("precise")))


def mileage_cap(days: Column) -> Column:
    return F.greatest(F.lit(1), days) * 350


def money_text(amount: Column, currency: Column) -> Column:
    """Symbol and two decimals for known currencies, code and amount for others."""
    sign = F.when(currency.isNull() | (currency == "USD"), "$").when(currency == "EUR", "€").when(currency == "GBP", "£").when(currency.isin("JPY", "CNY"), "¥").when(currency == "INR", "₹")
    return F.when(amount.isNotNull(), F.concat(F.coalesce(sign, F.concat(currency, F.lit(" "))), F.format_string("%.2f", amount)))


def original_amount_display(original: Column, currency: Column, usd: Column) -> Column:
    return F.when(original.isNotNull(), money_text(original, currency)).otherwise(money_text(usd, F.lit("USD")))


def title_case(snake: Column) -> Column:
    return F.array_join(F.transform(F.split(snake, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2**20))), " ")


def line_headline(kind: Column, venue: Column, provider: Column, airline: Column, departure: Column, destination: Column, round_trip: Column, hotel: Column, conference: Column, fee: Column) -> Column:
    """What a line is about, by its kind: a venue, a service, an airline and its route ..."""
    has = lambda c: F.coalesce(c != "", F.lit(False))
    route = F.concat(airline, F.lit(" "), departure, F.when(F.coalesce(round_trip, F.lit(False)), "↔").otherwise("→"), destination)
    flown = F.when(has(airline) & has(departure) & has(destination), route).otherwise("(airfare)")
    charged = F.when(has(airline) & has(fee), F.concat(airline, F.lit(" — "), title_case(fee), F.lit(" fee"))).when(has(airline), airline).otherwise("(ancillary fee)")
    text = F.lit("—")
    for name, shown in (
        ("ancillary", charged),
        ("conference", F.when(has(conference), conference).otherwise("(conference)")),
        ("lodging", F.when(has(hotel), hotel).otherwise("(no hotel name)")),
        ("airfare", flown),
        ("transport", F.when(has(provider), provider).otherwise("(no service provider)")),
        ("meal", F.when(has(venue), venue).otherwise("(no venue)")),
    ):
        text = F.when(kind == name, shown).otherwise(text)
    return text


def expense_type_display(kind: Column, alcohol: Column) -> Column:
    meal = kind.isin("business_meal", "group_travel_meal")
    return F.when(meal & (alcohol > 0), F.concat(title_case(kind), F.lit(" with Alcohol"))).otherwise(title_case(kind))


# Labels of fields whose name differs from what is shown, by the path's end.
LABELS = {
    "transaction_summary.transaction_date": "Trip Date",
    "transaction_summary.total_usd": "Total USD",
    "transaction_summary.transaction_number": "Transaction Number",
    "general_information.category": "Category",
    "general_information.payment_method": "Payment Method",
    "general_information.event_name": "Event Name",
    "general_information.authorized_by": "Authorized By",
    "general_information.rush_processing": "Rush Processing",
}
# Sections that a label leaves out in front, and blocks that it leaves out inside.
SECTIONS = ("general_information", "transaction_summary", "per_diem_expenses", "mileage_expenses", "allocation_and_approvers")
BLOCKS = (
    "common",
    "meal_details",
    "ground_transport_details",
    "airfare_details",
    "lodging_details",
    "conference_registration_details",
    "car_rental_details",
    "gift_details",
    "human_subject_details",
)


def friendly_label(path: Column) -> Column:
    """A field's label: "Line n: " in front for lines, names of groups kept ("Payee: Name")."""
    parts = F.split(F.regexp_replace(path, r"^expense_report\.", ""), r"\.")
    line = F.regexp_extract(F.get(parts, F.lit(0)), r"^transaction_lines\[([0-9]+)\]$", 1)
    rest = F.when((line != "") | F.get(parts, F.lit(0)).isin(*SECTIONS), F.slice(parts, 2, 1000)).otherwise(parts)
    kept = F.filter(rest, lambda name, k: ~name.isin(*BLOCKS) | (k == F.size(rest) - 1))
    label = F.array_join(F.transform(kept, title_case), ": ")
    label = F.when(line != "", F.concat(F.lit("Line "), (line.cast("bigint") + 1).cast("string"), F.lit(": "), label)).otherwise(label)
    for end, text in LABELS.items():
        label = F.when(path.endswith(end), text).otherwise(label)
    return label


# What the codes of derived values mean; other codes have no text.
ORIGINS = {
    "reduce.total_usd": "sum of all line amounts",
    "reduce.earliest_date": "earliest date across all receipts",
    "reduce.inferred_category": "based on receipt currencies",
    "reduce.lodging.daily_rate": "average of per-night rates",
    "reduce.lodging.number_of_nights": "check-out minus check-in",
    "reduce.fx.mock": "converted via mock FX rate (placeholder; real-time tool TBD)",
}


def origin_text(code: Column) -> Column:
    """How a derived value came about, for a reader; null for codes of absence."""
    text = F.lit(None).cast("string")
    for k, v in ORIGINS.items():
        text = F.when(code == k, v).otherwise(text)
    return text


def field_anchor(path: Column) -> Column:
    return F.lower(F.regexp_replace(path, "[^A-Za-z0-9]", "-"))


def path_template(path: Column) -> Column:
    return F.regexp_replace(path, r"\[[0-9]+\]", "[]")


def path_steps(path: Column) -> Column:
    """Names and indexes of a path in order; null if it is malformed.

    A name is anything but points and opening brackets; indexes follow it.
    """
    part = r"[^.\[]+(?:\[[0-9]+\])*"
    steps = F.transform(F.split(path, r"\."), lambda c: F.concat(F.array(F.regexp_extract(c, r"(?s)^([^\[]+)", 1)), F.regexp_extract_all(c, F.lit(r"\[([0-9]+)\]"), F.lit(1))))
    return F.when(path.rlike(rf"\A{part}(?:\.{part})*\z"), F.flatten(steps))


def coerce_bool(text: Column) -> Column:
    """struct(value, error): yes and no in several spellings, blank is null."""
    t = F.lower(F.trim(text))
    value = F.when(t.isin("yes", "true", "1", "y", "t"), True).when(t.isin("no", "false", "0", "n", "f"), False)
    return F.struct(value.alias("value"), (value.isNull() & (t != "")).alias("error"))


def coerce_number(text: Column) -> Column:
    """struct(value, error): $ and , ignored, blank is null."""
    t = F.trim(F.translate(text, "$,", ""))
    # Java reads a letter behind a number as its type.
    value = F.when(~t.rlike("[0-9.][dDfF]$"), t.try_cast("double"))
    return F.struct(value.alias("value"), (value.isNull() & (t != "")).alias("error"))


def coerce_by_type(text: Column, kind: Column, old_kind: Column | None = None) -> Column:
    """struct(value as text, error). The type of the old value decides ("boolean", "number"
    or "string"; null where there is none), and without one the type that the field has.

    Text is trimmed, and blank text is null.
    """
    t = F.trim(text)
    use = kind if old_kind is None else F.coalesce(old_kind, kind)
    b, n = coerce_bool(t), coerce_number(t)
    value = F.when(t == "", None).when(use == "boolean", b["value"].cast("string")).when(use == "number", shown_number(n["value"])).otherwise(t)
    error = F.when(use == "boolean", b["error"]).when(use == "number", n["error"]).otherwise(False)
    return F.struct(value.alias("value"), error.alias("error"))


def validate_enum(value: Column, allowed: Column) -> Column:
    """null if the value is allowed, else a message with the first five that are."""
    more = F.when(F.size(allowed) > 5, F.concat(F.lit(", … ("), F.size(allowed).cast("string"), F.lit(" total)"))).otherwise("")
    some = F.concat(F.array_join(F.slice(allowed, 1, 5), ", "), more)
    return F.when(value.isNotNull() & ~F.array_contains(allowed, value), F.concat(F.lit("must be one of: "), some))


# Spellings of form fields, in normal form, and their codes.
RUSH_CODES = {"yes": "yes", "true": "yes", "no": "no", "false": "no"}
ACTIVITY_CODES = {"conference": "conference", "research_collaboration": "research_collaboration", "fieldwork": "fieldwork", "other": "other"}


def affiliation_codes(institution: str) -> dict[str, str]:
    """Spellings of affiliations; the codes begin with the institution's name."""
    roles = ("student", "postdoc", "faculty", "staff")
    return {**{r: f"{institution}_{r}" for r in roles}, **{f"{institution}_{r}": f"{institution}_{r}" for r in roles}, "other": "other"}


def normalize_enum(text: Column, codes: dict[str, str] | None = None) -> Column:
    """Trimmed, lower case, spaces as underscores; with ``codes`` the code, null if unknown."""
    normal = F.replace(F.lower(F.trim(text)), F.lit(" "), F.lit("_"))
    if codes is None:
        return normal
    found = F.lit(None).cast("string")
    for spelling, code in codes.items():
        found = F.when(normal == spelling, code).otherwise(found)
    return found


def sanitize_filename(name: Column) -> Column:
    """The last part of a path, each run of other characters as one _; "upload" if empty."""
    last = F.regexp_extract(F.regexp_replace(name, r"(/\.?)+$", ""), r"([^/]*)$", 1)
    clean = F.regexp_replace(F.when(last == ".", "").otherwise(last), "[^A-Za-z0-9._-]+", "_")
    return F.when(clean == "", "upload").otherwise(clean)


def valid_id(text: Column) -> Column:
    return text.rlike(r"^[A-Za-z0-9_-]+\z")


# Currency codes that quotes and tokens disagree about, and punctuation that
# counts as a space. Points (decimals) and @ stay.
QUOTE_CODES = (
    "USD",
    "EUR",
    "GBP",
    "JPY",
    "CNY",
    "INR",
    "SGD",
    "AUD",
    "CAD",
    "HKD",
    "CHF",
    "NZD",
    "SEK",
    "NOK",
    "DKK",
    "MXN",
    "ZAR",
    "KRW",
    "THB",
    "MYR",
    "IDR",
    "PHP",
    "VND",
    "BRL",
    "ARS",
    "TWD",
    "AED",
    "SAR",
)
QUOTE_SIGNS = "[$₹€£¥]"
QUOTE_PUNCTUATION = r"[:;,()\[\]{}<>'\"!?\\|*+=&^~`\-/%]"


def quote_norm(text: Column) -> Column:
    """Currency signs and whole-word codes dropped, punctuation to spaces, lower case."""
    codes = rf"(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(QUOTE_CODES)})(?![\p{{L}}\p{{N}}_])"
    bare = F.regexp_replace(F.regexp_replace(text, f"{QUOTE_SIGNS}|{codes}", ""), QUOTE_PUNCTUATION, " ")
    return F.lower(F.trim(F.regexp_replace(bare, r"(?U)\s+", " ")))


def edit_likeness(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance over the longer length; 0 if either is empty.

    Built in, and no measure of the verifier (see ``similarity``).
    """
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1 - F.levenshtein(a, b) / longest)


@F.pandas_udf(T.DoubleType())
def _matching_share(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)], dtype="float64")


def similarity(a: Column, b: Column) -> Column:
    """Two times the characters in matching blocks over all characters; 0 if either is
    empty or null, 1 if they are equal. Blocks are the longest match, then those on either side.

    Only pairs that aren't equal go to Python, in Arrow batches; texts are quotes of a line.
    """
    differ = a != b
    share = _matching_share(F.when(differ, a).otherwise(""), F.when(differ, b).otherwise(""))
    return F.when((F.length(a) > 0) & (a == b), 1.0).otherwise(F.coalesce(share, F.lit(0.0)))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _shares(a: pd.Series, b: pd.Series) -> pd.Series:
    share = lambda x, y: 0.0 if not x or not y else 1.0 if x == y else SequenceMatcher(None, x, y).ratio()
    return pd.Series([None if xs is None else [share(x, y) for x, y in zip(xs, ys, strict=True)] for xs, ys in zip(a, b, strict=True)], dtype="object")


def similarities(a: Column, b: Column) -> Column:
    """``similarity`` of the texts of two arrays, pair by pair."""
    return _shares(a, b)


def csv_field(text: Column) -> Column:
    """RFC 4180 quoting."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def bbox_union(boxes: Column) -> Column:
    """[min, min, max, max] of boxes of four numbers; null without one."""
    good = F.filter(boxes, lambda b: F.size(b) == 4)
    at = lambda k: F.transform(good, lambda b: F.get(b, F.lit(k)))
    return F.when(F.size(good) > 0, F.array(F.array_min(at(0)), F.array_min(at(1)), F.array_max(at(2)), F.array_max(at(3))))


def vertices_to_bbox(vertices: Column) -> Column:
    """The box around vertices of struct(x, y); null without one."""
    x, y = F.transform(vertices, lambda v: v["x"]), F.transform(vertices, lambda v: v["y"])
    return F.when(F.size(vertices) > 0, F.array(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y)))


def shown_number(value: Column) -> Column:
    """A double without a trailing .0."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def confidence_rank(level: Column) -> Column:
    """low 0, medium 1, high 2; null counts as low."""
    return F.when(level == "high", 2).when(level == "medium", 1).otherwise(0)


def confidence_name(rank: Column) -> Column:
    return F.when(rank == 2, "high").when(rank == 1, "medium").otherwise("low")


# Parts of paths that decide how a field is shown and reviewed.
AMOUNT_PARTS = ("amount", "rate", "total", "fare", "deduction", "net_amount")
LONG_TEXT_PARTS = ("purpose", "remarks", "explanation", "why", "what", "where", "when")
CRITICAL_PARTS = ("amount", "currency", "date", "expense_type", "payee", "airline", "hotel", "rate")


def _has_part(path: Column, parts: tuple[str, ...]) -> Column:
    return path.rlike("|".join(parts))


def control_type(kind: Column, path: Column) -> Column:
    """How a form shows a field of a type: select, checkbox, date, currency, number, textarea or text."""
    number = F.when(_has_part(path, AMOUNT_PARTS), "currency").otherwise("number")
    text = F.when(_has_part(path, LONG_TEXT_PARTS), "textarea").otherwise("text")
    return F.when(kind == "enum", "select").when(kind == "boolean", "checkbox").when(kind == "date", "date").when(kind == "number", number).otherwise(text)


def entry_mode(tier: Column) -> Column:
    """Who fills a field, by its tier."""
    return F.when(tier == "T1", "user_confirmed_input").when(tier == "T2", "computed_readonly").when(tier.isin("T3", "T4"), "model_prefill_review").otherwise("structural")


def review_priority(path: Column, required: Column, expression: Column) -> Column:
    """high for required fields that matter, medium for other required ones, else low."""
    needed = F.coalesce(required, F.lit(False)) | (F.coalesce(expression, F.lit("")) != "")
    return F.when(needed & _has_part(path, CRITICAL_PARTS), "high").when(needed, "medium").otherwise("low")


def inherited_tier(tiers: Column) -> Column:
    """The tier of the nearest of a node and its parents that has one (from the root down)."""
    return F.get(F.reverse(F.filter(tiers, lambda t: t.isNotNull())), F.lit(0))
