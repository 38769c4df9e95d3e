"""Dimension tables of the expense domain, as small DataFrames to broadcast."""

from __future__ import annotations

import json
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Display names of currencies, as the filing portal spells them.
CURRENCIES = {
    "AED": "United Arab Emirates Dirham",
    "ALL": "Albanian Lek",
    "AOA": "Angolanische Kwanza",
    "ARS": "Argentine peso",
    "AUD": "Australian Dollar",
    "BDT": "Bangladeshi Taka",
    "BGN": "Bulgarian Lev",
    "BRL": "Brazilian Real",
    "BWP": "Botswana Pula",
    "CAD": "Canadian Dollar",
    "CHF": "Swiss Franc",
    "CLP": "Chilean Peso",
    "CNY": "Chinese Yuan Renminbi",
    "COP": "Colombian Peso",
    "CRC": "Costa Rican Colon",
    "CZK": "Czech Koruna",
    "DKK": "Danish Krone",
    "DOP": "Dominican Peso",
    "EGP": "Egyptian Pound",
    "EUR": "Euro",
    "GBP": "British Pound",
    "GEL": "Georgian Lari",
    "GTQ": "Guatemalan Quetzal",
    "HKD": "Hong Kong Dollar",
    "HUF": "Hungarian Forint",
    "IDR": "Indonesian Rupiah",
    "ILS": "Israeli Shekel",
    "INR": "Indian Rupee",
    "ISK": "Icelandic Krona",
    "JMD": "Jamaican Dollar",
    "JOD": "Jordanian Dinars",
    "JPY": "Japanese Yen",
    "KES": "Kenyan Shilling",
    "KRW": "South Korean won",
    "KWD": "Kuwaiti Dinar",
    "KYD": "Cayman Islands Dollar",
    "KZT": "Kazakhstan Tenge",
    "LKR": "Sri Lankan Rupee",
    "LTL": "Lithuanian Litas",
    "LYD": "Libyan Dinar",
    "MAD": "Moroccan Dirham",
    "MGA": "Malagasy Ariary",
    "MOP": "Macanese Pataca",
    "MXN": "Mexican Peso",
    "MYR": "Malaysian Ringgit",
    "NAD": "Namibian Dollar",
    "NGN": "Nigerian Naira",
    "NIO": "Nicaraguan Córdoba",
    "NOK": "Norwegian Krone",
    "NPR": "Nepalese Rupee",
    "NZD": "New Zealand Dollar",
    "OMR": "Omani Rial",
    "PEN": "Sol",
    "PHP": "Philippine Peso",
    "PLN": "Polish Zloty",
    "PYG": "Paraguay Guarani",
    "QAR": "Qatari Rial",
    "RON": "Romanian Leu",
    "RSD": "Serbian Dinar",
    "SAR": "Saudi Riyal",
    "SEK": "Swedish Krona",
    "SGD": "Singapore Dollar",
    "THB": "Thai Baht",
    "TRY": "Turkish Lira",
    "TTD": "Trinidad and Tobago Dollar",
    "TWD": "New Taiwan dollar",
    "TZS": "Tanzanian Schilling",
    "UGX": "Ugandan Shilling",
    "USD": "US Dollar",
    "UYU": "Uruguayan Peso",
    "VEF": "Venezuelan Bolivar Fuerte",
    "VND": "Vietnamese Dong",
    "XOF": "West African CFA Franc",
    "ZAR": "South African Rand",
    "ZWD": "Zimbabwe Dollar",
}

# Placeholder rates, USD per unit.
PLACEHOLDER_RATES = {"INR": 0.012, "EUR": 1.07, "GBP": 1.27, "JPY": 0.0067}

# Business mileage rates, cents per mile, by the label of their period.
MILEAGE_RATES = {
    "2025": 70.0,
    "2024": 67.0,
    "2023": 65.5,
    "7/1/2022-12/31/2022": 62.5,
    "1/1/2022-6/30/2022": 58.5,
    "2021": 56.0,
    "2020": 57.5,
    "2019": 58.0,
    "2018\n\t\t\t\n\t\t\t\tTCJA": 54.5,
    "2017": 53.5,
    "2016": 54.0,
    "2015": 57.5,
    "2014": 56.0,
    "2013": 56.5,
    "2012": 55.5,
    "7/1/2011-12/31/2011": 55.5,
    "1/1/2011-6/30/2011": 51.0,
}

# Expense types and their labels on the domestic and the foreign page;
# with alcohol on the receipt, meals have a label of their own.
EXPENSE_LABELS = [
    ("adjusted_per_diem", "Adjusted Per Diem", "Adjusted Per Diem"),
    ("airfare_domestic", "Airfare", "Airfare - Foreign and Domestic"),
    ("airfare_foreign", "Airfare", "Airfare - Foreign and Domestic"),
    ("ancillary_airline_fee", "Ancillary Airline Fee", "Ancillary Airline Fee"),
    ("business_meal", "Business Meal", "Business Meal"),
    ("car_rental", "Car Rental", "Car Rental"),
    ("conference_registration", "Conference Registration", "Conference Registration"),
    ("gift_card_employee_foreign", "Gift Card - Employee", "Gift Card - Employee (Foreign)"),
    ("gifts_foreign_activity", "Gifts", "Gifts - Foreign Activity"),
    ("ground_transportation_domestic", "Ground Transportation", "Ground Transportation-Foreign"),
    ("ground_transportation_foreign", "Ground Transportation", "Ground Transportation-Foreign"),
    ("group_travel_meal", "Group Travel Meal", "Group Travel Meal"),
    ("human_subject_incentive", "Human Subject Incentive", "Human Subject Incentive"),
    ("lodging_domestic", "Lodging", "Lodging - Foreign and Domestic"),
    ("lodging_foreign", "Lodging", "Lodging - Foreign and Domestic"),
    ("membership_dues", "Membership Dues", "Membership Dues - Foreign"),
    ("other_business_expense", "Miscellaneous", "Miscellaneous - Foreign"),
    ("personal_mileage", "Personal Mileage", "Personal Mileage - Foreign"),
]

# Types that always go to the foreign page, and to the domestic one.
ALWAYS_FOREIGN = ("airfare_foreign", "gift_card_employee_foreign", "gifts_foreign_activity", "ground_transportation_foreign", "lodging_foreign")
ALWAYS_DOMESTIC = ("airfare_domestic", "ground_transportation_domestic", "lodging_domestic")

# The kind of an expense type, by its detail block, in display order.
KINDS = ("meal", "transport", "airfare", "lodging", "conference", "car_rental", "gift", "human_subject", "ancillary", "other")
KIND_OF_TYPE = {
    "business_meal": "meal",
    "group_travel_meal": "meal",
    "ground_transportation_domestic": "transport",
    "ground_transportation_foreign": "transport",
    "airfare_domestic": "airfare",
    "airfare_foreign": "airfare",
    "lodging_domestic": "lodging",
    "lodging_foreign": "lodging",
    "conference_registration": "conference",
    "car_rental": "car_rental",
    "gift_card_employee_foreign": "gift",
    "gifts_foreign_activity": "gift",
    "human_subject_incentive": "human_subject",
    "ancillary_airline_fee": "ancillary",
}

# Fields that must be there, by the object they stand in.
REQUIRED_FIELDS = {
    "general_information": [
        "category",
        "payee",
        "payee.name",
        "payee.payee_id",
        "payee.affiliation",
        "rush_processing",
        "payment_method",
        "business_purpose",
        "business_purpose.who",
        "business_purpose.what",
        "business_purpose.when",
        "business_purpose.where",
        "business_purpose.why",
        "event_name",
        "student_certification",
        "authorized_by",
    ],
    "transaction_summary": [
        "transaction_date",
        "total_usd",
    ],
    "transaction_lines[].common": [
        "date",
        "line_amount_usd",
        "expense_type",
        "remarks",
        "source_document",
    ],
    "transaction_lines[].airfare_details": [
        "travelers_name",
        "ticket_number",
        "ticket_amount",
        "booking_method",
        "airline",
        "class_of_ticket",
        "departure_airport",
        "destination_airport",
        "round_trip",
    ],
    "transaction_lines[].lodging_details": [
        "hotel_name",
        "location",
        "check_in_date",
        "check_out_date",
        "number_of_nights",
        "daily_rate",
        "booking_method",
        "is_shared_lodging",
    ],
    "transaction_lines[].ground_transport_details": [
        "origin",
        "destination",
        "service_provider",
        "missing_receipt",
    ],
    "transaction_lines[].conference_registration_details": [
        "conference_name",
        "order_number",
        "ticket_type",
        "attendee_name",
        "registration_system",
        "conference_start_date",
        "conference_end_date",
        "meals_included",
    ],
    "transaction_lines[].ancillary_details": [
        "fee_category",
        "airline",
        "description",
    ],
    "transaction_lines[].meal_details": [
        "venue_name",
        "attendees",
        "meal_purpose",
        "has_alcohol_on_receipt",
    ],
    "transaction_lines[].car_rental_details": [
        "rental_company",
        "pickup_location",
        "return_location",
        "rental_start_date",
        "rental_end_date",
        "vehicle_class",
        "insurance_included",
    ],
    "transaction_lines[].mileage_details": [
        "distance_miles",
        "origin",
        "destination",
        "trip_date",
    ],
    "transaction_lines[].gift_details": [
        "recipient_name",
        "recipient_relationship",
        "gift_purpose",
    ],
    "transaction_lines[].human_subject_details": [
        "irb_protocol_number",
        "number_of_subjects",
        "per_subject_amount",
    ],
    "per_diem_expenses[]": [
        "expense_type",
        "start_date",
        "end_date",
        "number_of_days",
        "location",
        "country_of_activity",
        "per_diem_rate",
        "remarks",
        "meal_deductions",
        "reimbursement_summary",
    ],
    "allocation_and_approvers": ["other_beneficiaries"],
}
# Fields that may be missing.
OPTIONAL_FIELDS = {
    "general_information.student_certification": [
        "supports_faculty_research",
        "presenting_at_conference",
        "integral_to_degree_work",
        "related_to_employment",
        "other",
    ],
    "transaction_summary": [
        "transaction_number",
        "status",
    ],
    "transaction_lines[].common.source_document": [
        "filename",
        "document_type",
    ],
    "transaction_lines[].lodging_details": ["personal_nights_excluded"],
    "transaction_lines[].ground_transport_details": [
        "tip_amount",
        "pre_tax_amount",
        "tax_amount",
    ],
    "transaction_lines[].conference_registration_details.meals_included": [
        "schedule",
        "schedule[]",
        "schedule[].date",
        "schedule[].breakfast",
        "schedule[].lunch",
        "schedule[].dinner",
    ],
    "transaction_lines[].meal_details": [
        "attendees[]",
        "attendees[].name",
        "attendees[].affiliation",
        "tip_amount",
        "pre_tax_amount",
        "tax_amount",
    ],
    "transaction_lines[].car_rental_details": ["miles_driven"],
    "transaction_lines[].mileage_details": ["vehicle_class"],
    "per_diem_expenses[]": [
        "meal_deductions[]",
        "meal_deductions[].date",
        "meal_deductions[].breakfast_provided",
        "meal_deductions[].lunch_provided",
        "meal_deductions[].dinner_provided",
        "meal_deductions[].deduction_amount",
        "reimbursement_summary[]",
        "reimbursement_summary[].date",
        "reimbursement_summary[].per_diem_amount",
        "reimbursement_summary[].meal_deduction",
        "reimbursement_summary[].net_amount",
    ],
    "allocation_and_approvers": [
        "beneficiary_list[]",
        "beneficiary_list[].name",
        "beneficiary_list[].relationship",
    ],
}
_AWAY = "expense_type in [airfare_foreign, gift_card_employee_foreign, gifts_foreign_activity, ground_transportation_foreign, lodging_foreign]"
# Fields and blocks that must be there when a condition holds, in order.
REQUIRED_WHEN = [
    ("general_information.student_certification.other_explanation", "student_certification.other == true"),
    ("transaction_lines[].common.original_currency", _AWAY),
    ("transaction_lines[].common.original_amount", _AWAY),
    ("transaction_lines[].common.exchange_rate", _AWAY),
    ("transaction_lines[].common.country_of_activity", _AWAY),
    ("transaction_lines[].common.foreign_activity_type", _AWAY),
    ("transaction_lines[].airfare_details", "expense_type in [airfare_domestic, airfare_foreign]"),
    ("transaction_lines[].lodging_details", "expense_type in [lodging_domestic, lodging_foreign]"),
    ("transaction_lines[].lodging_details.shared_with_transaction_number", "lodging_details.is_shared_lodging == true"),
    ("transaction_lines[].ground_transport_details", "expense_type in [ground_transportation_foreign, ground_transportation_domestic]"),
    ("transaction_lines[].conference_registration_details", "expense_type == conference_registration"),
    ("transaction_lines[].ancillary_details", "expense_type == ancillary_airline_fee"),
    ("transaction_lines[].meal_details", "expense_type in [business_meal, group_travel_meal]"),
    ("transaction_lines[].meal_details.alcohol_amount", "meal_details.has_alcohol_on_receipt == true"),
    ("transaction_lines[].car_rental_details", "expense_type == car_rental"),
    ("transaction_lines[].mileage_details", "expense_type == personal_mileage"),
    ("transaction_lines[].gift_details", "expense_type in [gift_card_employee_foreign, gifts_foreign_activity]"),
    ("transaction_lines[].human_subject_details", "expense_type == human_subject_incentive"),
    ("per_diem_expenses[].foreign_activity_type", "expense_type in [international_lodging, international_meals]"),
    ("allocation_and_approvers.beneficiary_list", "allocation_and_approvers.other_beneficiaries == true"),
]
# Required line fields that aren't looked at, as nothing fills them before a person does.
NOT_WALKED = ("conference_registration_details.conference_start_date", "conference_registration_details.conference_end_date", "conference_registration_details.meals_included")
WALKED_BLOCKS = ("common", "meal_details", "ground_transport_details", "lodging_details", "mileage_details", "conference_registration_details", "ancillary_details")
# Targets of conditions that are never reported, and conditions that nothing resolves.
UNCHECKED_TARGETS = ("transaction_lines[].ancillary_details", "transaction_lines[].mileage_details", "per_diem_expenses[].foreign_activity_type")
UNRESOLVED = ("meal_details.has_alcohol_on_receipt",)


def validation_rules(spark: SparkSession) -> DataFrame:
    """(path, required, required_expression) of every rule on a field."""
    when = dict(REQUIRED_WHEN)
    rows = [(f"expense_report.{group}.{f}", True, None) for group, fields in REQUIRED_FIELDS.items() for f in fields]
    rows += [(f"expense_report.{group}.{f}", False, None) for group, fields in OPTIONAL_FIELDS.items() for f in fields]
    rows += [(f"expense_report.{path}", False, condition) for path, condition in when.items()]
    return spark.createDataFrame(rows, "path string, required boolean, required_expression string")


def condition(text: str) -> tuple[str, list[str]] | None:
    """Field and accepted values of "field == value" or "field in [a, b]"; None for other text."""
    if " in " in text:
        field, values = text.split(" in ", 1)
        return field.strip(), [v.strip() for v in values.strip().strip("[]").split(",")]
    if "==" in text:
        field, value = text.split("==", 1)
        return field.strip(), [value.strip()]
    return None


def literal_map(values: dict) -> Column:
    """A constant map column; for a handful of keys."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def dim_currency(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CURRENCIES.items()), "code string, name string")


def dim_label(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EXPENSE_LABELS, "expense_type string, domestic string, foreign_ string")


def dim_mileage_rate(spark: SparkSession) -> DataFrame:
    """label, leading year and cents per mile of every period."""
    df = spark.createDataFrame(list(MILEAGE_RATES.items()), "label string, cents double")
    return df.withColumn("year", F.expr("try_cast(regexp_extract(trim(label), '^([0-9]{4})', 1) as int)"))


def load_mileage_rates(spark: SparkSession, path: str) -> DataFrame:
    """Mileage rates of a rate file: {rates_by_period: {label: {business: cents}}}."""
    text = spark.read.text(path, wholetext=True)
    kind = "struct<rates_by_period:map<string,struct<business:double,charity:double,medical_or_military_moving:double>>>"
    entry = F.explode(F.map_entries(F.from_json("value", kind)["rates_by_period"])).alias("e")
    return text.select(entry).select(F.col("e.key").alias("label"), F.col("e.value.business").alias("cents"))


def conditional_rules(spark: SparkSession) -> DataFrame:
    """(target, field, JSON list of its values) of the rules that hold under a condition."""
    return spark.createDataFrame([(t, condition(c)[0], json.dumps(condition(c)[1])) for t, c in REQUIRED_WHEN], "target string, on_field string, allowed string")

# The type of each field of a report, by its path below the report.
FIELD_TYPES = {
    "general_information.category": "enum",
    "general_information.payee.name": "string",
    "general_information.payee.payee_id": "string",
    "general_information.payee.affiliation": "enum",
    "general_information.rush_processing": "enum",
    "general_information.payment_method": "string",
    "general_information.business_purpose.who": "string",
    "general_information.business_purpose.what": "string",
    "general_information.business_purpose.when": "string",
    "general_information.business_purpose.where": "string",
    "general_information.business_purpose.why": "string",
    "general_information.event_name": "string",
    "general_information.student_certification.supports_faculty_research": "boolean",
    "general_information.student_certification.presenting_at_conference": "boolean",
    "general_information.student_certification.integral_to_degree_work": "boolean",
    "general_information.student_certification.related_to_employment": "boolean",
    "general_information.student_certification.other": "boolean",
    "general_information.student_certification.other_explanation": "string",
    "general_information.authorized_by": "string",
    "transaction_summary.transaction_number": "string",
    "transaction_summary.transaction_date": "date",
    "transaction_summary.status": "enum",
    "transaction_summary.total_usd": "number",
    "transaction_lines[].common.date": "date",
    "transaction_lines[].common.line_amount_usd": "number",
    "transaction_lines[].common.original_currency": "string",
    "transaction_lines[].common.original_amount": "number",
    "transaction_lines[].common.exchange_rate": "number",
    "transaction_lines[].common.expense_type": "enum",
    "transaction_lines[].common.remarks": "string",
    "transaction_lines[].common.country_of_activity": "string",
    "transaction_lines[].common.foreign_activity_type": "enum",
    "transaction_lines[].common.source_document.filename": "string",
    "transaction_lines[].common.source_document.document_type": "enum",
    "transaction_lines[].airfare_details.travelers_name": "string",
    "transaction_lines[].airfare_details.ticket_number": "string",
    "transaction_lines[].airfare_details.ticket_amount": "number",
    "transaction_lines[].airfare_details.booking_method": "enum",
    "transaction_lines[].airfare_details.airline": "string",
    "transaction_lines[].airfare_details.class_of_ticket": "enum",
    "transaction_lines[].airfare_details.departure_airport": "string",
    "transaction_lines[].airfare_details.destination_airport": "string",
    "transaction_lines[].airfare_details.round_trip": "boolean",
    "transaction_lines[].lodging_details.hotel_name": "string",
    "transaction_lines[].lodging_details.location": "string",
    "transaction_lines[].lodging_details.check_in_date": "date",
    "transaction_lines[].lodging_details.check_out_date": "date",
    "transaction_lines[].lodging_details.number_of_nights": "number",
    "transaction_lines[].lodging_details.daily_rate": "number",
    "transaction_lines[].lodging_details.booking_method": "enum",
    "transaction_lines[].lodging_details.is_shared_lodging": "boolean",
    "transaction_lines[].lodging_details.shared_with_transaction_number": "string",
    "transaction_lines[].lodging_details.personal_nights_excluded": "number",
    "transaction_lines[].ground_transport_details.origin": "string",
    "transaction_lines[].ground_transport_details.destination": "string",
    "transaction_lines[].ground_transport_details.service_provider": "string",
    "transaction_lines[].ground_transport_details.missing_receipt": "boolean",
    "transaction_lines[].ground_transport_details.tip_amount": "number",
    "transaction_lines[].ground_transport_details.pre_tax_amount": "number",
    "transaction_lines[].ground_transport_details.tax_amount": "number",
    "transaction_lines[].conference_registration_details.conference_name": "string",
    "transaction_lines[].conference_registration_details.order_number": "string",
    "transaction_lines[].conference_registration_details.ticket_type": "string",
    "transaction_lines[].conference_registration_details.attendee_name": "string",
    "transaction_lines[].conference_registration_details.registration_system": "enum",
    "transaction_lines[].conference_registration_details.conference_start_date": "date",
    "transaction_lines[].conference_registration_details.conference_end_date": "date",
    "transaction_lines[].conference_registration_details.meals_included.schedule[].date": "date",
    "transaction_lines[].conference_registration_details.meals_included.schedule[].breakfast": "boolean",
    "transaction_lines[].conference_registration_details.meals_included.schedule[].lunch": "boolean",
    "transaction_lines[].conference_registration_details.meals_included.schedule[].dinner": "boolean",
    "transaction_lines[].ancillary_details.fee_category": "enum",
    "transaction_lines[].ancillary_details.airline": "string",
    "transaction_lines[].ancillary_details.description": "string",
    "transaction_lines[].meal_details.venue_name": "string",
    "transaction_lines[].meal_details.attendees[].name": "string",
    "transaction_lines[].meal_details.attendees[].affiliation": "string",
    "transaction_lines[].meal_details.meal_purpose": "string",
    "transaction_lines[].meal_details.alcohol_amount": "number",
    "transaction_lines[].meal_details.tip_amount": "number",
    "transaction_lines[].meal_details.has_alcohol_on_receipt": "boolean",
    "transaction_lines[].meal_details.pre_tax_amount": "number",
    "transaction_lines[].meal_details.tax_amount": "number",
    "transaction_lines[].car_rental_details.rental_company": "string",
    "transaction_lines[].car_rental_details.pickup_location": "string",
    "transaction_lines[].car_rental_details.return_location": "string",
    "transaction_lines[].car_rental_details.rental_start_date": "date",
    "transaction_lines[].car_rental_details.rental_end_date": "date",
    "transaction_lines[].car_rental_details.vehicle_class": "string",
    "transaction_lines[].car_rental_details.insurance_included": "boolean",
    "transaction_lines[].car_rental_details.miles_driven": "number",
    "transaction_lines[].mileage_details.distance_miles": "number",
    "transaction_lines[].mileage_details.origin": "string",
    "transaction_lines[].mileage_details.destination": "string",
    "transaction_lines[].mileage_details.trip_date": "date",
    "transaction_lines[].mileage_details.vehicle_class": "enum",
    "transaction_lines[].gift_details.recipient_name": "string",
    "transaction_lines[].gift_details.recipient_relationship": "string",
    "transaction_lines[].gift_details.gift_purpose": "string",
    "transaction_lines[].human_subject_details.irb_protocol_number": "string",
    "transaction_lines[].human_subject_details.number_of_subjects": "number",
    "transaction_lines[].human_subject_details.per_subject_amount": "number",
    "per_diem_expenses[].expense_type": "enum",
    "per_diem_expenses[].start_date": "date",
    "per_diem_expenses[].end_date": "date",
    "per_diem_expenses[].number_of_days": "number",
    "per_diem_expenses[].location": "string",
    "per_diem_expenses[].country_of_activity": "string",
    "per_diem_expenses[].foreign_activity_type": "enum",
    "per_diem_expenses[].per_diem_rate": "number",
    "per_diem_expenses[].remarks": "string",
    "per_diem_expenses[].meal_deductions[].date": "date",
    "per_diem_expenses[].meal_deductions[].breakfast_provided": "boolean",
    "per_diem_expenses[].meal_deductions[].lunch_provided": "boolean",
    "per_diem_expenses[].meal_deductions[].dinner_provided": "boolean",
    "per_diem_expenses[].meal_deductions[].deduction_amount": "number",
    "per_diem_expenses[].reimbursement_summary[].date": "date",
    "per_diem_expenses[].reimbursement_summary[].per_diem_amount": "number",
    "per_diem_expenses[].reimbursement_summary[].meal_deduction": "number",
    "per_diem_expenses[].reimbursement_summary[].net_amount": "number",
    "allocation_and_approvers.other_beneficiaries": "boolean",
    "allocation_and_approvers.beneficiary_list[].name": "string",
    "allocation_and_approvers.beneficiary_list[].relationship": "string",
}
# What a field may hold. {} stands for the institution's name.
ALLOWED_VALUES = {
    "general_information.category": ["expenses_domestic", "expenses_foreign", "athletic_use_only", "hr_use_only", "human_subjects", "relocation"],
    "general_information.payee.affiliation": ["{}_student", "{}_postdoc", "{}_faculty", "{}_staff", "other"],
    "general_information.rush_processing": ["yes", "no"],
    "transaction_summary.status": ["draft", "submitted", "approved", "returned", "paid"],
    "transaction_lines[].common.expense_type": ["adjusted_per_diem", "airfare_domestic", "airfare_foreign", "ancillary_airline_fee", "business_meal", "car_rental", "conference_registration", "gift_card_employee_foreign", "gifts_foreign_activity", "ground_transportation_foreign", "ground_transportation_domestic", "group_travel_meal", "human_subject_incentive", "lodging_domestic", "lodging_foreign", "membership_dues", "other_business_expense", "personal_mileage"],
    "transaction_lines[].common.foreign_activity_type": ["conference", "research_collaboration", "fieldwork", "other"],
    "transaction_lines[].common.source_document.document_type": ["receipt", "booking_confirmation", "price_comparison", "currency_conversion", "conference_program", "missing_receipt_form", "other"],
    "transaction_lines[].airfare_details.booking_method": ["{}_travel_egencia", "{}_travel_key_travel", "{}_travel_connect_ua", "{}_travel_connect_dl", "{}_travel_connect_aa", "{}_travel_connect_as", "{}_travel_connect_ha", "other"],
    "transaction_lines[].airfare_details.class_of_ticket": ["coach", "premium_economy", "business", "first"],
    "transaction_lines[].lodging_details.booking_method": ["conference_hotel", "{}_travel_egencia", "{}_travel_key_travel", "other"],
    "transaction_lines[].conference_registration_details.registration_system": ["whova", "cvent", "acm_regonline", "eventbrite", "usenix", "other"],
    "transaction_lines[].ancillary_details.fee_category": ["wifi", "baggage", "seat", "priority_boarding", "other"],
    "transaction_lines[].mileage_details.vehicle_class": ["personal_car", "motorcycle"],
    "per_diem_expenses[].expense_type": ["alaska_hawaii_lodging", "alaska_hawaii_meals", "continental_us_lodging", "continental_us_meals", "international_lodging", "international_meals"],
    "per_diem_expenses[].foreign_activity_type": ["conference", "research_collaboration", "fieldwork", "other"],
}


def field_types(spark: SparkSession, institution: str = "institution") -> DataFrame:
    """template, type and allowed (null: anything) of every field of a report."""
    allowed = {p: [v.replace("{}", institution) for v in vs] for p, vs in ALLOWED_VALUES.items()}
    rows = [(f"expense_report.{p}", kind, allowed.get(p)) for p, kind in FIELD_TYPES.items()]
    return spark.createDataFrame(rows, "template string, type string, allowed array<string>")
