"""Readers and writers of receipts, reports, forms, rate pages and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVIDENCE = "struct<kind:string,document_id:string,filename:string,page:int,quote:string,origin:string,bboxes:array<array<double>>,token_ids:array<int>>"
META = f"struct<confidence:string,evidence:array<{EVIDENCE}>,needs_review:boolean,flags:array<string>,confidence_reason:string>"


def wrapped(kind: str) -> str:
    return f"struct<value:{kind},_meta:{META}>"


COMMON = "struct<" + ",".join(
    f"{n}:{wrapped(t)}"
    for n, t in {
        "date": "string", "line_amount_usd": "double", "original_currency": "string", "original_amount": "double", "exchange_rate": "double",
        "expense_type": "string", "remarks": "string", "country_of_activity": "string", "foreign_activity_type": "string",
    }.items()
) + ">"
RECEIPT = (
    f"struct<source_filename:string,common:{COMMON},extras:struct<merchant_address:{wrapped('string')},printed_currency:{wrapped('string')},"
    "nightly_rates:array<struct<date:string,rate:double,taxes_and_fees:double>>,segments:array<struct<flight_number:string,from_airport:string,to_airport:string,departure_datetime:string>>>>"
)
# Fields of the form's input, all of them optional.
FORM_FIELDS = (
    "payee_name",
    "payee_id",
    "payee_affiliation",
    "event_name",
    "business_purpose_who",
    "business_purpose_what",
    "business_purpose_when",
    "business_purpose_where",
    "business_purpose_why",
    "authorized_by",
    "rush_processing",
    "payment_method",
    "foreign_activity_type",
)
SUPPORTING = (
    f"struct<source_filename:string,conference_name_as_printed:{wrapped('string')},doc_kind:{wrapped('string')},scheduled_dates:array<string>,venues_mentioned:array<string>,"
    "papers_listed:array<struct<title:string,authors_string:string>>,workshops_listed:array<string>>"
)
SYNTHESIS = (
    f"struct<source_filename:string,canonical_event_name:{wrapped('string')},participant_role:{wrapped('string')},business_purpose_what:{wrapped('string')},business_purpose_why:{wrapped('string')},"
    f"source_filenames:array<string>,synthesis_confidence:{wrapped('string')}>"
)


def read_form_input(spark: SparkSession, path: str, payee_key: str = "payee_id") -> DataFrame:
    """file_name and the fields of form input files, one JSON object each; missing ones are null.

    ``payee_key``: what the files call the payee's id.
    """
    kind = ", ".join(f"`{payee_key if f == 'payee_id' else f}` string" for f in FORM_FIELDS)
    df = spark.read.schema(kind).option("multiLine", True).option("pathGlobFilter", "*.json").json(path).withColumnRenamed(payee_key, "payee_id")
    return df.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file_name"), *FORM_FIELDS)


def _documents(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows of JSON files that hold an object or an array of objects."""
    raw = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    text = F.when(F.startswith(F.ltrim("value"), F.lit("[")), F.col("value")).otherwise(F.concat(F.lit("["), "value", F.lit("]")))
    return raw.select(F.inline(F.from_json(text, f"array<{kind}>")))


def read_supporting_docs(spark: SparkSession, path: str) -> DataFrame:
    """Supporting conference documents; missing arrays are empty."""
    df = _documents(spark, path, SUPPORTING)
    empty = {c: F.coalesce(c, F.array().cast(df.schema[c].dataType)) for c in ("scheduled_dates", "venues_mentioned", "papers_listed", "workshops_listed")}
    return df.withColumns(empty)


def read_synthesis(spark: SparkSession, path: str) -> DataFrame:
    """Synthesis bundles of uploads."""
    return _documents(spark, path, SYNTHESIS)


def with_provenance(rates: DataFrame, source_url: str, now: Column | None = None) -> DataFrame:
    """``rates`` with where and when they were read, and their unit."""
    return rates.withColumns({"fetched_at": F.current_timestamp() if now is None else now, "source_url": F.lit(source_url), "unit": F.lit("cents_per_mile")})


def read_extractions(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """One receipt per JSON file (a one-element array), with file_name.

    An empty array is an error if ``strict``, else left out.
    """
    raw = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    receipts = F.from_json("value", f"array<{RECEIPT}>")
    df = raw.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file_name"), receipts.alias("_all"))
    if not strict:
        df = df.where(F.size("_all") > 0)
    first = F.when(F.size("_all") > 0, F.get("_all", F.lit(0))).otherwise(F.raise_error(F.concat(F.lit("no receipt in "), F.col("file_name"))).cast(RECEIPT)) if strict else F.get("_all", F.lit(0))
    return df.select("file_name", first.alias("receipt")).select("file_name", "receipt.*")


def line_index(receipts: DataFrame) -> DataFrame:
    at = Window.partitionBy("report_id").orderBy("file_name")
    return receipts.withColumn("line_idx", F.row_number().over(at).cast("long") - 1)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """file_name and the report as a variant; an expense_report root is unwrapped."""
    raw = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    v = F.try_parse_json("value")
    root = F.try_variant_get(v, "$.expense_report", "variant")
    kind = F.schema_of_variant(root)
    bad = root.isNotNull() & ~kind.startswith("OBJECT")
    return raw.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file_name"), F.when(~bad | bad.isNull(), F.coalesce(root, v)).alias("report"), F.coalesce(bad | v.isNull(), v.isNull()).alias("is_bad"))


def form_input(rows: DataFrame) -> DataFrame:
    """Raw form rows to form input: trimmed, blanks dropped, one window text; rows with
    nothing filled are left out."""
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    fields = [c for c in rows.columns if c not in ("report_id", "when_from", "when_to")]
    start, end = clean(F.col("when_from")), clean(F.col("when_to"))
    window = F.when(end.isNull() | (start == end), start).otherwise(F.concat_ws(" to ", start, end))
    out = rows.select("report_id", *[clean(F.col(c)).alias(c) for c in fields], window.alias("when_text"))
    return out.dropna(how="all", subset=[*fields, "when_text"])


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    kind = "corpus_name string, documents array<struct<document_id:string,kind:string,source:string,license:string,expected_fields:map<string,string>,tags:array<string>>>"
    return spark.read.schema(kind).json(path, multiLine=True).select("corpus_name", F.inline("documents"))


def rate_rows(pages: DataFrame) -> DataFrame:
    """(period, business, charity, medical) of the tables of class complex-table.

    Rows with fewer than four cells or without numbers are skipped; of a period that
    comes twice the later row counts. Pages without a row show up with null.
    """
    table = F.regexp_extract("html", r'(?is)<table[^>]*class="[^"]*complex-table[^"]*"[^>]*>(.*?)</table>', 1)
    body = F.regexp_extract(table, r"(?is)<tbody[^>]*>(.*?)</tbody>", 1)
    rows = F.regexp_extract_all(body, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    each = pages.select("page_id", F.posexplode_outer(rows).alias("pos", "row"))
    cells = F.transform(F.regexp_extract_all("row", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, "<[^>]*>", "")))
    cell = lambda k: F.regexp_replace(F.get(cells, F.lit(k)), "[^0-9.]", "").try_cast("double")
    parsed = each.select("page_id", "pos", F.get(cells, F.lit(0)).alias("period"), cell(1).alias("business"), cell(2).alias("charity"), cell(3).alias("medical"), F.size(cells).alias("n"))
    good = parsed.where("n >= 4 and business is not null and charity is not null and medical is not null")
    return good.groupBy("page_id", "period").agg(*[F.max_by(c, "pos").alias(c) for c in ("business", "charity", "medical")])


def airport_dim(rows: DataFrame) -> DataFrame:
    """code and display of rows (pos, text) like "SFO - Name"; the first row of a code counts."""
    code = F.regexp_extract("text", r"^([A-Z0-9]{2,4})\s+-\s+", 1)
    return rows.withColumn("code", code).where("code <> ''").groupBy("code").agg(F.min_by("text", "pos").alias("display"))


def list_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """upload_id, category, filename and length of files below uploads/."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    parts = F.split(F.regexp_extract("path", r"uploads/(.*)$", 1), "/")
    return files.select(F.get(parts, F.lit(0)).alias("upload_id"), F.get(parts, F.lit(1)).alias("category"), F.get(parts, F.lit(2)).alias("filename"), "length")


def is_heic(content: Column) -> Column:
    """Whether bytes are of the HEIC family, by their first box."""
    brands = ("heic", "heix", "hevc", "hevx", "heim", "heis", "hevm", "hevs", "mif1", "msf1")
    text = lambda a: F.decode(F.substring(content, a, 4), "ISO-8859-1")
    return (F.octet_length(content) >= 12) & (text(5) == "ftyp") & text(9).isin(*brands)


def write_reports_json(reports: DataFrame, lines: DataFrame, path: str) -> None:
    """Nested reports as JSON lines; null leaves are left out."""
    own = [c for c in lines.columns if c != "report_id"]
    nested = lines.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("line_idx", *[c for c in own if c != "line_idx"]))).alias("transaction_lines"))
    reports.join(nested, "report_id", "left").select(F.to_json(F.struct("*")).alias("value")).write.text(path)
