"""Historical exchange rates: as-of joins and enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reckoner.operators.reduce import money


def _keys(lines: DataFrame) -> DataFrame:
    code = F.upper(F.trim("original_currency"))
    return lines.where(F.col("original_currency").isNotNull()).select(code.alias("currency"), F.expr("try_to_date(date_text, 'yyyy-MM-dd')").alias("day")).where("day is not null").distinct()


def as_of(keys: DataFrame, rates: DataFrame) -> DataFrame:
    """(currency, day, usd_per_unit) for each key: the rate of that or the last earlier day.

    Rates and keys are put in one stream by currency and day; the last rate so far is
    carried on. Months are a second level: a key before the first rate of its month
    takes the last rate of the months before, so no task holds more than one
    currency's month, and one of months.
    """
    month = lambda c: F.date_trunc("month", c).cast("date")
    r = rates.select("currency", F.col("rate_date").alias("day"), F.col("usd_per_unit").alias("rate"), F.lit(0).alias("side"))
    k = keys.select("currency", "day", F.lit(None).cast("double").alias("rate"), F.lit(1).alias("side"))
    both = r.unionByName(k).withColumn("month", month("day"))
    inside = Window.partitionBy("currency", "month").orderBy("day", "side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("found", F.last("rate", ignorenulls=True).over(inside)).where("side = 1")
    last = r.withColumn("month", month("day")).groupBy("currency", "month").agg(F.max_by("rate", "day").alias("rate"))
    months = last.withColumn("kind", F.lit(0)).unionByName(k.select("currency", month("day").alias("month"), "rate").distinct().withColumn("kind", F.lit(1)))
    # A key's month takes the last rate of an earlier month.
    carried = months.groupBy("currency", "month").agg(F.max("rate").alias("rate"), F.max("kind").alias("kind"))
    carried = carried.withColumn("earlier", F.last("rate", ignorenulls=True).over(Window.partitionBy("currency").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)))
    joined = seen.join(carried.where("kind = 1").select("currency", "month", "earlier"), ["currency", "month"], "left")
    return joined.select("currency", "day", F.when(F.col("currency") == "USD", F.lit(1.0)).otherwise(F.coalesce("found", "earlier")).alias("usd_per_unit"))


def as_of_range(keys: DataFrame, rates: DataFrame) -> DataFrame:
    """The same by a range join: a rate holds until the next, in each month until then.

    A key meets the rates of its currency and month only, and one of them holds.
    """
    month = lambda c: F.date_trunc("month", c).cast("date")
    end = keys.agg(F.max("day").alias("end"))
    following = F.lead("rate_date").over(Window.partitionBy("currency").orderBy("rate_date"))
    until = F.coalesce(F.date_sub("next", 1), F.greatest("end", "rate_date"))
    held = rates.withColumn("next", following).join(F.broadcast(end)).withColumn("until", until)
    held = held.select(F.col("currency").alias("_currency"), "rate_date", "until", "usd_per_unit", F.explode(F.sequence(month(F.col("rate_date")), month(F.col("until")), F.expr("interval 1 month"))).alias("_month"))
    met = (F.col("currency") == F.col("_currency")) & (month(F.col("day")) == F.col("_month")) & F.col("day").between(F.col("rate_date"), F.col("until"))
    return keys.join(held, met, "left").select("currency", "day", F.when(F.col("currency") == "USD", F.lit(1.0)).otherwise(F.col("usd_per_unit")).alias("usd_per_unit"))


def enrich(lines: DataFrame, rates: DataFrame) -> DataFrame:
    """``lines`` with fx_status, fx_rate and the amount at the historical rate.

    Each different (currency, day) is looked up once.
    """
    keyed = lines.withColumn("currency", F.upper(F.trim("original_currency"))).withColumn("day", F.expr("try_to_date(date_text, 'yyyy-MM-dd')"))
    found = as_of(_keys(lines), rates)
    joined = keyed.join(found, ["currency", "day"], "left")
    skipped = F.col("original_currency").isNull() | F.col("original_amount").isNull() | F.col("day").isNull()
    status = F.when(skipped, "skipped").when(F.col("usd_per_unit").isNull(), "failed").otherwise("fetched")
    rate = F.when(status == "fetched", F.col("usd_per_unit"))
    amount = F.coalesce(F.round((F.col("original_amount") * rate).cast("decimal(24,6)"), 2).cast("double"), F.col("line_amount_usd"))
    return joined.select(*lines.columns, status.alias("fx_status"), rate.alias("fx_rate"), amount.alias("fx_amount_usd"))


def totals(enriched: DataFrame) -> DataFrame:
    """Per report: the total after enrichment, and counts by status."""
    n = lambda s: F.count_if(F.col("fx_status") == s)
    return enriched.groupBy("report_id").agg(
        F.coalesce(money(F.col("fx_amount_usd")), F.lit(0.0)).alias("total_usd"), n("fetched").alias("n_fetched"), n("skipped").alias("n_skipped"), n("failed").alias("n_failed")
    )
