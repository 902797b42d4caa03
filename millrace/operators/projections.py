"""Raw postings as rows of the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.salary import format_salary, parse_salary, pay_snippet, to_monthly
from ..functions.text import clean, is_placeholder
from ..functions.urls import JOB_LABELS, source_label, url_key

SALARY = ["salary_raw", "salary_currency", "salary_min", "salary_max", "salary_interval", "salary_monthly_min", "salary_monthly_max", "salary_display"]
HELD_LABELS = ["indeed", "linkedin", "jobstreet", "glassdoor", "google"]
# Fixed value: pesos from which an amount without cadence of one source is a year's.
YEARLY_PESOS = 200_000.0


def _has(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def _derived(df: DataFrame) -> DataFrame:
    """Monthly amounts and display from currency, amounts and cadence."""
    df = df.withColumn("salary_monthly_min", to_monthly(F.col("salary_min"), F.col("salary_interval"))).withColumn("salary_monthly_max", to_monthly(F.col("salary_max"), F.col("salary_interval")))
    return df.withColumn("salary_display", format_salary(*[F.col(f"salary_{c}") for c in ("currency", "min", "max", "interval", "monthly_min", "monthly_max")]))


def normalize_salary(df: DataFrame) -> DataFrame:
    """PRJ-2: adds the eight salary columns.

    From pay text, else from amount columns, else from the nested compensation, else from the
    snippet of the description. Columns that are missing count as null. Bounds in the wrong
    order are swapped; large pesos of trabajo without a cadence are a year's.
    """
    told, snippet = clean(_has(df, "salary_raw", "string")), pay_snippet(_has(df, "description", "string"))
    nested = lambda f, kind: F.col(f"compensation.{f}").cast(kind) if "compensation" in df.columns else F.lit(None).cast(kind)
    low, high = _has(df, "min_amount", "double"), _has(df, "max_amount", "double")
    in_columns, in_nested = low.isNotNull() | high.isNotNull(), nested("min_amount", "double").isNotNull() | nested("max_amount", "double").isNotNull()

    def amounts(low: Column, high: Column, interval: Column, currency: Column) -> Column:
        low, high = F.coalesce(low, high), F.coalesce(high, low)
        return F.struct(F.upper(clean(currency)).alias("currency"), F.least(low, high).alias("min"), F.greatest(low, high).alias("max"), F.coalesce(F.nullif(F.lower(clean(interval)), F.lit("")), F.lit("unknown")).alias("interval"))

    by_column = amounts(low, high, _has(df, "interval", "string"), _has(df, "currency", "string"))
    by_nested = amounts(nested("min_amount", "double"), nested("max_amount", "double"), nested("interval", "string"), nested("currency", "string"))
    raw = F.when(told != "", told).when(in_columns | in_nested, "").otherwise(snippet)
    df = df.withColumn("_raw", raw).withColumn("_pay", F.when(F.col("_raw") != "", parse_salary(F.col("_raw"))).when(in_columns, by_column).when(in_nested, by_nested).otherwise(parse_salary(F.lit(""))))
    yearly = (F.col("_pay.currency") == "PHP") & (F.col("_pay.interval") == "unknown") & (F.col("_pay.min") >= YEARLY_PESOS) & (clean(_has(df, "site", "string")) == "trabajo")
    df = df.withColumn("salary_raw", F.col("_raw")).withColumn("salary_currency", F.col("_pay.currency")).withColumn("salary_min", F.col("_pay.min")).withColumn("salary_max", F.col("_pay.max"))
    return _derived(df.withColumn("salary_interval", F.when(yearly, "yearly").otherwise(F.col("_pay.interval")))).drop("_raw", "_pay")


def to_jobs_rows(df: DataFrame, as_of, scored: bool = False) -> DataFrame:
    """PRJ-1: new jobs from raw postings: label, clean texts, url key, day, NEW, description to 20,000 characters, salary."""
    df = normalize_salary(df)
    now = F.lit(as_of).cast("timestamp")
    return df.select(
        source_label(F.col("site"), F.col("job_url"), JOB_LABELS).alias("source"), clean(F.col("title")).alias("title"), clean(F.col("company")).alias("company"), url_key(F.col("job_url")).alias("url"),
        F.nullif(clean(F.col("location")), F.lit("")).alias("location"), _has(df, "date_posted", "date").alias("date_posted"), F.substring(clean(F.col("description")), 1, 20000).alias("description"),
        F.lit("NEW").alias("status"), F.lit(None).cast("string").alias("stage"), now.alias("scraped_at"), now.alias("last_seen"), now.alias("status_updated_at"),
        (F.col("score") if scored else F.lit(0)).alias("score"), (F.col("score_reason") if scored else F.lit("")).alias("score_reason"), *SALARY,
        *(["seq"] if "seq" in df.columns else []),
    )


def to_held_rows(df: DataFrame, as_of) -> DataFrame:
    """PRJ-3: held postings from dropped ones with a filter_reason."""
    df = normalize_salary(df)
    return df.select(
        source_label(F.col("site"), F.col("job_url"), HELD_LABELS).alias("source"), clean(F.col("title")).alias("title"), clean(F.col("company")).alias("company"), url_key(F.col("job_url")).alias("url"),
        F.nullif(clean(F.col("location")), F.lit("")).alias("location"), F.substring(clean(F.col("description")), 1, 20000).alias("description"), "filter_reason",
        F.lit(as_of).cast("timestamp").alias("filtered_at"), F.lit(False).alias("restored"), *SALARY, *(["seq"] if "seq" in df.columns else []),
    )


def resolve_fields(fetched: DataFrame, typed: DataFrame, key: str = "url") -> DataFrame:
    """PRJ-4: (key, title, company, location): what was typed, else what was fetched, else a placeholder title."""
    pick = lambda c, most: F.substring(F.coalesce(F.nullif(clean(F.col(f"_{c}")), F.lit("")), clean(F.col(c))), 1, most)
    both = fetched.select(key, "title", "company", "location").join(typed.select(key, *[F.col(c).alias(f"_{c}") for c in ("title", "company", "location")]), key, "left")
    title = pick("title", 500)
    return both.select(key, F.when(is_placeholder(title), "Untitled (manual)").otherwise(title).alias("title"), pick("company", 300).alias("company"), pick("location", 300).alias("location"))


def correct_salary(jobs: DataFrame, edits: DataFrame) -> DataFrame:
    """PRJ-5: jobs after edits (job_id, salary_raw, salary_currency, salary_min, salary_max, salary_interval).

    A given text is read anew, explicit values win over what it says, monthly amounts and
    display follow; a blank text without explicit values clears all. Null means not given.
    """
    names = ["raw", "currency", "min", "max", "interval"]
    changes = edits.select(F.col("job_id").alias("id"), F.lit(True).alias("_hit"), *[F.col(f"salary_{c}").alias(f"_{c}") for c in names])
    both = jobs.join(changes, "id", "left").withColumn("_read", parse_salary(F.col("_raw")))
    told = F.col("_raw").isNotNull()
    for c in names:
        old = F.col(f"salary_{c}")
        read = clean(F.col("_raw")) if c == "raw" else F.coalesce(f"_{c}", F.when(told, F.col(f"_read.{c}")).otherwise(old))
        both = both.withColumn(f"salary_{c}", F.when(F.col("_hit") & (told if c == "raw" else F.lit(True)), read).otherwise(old))
    swap = F.col("salary_max") < F.col("salary_min")
    both = both.withColumn("_low", F.when(swap, F.col("salary_max")).otherwise(F.col("salary_min"))).withColumn("salary_max", F.when(swap, F.col("salary_min")).otherwise(F.col("salary_max"))).withColumn("salary_min", F.col("_low"))
    new = _derived(both.withColumn("_old", F.struct("salary_monthly_min", "salary_monthly_max", "salary_display")))
    for c in ("monthly_min", "monthly_max", "display"):
        new = new.withColumn(f"salary_{c}", F.when(F.col("_hit"), F.col(f"salary_{c}")).otherwise(F.col(f"_old.salary_{c}")))
    return new.drop("_hit", "_read", "_low", "_old", *[f"_{c}" for c in names])
