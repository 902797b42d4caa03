"""Landed payloads and tables as raw postings, and outputs.

Raw postings: title, company, location, date_posted, job_url, description, site,
matched_search_term, and salary columns where a source has them. Payload files are JSON with
fixed schemas; fields that are missing become null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import from_millis, parse_iso
from ..functions.text import clean, strip_html
from ..operators.gates import first_term
from .json_arrays import read_array, read_objects

RAW_COLUMNS = ["title", "company", "location", "date_posted", "job_url", "description", "site", "matched_search_term"]

_LISTS = "board string, jobs array<struct<id:string,title:string,absolute_url:string,updated_at:string,location:struct<name:string>>>"
_DETAILS = "board string, id string, content string, created_at string, updated_at string"
_ARRAY = "text string, createdAt bigint, hostedUrl string, applyUrl string, descriptionPlain string, description string, categories struct<location:string>"
_LISTED = "board string, jobs array<struct<title:string,isListed:boolean,location:string,isRemote:boolean,publishedAt:string,jobUrl:string,descriptionHtml:string>>"
_FEED = "position string, company string, tags array<string>, location string, date string, url string, apply_url string, description string, salary_min double, salary_max double, legal string"


def _board(given: Column | None = None, file: Column | None = None) -> Column:
    """The board named in the payload, else the name of its file."""
    file = F.regexp_extract(F.input_file_name() if file is None else file, r"([^/]+?)(?:\.json)?$", 1)
    return file if given is None else F.coalesce(given, file)


def _text(c: Column) -> Column:
    """Text of HTML that may have been escaped once."""
    once = c
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        once = F.replace(once, F.lit(name), F.lit(sign))
    return strip_html(once)


def _raw(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*[columns.get(c, F.lit(None).cast("string")).alias(c) for c in RAW_COLUMNS], *[v.alias(k) for k, v in columns.items() if k not in RAW_COLUMNS])


def read_board_payloads(spark: SparkSession, lists: str, details: str, site: str = "greenhouse") -> DataFrame:
    """SRC-1: boards (one JSON each, jobs nested) with their postings' details, left joined on (board, id)."""
    jobs = spark.read.schema(_LISTS).json(lists, multiLine=True).select(_board(F.col("board")).alias("board"), F.explode("jobs").alias("j")).select("board", "j.*")
    more = spark.read.schema(_DETAILS).json(details, multiLine=True).withColumnRenamed("updated_at", "_updated").dropDuplicates(["board", "id"])
    df = jobs.join(more, ["board", "id"], "left")
    return _raw(
        df, title=clean(F.col("title")), company=F.col("board"), location=clean(F.col("location.name")), date_posted=F.coalesce(parse_iso(F.col("created_at")), parse_iso(F.coalesce("_updated", "updated_at"))),
        job_url=clean(F.col("absolute_url")), description=_text(F.col("content")), site=F.lit(site), matched_search_term=F.concat(F.lit("board:"), F.col("board")),
    )


def read_posting_array(spark: SparkSession, path: str, site: str = "lever") -> DataFrame:
    """SRC-2: flat arrays, a file a board: milliseconds, nested place, plain text before stripped HTML."""
    df = read_objects(spark, path).select(_board(file=F.col("file")).alias("board"), F.from_json("text", _ARRAY).alias("_o")).select("board", "_o.*")
    plain = F.nullif(clean(F.col("descriptionPlain")), F.lit(""))
    return _raw(
        df, title=clean(F.col("text")), company=F.col("board"), location=clean(F.col("categories.location")), date_posted=from_millis(F.col("createdAt")),
        job_url=F.coalesce(F.nullif(clean(F.col("hostedUrl")), F.lit("")), clean(F.col("applyUrl"))), description=F.coalesce(plain, strip_html(F.col("description"))), site=F.lit(site),
        matched_search_term=F.concat(F.lit("board:"), F.col("board")),
    )


def read_listed_board(spark: SparkSession, path: str, site: str = "ashby") -> DataFrame:
    """SRC-3: boards whose unlisted postings go; a remote posting without a place is Remote."""
    df = spark.read.schema(_LISTED).json(path, multiLine=True).select(_board(F.col("board")).alias("board"), F.explode("jobs").alias("j")).select("board", "j.*").where(F.coalesce("isListed", F.lit(True)))
    place = clean(F.col("location"))
    return _raw(
        df, title=clean(F.col("title")), company=F.col("board"), location=F.when((place == "") & F.coalesce("isRemote", F.lit(False)), "Remote").otherwise(place), date_posted=parse_iso(F.col("publishedAt")),
        job_url=clean(F.col("jobUrl")), description=strip_html(F.col("descriptionHtml")), site=F.lit(site), matched_search_term=F.concat(F.lit("board:"), F.col("board")),
    )


def read_feed(spark: SparkSession, path: str, terms: list[str], site: str = "remoteok") -> DataFrame:
    """SRC-4: a feed whose array opens with a notice; postings that match a term, with pay text from their bounds.

    The notice is the entry without a position.
    """
    df = read_array(spark, path, _FEED).where(clean(F.col("position")) != "")
    text = F.concat_ws(" ", "position", "company", F.array_join(F.coalesce("tags", F.array()), " "))
    amount = lambda c: F.concat(F.lit("$"), F.format_number(F.col(c), 0))
    pay = F.when((F.col("salary_min") > 0) & (F.col("salary_max") > 0), F.concat(amount("salary_min"), F.lit(" - "), amount("salary_max"), F.lit(" per year")))
    df = df.withColumn("_term", first_term(text, terms)).where("_term is not null")
    return _raw(
        df, title=clean(F.col("position")), company=clean(F.col("company")), location=clean(F.col("location")), date_posted=parse_iso(F.col("date")),
        job_url=F.coalesce(F.nullif(clean(F.col("url")), F.lit("")), clean(F.col("apply_url"))), description=strip_html(F.col("description")), site=F.lit(site), matched_search_term=F.col("_term"), salary_raw=F.coalesce(pay, F.lit("")),
    )


def read_amount_frame(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """SRC-8: postings with min_amount, max_amount, interval, currency, from Parquet, CSV or JSON."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"') if kind == "csv" else spark.read.format(kind).load(path)
    have = lambda c, t: F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t)
    return df.select(*[have(c, "string").alias(c) for c in RAW_COLUMNS], *[have(c, t).alias(c) for c, t in (("min_amount", "double"), ("max_amount", "double"), ("interval", "string"), ("currency", "string"))])


def export_tables(jobs: DataFrame, held: DataFrame, out: str) -> None:
    """SNK-1: both tables as CSV folders ``jobs`` (by score, then time scraped) and ``held``, null as empty, times as text."""
    job_sheet(jobs).orderBy(F.desc("_s"), F.desc("_t")).drop("_s", "_t").write.mode("overwrite").csv(f"{out}/jobs", header=True)
    plain(held, ["id", "source", "title", "company", "url", "filter_reason", "filtered_at", "restored"]).write.mode("overwrite").csv(f"{out}/held", header=True)


def plain(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as text: null as empty, days and times in ISO form."""
    kinds = dict(df.dtypes)
    shown = {"date": "yyyy-MM-dd", "timestamp": "yyyy-MM-dd HH:mm:ss"}
    as_text = lambda c: F.date_format(c, shown[kinds[c]]) if kinds[c] in shown else F.col(c).cast("string")
    return df.select(*[F.coalesce(as_text(c), F.lit("")).alias(c) for c in columns])


def job_sheet(jobs: DataFrame) -> DataFrame:
    """The jobs sheet, and _s, _t to sort it by."""
    names = ["id", "source", "title", "company", "location", "url", "date_posted", "status", "stage", "score", "scraped_at"]
    return plain(jobs.withColumn("_s", F.lpad(F.col("score").cast("string"), 4, "0")).withColumn("_t", F.col("scraped_at")), [*names, "_s", "_t"])


def write_raw(df: DataFrame, path: str) -> None:
    """SNK-2: a batch as CSV with header; quotes are doubled, so texts of several lines survive."""
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def append_run(runs: DataFrame, path: str) -> None:
    """SNK-3: run records, each in a new part file of the run log, as JSON lines."""
    runs.write.mode("append").json(path)
