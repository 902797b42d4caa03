"""The engine's logical tables, built from the driver's tables.

Each binding is a deterministic expression of its key columns, written once for Spark
and once as SQL, so a query and its oracle read the same logical table.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    for column, kind in df.dtypes:
        if kind == "timestamp_ntz":
            df = df.withColumn(column, F.col(column).cast("timestamp"))
    return df


def spread(df: DataFrame) -> DataFrame:
    """For work on whole texts: rows over all cores where the files of a small table are fewer than these."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


STATUS = "element_at(array('NEW','REVIEWED','APPLIED','SKIP','MISMATCH','EXP_GAP','EXPIRED','DUPLICATE'), CAST(o_orderkey % 8 AS INT) + 1)"
STAGE = "element_at(array('APPLIED','INITIAL','TECHNICAL','FINAL','OFFER','OUT'), CAST(o_custkey % 6 AS INT) + 1)"
SUFFIX = "element_at(array(' Inc','',' Corp PH',' Co.',' in the Philippines'), CAST(o_custkey % 5 AS INT) + 1)"

PLACE = "CASE o_orderkey % 7 WHEN 0 THEN 'Cebu City' WHEN 1 THEN 'Makati' WHEN 2 THEN NULL WHEN 3 THEN 'Davao del Sur 8000' WHEN 4 THEN 'Baguio' WHEN 5 THEN 'Remote' ELSE 'Quezon City' END"
TEXT = "CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '3 days ago' WHEN 3 THEN 'We use python and sql' WHEN 4 THEN 'Docker on linux' ELSE 'Sales calls' END"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    df = orders.withColumn("p_partkey", F.col("o_orderkey") % 500 + 1)
    df = df.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(part, "p_partkey", "left")
    status = F.expr(STATUS)
    return df.select(
        F.col("o_orderkey").alias("id"),
        F.expr("concat('src', CAST(o_custkey % 7 AS STRING))").alias("source"),
        F.coalesce("p_name", F.lit("")).alias("title"),
        F.concat(F.coalesce("c_name", F.lit("")), F.expr(SUFFIX)).alias("company"),
        F.expr("concat('https://jobs.example.com/view/', CAST(o_orderkey % 4000 AS STRING), '/')").alias("url"),
        F.expr("CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE date_add(CAST(o_orderdate AS DATE), -3) END").alias("date_posted"),
        status.alias("status"),
        F.when(status == "APPLIED", F.expr(STAGE)).alias("stage"),
        F.col("o_orderdate").alias("scraped_at"),
        F.expr("o_orderdate + make_dt_interval(CAST(o_orderkey % 40 AS INT))").alias("status_updated_at"),
        F.when(F.col("o_orderkey") % 3 == 0, F.expr("o_orderdate + make_dt_interval(CAST(o_orderkey % 50 AS INT))")).alias("last_seen"),
        F.expr("CASE WHEN o_orderkey % 9 = 0 THEN date_add(CAST(o_orderdate AS DATE), CAST(o_orderkey % 20 AS INT)) END").alias("follow_up_at"),
        F.expr("CAST(o_orderkey % 101 AS INT)").alias("score"),
        F.when(status == "APPLIED", F.expr("o_orderdate + make_dt_interval(CAST(o_orderkey % 40 AS INT))")).alias("applied_at"),
        F.expr(PLACE).alias("location"),
        F.expr(TEXT).alias("description"),
    )


JOBS_SQL = """
jobs AS (
  SELECT o_orderkey AS id, 'src' || CAST(o_custkey % 7 AS VARCHAR) AS source, coalesce(p_name, '') AS title,
    coalesce(c_name, '') || ([' Inc','',' Corp PH',' Co.',' in the Philippines'])[CAST(o_custkey % 5 AS INT) + 1] AS company,
    'https://jobs.example.com/view/' || CAST(o_orderkey % 4000 AS VARCHAR) || '/' AS url,
    CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) - 3 END AS date_posted,
    (['NEW','REVIEWED','APPLIED','SKIP','MISMATCH','EXP_GAP','EXPIRED','DUPLICATE'])[CAST(o_orderkey % 8 AS INT) + 1] AS status,
    CASE WHEN o_orderkey % 8 = 2 THEN (['APPLIED','INITIAL','TECHNICAL','FINAL','OFFER','OUT'])[CAST(o_custkey % 6 AS INT) + 1] END AS stage,
    o_orderdate AS scraped_at, o_orderdate + to_days(CAST(o_orderkey % 40 AS INT)) AS status_updated_at,
    CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + to_days(CAST(o_orderkey % 50 AS INT)) END AS last_seen,
    CASE WHEN o_orderkey % 9 = 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 20 AS INT) END AS follow_up_at,
    CAST(o_orderkey % 101 AS INT) AS score,
    CASE WHEN o_orderkey % 8 = 2 THEN o_orderdate + to_days(CAST(o_orderkey % 40 AS INT)) END AS applied_at,
    CASE o_orderkey % 7 WHEN 0 THEN 'Cebu City' WHEN 1 THEN 'Makati' WHEN 2 THEN NULL WHEN 3 THEN 'Davao del Sur 8000' WHEN 4 THEN 'Baguio' WHEN 5 THEN 'Remote' ELSE 'Quezon City' END AS location,
    CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '3 days ago' WHEN 3 THEN 'We use python and sql' WHEN 4 THEN 'Docker on linux' ELSE 'Sales calls' END AS description
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN part ON p_partkey = o_orderkey % 500 + 1
)"""


def status_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("job_id"), F.expr("element_at(array('APPLIED','SKIP','MISMATCH','EXP_GAP','REJECTED'), CAST(event_id % 5 AS INT) + 1)").alias("new_status"), F.col("ts").alias("changed_at"))


HISTORY_SQL = """
hist AS (SELECT event_id AS id, user_id AS job_id, (['APPLIED','SKIP','MISMATCH','EXP_GAP','REJECTED'])[CAST(event_id % 5 AS INT) + 1] AS new_status, ts AS changed_at FROM events)"""


def stage_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("job_id"),
        F.expr("element_at(array('APPLIED','INITIAL','TECHNICAL','FINAL'), CAST(event_id % 4 AS INT) + 1)").alias("old_stage"),
        F.expr("element_at(array('INITIAL','TECHNICAL','OUT'), CAST(event_id % 3 AS INT) + 1)").alias("new_stage"),
        F.col("ts").alias("changed_at"),
    )


STAGE_SQL = """
shist AS (SELECT event_id AS id, user_id AS job_id, (['APPLIED','INITIAL','TECHNICAL','FINAL'])[CAST(event_id % 4 AS INT) + 1] AS old_stage,
  (['INITIAL','TECHNICAL','OUT'])[CAST(event_id % 3 AS INT) + 1] AS new_stage, ts AS changed_at FROM events)"""


def raw_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("seq"),
        F.expr("CASE doc_id % 5 WHEN 0 THEN 'Junior Developer' WHEN 1 THEN 'Senior Data Engineer' WHEN 2 THEN 'Backend Engineer (Intern)' WHEN 3 THEN 'QA Analyst - Manila' ELSE NULL END").alias("title"),
        F.expr("concat('Acme ', CAST(doc_id % 37 AS STRING), CASE doc_id % 3 WHEN 0 THEN ' Inc' WHEN 1 THEN ' Corp. PH' ELSE '' END)").alias("company"),
        F.expr("CASE doc_id % 6 WHEN 0 THEN 'Makati, P00, PH' WHEN 1 THEN '' WHEN 2 THEN 'Cebu, Philippines' WHEN 3 THEN 'Philippines' WHEN 4 THEN 'Remote Worldwide' ELSE 'Quezon City' END").alias("location"),
        F.expr("concat('HTTPS://Jobs.Example.com/View/', CAST(doc_id % 700 AS STRING), CASE WHEN doc_id % 2 = 0 THEN '/' ELSE '' END)").alias("job_url"),
        F.expr("concat(coalesce(text, ''), ' ', CASE doc_id % 7 WHEN 0 THEN 'Fresh graduates welcome' WHEN 1 THEN concat(CAST(doc_id % 12 AS STRING), '+ years of experience') WHEN 2 THEN 'experience: 3 years' ELSE '' END)").alias("description"),
        F.col("source").alias("site"),
        F.expr("CAST(doc_id % 4 AS INT)").alias("source_rank"),
        F.expr("doc_id % 5 = 1").alias("loose_location"),
        F.expr("CASE doc_id % 8 WHEN 0 THEN 'PHP 30,000 - 40,000 per month' WHEN 1 THEN '$42k/yr' WHEN 2 THEN '₱500 per day' WHEN 3 THEN '1.5m USD annually' WHEN 4 THEN '3 days ago' ELSE '' END").alias("salary_raw"),
    )


RAW_SQL = """
raw AS (SELECT doc_id AS seq,
  CASE doc_id % 5 WHEN 0 THEN 'Junior Developer' WHEN 1 THEN 'Senior Data Engineer' WHEN 2 THEN 'Backend Engineer (Intern)' WHEN 3 THEN 'QA Analyst - Manila' ELSE NULL END AS title,
  'Acme ' || CAST(doc_id % 37 AS VARCHAR) || CASE doc_id % 3 WHEN 0 THEN ' Inc' WHEN 1 THEN ' Corp. PH' ELSE '' END AS company,
  CASE doc_id % 6 WHEN 0 THEN 'Makati, P00, PH' WHEN 1 THEN '' WHEN 2 THEN 'Cebu, Philippines' WHEN 3 THEN 'Philippines' WHEN 4 THEN 'Remote Worldwide' ELSE 'Quezon City' END AS location,
  'HTTPS://Jobs.Example.com/View/' || CAST(doc_id % 700 AS VARCHAR) || CASE WHEN doc_id % 2 = 0 THEN '/' ELSE '' END AS job_url,
  coalesce(text, '') || ' ' || CASE doc_id % 7 WHEN 0 THEN 'Fresh graduates welcome' WHEN 1 THEN CAST(doc_id % 12 AS VARCHAR) || '+ years of experience' WHEN 2 THEN 'experience: 3 years' ELSE '' END AS description,
  source AS site, CAST(doc_id % 4 AS INT) AS source_rank, doc_id % 5 = 1 AS loose_location,
  CASE doc_id % 8 WHEN 0 THEN 'PHP 30,000 - 40,000 per month' WHEN 1 THEN '$42k/yr' WHEN 2 THEN '₱500 per day' WHEN 3 THEN '1.5m USD annually' WHEN 4 THEN '3 days ago' ELSE '' END AS salary_raw
  FROM documents)"""


REASON = "CASE doc_id % 5 WHEN 0 THEN 'location:cebu' WHEN 1 THEN concat('title-keyword:k', CAST(doc_id % 11 AS STRING)) WHEN 2 THEN 'repeat-seen:skip:x' WHEN 3 THEN 'ai:judge' ELSE concat('exp-gap:needs ', CAST(doc_id % 9 AS STRING), ' yrs') END"


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every posting as a held one, with a url of its own."""
    d = raw_postings(spark, sf_dir).withColumn("doc_id", F.col("seq"))
    return d.select(
        F.col("seq").alias("id"), F.col("site").alias("source"), "title", "company", F.expr("concat('https://held.example.com/', CAST(seq AS STRING))").alias("url"),
        F.expr(REASON).alias("filter_reason"), F.lit(None).cast("timestamp").alias("filtered_at"), (F.col("seq") % 4 == 0).alias("restored"),
    )


HELD_SQL = """
held AS (SELECT seq AS id, site AS source, title, company, 'https://held.example.com/' || CAST(seq AS VARCHAR) AS url,
  CASE seq % 5 WHEN 0 THEN 'location:cebu' WHEN 1 THEN 'title-keyword:k' || CAST(seq % 11 AS VARCHAR) WHEN 2 THEN 'repeat-seen:skip:x' WHEN 3 THEN 'ai:judge' ELSE 'exp-gap:needs ' || CAST(seq % 9 AS VARCHAR) || ' yrs' END AS filter_reason,
  seq % 4 = 0 AS restored FROM raw)"""
