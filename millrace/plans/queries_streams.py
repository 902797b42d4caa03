"""Registered queries of streams, pages and outputs."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..functions import urls
from ..operators.lineage import shared_folder
from ..sources import pages, payloads
from ..streaming import ingest, transitions
from . import bindings as b
from .bindings import HISTORY_SQL, JOBS_SQL, RAW_SQL
from .queries import FP, URL
from .queries_more import _READ_ALL
from .registry import query


def _events(spark, d):
    """The status history as a stream."""
    kind = spark.read.parquet(os.path.join(d, "events.parquet"))
    e = ingest.read_parquet_stream(spark, d, kind, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("job_id"), F.expr("element_at(array('APPLIED','SKIP','MISMATCH','EXP_GAP','REJECTED'), CAST(event_id % 5 AS INT) + 1)").alias("new_status"), F.col("ts").alias("changed_at"))


def _settled(spark, stream, key: str):
    """The table a stream ends with: each batch adds the keys it changed under its number, and the last row of a key counts."""
    out = shared_folder(spark)
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/table/batch={number}")
    stream.writeStream.outputMode("update").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    changes = spark.read.parquet(f"{out}/table")
    rest = [c for c in stream.columns if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select(key, *[f"_last.{c}" for c in rest])


@query("str3_stream_outcomes", f"""
WITH {HISTORY_SQL} SELECT CAST(changed_at AS DATE) AS day, count(*) FILTER (new_status = 'APPLIED') AS applied, count(*) FILTER (new_status = 'REJECTED') AS rejected, count(*) FILTER (new_status = 'SKIP') AS skipped,
  count(*) FILTER (new_status = 'MISMATCH') AS mismatch, count(*) FILTER (new_status = 'EXP_GAP') AS exp_gap FROM hist GROUP BY 1""")
def stream_outcomes(spark, d):
    return _settled(spark, ingest.stream_outcomes(_events(spark, d)), "day")


@query("str5_stream_current", f"""
WITH {HISTORY_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY changed_at DESC, id DESC) AS n FROM hist) SELECT job_id, new_status AS status, changed_at FROM r WHERE n = 1""")
def stream_current(spark, d):
    return _settled(spark, ingest.stream_current(_events(spark, d)), "job_id")


def _landings(spark, rows, parts, make, name: str = "out"):
    """What streams in append mode have left after each part of the rows was landed, in order: ``make`` gives a stream by name from the landed rows.

    A part has at most 64 files, which a stream reads as one batch (100 files).
    """
    folder = shared_folder(spark)
    for part in parts:
        rows.where(part).coalesce(64).write.mode("append").parquet(f"{folder}/in")
        for key, stream in make(ingest.read_parquet_stream(spark, f"{folder}/in", rows)).items():
            sink = stream.writeStream.format("parquet").option("path", f"{folder}/{key}").option("checkpointLocation", f"{folder}/state-{key}")
            sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/{name}"), folder


_DAY_SQL = "count(*) FILTER (new_status = 'APPLIED') AS applied, count(*) FILTER (new_status = 'REJECTED') AS rejected, count(*) FILTER (new_status = 'SKIP') AS skipped, count(*) FILTER (new_status = 'MISMATCH') AS mismatch, count(*) FILTER (new_status = 'EXP_GAP') AS exp_gap"


@query("str3_stream_late", f"""
WITH {HISTORY_SQL}, h AS (SELECT *, CAST(changed_at AS DATE) AS day, id % 7 = 0 AS second FROM hist),
m AS (SELECT max(changed_at) FILTER (NOT second) - INTERVAL 1 DAY AS first_mark, max(changed_at) - INTERVAL 1 DAY AS mark FROM h),
r AS (SELECT h.*, day + 1 <= first_mark AND second AS late FROM h, m WHERE day + 1 <= mark)
SELECT day, CASE WHEN late THEN 'late' ELSE 'closed' END AS kind, {_DAY_SQL} FROM r GROUP BY day, late""")
def stream_late(spark, d):
    """A seventh of the events comes after all others: days that are closed by then count it as late, the last days are open."""
    events = b.status_history(spark, d)
    closed, folder = _landings(spark, events, ["id % 7 != 0", "id % 7 = 0"], lambda landed: {"out": ingest.stream_outcomes(landed)})
    totals = _settled(spark, ingest.stream_totals(ingest.read_parquet_stream(spark, f"{folder}/in", events)), "day")
    kind = lambda df, x: df.select("day", F.lit(x).alias("kind"), *ingest.OUTCOMES)
    return kind(closed, "closed").unionByName(kind(ingest.late_outcomes(closed, totals), "late"))


@query("str2_stream_first", f"""
WITH {RAW_SQL}, r AS (SELECT seq, source_rank, {FP('title', 'company')} AS fp, {URL('job_url')} AS u, CAST(seq % 5 AS INT) AS day FROM raw),
x AS (SELECT *, row_number() OVER (PARTITION BY day, u ORDER BY source_rank, seq) AS i FROM r), y AS (SELECT * FROM x WHERE i = 1 OR u = ''),
z AS (SELECT *, row_number() OVER (PARTITION BY day, fp ORDER BY source_rank, seq) AS j FROM y)
SELECT seq, CAST(day + 1 AS INT) AS day FROM z WHERE (j = 1 OR fp = '') AND day + 2 <= (SELECT max(day) - 1 FROM r)""")
def stream_first(spark, d):
    """Postings of five days in three landings that cut the days; days that the watermark has passed are shown."""
    raw = b.raw_postings(spark, d).withColumn("t", F.expr("timestamp'2026-01-01' + make_dt_interval(CAST(seq % 5 AS INT))"))
    raw = raw.select("seq", "source_rank", "title", "company", urls.url_key(F.col("job_url")).alias("url_key"), "t")
    parts = ["seq % 5 < 2 and seq % 3 = 0", "seq % 5 < 2 and seq % 3 = 1 or seq % 5 = 2", "seq % 5 < 2 and seq % 3 = 2 or seq % 5 > 2"]
    return _landings(spark, raw, parts, lambda landed: {"out": ingest.stream_first(landed, "t", "2 days")})[0].select("seq", F.dayofmonth("t").alias("day"))


@query("str5_stream_transitions", f"""
WITH {HISTORY_SQL}, t AS (SELECT id, job_id, new_status, date_trunc('second', changed_at) AS changed_at FROM hist),
h AS (SELECT *, lag(new_status) OVER (PARTITION BY job_id ORDER BY changed_at, id) AS before FROM t)
SELECT job_id, id, 'change' AS kind, changed_at, coalesce(before, 'NEW') AS old_status, new_status, CASE WHEN before = 'APPLIED' THEN 'APPLIED' END AS old_stage,
  CASE WHEN new_status = 'APPLIED' THEN 'APPLIED' END AS new_stage, CASE WHEN new_status = 'APPLIED' THEN changed_at END AS applied_at
FROM h WHERE changed_at <= (SELECT max(changed_at) FROM t) - INTERVAL 3 DAY""")
def stream_transitions(spark, d):
    """Events in three landings, some of them up to two days late and some twice; the last three days wait for the watermark."""
    transitions.use_rocksdb(spark)
    events = b.status_history(spark, d).withColumn("changed_at", F.date_trunc("second", "changed_at"))
    late = "changed_at > timestamp'2024-01-08' and id % 5 = 0"
    parts = [f"changed_at <= timestamp'2024-01-10' and not ({late})", "changed_at <= timestamp'2024-01-20' and changed_at > timestamp'2024-01-08'", "changed_at > timestamp'2024-01-20' or id % 9 = 0 and changed_at > timestamp'2024-01-18'"]
    return _landings(spark, events, parts, lambda landed: {"out": transitions.stream_transitions(landed, "3 days")})[0]


@query("src6_page_heads", f"""
SELECT page_id, {_READ_ALL("trim(regexp_replace(regexp_extract(coalesce(html, ''), '(?is)<title>(.*?)</title>', 1), '[ \t\n\r]+', ' ', 'g'))")} AS title FROM pages""")
def page_heads(spark, d):
    return pages.page_tags(b.table(spark, d, "pages").select("page_id", "html"), ["title_tag"], ["page_id"]).select("page_id", F.col("title_tag").alias("title"))


@query("src6_extract_pages")
def extract_pages(spark, d):
    return pages.extract_pages(b.spread(b.table(spark, d, "pages").select("url", "html")))


@query("snk1_job_sheet", f"""
WITH {JOBS_SQL} SELECT CAST(id AS VARCHAR) AS id, title, company, coalesce(location, '') AS location, coalesce(strftime(date_posted, '%Y-%m-%d'), '') AS date_posted, coalesce(stage, '') AS stage, strftime(scraped_at, '%Y-%m-%d %H:%M:%S') AS scraped_at FROM jobs""")
def job_sheet(spark, d):
    return payloads.job_sheet(b.jobs(spark, d)).select("id", "title", "company", "location", "date_posted", "stage", "scraped_at")
