"""Incremental forms: Structured Streaming over landed postings, change events and run logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.text import fingerprint
from ..operators.dedupe import dedupe_fingerprint, dedupe_first
from ..operators.reports import OUTCOMES
from ..sources.buckets import JobBuckets


def read_parquet_stream(spark: SparkSession, folder: str, like: DataFrame, pattern: str = "*.parquet", per_batch: int = 100) -> DataFrame:
    """New files of a folder as a stream with the schema of ``like``."""
    return spark.readStream.schema(like.schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch).parquet(folder)


def stream_ingest(raw: DataFrame, store: JobBuckets, rows: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """STR-1: each batch of raw postings, deduplicated, becomes rows and is merged into the buckets of jobs that it touches.

    A batch that is run again after a failure leaves the same table. ``raw`` needs url_key, source_rank and seq.
    """

    def apply(batch: DataFrame, number: int) -> None:
        first = dedupe_fingerprint(dedupe_first(batch, F.col("url_key"), ["source_rank", "seq"]), ["source_rank", "seq"])
        store.merge(rows(first), number, merge)

    return raw.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_dedupe(postings: DataFrame, time: str, delay: str) -> DataFrame:
    """STR-2: one posting of each fingerprint within the delay, shown at once; rows without one pass by their url.

    Which of several rows in one batch stays is not fixed; use stream_first where the first must.
    """
    fp = fingerprint(F.col("title"), F.col("company"))
    keyed = postings.withColumn("_key", F.when(fp != "", fp).otherwise(F.concat(F.lit("|"), F.coalesce("url_key", F.lit("")))))
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def stream_first(postings: DataFrame, time: str, delay: str, span: str = "1 day") -> DataFrame:
    """STR-2: of each span of ``time`` the postings that WIN-1 and then WIN-2 leave, in append mode.

    State holds the best row by (source_rank, seq) of each url, and then of each fingerprint, until the
    watermark passes the span's end; it is shown once. The rows are the same however the input is cut into batches, if none comes
    later than the delay. Rows with an empty url or fingerprint all stay; ``seq`` tells them apart. Best rows are
    combined before the shuffle.
    """
    names = postings.columns
    best = F.min_by("_row", F.struct("_row.source_rank", "_row.seq")).alias("_row")
    alone = F.concat(F.lit("|"), F.col("_row.seq").cast("string"))
    rows = postings.withWatermark(time, delay).select(F.col(time).alias("_time"), F.struct(*names).alias("_row"))
    key = F.when(F.coalesce("_row.url_key", F.lit("")) != "", F.col("_row.url_key")).otherwise(alone)
    by_url = rows.groupBy(F.window("_time", span).alias("_w"), key.alias("_key")).agg(best)
    fp = fingerprint(F.col("_row.title"), F.col("_row.company"))
    by_fp = by_url.select("_w", "_row", F.when(fp != "", fp).otherwise(alone).alias("_key")).groupBy(F.window("_w", span).alias("_v"), "_key").agg(best)
    return by_fp.select("_row.*")


def _decided(events: DataFrame) -> DataFrame:
    return events.where(F.col("new_status").isin([s for group in OUTCOMES.values() for s in group]))


def _counts() -> list:
    return [F.count_if(F.col("new_status").isin(s)).alias(name) for name, s in OUTCOMES.items()]


def stream_outcomes(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """STR-3: decisions a day and outcome from events (new_status, changed_at).

    In append mode a day is shown once, when the watermark passes its end; what comes later is left
    out and is counted by late_outcomes.
    """
    daily = _decided(events).withWatermark("changed_at", delay).groupBy(F.window("changed_at", "1 day").alias("_w")).agg(*_counts())
    return daily.select(F.col("_w.start").cast("date").alias("day"), *OUTCOMES)


def stream_totals(events: DataFrame) -> DataFrame:
    """The same counts without a watermark, late events included, for update mode: its state is a row a day."""
    return _decided(events).groupBy(F.to_date("changed_at").alias("day")).agg(*_counts())


def late_outcomes(closed: DataFrame, totals: DataFrame) -> DataFrame:
    """Counts a day and outcome of what came after its day was shown: the totals of the closed days less what was shown."""
    late = totals.alias("t").join(closed.alias("c"), "day").select("day", *[(F.col(f"t.{c}") - F.col(f"c.{c}")).alias(c) for c in OUTCOMES])
    return late.where(" or ".join(f"{c} > 0" for c in OUTCOMES))


def stream_runs(spark: SparkSession, path: str) -> DataFrame:
    """STR-4: run records of part files not seen before."""
    return spark.readStream.schema("id bigint, started_at timestamp, finished_at timestamp, new_jobs_count int, summary string").json(path)


def stream_current(events: DataFrame) -> DataFrame:
    """STR-5: the status and time of each job's last event (job_id, new_status, changed_at, id); update mode."""
    last = F.max(F.struct("changed_at", "id", "new_status")).alias("_l")
    return events.groupBy("job_id").agg(last).select("job_id", F.col("_l.new_status").alias("status"), F.col("_l.changed_at").alias("changed_at"))
