"""Bucketed merges and stateful streams against their batch forms, for several cuts into micro-batches."""

import os
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import dedupe, merge
from millrace.sources.buckets import PER_BATCH, JobBuckets
from millrace.streaming import ingest, transitions

JOBS = "id bigint, title string, company string, url string, description string, status string, last_seen timestamp, salary_display string"
POSTINGS = "seq bigint, title string, company string, url string, description string, status string"


def files(folder):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")}


def merged(jobs, rows):
    return merge.merge_postings(jobs, rows, "2026-01-31")[0]


def postings(spark, numbers, title="Dev", text="told"):
    return spark.createDataFrame([(n, f"{title} {n}", "Acme", f"https://x/{n}", text, "NEW") for n in numbers], POSTINGS)


@pytest.fixture
def store(spark, tmp_path):
    return JobBuckets(spark, f"file://{tmp_path}/jobs", spark.createDataFrame([], JOBS).schema, buckets=32)


def test_batch_rewrites_what_it_touches(spark, store, tmp_path):
    store.merge(postings(spark, range(300)), 0, merged)
    before = files(tmp_path)
    touched = store.merge(postings(spark, [5, 5000]), 1, merged)
    after = files(tmp_path)
    assert len(touched) == 2 and sum("/jobs/jobs/" in f for f in set(after) - set(before)) == 2 and sum("/jobs/urls/" in f for f in set(after) - set(before)) <= 1
    assert sum(after[f] for f in set(after) - set(before)) < sum(before.values()) / 5
    assert store.read().count() == 301 and store.read().where(F.col("id") > 2 * PER_BATCH).select("title").collect() == [("Dev 5000",)]


def test_url_in_another_bucket_and_no_fingerprint(spark, store):
    store.merge(postings(spark, range(40)), 0, merged)
    same_url = postings(spark, range(40), title="Other")
    no_title = spark.createDataFrame([(n, "", "Acme", f"https://y/{n}", None, "NEW") for n in range(5)], POSTINGS)
    for number in (1, 2):
        store.merge(same_url.unionByName(no_title), number, merged)
        assert store.read().count() == 45
    assert store.read().where("title like 'Other%'").count() == 0


def test_replay_after_a_failure(spark, store, monkeypatch):
    store.load(spark.createDataFrame([(7, "Dev 7", "Acme", "https://x/7", "", "NEW", None, "")], JOBS))
    store.merge(postings(spark, range(20)), 0, merged)
    batch = postings(spark, range(10, 60), text="new")
    write, calls = store._write, []

    def broken(df, name, mode="overwrite"):
        calls.append(name)
        if name == "jobs":  # some buckets are replaced, the rest are not
            write(df.where("bucket < 16"), name, mode)
            raise OSError("lost")
        write(df, name, mode)

    monkeypatch.setattr(store, "_write", broken)
    with pytest.raises(OSError, match="lost"):
        store.merge(batch, 1, merged)
    assert calls == ["urls", "jobs"]
    monkeypatch.setattr(store, "_write", write)
    rows = lambda: sorted(map(tuple, store.read().select("id", "title", "description", "last_seen").collect()))
    store.merge(batch, 1, merged)
    first = rows()
    store.merge(batch, 1, merged)
    assert rows() == first and len(first) == 60 == len({r[0] for r in first})
    assert [r for r in first if r[0] == 7][0][2] == "told"
    with pytest.raises(ValueError, match="batches after 0"):
        store.merge(batch, 0, merged)


def landed(spark, folder, parts, make, rocks=False):
    """Rows that a stream in append mode leaves when the parts are landed one after another."""
    if rocks:
        transitions.use_rocksdb(spark)
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = make(ingest.read_parquet_stream(spark, f"{folder}/in", part))
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@pytest.mark.parametrize("seed", [1, 2])
def test_first_row_wins(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = [(i, r.randrange(3), r.choice(["Dev", "QA", ""]), r.choice(["Acme", "Beta", ""]), r.choice(["a", "b", "c", "d", "", None])) for i in range(60)]
    df = spark.createDataFrame([(*x, "2026-01-01 10:00:00") for x in rows], "seq bigint, source_rank int, title string, company string, url_key string, t string").withColumn("t", F.to_timestamp("t"))
    last = df.limit(1).withColumn("seq", F.lit(99).cast("long")).withColumn("t", F.lit("2026-01-05").cast("timestamp"))
    cut = r.randrange(3, 50)
    out = landed(spark, tmp_path, [df.where(F.col("seq") % 60 >= cut), df.where(F.col("seq") < cut), last], lambda s: ingest.stream_first(s, "t", "1 day"))
    order = ["source_rank", "seq"]
    want = dedupe.dedupe_fingerprint(dedupe.dedupe_first(df, F.col("url_key"), order), order)
    assert sorted(x.seq for x in out.collect()) == sorted(x.seq for x in want.collect())


EVENTS = "job_id bigint, id bigint, new_status string, changed_at string"


def test_jobs_of_a_bucket_share_one_state(spark, tmp_path):
    """Many jobs in few buckets: all changes once and in order, those without a time of application among them."""
    day = F.expr("timestamp'2026-01-01' + make_dt_interval(CAST(id % 10 AS INT), 0, 0, CAST(id % 7 AS INT))")
    rows = spark.range(6000).select((F.col("id") % 1500).alias("job_id"), "id", F.expr("element_at(array('APPLIED', 'SKIP', 'NEW'), CAST(id % 3 AS INT) + 1)").alias("new_status"), day.alias("changed_at"))
    last = spark.createDataFrame([(10**6, 10**6, "SKIP", "2026-02-01 00:00:00")], EVENTS).withColumn("changed_at", F.to_timestamp("changed_at"))
    out = landed(spark, tmp_path, [rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), last], lambda s: transitions.stream_transitions(s, "20 days", buckets=8), True).collect()
    want = {}
    for r in sorted(rows.collect(), key=lambda r: (r.changed_at, r.id)):
        want.setdefault(r.job_id, []).append((r.id, r.new_status))
    got = {}
    for r in sorted(out, key=lambda r: (r.changed_at, r.id)):
        assert r.kind == "change" and (r.applied_at == r.changed_at) == (r.new_status == "APPLIED") and r.old_status == (got[r.job_id][-1][1] if r.job_id in got else "NEW")
        got.setdefault(r.job_id, []).append((r.id, r.new_status))
    assert got == want


def test_transitions(spark, tmp_path):
    day = lambda d, h=0: f"2026-01-{d:02d} {h:02d}:00:00"
    rows = [
        [(1, 1, "APPLIED", day(1)), (1, 3, "APPLIED", day(3)), (2, 4, "SKIP", day(3)), (3, 5, "SKIP", day(1))],
        [(1, 2, "SKIP", day(2, 12)), (1, 3, "APPLIED", day(3)), (2, 6, "SKIP", day(4)), (3, 7, "APPLIED", day(4)), (9, 8, "SKIP", day(10))],
        [(1, 9, "SKIP", day(1, 5)), (1, 10, "REVIEWED", day(9)), (9, 11, "SKIP", day(30))],
    ]
    frames = [spark.createDataFrame(x, EVENTS).withColumn("changed_at", F.to_timestamp("changed_at")) for x in rows]
    jobs = spark.createDataFrame([(3, "APPLIED", "FINAL", day(1)), (4, "NEW", None, None)], "id bigint, status string, stage string, applied_at string").withColumn("applied_at", F.to_timestamp("applied_at"))
    out = landed(spark, tmp_path, frames, lambda s: transitions.stream_transitions(s, "2 days", stale_days=15, jobs=jobs), True).collect()
    late = [(x.job_id, x.id) for x in out if x.kind == "late"]
    assert late == [(1, 9)]
    changes = sorted((x.job_id, x.changed_at, x.id, x.old_status, x.new_status, x.old_stage, x.new_stage, x.applied_at) for x in out if x.kind == "change")
    assert [(x[0], x[2], *x[3:7]) for x in changes] == [
        (1, 1, "NEW", "APPLIED", None, "APPLIED"), (1, 2, "APPLIED", "SKIP", "APPLIED", None), (1, 3, "SKIP", "APPLIED", None, "APPLIED"), (1, 10, "APPLIED", "REVIEWED", "APPLIED", None),
        (2, 4, "NEW", "SKIP", None, None), (2, 6, "SKIP", "SKIP", None, None), (3, 5, "APPLIED", "SKIP", "FINAL", None), (3, 7, "SKIP", "APPLIED", None, "APPLIED"), (9, 8, "NEW", "SKIP", None, None),
    ]
    assert sorted((x.job_id, x.new_status) for x in out if x.kind == "stale") == [(1, "REVIEWED"), (2, "SKIP"), (3, "APPLIED"), (9, "SKIP")]
    # the same as MUT-8, one change after another
    full = "id bigint, status string, stage string, status_updated_at timestamp, applied_at timestamp"
    now = spark.createDataFrame([(1, "NEW", None, None, None), (3, "APPLIED", "FINAL", None, None)], full)
    events = {1: set(), 3: set()}
    for job, at, number, *_ in changes:
        if job in events:
            change = spark.createDataFrame([(job, next(e[2] for part in rows for e in part if e[1] == number))], "job_id bigint, new_status string")
            now, history, _ = merge.apply_status(now, change, str(at))
            events[job] |= {(r.old_status, r.new_status) for r in history.collect()}
            now = spark.createDataFrame(now.collect(), full)
    for job, state in ((r.id, (r.status, r.stage, r.applied_at)) for r in now.collect()):
        assert state == next((x[4], x[6], x[7]) for x in reversed(changes) if x[0] == job)
        assert events[job] == {(x[3], x[4]) for x in changes if x[0] == job and x[3] != x[4]}
