"""Batch changes to a snapshot: each takes tables and returns new ones.

Jobs: id, title, company, url, status, stage, status_updated_at, and whatever else they
carry. Where a change table may name a row more than once, its last row (by seq, if it has
one) counts. Empty URLs are no keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import clean, fingerprint, is_placeholder
from ..functions.urls import url_key
from .dedupe import default_keeper, match_ladder, norm_company, norm_text
from .projections import SALARY

_AGE_ONLY = r"(?i)^\s*$|^\s*\d+\s+(second|minute|hour|day|week|month|year)s? ago\s*$"


def _now(as_of) -> Column:
    return F.lit(as_of).cast("timestamp")


def _last(df: DataFrame, key: str) -> DataFrame:
    """The last row of each key by seq."""
    if "seq" not in df.columns:
        return df.dropDuplicates([key])
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("seq")))).where("_n = 1").drop("_n")


def _events(changed: DataFrame, what: str, as_of) -> DataFrame:
    """History rows where the old and new value of ``what`` differ."""
    old, new = F.col(f"_old_{what}"), F.col(what)
    return changed.where(F.col("_hit") & ~old.eqNullSafe(new)).select(F.col("id").alias("job_id"), old.alias(f"old_{what}"), new.alias(f"new_{what}"), _now(as_of).alias("changed_at"))


def _settle(jobs: DataFrame, changed: DataFrame, as_of) -> tuple[DataFrame, DataFrame, DataFrame]:
    return changed.select(*jobs.columns), _events(changed, "status", as_of), _events(changed, "stage", as_of)


def apply_status(jobs: DataFrame, changes: DataFrame, as_of) -> tuple[DataFrame, DataFrame, DataFrame]:
    """MUT-8: (jobs, status history, stage history) after status changes (job_id, new_status).

    Applied jobs get applied_at, and a stage unless they have one; others lose both. History has
    a row only where a value really changes; the time of the update is refreshed anyway.
    """
    new = _last(changes, "job_id").select(F.col("job_id").alias("id"), F.col("new_status").alias("_new"), F.lit(True).alias("_hit"))
    both = jobs.join(new, "id", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False))).withColumn("_old_status", F.col("status")).withColumn("_old_stage", F.col("stage"))
    both = both.withColumn("stage", F.when(F.col("_hit"), F.when(F.col("_new") == "APPLIED", F.coalesce("stage", F.lit("APPLIED")))).otherwise(F.col("stage"))).withColumn("status", F.coalesce("_new", "status"))
    both = both.withColumn("status_updated_at", F.when(F.col("_hit"), _now(as_of)).otherwise(F.col("status_updated_at")))
    if "applied_at" in jobs.columns:
        both = both.withColumn("applied_at", F.when(F.col("_hit"), F.when(F.col("_new") == "APPLIED", _now(as_of))).otherwise(F.col("applied_at")))
    return _settle(jobs, both, as_of)


def apply_stage(jobs: DataFrame, changes: DataFrame, as_of) -> tuple[DataFrame, DataFrame, DataFrame]:
    """MUT-9: (jobs, status history, stage history) after stage changes (job_id, new_stage); a job with a stage is applied."""
    new = _last(changes, "job_id").select(F.col("job_id").alias("id"), F.col("new_stage").alias("_new"), F.lit(True).alias("_hit"))
    both = jobs.join(new, "id", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False))).withColumn("_old_status", F.col("status")).withColumn("_old_stage", F.col("stage"))
    turned = F.col("_hit") & (F.col("_old_status") != "APPLIED")
    both = both.withColumn("stage", F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("stage"))).withColumn("status", F.when(F.col("_hit"), "APPLIED").otherwise(F.col("status")))
    for c in ("status_updated_at", "applied_at"):
        if c in jobs.columns:
            both = both.withColumn(c, F.when(turned, _now(as_of)).otherwise(F.col(c)))
    return _settle(jobs, both, as_of)


def apply_edits(jobs: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """MUT-10: (jobs, rejects (job_id, reason)) after edits: job_id and any job columns, null for not given.

    A blank title or company is rejected, and so is an edit that lands on another job's
    title and company; a blank location becomes null.
    """
    given = [c for c in edits.columns if c not in ("job_id", "seq") and c in jobs.columns]
    new = _last(edits, "job_id").select(F.col("job_id").alias("id"), *[F.col(c).alias(f"_{c}") for c in given])
    after = lambda c: F.coalesce(f"_{c}", c) if c in given else F.col(c)
    both = new.join(jobs.select("id", "title", "company"), "id")
    blank = [F.coalesce(clean(F.col(f"_{c}")) == "", F.lit(False)) & F.col(f"_{c}").isNotNull() for c in ("title", "company") if c in given]
    both = both.withColumn("_fp", fingerprint(after("title"), after("company"))).withColumn("_blank", blank[0] if len(blank) == 1 else (blank[0] | blank[1]) if blank else F.lit(False))
    holders = jobs.select(fingerprint(F.col("title"), F.col("company")).alias("_fp"), "id").groupBy("_fp").agg(F.min("id").alias("_low"), F.max("id").alias("_high"), F.bool_or(F.col("_fp") != "").alias("_real")).where("_real").drop("_real")
    both = both.join(holders, "_fp", "left").withColumn("_taken", F.coalesce((F.col("_low") != F.col("id")) | (F.col("_high") != F.col("id")), F.lit(False)))
    names = F.lit("title" in given or "company" in given)
    both = both.withColumn("reason", F.when(F.col("_blank"), "blank").when(F.col("_taken") & names, "collision"))
    good = both.where("reason is null").select("id", *[f"_{c}" for c in given])
    out = jobs.join(good, "id", "left")
    for c in given:
        out = out.withColumn(c, F.when(clean(F.col(f"_{c}")) == "", None).otherwise(F.coalesce(f"_{c}", c)) if c == "location" else F.coalesce(f"_{c}", c))
    return out.select(*jobs.columns), both.where("reason is not null").select(F.col("id").alias("job_id"), "reason")


def touch(jobs: DataFrame, ids: DataFrame, as_of) -> DataFrame:
    """MUT-3: refreshes last_seen of the jobs in ``ids`` (id)."""
    seen = ids.select("id").distinct().withColumn("_seen", F.lit(True))
    return jobs.join(seen, "id", "left").withColumn("last_seen", F.when(F.col("_seen"), _now(as_of)).otherwise(F.col("last_seen"))).drop("_seen")


def assign_ids(rows: DataFrame, table: DataFrame, key: list[str], buckets: int = 256) -> DataFrame:
    """Adds ``id``: numbers without gaps above the table's largest, in an order that a rerun repeats.

    Rows are numbered within hash buckets of the key; each bucket starts after the counts of
    those before it, so no task numbers all rows.
    """
    rows = rows.withColumn("_b", F.pmod(F.xxhash64(*key), F.lit(buckets)))
    sizes = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_size"))
    # one row a bucket
    starts = sizes.withColumn("_start", F.sum("_size").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).drop("_size")
    top = table.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("_top"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy(*key))
    rows = rows.join(F.broadcast(starts), "_b").join(F.broadcast(top)).withColumn("_n", place)
    return rows.withColumn("id", F.col("_top") + F.coalesce("_start", F.lit(0)) + F.col("_n")).drop("_b", "_start", "_top", "_n")


def insert_absent(jobs: DataFrame, rows: DataFrame, key: str = "url") -> DataFrame:
    """MUT-1: rows whose key is not held yet are added, one a key, the last by seq; the rest are left to heal()."""
    new = _last(rows.where(F.col(key) != ""), key).drop("seq").join(jobs.select(key), key, "left_anti")
    if "id" in jobs.columns:
        new = assign_ids(new.drop("id"), jobs, [key])
    return jobs.unionByName(new.select(*[c for c in new.columns if c in jobs.columns]), allowMissingColumns=True)


def heal(jobs: DataFrame, rows: DataFrame, key: str = "url", cap: int = 8000) -> DataFrame:
    """MUT-2: fills a description that is empty or only an age, and the salary where none is shown, from the first row of the key."""
    names = [c for c in SALARY if c in rows.columns and c in jobs.columns]
    order = F.struct(*([F.col("seq")] if "seq" in rows.columns else []), F.col("description"))
    told = F.coalesce(clean(F.col("description")), F.lit("")) != ""
    fresh = rows.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.min_by(F.when(told, F.col("description")), F.when(told, order)).alias("_new"),
        *([F.min_by(F.struct(*names), F.when(F.coalesce("salary_display", F.lit("")) != "", order)).alias("_pay")] if names else []),
    )
    empty = F.coalesce("description", F.lit("")).rlike(_AGE_ONLY)
    out = jobs.join(fresh, key, "left").withColumn("description", F.when(empty & F.col("_new").isNotNull(), F.substring("_new", 1, cap)).otherwise(F.col("description")))
    if names:
        out = out.withColumn("_fill", (F.coalesce("salary_display", F.lit("")) == "") & F.col("_pay").isNotNull())
        for c in names:
            out = out.withColumn(c, F.when(F.col("_fill"), F.col(f"_pay.{c}")).otherwise(F.col(c)))
    return out.select(*jobs.columns)


def merge_postings(jobs: DataFrame, batch: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """MUT-4: (jobs, counts (tier, n)): known postings refresh last_seen and fill what is empty, others are added.

    The batch (rows of to_jobs_rows with seq) is expected to be deduplicated. Known means the
    same fingerprint, else the same url.
    """
    found = match_ladder(batch.withColumn("url_key", url_key(F.col("url"))), jobs).drop("url_key", "fp")
    known = found.where("job_id is not null")
    seen = heal(touch(jobs, known.select(F.col("job_id").alias("id")), as_of), known.drop("id").withColumnRenamed("job_id", "id"), "id")
    return insert_absent(seen, found.where("job_id is null").drop("job_id", "tier")), found.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


def drop_repeats(df: DataFrame) -> DataFrame:
    """FLT-19: without rows held only because they were decided before."""
    return df.where(~F.coalesce(F.trim("filter_reason").startswith("repeat-seen:"), F.lit(False)))


def untracked(held: DataFrame, jobs: DataFrame) -> DataFrame:
    """JON-8: rows whose url no job has."""
    return held.join(jobs.select("url").distinct(), "url", "left_anti")


def hold(held: DataFrame, jobs: DataFrame, rows: DataFrame, as_of) -> DataFrame:
    """MUT-5: held postings after new ones (of to_held_rows, with seq): the last row of a url replaces what was held, and shows again.

    Repeats, rows without url and urls of jobs are left out.
    """
    new = untracked(_last(drop_repeats(rows).where(F.col("url") != ""), "url"), jobs).withColumn("filtered_at", _now(as_of)).withColumn("restored", F.lit(False))
    kept_ids = new.join(held.where(F.col("url") != "").select("url", F.col("id").alias("_id")), "url", "left")
    again = kept_ids.where("_id is not null").withColumn("id", F.col("_id")).drop("_id", "seq")
    fresh = assign_ids(kept_ids.where("_id is null").drop("_id", "seq", "id"), held, ["url"])
    rest = held.join(again.select("id"), "id", "left_anti")
    return rest.unionByName(again.select(*[c for c in again.columns if c in held.columns]), allowMissingColumns=True).unionByName(fresh.select(*[c for c in fresh.columns if c in held.columns]), allowMissingColumns=True)


def resolve_restore(held: DataFrame, jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """JON-13: the held rows in ``ids`` (id) with the job_id and job_status of their url, null where there is none."""
    stored = jobs.where(F.col("url") != "").groupBy("url").agg(F.min_by(F.struct(F.col("id").alias("job_id"), F.col("status").alias("job_status")), "id").alias("_job"))
    return held.join(ids.select("id").distinct(), "id", "left_semi").join(stored, "url", "left").withColumn("job_id", F.col("_job.job_id")).withColumn("job_status", F.col("_job.job_status")).drop("_job")


def restore(held: DataFrame, jobs: DataFrame, ids: DataFrame, as_of) -> tuple[DataFrame, DataFrame, DataFrame]:
    """MUT-6: (held, jobs, report (id, job_id, job_status)): held rows become NEW jobs unless their url has one; they are flagged."""
    picked = resolve_restore(held, jobs, ids)
    fresh = picked.where("job_id is null").drop("job_id", "job_status", "id").withColumn("status", F.lit("NEW"))
    fresh = fresh.withColumn("status_updated_at", _now(as_of)).withColumn("scraped_at", _now(as_of)).withColumn("last_seen", _now(as_of))
    after = insert_absent(jobs, fresh)
    flagged = held.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left").withColumn("restored", F.coalesce("_hit", "restored")).select(*held.columns)
    return flagged, after, resolve_restore(held, after, ids).select("id", "job_id", "job_status")


def unrestore(held: DataFrame, jobs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """MUT-7: (held, jobs) with the rows in ``ids`` no longer restored and their jobs gone if still NEW."""
    hit = ids.select("id").distinct()
    urls = held.join(hit, "id", "left_semi").where(F.col("url") != "").select("url", F.lit("NEW").alias("status")).distinct()
    flagged = held.join(hit.withColumn("_hit", F.lit(True)), "id", "left").withColumn("restored", F.when(F.col("_hit"), F.lit(False)).otherwise(F.col("restored"))).select(*held.columns)
    return flagged, jobs.join(urls, ["url", "status"], "left_anti").select(*jobs.columns)


def add_external(jobs: DataFrame, rows: DataFrame, as_of) -> tuple[DataFrame, DataFrame, DataFrame]:
    """MUT-11: (jobs, status history, stage history) after postings (seq, url, title, company, location, description) that were applied to elsewhere.

    A stored url, else a stored title and company (never for placeholder titles), is moved to
    APPLIED and its empty fields are filled; others are added as APPLIED.
    """
    rows = _last(rows.withColumn("url", url_key(F.col("url"))).where("url != ''"), "url")
    by_url = jobs.select(url_key(F.col("url")).alias("url"), F.col("id").alias("_u")).where("url != ''").groupBy("url").agg(F.min("_u").alias("_u"))
    by_fp = jobs.select(fingerprint(F.col("title"), F.col("company")).alias("_fp"), F.col("id").alias("_f")).groupBy("_fp").agg(F.min("_f").alias("_f"), F.bool_or(F.col("_fp") != "").alias("_real")).where("_real").drop("_real")
    real = ~is_placeholder(F.col("title"))
    found = rows.withColumn("_fp", F.when(real, fingerprint(F.col("title"), F.col("company")))).join(by_url, "url", "left").join(by_fp, "_fp", "left").withColumn("job_id", F.coalesce("_u", "_f")).drop("_u", "_f", "_fp")
    moved, status_events, stage_events = apply_status(jobs, found.where("job_id is not null").select("job_id", "seq", F.lit("APPLIED").alias("new_status")), as_of)
    fill = _last(found.where("job_id is not null"), "job_id").select(F.col("job_id").alias("id"), *[F.col(c).alias(f"_{c}") for c in ("title", "company", "location", "description")])
    both = moved.join(fill, "id", "left")
    for c, most in (("title", 500), ("company", 300), ("location", 300), ("description", 8000)):
        given = F.coalesce(clean(F.col(f"_{c}")), F.lit("")) != ""
        open_ = is_placeholder(F.col("title")) & ~is_placeholder(F.col("_title")) if c == "title" else clean(F.col(c)) == ""
        both = both.withColumn(c, F.when(open_ & given, F.substring(f"_{c}", 1, most)).otherwise(F.col(c)))
    fresh = found.where("job_id is null").drop("job_id").withColumn("status", F.lit("APPLIED")).withColumn("stage", F.lit("APPLIED")).withColumn("status_updated_at", _now(as_of)).withColumn("applied_at", _now(as_of))
    out = insert_absent(both.select(*jobs.columns), fresh)
    new = out.join(jobs.select("id"), "id", "left_anti")
    event = lambda what: new.select(F.col("id").alias("job_id"), F.lit(None).cast("string").alias(f"old_{what}"), F.lit("APPLIED").alias(f"new_{what}"), _now(as_of).alias("changed_at"))
    return out, status_events.unionByName(event("status")), stage_events.unionByName(event("stage"))


def mark_duplicates(jobs: DataFrame, as_of) -> tuple[DataFrame, DataFrame, DataFrame]:
    """DUP-3: all but the keeper of each exact group become DUPLICATE, as apply_status does it."""
    key = F.concat_ws("|", norm_company(F.col("company")), norm_text(F.col("title")))
    surplus = jobs.where(~F.col("status").isin("DUPLICATE", "EXPIRED")).select("id", key.alias("key")).join(default_keeper(jobs), "key").where("id != keeper")
    return apply_status(jobs, surplus.select(F.col("id").alias("job_id"), F.lit("DUPLICATE").alias("new_status")), as_of)


def delete_jobs(jobs: DataFrame, histories: list[DataFrame], ids: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """MUT-12: without the jobs in ``ids`` (id), nor their histories."""
    gone = ids.select("id").distinct()
    return jobs.join(gone, "id", "left_anti"), [h.join(gone.withColumnRenamed("id", "job_id"), "job_id", "left_anti") for h in histories]


def reinsert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """MUT-13: deleted rows back in a table; a url that is held again keeps its present row, a stage needs the status APPLIED.

    Rows without url come back unless a row has the same title and company.
    """
    if "stage" in rows.columns:
        rows = rows.withColumn("stage", F.when(F.col("status") == "APPLIED", F.coalesce("stage", F.lit("APPLIED"))))
    key = F.when(F.col("url") != "", F.col("url")).otherwise(F.concat(F.lit("|"), fingerprint(F.col("title"), F.col("company"))))
    have = table.select(key.alias("_key")).unionByName(table.select(F.concat(F.lit("|"), fingerprint(F.col("title"), F.col("company"))).alias("_key"))).distinct()
    new = rows.withColumn("_key", key).dropDuplicates(["_key"]).join(have, "_key", "left_anti").drop("_key")
    return table.unionByName(new.select(*[c for c in new.columns if c in table.columns]), allowMissingColumns=True)


def evolve(df: DataFrame, schema: StructType, defaults: dict | None = None) -> DataFrame:
    """MUT-14: columns of the schema that are missing are added with their default or null; a null status_updated_at is filled."""
    for field in schema:
        if field.name not in df.columns:
            df = df.withColumn(field.name, F.lit((defaults or {}).get(field.name)).cast(field.dataType))
    if {"status_updated_at", "applied_at", "scraped_at"} <= set(df.columns):
        df = df.withColumn("status_updated_at", F.coalesce("status_updated_at", "applied_at", "scraped_at"))
    return df


def heal_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """AGG-15: one row (got_description, got_salary, unchanged) of a backfill."""
    b = before.select("id", F.col("description").alias("_d"), F.col("salary_display").alias("_s"))
    none = lambda c: F.coalesce(c, F.lit("")) == ""
    d, s = F.coalesce("_d", F.lit("")).rlike(_AGE_ONLY) & ~F.coalesce("description", F.lit("")).rlike(_AGE_ONLY), none(F.col("_s")) & ~none(F.col("salary_display"))
    return after.join(b, "id").agg(F.count_if(d).alias("got_description"), F.count_if(s).alias("got_salary"), F.count_if(~d & ~s).alias("unchanged"))
