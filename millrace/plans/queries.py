"""Registered queries over the logical tables, each with the SQL that gives its rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates, experience, location, salary, text, urls
from ..operators import dedupe, gates, merge, mining, reports
from ..operators.lineage import cut
from . import bindings as b
from .bindings import HISTORY_SQL, JOBS_SQL, RAW_SQL, STAGE_SQL
from .registry import query

AS_OF = "1998-06-10 00:00:00"

# SQL forms of the scalar functions, for oracles.
NORM = lambda c: f"trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g'))"
_suffixes = "|".join(text.COMPANY_SUFFIXES)
COMPANY = lambda c: (
    "trim(regexp_replace("
    + "".join("regexp_replace(" for _ in text.COMPANY_PREFIXES)
    + f"trim(regexp_replace(regexp_replace({NORM(c)}, 'in the philippines', ' ', 'g'), ' +', ' ', 'g'))"
    + "".join(f", '^(?:{p})+', '')" for p in text.COMPANY_PREFIXES)
    + f", '(?:(?:^| )(?:{_suffixes}))+$', ''))"
)
FP = lambda t, c: f"CASE WHEN {NORM(t)} = '' OR {COMPANY(c)} = '' THEN '' ELSE {COMPANY(c)} || '|' || {NORM(t)} END"
URL = lambda c: f"regexp_replace(lower(trim(coalesce({c}, ''))), '/+$', '')"
WORDS = lambda c: f"regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9+#.]+')"
STOPS = "('" + "', '".join(text.STOP_WORDS) + "')"
TOKENS = lambda c: f"list_distinct(list_filter({WORDS(c)}, lambda w: w NOT IN {STOPS}))"


def _placed(df):
    """Adds ``place``, the number of each row in the order of a sorted table: counts of the partitions before it, and the place within its own."""
    parts = cut(df.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    before = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))  # a row a partition
    place = F.coalesce("_before", F.lit(0)) + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return parts.join(F.broadcast(before.drop("_n")), "_part").withColumn("place", place).drop("_part", "_at", "_before")


@query("agg5_outcome_series", f"""
WITH {JOBS_SQL}, {HISTORY_SQL},
e AS (SELECT new_status, changed_at FROM hist UNION ALL SELECT status, status_updated_at FROM jobs WHERE id NOT IN (SELECT job_id FROM hist))
SELECT CAST(changed_at AS DATE) AS day, count(*) FILTER (new_status = 'APPLIED') AS applied, count(*) FILTER (new_status = 'REJECTED') AS rejected,
  count(*) FILTER (new_status = 'SKIP') AS skipped, count(*) FILTER (new_status = 'MISMATCH') AS mismatch, count(*) FILTER (new_status = 'EXP_GAP') AS exp_gap
FROM e WHERE new_status IN ('APPLIED', 'REJECTED', 'SKIP', 'MISMATCH', 'EXP_GAP') GROUP BY 1""")
def outcome_series(spark, d):
    return reports.outcome_series(b.jobs(spark, d), b.status_history(spark, d))


@query("agg1_counts_by_status", f"WITH {JOBS_SQL} SELECT status, count(*) AS n FROM jobs GROUP BY 1")
def counts_by_status(spark, d):
    return reports.counts_by(b.jobs(spark, d), "status")


@query("agg1_counts_by_source", f"WITH {JOBS_SQL} SELECT source, count(*) AS n FROM jobs GROUP BY 1")
def counts_by_source(spark, d):
    return reports.counts_by(b.jobs(spark, d), "source")


@query("agg2_week_kpis", f"""
WITH {JOBS_SQL}, w AS (SELECT date_trunc('week', TIMESTAMP '{AS_OF}') AS s)
SELECT count(*) FILTER (scraped_at >= s) AS new_week, count(*) FILTER (status = 'APPLIED' AND status_updated_at >= s) AS applied_week, count(*) FILTER (status = 'SKIP' AND status_updated_at >= s) AS skip_week,
  count(*) FILTER (status = 'MISMATCH' AND status_updated_at >= s) AS mismatch_week, count(*) FILTER (status = 'EXP_GAP' AND status_updated_at >= s) AS exp_gap_week,
  count(*) FILTER (status IN ('APPLIED', 'SKIP', 'MISMATCH', 'EXP_GAP', 'REJECTED')) AS decided FROM jobs, w""")
def week_kpis(spark, d):
    return reports.week_kpis(b.jobs(spark, d), AS_OF)


@query("agg3_weekly_applied", f"WITH {JOBS_SQL} SELECT CAST(date_trunc('week', status_updated_at) AS DATE) AS week, count(*) AS n FROM jobs WHERE status = 'APPLIED' GROUP BY 1")
def weekly_applied(spark, d):
    return reports.weekly_applied(b.jobs(spark, d))


@query("agg9_funnel_counts", f"""
WITH {JOBS_SQL}, a AS (SELECT *, coalesce(stage, 'APPLIED') AS s FROM jobs WHERE status = 'APPLIED')
SELECT count(*) AS total, count(*) FILTER (s IN ('APPLIED', 'INITIAL', 'TECHNICAL', 'FINAL')) AS in_progress, count(*) FILTER (s IN ('OFFER', 'ACCEPTED', 'DECLINED')) AS offers,
  count(*) FILTER (s = 'OUT') AS rejected, count(*) FILTER (follow_up_at <= DATE '1998-06-10') AS due FROM a""")
def funnel_counts(spark, d):
    return reports.funnel_counts(b.jobs(spark, d), AS_OF)


@query("agg12_usage_budget", """
WITH l AS (SELECT event_id AS id, event_type AS bucket, ts, CAST(floor(abs(value)) AS BIGINT) AS tokens FROM events),
r AS (SELECT *, count(*) OVER w AS calls, CAST(sum(tokens) OVER w AS BIGINT) AS total FROM l WINDOW w AS (PARTITION BY bucket, CAST(ts AS DATE) ORDER BY ts, id ROWS UNBOUNDED PRECEDING))
SELECT id, bucket, tokens, calls, total, calls > 20 OR total > 1000 AS over FROM r""")
def usage_budget(spark, d):
    ledger = b.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("bucket"), "ts", F.floor(F.abs("value")).alias("tokens"))
    return reports.usage_budget(ledger, 20, 1000).drop("ts")


@query("jon9_without_history", f"WITH {JOBS_SQL}, {HISTORY_SQL} SELECT id, status FROM jobs WHERE id NOT IN (SELECT job_id FROM hist)")
def without_history(spark, d):
    seen = b.status_history(spark, d).select(F.col("job_id").alias("id")).distinct()
    return b.jobs(spark, d).join(seen, "id", "left_anti").select("id", "status")


@query("set2_history_with_legacy", f"""
WITH {JOBS_SQL}, {HISTORY_SQL} SELECT job_id, new_status, changed_at FROM hist
UNION ALL SELECT id, status, status_updated_at FROM jobs WHERE id NOT IN (SELECT job_id FROM hist)""")
def history_with_legacy(spark, d):
    return reports.history_with_legacy(b.status_history(spark, d), b.jobs(spark, d))


@query("win6_stage_before_out", f"""
WITH {STAGE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY changed_at DESC, id DESC) AS n FROM shist WHERE new_stage = 'OUT')
SELECT job_id, old_stage AS stage FROM r WHERE n = 1""")
def stage_before_out(spark, d):
    return reports.stage_before_out(b.stage_history(spark, d))


@query("srt6_timeline", f"WITH {HISTORY_SQL}, {STAGE_SQL} SELECT job_id, 'status' AS kind, new_status AS value, changed_at FROM hist UNION ALL SELECT job_id, 'stage', new_stage, changed_at FROM shist")
def timeline(spark, d):
    return reports.timeline(b.status_history(spark, d), b.stage_history(spark, d))


@query("win8_newest_per_label", f"""
WITH {JOBS_SQL}, l AS (SELECT id, status_updated_at, CASE WHEN status IN ('APPLIED', 'REVIEWED') THEN 'GOOD' ELSE 'BAD' END AS label FROM jobs
  WHERE status IN ('APPLIED', 'REVIEWED', 'REJECTED', 'SKIP', 'MISMATCH', 'EXP_GAP') AND coalesce(stage, '') <> 'OUT'),
r AS (SELECT id, label, CAST(row_number() OVER (PARTITION BY label ORDER BY status_updated_at DESC, id DESC) AS INTEGER) AS rank FROM l)
SELECT id, label, rank FROM r WHERE rank <= 30""")
def newest_per_label(spark, d):
    return reports.top_n_per_side(mining.labelled(b.jobs(spark, d)), 30).select("id", "label", "rank")


@query("flt11_list_filter", f"""
WITH {JOBS_SQL} SELECT id, status, date_posted FROM jobs WHERE status = 'NEW' AND date_posted BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' AND (contains(lower(title), 'a') OR contains(lower(company), 'a'))""")
def list_filter(spark, d):
    return gates.list_filter(b.jobs(spark, d), status="NEW", date_from="1995-01-01", date_to="1996-12-31", search="a").select("id", "status", "date_posted")


_HAS = lambda c, w: f"contains(lower(coalesce({c}, '')), '{w}')"


@query("flt12_search", f"""
WITH {JOBS_SQL} SELECT id, ({_HAS('title', 'a')} AND {_HAS('title', 'e')}) OR {_HAS('title', 'x')} AS scoped, {_HAS('company', '1 inc')} OR {_HAS('title', 'a, b')} OR {_HAS('company', 'a, b')} OR ({_HAS('company', '7')} AND {_HAS('title', 'lin')}) OR ({_HAS('company', '7')} AND {_HAS('company', 'lin')})
  OR ({_HAS('title', '7')} AND ({_HAS('title', 'lin')} OR {_HAS('company', 'lin')})) OR {_HAS('title', '1 inc')} AS quoted, {_HAS('company', 'title:a')} AS inside FROM jobs""")
def search(spark, d):
    found = lambda q, name: gates.compile_search(q).alias(name)
    return b.jobs(spark, d).select("id", found("Title: a e, X", "scoped"), found('"1 INC" | "a, b" OR 7 lin', "quoted"), found("company:title:a", "inside"))


@query("flt13_hide", f"WITH {JOBS_SQL} SELECT id, status, source FROM jobs WHERE status NOT IN ('SKIP', 'DUPLICATE') AND source <> 'src3'")
def hide(spark, d):
    return gates.hide(b.jobs(spark, d), ["SKIP", "DUPLICATE"], ["src3"]).select("id", "status", "source")


@query("flt14_stale", f"WITH {JOBS_SQL} SELECT id FROM jobs WHERE coalesce(last_seen, scraped_at) < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY")
def stale(spark, d):
    return b.jobs(spark, d).where(gates.is_stale(F.col("last_seen"), F.col("scraped_at"), F.lit(AS_OF).cast("timestamp"))).select("id")


@query("flt15_due", f"WITH {JOBS_SQL} SELECT id, follow_up_at FROM jobs WHERE follow_up_at <= DATE '1998-06-10'")
def due(spark, d):
    return b.jobs(spark, d).where(gates.is_due(F.col("follow_up_at"), F.lit(AS_OF).cast("timestamp"))).select("id", "follow_up_at")


@query("flt16_applications_in_progress", f"WITH {JOBS_SQL} SELECT id, coalesce(stage, 'APPLIED') AS stage FROM jobs WHERE status = 'APPLIED' AND coalesce(stage, 'APPLIED') IN ('APPLIED', 'INITIAL', 'TECHNICAL', 'FINAL')")
def in_progress(spark, d):
    return gates.applications(b.jobs(spark, d), "in_progress").select("id", "stage")


@query("srt1_jobs_by_score", f"""
WITH {JOBS_SQL}, r AS (SELECT id, score, scraped_at, CAST(row_number() OVER (ORDER BY score DESC NULLS LAST, scraped_at DESC NULLS LAST, id DESC) AS BIGINT) AS place FROM jobs) SELECT * FROM r""")
def jobs_by_score(spark, d):
    return _placed(reports.sort_view(b.jobs(spark, d).select("id", "score", "scraped_at")))


@query("fn4_fingerprint", f"WITH {RAW_SQL} SELECT seq, {NORM('title')} AS title_norm, {COMPANY('company')} AS company_norm, {FP('title', 'company')} AS fp FROM raw")
def fingerprint(spark, d):
    t, c = F.col("title"), F.col("company")
    return b.raw_postings(spark, d).select("seq", text.norm_text(t).alias("title_norm"), text.norm_company(c).alias("company_norm"), text.fingerprint(t, c).alias("fp"))


@query("fn7_url_parts", f"""
SELECT page_id, {URL('url')} AS url_key, regexp_replace(lower(regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#:]*)', 1)), '^www\\.', '') AS site,
  regexp_replace(trim(url), '[?#].*$', '') AS bare FROM pages""")
def url_parts(spark, d):
    u = F.col("url")
    return b.table(spark, d, "pages").select("page_id", urls.url_key(u).alias("url_key"), urls.site_of(u).alias("site"), urls.strip_query(u).alias("bare"))


@query("fn14_listed_date", """
WITH a AS (SELECT doc_id, CASE WHEN doc_id % 7 = 6 THEN 'just now' ELSE CAST(doc_id % 23 AS VARCHAR) || ' ' || (['second','minute','hour','day','week','month'])[CAST(doc_id % 6 AS INT) + 1] || 's ago' END AS t FROM documents),
p AS (SELECT doc_id, t, TRY_CAST(regexp_extract(t, '([0-9]+) (second|minute|hour|day|week|month)s ago', 1) AS INTEGER) AS n, regexp_extract(t, '([0-9]+) (second|minute|hour|day|week|month)s ago', 2) AS u FROM a)
SELECT doc_id, CASE WHEN n IS NULL THEN DATE '2026-01-31' ELSE DATE '2026-01-31' - n * CASE u WHEN 'day' THEN 1 WHEN 'week' THEN 7 WHEN 'month' THEN 30 ELSE 0 END END AS listed,
  round(coalesce(n * CASE u WHEN 'second' THEN 1.0 / 3600 WHEN 'minute' THEN 1.0 / 60 WHEN 'hour' THEN 1.0 WHEN 'day' THEN 24.0 WHEN 'week' THEN 168.0 WHEN 'month' THEN 720.0 END, 0.0)::DOUBLE, 6) AS hours FROM p""")
def listed_date(spark, d):
    t = F.expr("CASE WHEN doc_id % 7 = 6 THEN 'just now' ELSE concat(CAST(doc_id % 23 AS STRING), ' ', element_at(array('second','minute','hour','day','week','month'), CAST(doc_id % 6 AS INT) + 1), 's ago') END")
    docs = b.table(spark, d, "documents").select("doc_id", t.alias("t"))
    return docs.select("doc_id", dates.listed_date(F.col("t"), F.lit("2026-01-31").cast("timestamp")).alias("listed"), F.round(dates.age_hours_text(F.col("t")), 6).alias("hours"))


@query("fn18_tokens", f"SELECT doc_id, len({TOKENS('text')}) AS n_tokens, greatest(1, CAST(floor(length(coalesce(text, '')) / 4) AS INTEGER)) AS est FROM documents")
def tokens(spark, d):
    return b.table(spark, d, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n_tokens"), text.est_tokens(F.col("text")).alias("est"))


@query("fn22_salary_words", f"""
WITH {RAW_SQL}, s AS (SELECT seq, salary_raw AS t, lower(salary_raw) AS l FROM raw)
SELECT seq, CASE WHEN regexp_matches(l, 'per hour|/hr\\b|\\bhourly\\b|an? hour\\b') THEN 'hourly' WHEN regexp_matches(l, 'per day|/day\\b|\\bdaily\\b|a day\\b') THEN 'daily'
    WHEN regexp_matches(l, 'per week|/w(e)?e?k\\b|\\bweekly\\b|a week\\b') THEN 'weekly' WHEN regexp_matches(l, 'per month|/m(o|onth)\\b|\\bmonthly\\b|a month\\b') THEN 'monthly'
    WHEN regexp_matches(l, 'per year|per annum|/y(r|ear)\\b|\\bannual\\w*\\b|\\byearly\\b|a year\\b|p\\.a\\.') THEN 'yearly' ELSE 'unknown' END AS cadence,
  CASE WHEN contains(t, '₱') THEN 'PHP' WHEN contains(t, '$') THEN 'USD' ELSE upper(regexp_extract(t, '(?i)\\b(PHP|USD|EUR|GBP|JPY|INR|AUD|CAD|SGD)\\b', 1)) END AS currency FROM s""")
def salary_words(spark, d):
    s = F.col("salary_raw")
    return b.raw_postings(spark, d).select("seq", salary.pay_interval(s).alias("cadence"), salary.pay_currency(s).alias("currency"))


@query("fn26_to_monthly", """
SELECT o_orderkey, round(CASE o_orderkey % 6 WHEN 0 THEN o_totalprice * 160.0 WHEN 1 THEN o_totalprice * 22.0 WHEN 2 THEN o_totalprice * (52.0::DOUBLE / 12.0::DOUBLE) WHEN 3 THEN o_totalprice WHEN 4 THEN o_totalprice / 12.0 END, 6) AS monthly FROM orders""")
def to_monthly(spark, d):
    kind = F.expr("element_at(array('hourly','daily','weekly','monthly','yearly','unknown'), CAST(o_orderkey % 6 AS INT) + 1)")
    return b.table(spark, d, "orders").select("o_orderkey", F.round(salary.to_monthly(F.col("o_totalprice"), kind), 6).alias("monthly"))


@query("fn20_max_experience", f"""
WITH {RAW_SQL} SELECT seq, CASE seq % 7 WHEN 0 THEN 0 WHEN 1 THEN CAST(seq % 12 AS INTEGER) WHEN 2 THEN 3 END AS years FROM raw""")
def max_experience(spark, d):
    return b.spread(b.raw_postings(spark, d).select("seq", "description")).select("seq", experience.max_experience(F.col("description")).alias("years"))


@query("flt4_location_gate", f"""
WITH {RAW_SQL} SELECT seq, location IN ('Makati, P00, PH', '', 'Quezon City') AS strict, location IN ('Makati, P00, PH', '', 'Quezon City', 'Philippines') AS loose, location = 'Remote Worldwide' AS remote,
  location = 'Remote Worldwide' OR CASE WHEN loose_location THEN location IN ('Makati, P00, PH', '', 'Quezon City', 'Philippines') ELSE location IN ('Makati, P00, PH', '', 'Quezon City') END AS passes FROM raw""")
def location_gate(spark, d):
    c = F.col("location")
    return b.raw_postings(spark, d).select("seq", location.in_region(c).alias("strict"), location.in_region_or_country(c).alias("loose"), location.is_remote(c).alias("remote"), location.location_gate(c, F.col("loose_location")).alias("passes"))


@query("flt20_apply_gates", f"""
WITH {RAW_SQL}, g AS (SELECT seq, CASE WHEN seq % 7 = 1 AND seq % 12 > 2 THEN 'exp-gap:needs ' || CAST(seq % 12 AS VARCHAR) || ' yrs (ceiling 2)' WHEN seq % 7 = 2 THEN 'exp-gap:needs 3 yrs (ceiling 2)' END AS reason,
  (location IN ('Makati, P00, PH', '', 'Quezon City', 'Remote Worldwide') OR (loose_location AND location = 'Philippines'))
  AND coalesce(NOT contains(lower(title), 'senior') AND (contains(lower(title), 'developer') OR contains(lower(title), 'engineer')), false) AND coalesce(NOT contains(lower(company), 'acme 7'), true) AS ok FROM raw)
SELECT seq, reason, CASE WHEN reason IS NOT NULL THEN 'held' WHEN ok THEN 'kept' ELSE 'dropped' END AS outcome FROM g""")
def apply_gates(spark, d):
    return gates.apply_gates(b.spread(b.raw_postings(spark, d)), ["developer", "engineer"], ["senior"], ["acme 7"], 2).select("seq", "reason", "outcome")


@query("win1_dedupe_first", f"""
WITH {RAW_SQL}, r AS (SELECT seq, {URL('job_url')} AS k, source_rank FROM raw), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY source_rank, seq) AS n FROM r) SELECT seq, k AS url_key FROM n WHERE n = 1""")
def dedupe_first(spark, d):
    df = b.raw_postings(spark, d).withColumn("url_key", urls.url_key(F.col("job_url")))
    return dedupe.dedupe_first(df, F.col("url_key"), ["source_rank", "seq"]).select("seq", "url_key")


@query("win2_dedupe_fingerprint", f"""
WITH {RAW_SQL}, r AS (SELECT seq, {FP('title', 'company')} AS k, source_rank FROM raw), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY source_rank, seq) AS n FROM r) SELECT seq FROM n WHERE n = 1 OR k = ''""")
def dedupe_fingerprint(spark, d):
    return dedupe.dedupe_fingerprint(b.raw_postings(spark, d), ["source_rank", "seq"]).select("seq")


@query("win3_cap_per_group", f"""
WITH {RAW_SQL}, n AS (SELECT seq, site, source_rank, row_number() OVER (PARTITION BY site, source_rank ORDER BY seq) AS n FROM raw) SELECT seq, site FROM n WHERE n <= 5""")
def cap_per_group(spark, d):
    return dedupe.cap_per_group(b.raw_postings(spark, d), ["site", "source_rank"], 5, ["seq"]).select("seq", "site")


@query("jon2_match_ladder", f"""
WITH {RAW_SQL}, {JOBS_SQL}, j AS (SELECT id, {FP('title', 'company')} AS fp, {URL('url')} AS k FROM jobs), f AS (SELECT fp, min(id) AS id FROM j WHERE fp <> '' GROUP BY fp), u AS (SELECT k, min(id) AS id FROM j WHERE k <> '' GROUP BY k),
r AS (SELECT seq, {FP('title', 'company')} AS fp, 'https://jobs.example.com/view/' || CAST(seq % 5000 AS VARCHAR) AS k FROM raw)
SELECT seq, coalesce(f.id, u.id) AS job_id, CASE WHEN f.id IS NOT NULL THEN 'fingerprint' WHEN u.id IS NOT NULL THEN 'url' ELSE 'new' END AS tier FROM r LEFT JOIN f ON f.fp = r.fp LEFT JOIN u ON u.k = r.k""")
def match_ladder(spark, d):
    df = b.raw_postings(spark, d).withColumn("url_key", F.expr("concat('https://jobs.example.com/view/', CAST(seq % 5000 AS STRING))"))
    return dedupe.match_ladder(df, b.jobs(spark, d)).select("seq", "job_id", "tier")


@query("jon3_fingerprint_index", f"WITH {JOBS_SQL}, j AS (SELECT id, {FP('title', 'company')} AS fp FROM jobs) SELECT fp, min(id) AS id FROM j WHERE fp <> '' GROUP BY fp")
def fingerprint_index(spark, d):
    return dedupe.fingerprint_index(b.jobs(spark, d))


@query("jon10_edit_collisions", f"""
WITH {JOBS_SQL}, j AS (SELECT id, {FP('title', 'company')} AS fp FROM jobs), e AS (SELECT id AS job_id, {FP('title', 'company')} AS fp FROM jobs WHERE id % 5 = 0)
SELECT job_id, min(j.id) AS other_id FROM e JOIN j ON e.fp = j.fp AND j.id <> e.job_id WHERE e.fp <> '' GROUP BY job_id""")
def edit_collisions(spark, d):
    jobs = b.jobs(spark, d)
    return dedupe.edit_collisions(jobs, jobs.where("id % 5 = 0").select(F.col("id").alias("job_id"), "title", "company"))


@query("dup1_exact_groups", f"""
WITH {JOBS_SQL}, j AS (SELECT id, {COMPANY('company')} || '|' || {NORM('title')} AS key FROM jobs WHERE status NOT IN ('DUPLICATE', 'EXPIRED')) SELECT key, count(*) AS size, min(id) AS first_id FROM j GROUP BY key HAVING count(*) > 1""")
def exact_groups(spark, d):
    return dedupe.exact_groups(b.jobs(spark, d))


@query("win4_default_keeper", f"""
WITH {JOBS_SQL}, j AS (SELECT id, {COMPANY('company')} || '|' || {NORM('title')} AS key, CASE status WHEN 'APPLIED' THEN 0 WHEN 'REVIEWED' THEN 1 WHEN 'NEW' THEN 2 ELSE 3 END AS r, scraped_at FROM jobs WHERE status NOT IN ('DUPLICATE', 'EXPIRED')),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY r, scraped_at NULLS LAST, id) AS n, count(*) OVER (PARTITION BY key) AS size FROM j) SELECT key, size, id AS keeper FROM n WHERE n = 1 AND size > 1""")
def default_keeper(spark, d):
    return dedupe.default_keeper(b.jobs(spark, d))


_LAB = "lab AS (SELECT id, title, company, CASE WHEN status IN ('APPLIED', 'REVIEWED') THEN 'GOOD' ELSE 'BAD' END AS label FROM jobs WHERE status IN ('APPLIED', 'REVIEWED', 'REJECTED', 'SKIP', 'MISMATCH', 'EXP_GAP') AND coalesce(stage, '') <> 'OUT')"
_RATE = "SELECT value, count(*) AS hits, count(*) FILTER (label = 'BAD') AS bad_hits FROM v GROUP BY value HAVING count(*) >= 5 AND count(*) FILTER (label = 'BAD') >= 0.6::DOUBLE * count(*)"


@query("min4_keywords", f"WITH {JOBS_SQL}, {_LAB}, v AS (SELECT label, unnest({TOKENS('title')}) AS value FROM lab) {_RATE.replace('GROUP BY', 'WHERE value NOT IN (' + repr('almond') + ') GROUP BY')}")
def keywords(spark, d):
    return mining.mine_keywords(mining.labelled(b.jobs(spark, d)), 5, 0.6, ["almond"])


@query("min5_phrases", f"""
WITH {JOBS_SQL}, {_LAB}, t AS (SELECT id, label, list_filter({WORDS('title')}, lambda w: w NOT IN {STOPS}) AS w FROM lab),
v AS (SELECT DISTINCT id, label, w[i] || ' ' || w[i + 1] AS value FROM t, unnest(range(1, len(w))) AS r(i)) {_RATE}""")
def phrase_rules(spark, d):
    return mining.mine_phrases(mining.labelled(b.jobs(spark, d)), 5, 0.6)


@query("min6_companies", f"WITH {JOBS_SQL}, {_LAB}, v AS (SELECT label, {COMPANY('company')} AS value FROM lab WHERE {COMPANY('company')} <> '') {_RATE}")
def companies(spark, d):
    return mining.mine_companies(mining.labelled(b.jobs(spark, d)), 5, 0.6, [])


@query("mut8_apply_status", f"""
WITH {JOBS_SQL}, c AS (SELECT id AS cid, CASE WHEN id % 2 = 0 THEN 'APPLIED' ELSE 'SKIP' END AS new_status FROM jobs WHERE id % 3 = 0)
SELECT id, coalesce(new_status, status) AS status, CASE WHEN new_status IS NULL THEN stage WHEN new_status = 'APPLIED' THEN coalesce(stage, 'APPLIED') END AS stage,
  CASE WHEN new_status IS NULL THEN status_updated_at ELSE TIMESTAMP '{AS_OF}' END AS status_updated_at FROM jobs LEFT JOIN c ON cid = id""")
def apply_status(spark, d):
    jobs = b.jobs(spark, d)
    changes = jobs.where("id % 3 = 0").select(F.col("id").alias("job_id"), F.expr("CASE WHEN id % 2 = 0 THEN 'APPLIED' ELSE 'SKIP' END").alias("new_status"))
    return merge.apply_status(jobs, changes, AS_OF)[0].select("id", "status", "stage", "status_updated_at")


@query("mut8_status_history", f"""
WITH {JOBS_SQL}, c AS (SELECT id AS job_id, status AS old_status, CASE WHEN id % 2 = 0 THEN 'APPLIED' ELSE 'SKIP' END AS new_status FROM jobs WHERE id % 3 = 0) SELECT job_id, old_status, new_status FROM c WHERE old_status <> new_status""")
def apply_status_history(spark, d):
    jobs = b.jobs(spark, d)
    changes = jobs.where("id % 3 = 0").select(F.col("id").alias("job_id"), F.expr("CASE WHEN id % 2 = 0 THEN 'APPLIED' ELSE 'SKIP' END").alias("new_status"))
    return merge.apply_status(jobs, changes, AS_OF)[1].drop("changed_at")


@query("mut3_touch", f"WITH {JOBS_SQL} SELECT id, CASE WHEN id % 4 = 0 THEN TIMESTAMP '{AS_OF}' ELSE last_seen END AS last_seen FROM jobs")
def touch(spark, d):
    jobs = b.jobs(spark, d)
    return merge.touch(jobs, jobs.where("id % 4 = 0").select("id"), AS_OF).select("id", "last_seen")


@query("mut12_delete_jobs", f"WITH {JOBS_SQL}, {HISTORY_SQL} SELECT job_id, count(*) AS n FROM hist WHERE job_id NOT IN (SELECT id FROM jobs WHERE id % 2 = 0) GROUP BY job_id")
def delete_jobs(spark, d):
    jobs = b.jobs(spark, d)
    left = merge.delete_jobs(jobs, [b.status_history(spark, d)], jobs.where("id % 2 = 0"))[1][0]
    return left.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))
