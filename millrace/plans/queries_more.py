"""Further registered queries: texts, projections, mining, scoring, groups and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, location, salary, text, urls
from ..operators import dedupe, gates, merge, mining, projections, reports, scoring
from . import bindings as b
from .bindings import HELD_SQL, JOBS_SQL, RAW_SQL
from .queries import AS_OF, COMPANY, FP, NORM, STOPS, TOKENS, URL, WORDS
from .registry import query

_quoted = lambda names: "('" + "', '".join(names) + "')"
TITLE = lambda c: f"array_to_string(list_filter({WORDS(c)}, lambda w: w NOT IN {STOPS}), ' ')"
PLACES = lambda c: f"list_filter({TOKENS(c)}, lambda w: w NOT IN {_quoted(text.PLACE_WORDS)} AND NOT regexp_full_match(w, '[0-9]+'))"
_INSIDE = "(trim(coalesce(location, '')) = '' OR regexp_matches(lower(location), '" + "|".join(location.REGION) + "'))"
_LABELLED = "lab AS (SELECT *, CASE WHEN status IN ('APPLIED', 'REVIEWED') THEN 'GOOD' ELSE 'BAD' END AS label FROM jobs WHERE status IN ('APPLIED', 'REVIEWED', 'REJECTED', 'SKIP', 'MISMATCH', 'EXP_GAP') AND coalesce(stage, '') <> 'OUT')"
_named = lambda c: "list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'''contains(lower({c}), '{a}')''' for a in aliases)} THEN '{s}' END" for s, aliases in scoring.SKILLS.items()) + "], lambda x: x IS NOT NULL)"
_BOTH = "(coalesce(title, '') || ' ' || coalesce(description, ''))"
_case = lambda c, names, default: "CASE " + " ".join(f"WHEN contains({c}, '{n}') THEN '{n}'" for n in names) + f" ELSE {default} END"


@query("fn6_canonical_url", f"""
WITH p AS (SELECT page_id, trim(url) AS u, lower(regexp_extract(trim(url), '^[A-Za-z]+://([^/?#:]*)', 1)) AS host, regexp_extract(trim(url), '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS path,
  array_to_string(list_filter(string_split(regexp_extract(trim(url), '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' AND lower(string_split(x, '=')[1]) NOT IN {_quoted(urls.TRACKING)}), '&') AS q FROM pages)
SELECT page_id, regexp_replace(lower(regexp_extract(u, '^([A-Za-z]+)://', 1)) || '://' || host || regexp_replace(path, '/+$', '') || CASE WHEN q = '' THEN '' ELSE '?' || q END, '/+$', '') AS url,
  url AS with_login, url AS with_params, lower(substr(u, strpos(u, '://') + 3)) || '?u=http://x.y/z' AS no_scheme FROM p""")
def canonical_url(spark, d):
    """Each link as it is, with a login, with parameters of its last segment, and without a scheme before another link."""
    u, one = F.trim("url"), urls.canonical_url
    params = F.regexp_replace(u, r"^([^?#]*[^?#/])/?(?=[?#]|\z)", "$1;jsessionid=A1")
    pages = b.table(spark, d, "pages")
    return pages.select("page_id", one(u).alias("url"), one(F.replace(u, F.lit("://"), F.lit("://me:x@"))).alias("with_login"), one(params).alias("with_params"), one(F.concat(F.substr(u, F.instr(u, "://") + 3), F.lit("?u=http://x.y/z"))).alias("no_scheme"))


@query("fn8_source_label", f"""
WITH {RAW_SQL}, t AS (SELECT seq, lower(trim(CASE WHEN seq % 3 = 0 THEN '' ELSE coalesce(site, '') END)) AS s, lower(job_url) AS u FROM raw)
SELECT seq, CASE WHEN s <> '' THEN {_case('s', urls.JOB_LABELS, 's')} ELSE {_case('u', urls.JOB_LABELS, "''")} END AS label FROM t""")
def source_label(spark, d):
    site = F.when(F.col("seq") % 3 == 0, "").otherwise(F.col("site"))
    return b.raw_postings(spark, d).select("seq", urls.source_label(site, F.col("job_url")).alias("label"))


@query("fn10_clean_id_url", "SELECT page_id, CASE WHEN regexp_extract(url, '[?&]page=([^&#]+)', 1) = '' THEN '' ELSE regexp_replace(trim(url), '[?#].*$', '') || '?page=' || regexp_extract(url, '[?&]page=([^&#]+)', 1) END AS url FROM pages")
def clean_id_url(spark, d):
    return b.table(spark, d, "pages").select("page_id", urls.clean_id_url(F.col("url"), "page").alias("url"))


_READ = lambda c: f"replace(regexp_replace(regexp_replace(regexp_replace({c}, '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&quot;?', chr(34), 'g'), '&amp;', '&')"
_READ_ALL = lambda c: "regexp_replace(" + _READ(c) + ", '&amp', '&', 'g')"  # noqa: E731  what the pages hold


@query("fn11_strip_html", rf"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g') AS s FROM pages)
SELECT page_id, md5(regexp_replace(regexp_replace({_READ_ALL('s')}, '[ \t\x{{a0}}]+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM a""")
def strip_html(spark, d):
    return b.table(spark, d, "pages").select("page_id", F.md5(text.strip_html(F.col("html"))).alias("digest"))


@query("fn12_times", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE date_trunc('second', ts) END AS iso, to_timestamp(event_id * 3600)::TIMESTAMP AS millis FROM events")
def times(spark, d):
    made = F.when(F.col("event_id") % 5 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return b.table(spark, d, "events").select("event_id", dates.parse_iso(made).alias("iso"), dates.from_millis(F.col("event_id") * 3600000).alias("millis"))


@query("fn16_age_hours", "SELECT event_id, round(date_diff('microsecond', ts, TIMESTAMP '2024-02-01') / 3.6e9::DOUBLE, 6) AS hours, coalesce(date_diff('microsecond', ts, TIMESTAMP '2024-02-01') / 3.6e9::DOUBLE <= 100, true) AS recent FROM events")
def age_hours(spark, d):
    age = dates.age_hours(F.col("ts"), F.lit("2024-02-01").cast("timestamp"))
    return b.table(spark, d, "events").select("event_id", F.round(age, 6).alias("hours"), gates.recent(age, 100).alias("recent"))


_PAID = """p AS (SELECT o_orderkey AS id, o_orderkey % 5 AS k, CAST(floor(o_totalprice) AS BIGINT) AS a, CAST(floor(o_totalprice) AS BIGINT) + o_orderkey % 1000 AS z FROM orders),
s AS (SELECT id, k, CASE k WHEN 0 THEN 'PHP' WHEN 1 THEN 'USD' ELSE '' END AS currency, CASE WHEN k = 0 AND z < 5000 THEN NULL WHEN k < 3 THEN a END AS low, CASE WHEN k = 0 AND z < 5000 THEN NULL WHEN k = 1 THEN a WHEN k < 3 THEN z END AS high,
  CASE k WHEN 0 THEN 'monthly' WHEN 1 THEN 'yearly' ELSE 'unknown' END AS cadence FROM p)"""


def _paid(spark, d):
    made = F.expr("""CASE o_orderkey % 5 WHEN 0 THEN concat('PHP ', a, ' - PHP ', z, ' per month') WHEN 1 THEN concat('5 years experience, $', a, '/yr') WHEN 2 THEN concat('Salary ', z, ' to ', a) WHEN 3 THEN concat(z % 30, ' days ago') END""")
    o = b.table(spark, d, "orders").withColumn("a", F.floor("o_totalprice")).withColumn("z", F.col("a") + F.col("o_orderkey") % 1000)
    return o.select(F.col("o_orderkey").alias("id"), salary.parse_salary(made).alias("p"))


@query("fn25_parse_salary", f"WITH {_PAID} SELECT id, currency, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, cadence FROM s")
def parse_salary(spark, d):
    return _paid(spark, d).select("id", "p.currency", F.col("p.min").alias("low"), F.col("p.max").alias("high"), F.col("p.interval").alias("cadence"))


_SHORT = lambda v: f"CASE WHEN {v} >= 1000000 AND {v} % 1000000 = 0 THEN CAST({v} // 1000000 AS VARCHAR) || 'M' WHEN {v} >= 1000 AND {v} % 1000 = 0 THEN CAST({v} // 1000 AS VARCHAR) || 'k' ELSE format('{{:,}}', {v}) END"


_EACH = lambda v: f"CASE WHEN {v} >= 1000000 AND {v} % 1000000 = 0 THEN CAST(CAST({v} AS BIGINT) // 1000000 AS VARCHAR) || 'M' WHEN {v} >= 1000 AND {v} % 1000 = 0 THEN CAST(CAST({v} AS BIGINT) // 1000 AS VARCHAR) || 'k' ELSE format('{{:,}}', CAST(round_even({v}, 0) AS BIGINT)) END"


@query("fn27_format_salary", f"""
WITH {_PAID} SELECT id, CASE WHEN low IS NULL THEN '' ELSE CASE WHEN currency = '' THEN '' ELSE currency || ' ' END || CASE WHEN low = high THEN {_SHORT('low')} ELSE {_SHORT('low')} || '–' || {_SHORT('high')} END
  || CASE cadence WHEN 'monthly' THEN '/mo' WHEN 'yearly' THEN '/yr (~USD ' || {_EACH('(low / 12.0::DOUBLE)')} || '/mo)' ELSE '' END END AS display FROM s""")
def format_salary(spark, d):
    p = [F.col(f"p.{c}") for c in ("currency", "min", "max", "interval")]
    return _paid(spark, d).select("id", salary.format_salary(*p, *[salary.to_monthly(c, p[3]) for c in p[1:3]]).alias("display"))


_PAGE_TITLE = "CASE WHEN id % 4 = 3 THEN title WHEN id % 3 = 0 THEN {0}title || ' Job in Cebu City - Jobstreet' WHEN id % 3 = 1 THEN company || ' hiring ' || title || ' in Cebu City' ELSE title || ' in Cebu City - ' || company END"
_SHAPES = [(r"^(.+?)\s+job in\s+(.+?)\s*-\s*jobstreet\s*$", 1, None, 2), (r"^(.+?)\s+hiring\s+(.+?)\s+in\s+(.+?)\s*$", 2, 1, 3), (r"^(.+?)\s+in\s+(.+?)\s*-\s*(.+?)\s*$", 1, 3, 2)]
_PART = lambda i: "CASE " + " ".join(f"WHEN regexp_matches(t, '(?i){s[0]}') THEN " + (f"trim(regexp_extract(t, '(?i){s[0]}', {s[i]}))" if s[i] else "''") for s in _SHAPES) + " ELSE '' END"


@query("fn29_page_titles", f"""
WITH {JOBS_SQL}, a AS (SELECT id, trim({_PAGE_TITLE.format('')}) AS t FROM jobs) SELECT id, {_PART(1)} AS title, {_PART(2)} AS company, {_PART(3)} AS location FROM a""")
def page_titles(spark, d):
    return b.jobs(spark, d).select("id", text.split_page_title(F.expr(_PAGE_TITLE.format(""))).alias("t")).select("id", "t.*")


@query("fn30_is_wall", "SELECT page_id, regexp_matches(lower(left(coalesce(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '') || chr(10) || coalesce(html, ''), 20000)), '" + "|".join(text.WALL_MARKS) + "') AS wall FROM pages")
def is_wall(spark, d):
    return b.table(spark, d, "pages").select("page_id", text.is_wall(F.col("html"), F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)).alias("wall"))


@query("fn34_verdicts", "SELECT conv_id, turn, CAST(turn AS INTEGER) AS i, CASE WHEN turn % 2 = 0 THEN 'SKIP' ELSE 'KEEP' END AS decision FROM conversations WHERE turn < 5")
def verdicts(spark, d):
    reply = F.expr("concat('Sure: [{\"i\": ', turn, ', \"decision\": \"', CASE WHEN turn % 2 = 0 THEN 'skip' ELSE 'Keep' END, '\"}, {\"i\": 7, \"decision\": \"KEEP\"}, {\"i\": 1, \"decision\": \"maybe\"}] done')")
    return b.table(spark, d, "conversations").select("conv_id", "turn", F.inline(text.parse_verdicts(reply, 5)))


@query("prj1_jobs_rows", f"""
WITH {RAW_SQL} SELECT seq, trim(coalesce(title, '')) AS title, company, {URL('job_url')} AS url, nullif(location, '') AS location, CASE seq % 8 WHEN 0 THEN 'PHP 30k/mo' WHEN 1 THEN 'USD 42k/yr (~USD 3,500/mo)' WHEN 2 THEN 'PHP 500/day'
  WHEN 3 THEN 'USD 1500k/yr (~USD 125k/mo)' WHEN 4 THEN '' END AS display,
  CASE seq % 8 WHEN 0 THEN 30000 WHEN 1 THEN 3500 WHEN 2 THEN 11000 WHEN 3 THEN 125000 END::DOUBLE AS monthly_min, CASE seq % 8 WHEN 0 THEN 30000 WHEN 1 THEN 3500 WHEN 2 THEN 11000 WHEN 3 THEN 125000 END::DOUBLE AS monthly_max,
  CASE seq % 8 WHEN 0 THEN 'monthly' WHEN 1 THEN 'yearly' WHEN 2 THEN 'daily' WHEN 3 THEN 'yearly' ELSE 'unknown' END AS cadence FROM raw""")
def jobs_rows(spark, d):
    """Amounts a month and cadence of every posting; the display where the posting tells its pay, else it is in prj2_normalize_salary."""
    rows = projections.to_jobs_rows(b.spread(b.raw_postings(spark, d)), AS_OF)
    return rows.select("seq", "title", "company", "url", "location", F.when(F.col("seq") % 8 <= 4, F.col("salary_display")).alias("display"), F.col("salary_monthly_min").alias("monthly_min"), F.col("salary_monthly_max").alias("monthly_max"), F.col("salary_interval").alias("cadence"))


@query("prj2_normalize_salary")
def normalize_salary(spark, d):
    """All eight salary columns of every posting, from its text, amounts or description; held against plain loops in the tests."""
    rows = projections.normalize_salary(b.spread(b.raw_postings(spark, d)))
    return rows.select("seq", *projections.SALARY)


@query("prj4_resolve_fields", f"""
WITH {RAW_SQL}, r AS (SELECT seq, trim(CASE WHEN seq % 2 = 0 THEN 'Typed' ELSE coalesce(title, '') END) AS t, company, location FROM raw)
SELECT seq, CASE WHEN t = '' THEN 'Untitled (manual)' ELSE t END AS title, company, location FROM r""")
def resolve_fields(spark, d):
    raw = b.raw_postings(spark, d)
    typed = raw.where("seq % 2 = 0").select("seq", F.lit(" Typed ").alias("title"), F.lit(None).cast("string").alias("company"), F.lit("").alias("location"))
    return projections.resolve_fields(raw, typed, "seq")


@query("flt8_first_term", """
SELECT doc_id, CASE WHEN contains(lower(text), 'the') OR contains(lower(text), 'ing') THEN 'the ing' WHEN contains(lower(text), 'tion') THEN 'a tion' END AS term FROM documents""")
def first_term(spark, d):
    return b.table(spark, d, "documents").select("doc_id", gates.first_term(F.col("text"), ["of", "the ing", "a tion"]).alias("term"))


@query("flt17_held_view", f"WITH {RAW_SQL}, {HELD_SQL} SELECT id, filter_reason FROM held WHERE NOT restored AND starts_with(filter_reason, 'location:') AND contains(lower(company), '1')")
def held_view(spark, d):
    return reports.held_view(b.held(spark, d), reason="location:", query="company:1").select("id", "filter_reason")


@query("flt18_needs_backfill", f"WITH {JOBS_SQL} SELECT id FROM jobs WHERE coalesce(description, '') = '' AND source <> 'src3' ORDER BY id LIMIT 100")
def needs_backfill(spark, d):
    return reports.needs_backfill(b.jobs(spark, d).withColumn("salary_display", F.lit("x")), skip=["src3"]).select("id")


@query("flt19_drop_repeats", f"WITH {RAW_SQL}, {HELD_SQL} SELECT id FROM held WHERE NOT starts_with(filter_reason, 'repeat-seen:')")
def drop_repeats(spark, d):
    return merge.drop_repeats(b.held(spark, d)).select("id")


@query("jon1_flag_known", f"WITH {RAW_SQL}, {JOBS_SQL} SELECT seq, {URL('job_url')} IN (SELECT {URL('url')} FROM jobs) AS known FROM raw")
def flag_known(spark, d):
    return dedupe.flag_known(b.raw_postings(spark, d), b.jobs(spark, d)).select("seq", "known")


@query("jon4_already_judged", f"""
WITH {JOBS_SQL}, {_LABELLED}, l AS (SELECT *, {FP('title', 'company')} AS fp, row_number() OVER (PARTITION BY {FP('title', 'company')} ORDER BY status_updated_at DESC, id DESC) AS n FROM lab)
SELECT j.id, l.status AS judged FROM jobs j LEFT JOIN l ON l.n = 1 AND l.fp <> '' AND l.fp = {FP('j.title', 'j.company')}""")
def already_judged(spark, d):
    jobs = b.jobs(spark, d)
    return mining.already_judged(jobs, mining.labelled(jobs)).select("id", F.col("judged.status").alias("judged"))


_RULES = [("keyword", "widget"), ("keyword", "cold"), ("phrase", "red bolt"), ("phrase", "ll ri"), ("location", "cebu"), ("location", "davao"), ("company", "customer#000000007 inc"), ("skill", "Docker")]


def _rules(spark):
    return spark.createDataFrame(_RULES, "kind string, value string")


@query("jon5_token_hits", f"""
WITH {JOBS_SQL}, t AS (SELECT id, unnest({TOKENS('title')}) AS w FROM jobs) SELECT id, string_agg(w, ',' ORDER BY w) AS hits FROM t WHERE w IN ('widget', 'cold') GROUP BY id""")
def token_hits(spark, d):
    return mining.token_hits(b.jobs(spark, d), _rules(spark), "keyword", "id").select("id", F.array_join("hits", ",").alias("hits"))


@query("jon6_phrase_hits", f"""
WITH {JOBS_SQL}, t AS (SELECT id, {TITLE('title')} AS t FROM jobs) SELECT id, array_to_string(list_filter(['ll ri', 'red bolt'], lambda p: contains(t, p)), '|') AS hits FROM t""")
def phrase_hits(spark, d):
    return mining.phrase_hits(b.jobs(spark, d), _rules(spark)).select("id", F.array_join("phrase_hits", "|").alias("hits"))


@query("jon7_skill_hits", f"SELECT doc_id, array_to_string({_named('coalesce(text, chr(32))')}, ',') AS skills FROM documents")
def skill_hits(spark, d):
    return b.table(spark, d, "documents").select("doc_id", F.array_join(scoring.skill_hits(F.col("text")), ",").alias("skills"))


@query("min2_locations", f"WITH {JOBS_SQL}, {_LABELLED}, v AS (SELECT label, unnest({PLACES('location')}) AS value FROM lab WHERE NOT {_INSIDE}) SELECT value, count(*) AS hits, count(*) FILTER (label = 'BAD') AS bad_hits FROM v GROUP BY 1 HAVING count(*) >= 5 AND count(*) FILTER (label = 'BAD') >= 0.5::DOUBLE * count(*)")
def locations(spark, d):
    return mining.mine_locations(mining.labelled(b.jobs(spark, d)), 5, 0.5)


@query("min3_teachable", f"WITH {JOBS_SQL}, {_LABELLED} SELECT id, label FROM lab WHERE NOT (label = 'BAD' AND coalesce(NOT {_INSIDE} AND list_has_any({PLACES('location')}, ['cebu', 'davao']), false))")
def teachable(spark, d):
    bad = _rules(spark).where("kind = 'location'")
    return mining.teachable(mining.labelled(b.jobs(spark, d)), bad).select("id", "label")


@query("min7_skills", f"WITH {JOBS_SQL}, {_LABELLED}, v AS (SELECT label, unnest({_named(_BOTH)}) AS value FROM lab) SELECT value, count(*) AS hits, count(*) FILTER (label = 'BAD') AS bad_hits FROM v WHERE value <> 'Python' GROUP BY 1 HAVING count(*) >= 5 AND count(*) FILTER (label = 'BAD') >= 0.3::DOUBLE * count(*)")
def skill_rules(spark, d):
    return mining.mine_skills(mining.labelled(b.jobs(spark, d)), ["Python"], 5, 0.3)


@query("min8_enough_labels", f"WITH {JOBS_SQL}, {_LABELLED} SELECT count(*) AS n, count(*) FILTER (label = 'BAD') AS n_bad, count(*) >= 10 AND count(*) FILTER (label = 'BAD') > 0 AS enough FROM lab")
def enough_labels(spark, d):
    return mining.enough_labels(mining.labelled(b.jobs(spark, d)), 10)


@query("min9_apply_rules", f"""
WITH {JOBS_SQL}, {_LABELLED}, q AS (SELECT *, {FP('title', 'company')} AS fp FROM lab), l AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY status_updated_at DESC, id DESC) AS n FROM q),
r AS (SELECT j.id, j.title, j.company, j.description, j.location, l.status AS js, l.company AS jc, l.title AS jt FROM jobs j LEFT JOIN l ON l.n = 1 AND l.fp <> '' AND l.fp = {FP('j.title', 'j.company')}),
h AS (SELECT *, CASE WHEN NOT {_INSIDE} THEN list_sort(list_filter({PLACES('location')}, lambda w: w IN ('cebu', 'davao'))) ELSE [] END AS lh, list_sort(list_filter({TOKENS('title')}, lambda w: w IN ('widget', 'cold'))) AS kh,
  list_filter(['ll ri', 'red bolt'], lambda p: contains({TITLE('title')}, p)) AS ph FROM r)
SELECT id, CASE WHEN js IS NOT NULL THEN 'repeat-seen:' || lower(js) || ':' || left(jc, 40) || '|' || left(jt, 40) WHEN len(lh) > 0 THEN 'location:' || array_to_string(lh, ',') WHEN len(kh) > 0 THEN 'title-keyword:' || array_to_string(kh, ',')
  WHEN len(ph) > 0 THEN 'title-phrase:' || array_to_string(ph, '|') WHEN lower(trim(company)) = 'customer#000000007 inc' THEN 'company:' || lower(trim(company)) WHEN contains(lower({_BOTH}), 'docker') THEN 'desc-skill:Docker' END AS filter_reason FROM h""")
def apply_rules(spark, d):
    jobs = b.jobs(spark, d)
    return mining.apply_rules(jobs, _rules(spark), mining.labelled(jobs)).select("id", "filter_reason")


_OWN = "['Python', 'SQL']"


@query("sco1_score", f"""
WITH {JOBS_SQL}, s AS (SELECT id, {_named(_BOTH)} AS k, CASE WHEN lower(trim(company)) = 'customer#000000007 inc' THEN 25 ELSE 0 END AS c, len(list_filter({TOKENS('title')}, lambda w: w IN ('widget', 'cold'))) AS w,
  len(list_filter(['ll ri', 'red bolt'], lambda p: contains({TITLE('title')}, p))) AS p FROM jobs), m AS (SELECT *, len(list_intersect(k, {_OWN})) AS good FROM s)
SELECT id, CAST(greatest(0, least(100, 50 + least(5 * good, 30) - least(4 * (len(k) - good), 20) - c - CASE WHEN w > 0 THEN least(w * 10, 20) WHEN p > 0 THEN 10 ELSE 0 END)) AS INTEGER) AS score FROM m""")
def score(spark, d):
    jobs = b.jobs(spark, d).withColumn("profile_id", F.lit("p"))
    return scoring.score(jobs, _profiles(spark), _rules(spark)).select("id", "score")


def _profiles(spark):
    kind = "profile_id string, summary struct<variants:array<string>>, skills array<struct<group:string,items:array<string>>>, experience array<struct<title:string,bullets:array<string>>>, soft_skills array<string>"
    return spark.createDataFrame([("p", (["Builds things"],), [("Core", ["Python", "SQL", "Sales"])], [("Clerk", ["Filed papers"])], ["Calm"])], kind)


@query("sco5_skill_gap", f"""
WITH {JOBS_SQL}, s AS (SELECT id, {_named("coalesce(description, '')")} AS k, list_filter({TOKENS('description')}, lambda w: length(w) >= 3) AS w FROM jobs)
SELECT id, array_to_string(list_filter(k, lambda x: x IN ('Python', 'SQL')), ',') AS matched, array_to_string(list_filter(k, lambda x: x NOT IN ('Python', 'SQL')), ',') AS suggested_add,
  array_to_string(list_filter(['Python', 'SQL', 'Sales'], lambda x: NOT list_contains(w, lower(x))), ',') AS suggested_remove FROM s""")
def skill_gap(spark, d):
    found = scoring.skill_gap(b.jobs(spark, d).withColumn("profile_id", F.lit("p")), _profiles(spark))
    return found.select("id", *[F.array_join(c, ",").alias(c) for c in ("matched", "suggested_add", "suggested_remove")])


@query("agg7_term_audit", f"WITH {RAW_SQL} SELECT site AS term, count(*) AS raw, count(*) FILTER (seq % 3 = 0) AS kept FROM raw WHERE site IS NOT NULL GROUP BY 1")
def term_audit(spark, d):
    raw = b.raw_postings(spark, d).where("site is not null")
    return reports.term_audit(raw, raw.where("seq % 3 = 0"), "site")


@query("agg8_top_reasons", f"""
WITH {RAW_SQL}, {HELD_SQL}, c AS (SELECT CASE WHEN starts_with(filter_reason, 'ai:') THEN 'ai' WHEN starts_with(filter_reason, 'exp-gap:') THEN 'sift' ELSE 'rule' END AS kind, CASE WHEN starts_with(filter_reason, 'ai:') THEN 'ai' ELSE left(filter_reason, 60) END AS reason, count(*) AS n FROM held GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, reason) AS i FROM c) SELECT kind, reason, n FROM r WHERE i <= 5""")
def top_reasons(spark, d):
    return reports.top_reasons(b.held(spark, d))


@query("agg14_facets", f"WITH {RAW_SQL}, {HELD_SQL} SELECT filter_reason, count(*) AS n FROM held GROUP BY 1")
def facets(spark, d):
    return reports.facets(b.held(spark, d), "filter_reason")


@query("srt5_newest_decisions", f"WITH {JOBS_SQL}, {_LABELLED} SELECT id, label FROM lab ORDER BY status_updated_at DESC, id DESC LIMIT 2000")
def newest_decisions(spark, d):
    return mining.labelled(b.jobs(spark, d), 2000).select("id", "label")


@query("win7_chunks", f"WITH {RAW_SQL}, r AS (SELECT seq, row_number() OVER (ORDER BY seq) - 1 AS n FROM raw) SELECT seq, CASE WHEN n < 120 THEN CAST(n // 40 AS INTEGER) END AS chunk, CASE WHEN n < 120 THEN CAST(n % 40 AS INTEGER) END AS i FROM r")
def chunks(spark, d):
    return mining.assign_chunks(b.raw_postings(spark, d), 40, 3, ["seq"]).select("seq", "chunk", "i")


_FIRMS = "fz AS (SELECT id, status, title || CASE id % 3 WHEN 0 THEN ' lead' WHEN 1 THEN ' small lead night' ELSE '' END AS title, 'Firm ' || CAST(id % 150 AS VARCHAR) AS company FROM jobs)"
_CLASSES = f"{_FIRMS}, k AS (SELECT {COMPANY('company')} AS c, {NORM('title')} AS t, min(id) AS id, count(*) AS size FROM fz WHERE status NOT IN ('DUPLICATE', 'EXPIRED') GROUP BY 1, 2), w AS (SELECT *, list_distinct({WORDS('t')}) AS ws FROM k WHERE c <> '' AND t <> '')"
_PAIRS = "p AS (SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, len(list_intersect(x.ws, y.ws)) AS n, least(len(x.ws), len(y.ws)) AS low, greatest(len(x.ws), len(y.ws)) AS high FROM w x JOIN w y ON x.c = y.c AND x.id < y.id), e AS (SELECT a, b, n = low AS subset FROM p WHERE n = low OR n >= 0.6::DOUBLE * high)"


def _firms(spark, d):
    jobs = b.jobs(spark, d)
    return jobs.withColumn("title", F.expr("concat(title, CASE id % 3 WHEN 0 THEN ' lead' WHEN 1 THEN ' small lead night' ELSE '' END)")).withColumn("company", F.expr("concat('Firm ', id % 150)"))


@query("jon11_fuzzy_pairs", f"WITH {JOBS_SQL}, {_CLASSES}, {_PAIRS} SELECT * FROM e")
def fuzzy_pairs(spark, d):
    return dedupe.fuzzy_pairs(_firms(spark, d))


@query("dup2_fuzzy_groups", f"""
WITH RECURSIVE {JOBS_SQL}, {_CLASSES}, {_PAIRS}, u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS id, a AS reach FROM u UNION SELECT r.id, u.b FROM r JOIN u ON u.a = r.reach),
m AS (SELECT id, min(reach) AS g FROM r GROUP BY id), l AS (SELECT g, bool_and(subset) AS likely FROM e JOIN m ON m.id = e.a GROUP BY g), s AS (SELECT w.c, w.t, m.g, sum(w.size) OVER (PARTITION BY m.g) AS size FROM w JOIN m USING (id))
SELECT j.id, s.g AS group_id, CAST(s.size AS BIGINT) AS size, likely FROM fz j JOIN s ON s.c = {COMPANY('j.company')} AND s.t = {NORM('j.title')} JOIN l ON l.g = s.g WHERE j.status NOT IN ('DUPLICATE', 'EXPIRED')""")
def fuzzy_groups(spark, d):
    return dedupe.fuzzy_groups(_firms(spark, d))


_KEYED = f"y AS (SELECT *, {COMPANY('company')} || '|' || {NORM('title')} AS key, status IN ('DUPLICATE', 'EXPIRED') AS gone, CASE status WHEN 'APPLIED' THEN 0 WHEN 'REVIEWED' THEN 1 WHEN 'NEW' THEN 2 ELSE 3 END AS rank FROM jobs), z AS (SELECT *, row_number() OVER (PARTITION BY key, gone ORDER BY rank, scraped_at NULLS LAST, id) AS n FROM y)"


@query("dup3_mark_duplicates", f"WITH {JOBS_SQL}, {_KEYED} SELECT id, CASE WHEN NOT gone AND n > 1 THEN 'DUPLICATE' ELSE status END AS status, CASE WHEN NOT gone AND n > 1 THEN NULL ELSE stage END AS stage FROM z")
def mark_duplicates(spark, d):
    return merge.mark_duplicates(b.jobs(spark, d), AS_OF)[0].select("id", "status", "stage")


@query("agg11_dupe_summary", f"WITH {JOBS_SQL}, {_KEYED}, g AS (SELECT key, count(*) AS size FROM z WHERE NOT gone GROUP BY key HAVING count(*) > 1) SELECT count(*) AS groups, CAST(coalesce(sum(size), 0) AS BIGINT) AS rows, CAST(coalesce(sum(size - 1), 0) AS BIGINT) AS surplus FROM g")
def dupe_summary(spark, d):
    return dedupe.dupe_summary(dedupe.exact_groups(b.jobs(spark, d)))


_BATCH = f"""bt AS (SELECT seq, 'Junior Developer' AS title, 'Acme ' || CAST(seq AS VARCHAR) AS company, 'https://jobs.example.com/view/' || CAST(seq * 7 AS VARCHAR) AS url FROM raw),
u AS (SELECT {URL('url')} AS k, min(id) AS id FROM jobs GROUP BY 1), f AS (SELECT bt.*, u.id AS job_id FROM bt LEFT JOIN u ON u.k = bt.url)"""


def _merged(spark, d):
    raw = b.raw_postings(spark, d)
    batch = raw.select("seq", F.lit("Junior Developer").alias("title"), F.concat(F.lit("Acme "), F.col("seq")).alias("company"), F.concat(F.lit("https://jobs.example.com/view/"), F.col("seq") * 7).alias("url"), F.lit("NEW").alias("status"), F.lit("fresh text").alias("description"))
    return merge.merge_postings(b.jobs(spark, d), batch, AS_OF)


@query("mut4_merge_postings", f"""
WITH {RAW_SQL}, {JOBS_SQL}, {_BATCH}, o AS (SELECT j.url, j.company, CASE WHEN h.job_id IS NULL THEN j.last_seen ELSE TIMESTAMP '{AS_OF}' END AS last_seen,
  CASE WHEN h.job_id IS NOT NULL AND (coalesce(j.description, '') = '' OR j.description = '3 days ago') THEN 'fresh text' ELSE j.description END AS description FROM jobs j LEFT JOIN (SELECT DISTINCT job_id FROM f WHERE job_id IS NOT NULL) h ON h.job_id = j.id)
SELECT * FROM o UNION ALL SELECT url, company, NULL, 'fresh text' FROM f WHERE job_id IS NULL""")
def merge_postings(spark, d):
    return _merged(spark, d)[0].select("url", "company", "last_seen", "description")


@query("mut4_merge_counts", f"WITH {RAW_SQL}, {JOBS_SQL}, {_BATCH} SELECT CASE WHEN job_id IS NULL THEN 'new' ELSE 'url' END AS tier, count(*) AS n FROM f GROUP BY 1")
def merge_counts(spark, d):
    return _merged(spark, d)[1]


@query("mut5_hold", f"""
WITH {RAW_SQL}, {HELD_SQL}, {JOBS_SQL}, n AS (SELECT url, company, row_number() OVER (PARTITION BY url ORDER BY seq DESC) AS i FROM (SELECT seq, company, 'https://held.example.com/' || CAST(seq % 900 AS VARCHAR) AS url FROM raw WHERE seq % 3 <> 0))
SELECT url, company, 'location:cebu' AS filter_reason, false AS restored FROM n WHERE i = 1
UNION ALL SELECT url, company, filter_reason, restored FROM held WHERE url NOT IN (SELECT url FROM n)""")
def hold(spark, d):
    rows = b.raw_postings(spark, d).select("seq", "title", "company", F.concat(F.lit("https://held.example.com/"), F.col("seq") % 900).alias("url"), F.when(F.col("seq") % 3 == 0, "repeat-seen:skip:x").otherwise("location:cebu").alias("filter_reason"))
    return merge.hold(b.held(spark, d), b.jobs(spark, d), rows, AS_OF).select("url", "company", "filter_reason", "restored")


@query("mut6_restore", f"WITH {RAW_SQL}, {HELD_SQL} SELECT id, 'NEW' AS job_status FROM held WHERE id % 2 = 0")
def restore(spark, d):
    held = b.held(spark, d)
    return merge.restore(held, b.jobs(spark, d), held.where("id % 2 = 0").select("id"), AS_OF)[2].select("id", "job_status")


@query("mut7_unrestore", f"WITH {RAW_SQL}, {HELD_SQL} SELECT id, restored AND id % 2 <> 0 AS restored FROM held")
def unrestore(spark, d):
    held = b.held(spark, d)
    return merge.unrestore(held, b.jobs(spark, d), held.where("id % 2 = 0").select("id"))[0].select("id", "restored")


@query("mut9_apply_stage", f"""
WITH {JOBS_SQL} SELECT id, CASE WHEN id % 3 = 0 THEN 'APPLIED' ELSE status END AS status, CASE WHEN id % 3 = 0 THEN 'OFFER' ELSE stage END AS stage,
  CASE WHEN id % 3 = 0 AND status <> 'APPLIED' THEN TIMESTAMP '{AS_OF}' ELSE applied_at END AS applied_at FROM jobs""")
def apply_stage(spark, d):
    jobs = b.jobs(spark, d)
    return merge.apply_stage(jobs, jobs.where("id % 3 = 0").select(F.col("id").alias("job_id"), F.lit("OFFER").alias("new_stage")), AS_OF)[0].select("id", "status", "stage", "applied_at")


@query("mut10_edit_rejects", f"""
WITH {JOBS_SQL}, e AS (SELECT id, title, CASE WHEN id % 10 = 0 THEN ' ' ELSE 'Customer#000000007 Inc' END AS c FROM jobs WHERE id % 5 = 0), j AS (SELECT id, {FP('title', 'company')} AS fp FROM jobs)
SELECT id AS job_id, CASE WHEN trim(c) = '' THEN 'blank' ELSE 'collision' END AS reason FROM e WHERE trim(c) = '' OR ({FP('title', 'c')} <> '' AND EXISTS (SELECT 1 FROM j WHERE j.fp = {FP('e.title', 'e.c')} AND j.id <> e.id))""")
def edit_rejects(spark, d):
    jobs = b.jobs(spark, d)
    edits = jobs.where("id % 5 = 0").select(F.col("id").alias("job_id"), F.when(F.col("id") % 10 == 0, " ").otherwise("Customer#000000007 Inc").alias("company"))
    return merge.apply_edits(jobs, edits)[1]
