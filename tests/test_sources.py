"""Payload readers, pages, outputs and streams on small landed files."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import merge, projections
from millrace.sources import pages, payloads
from millrace.sources.buckets import PER_BATCH, JobBuckets
from millrace.streaming import ingest


def land(folder, name, value):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(json.dumps(value))
    return str(folder)


def test_board_payloads(spark, tmp_path):
    lists = land(tmp_path / "a", "acme.json", {"jobs": [{"id": 1, "title": " Dev ", "absolute_url": "https://x/1", "updated_at": "2026-01-02T03:00:00Z", "location": {"name": "Manila"}}, {"id": 2, "title": "QA"}]})
    details = land(tmp_path / "b", "d.json", {"board": "acme", "id": "1", "content": "&lt;p&gt;Hi &amp;amp; bye&lt;/p&gt;", "created_at": "2026-01-01T00:00:00Z"})
    one, two = payloads.read_board_payloads(spark, lists, details).orderBy("title").collect()
    assert (one["title"], one["company"], one["location"], one["description"], one["matched_search_term"], str(one["date_posted"])) == ("Dev", "acme", "Manila", "Hi & bye", "board:acme", "2026-01-01 00:00:00")
    assert (two["title"], two["date_posted"]) == ("QA", None)


def test_arrays_lists_and_feed(spark, tmp_path):
    path = land(tmp_path / "l", "zen.json", [{"text": "Dev", "createdAt": 86400000, "hostedUrl": "", "applyUrl": "https://y", "descriptionPlain": "", "description": "<b>Go</b>", "categories": {"location": "Cebu"}}])
    row = payloads.read_posting_array(spark, path).first()
    assert (row["job_url"], row["description"], row["location"], str(row["date_posted"]), row["company"]) == ("https://y", "Go", "Cebu", "1970-01-02 00:00:00", "zen")
    path = land(tmp_path / "h", "k.json", {"jobs": [{"title": "A", "isListed": False}, {"title": "B", "isRemote": True}, {"title": "C", "isListed": True, "location": "Pasig"}]})
    assert [(r["title"], r["location"]) for r in payloads.read_listed_board(spark, path).orderBy("title").collect()] == [("B", "Remote"), ("C", "Pasig")]
    path = land(tmp_path / "f", "feed.json", [{"legal": "notice"}, {"position": "Python Dev", "company": "X", "tags": ["web"], "salary_min": 60000, "salary_max": 90000, "url": "https://z"}, {"position": "Nurse", "company": "Y"}])
    rows = payloads.read_feed(spark, path, ["python developer", "web"]).collect()
    assert [(r["title"], r["matched_search_term"], r["salary_raw"]) for r in rows] == [("Python Dev", "python developer", "$60,000 - $90,000 per year")]
    assert projections.normalize_salary(payloads.read_feed(spark, path, ["web"])).first()["salary_max"] == 90000


def test_amounts_and_outputs(spark, tmp_path):
    df = spark.createDataFrame([("Dev", "Acme", 90000.0, 60000.0, "yearly", "usd", 'two\nlines "quoted"')], "title string, company string, min_amount double, max_amount double, interval string, currency string, description string")
    payloads.write_raw(df, f"{tmp_path}/raw")
    back = payloads.read_amount_frame(spark, f"{tmp_path}/raw", "csv")
    assert back.first()["description"] == 'two\nlines "quoted"'
    row = projections.normalize_salary(back).first()
    assert (row["salary_min"], row["salary_max"], row["salary_display"]) == (60000, 90000, "USD 60k–90k/yr (~USD 5k–7,500/mo)")
    runs = spark.createDataFrame([(1, 5)], "id bigint, new_jobs_count int")
    payloads.append_run(runs, f"{tmp_path}/runs")
    payloads.append_run(runs, f"{tmp_path}/runs")
    assert ingest.stream_runs(spark, f"{tmp_path}/runs").isStreaming and spark.read.json(f"{tmp_path}/runs").count() == 2


LD = '<script type="application/ld+json">%s</script>'
POSTING = {"@type": "JobPosting", "title": "Dev", "datePosted": "2026-01-05T00:00:00Z", "hiringOrganization": {"name": "Acme"}, "jobLocation": {"address": {"addressLocality": "Taguig"}}, "baseSalary": {"currency": "PHP", "value": {"minValue": 30000, "maxValue": 40000, "unitText": "MONTH"}}}


def test_pages(spark):
    html = [
        ("https://ph.trabajo.org/job-1/", "<title>Junior Dev in Taguig - Acme Corp</title><script>x</script><h1>Junior Dev</h1><p>Pay ₱30,000 - ₱40,000 per month</p>"),
        ("https://e.com/2", '<meta property="og:title" content="Solutions Architect Job in Taguig City, Metro Manila - Jobstreet"><h1>x</h1>'), ("https://e.com/3", "<title>Just a moment...</title>"), ("https://e.com/4", None),
    ]
    rows = {r["url"]: r for r in pages.extract_pages(spark.createDataFrame(html, "url string, html string")).collect()}
    r = rows["https://ph.trabajo.org/job-1"]
    assert (r["title"], r["company"], r["location"], r["wall"], "30,000" in r["salary_raw"], "x" in r["description"]) == ("Junior Dev", "Acme Corp", "Taguig", False, True, False)
    assert (rows["https://e.com/2"]["title"], rows["https://e.com/2"]["location"]) == ("Solutions Architect", "Taguig City, Metro Manila")
    assert rows["https://e.com/3"]["wall"] and rows["https://e.com/4"]["title"] == ""


def test_jsonld_in_each_shape(spark):
    shapes = [("a", LD % json.dumps(POSTING)), ("b", LD % json.dumps([{"@type": "WebPage"}, POSTING])), ("c", LD % json.dumps({"@graph": [POSTING]})), ("d", LD % "{broken"), ("e", None)]
    rows = pages.extract_jsonld(spark.createDataFrame(shapes, "url string, html string")).orderBy("url").collect()
    assert [r["url"] for r in rows] == ["a", "b", "c"]
    assert {(r["title"], r["company"], r["location"], str(r["date_posted"]), r["salary_raw"]) for r in rows} == {("Dev", "Acme", "Taguig", "2026-01-05", "PHP 30000 - PHP 40000 per month")}


def test_jsonld_of_pages_with_one_url(spark):
    named = lambda t: LD % json.dumps(POSTING | {"title": t})
    rows = [("a", named("One") + named("Other")), ("a", LD % "{broken" + LD % "[{}, {" + named("Two")), ("a", LD % json.dumps({"@type": "WebPage"})), (None, named("Three"))]
    got = pages.extract_jsonld(spark.createDataFrame(rows, "url string, html string")).collect()
    assert sorted((r["url"] or "", r["title"]) for r in got) == [("", "Three"), ("a", "One"), ("a", "Two")]


def test_cards(spark):
    card = '<div class="job card x"><a href="/job-9">Junior Dev</a><span>Makati City</span><span>Acme</span><span>₱20,000</span><span>Full-time</span><span>3 days ago</span></div>'
    rows = pages.extract_cards(spark.createDataFrame([("u", f"<ul>{card.replace('div', 'li')}{card.replace('div', 'li').replace('Acme', 'Beta')}</ul>"), ("v", None)], "url string, html string")).orderBy("company").collect()
    assert [(r["title"], r["job_url"], r["company"], r["location"], r["salary_raw"], r["age"]) for r in rows] == [("Junior Dev", "/job-9", c, "Makati City", "₱20,000", "3 days ago") for c in ("Acme", "Beta")]


def test_marked_places_pay_and_companies(spark):
    html = [
        ("https://ph.jobstreet.com/job/1", "<meta property='og:title' content='Dev - Acme Corp | Jobstreet'><div data-automation=jobSalary>₱30,000 – ₱40,000 a month</div><span class='x job-location'>Cebu <b>City</b></span><article>Body <p>text</p></article> more"),
        ("https://www.linkedin.com/jobs/view/2", "<meta property='og:site_name' content='LinkedIn'><title>x</title><h1>Dev at Beta Inc — Manila</h1><main>Main text</main>"),
        ("https://e.com/3", "<meta name='og:site_name' content='Gamma'><h1>Dev - Night</h1><meta property='og:description' content='told'>"), ("https://e.com/4", "<h1>Ops @ Delta | Jobs</h1><p>We pay ₱30,000 per month.</p>"),
    ]
    got = {r["url"][-1]: r for r in pages.extract_pages(spark.createDataFrame(html, "url string, html string")).collect()}
    assert {i: (r["title"], r["company"], r["location"], r["description"]) for i, r in got.items()} == {
        "1": ("Dev", "Acme Corp", "Cebu City", "Body text"), "2": ("Dev", "Beta Inc", "", "Main text"), "3": ("Dev - Night", "Gamma", "", "told"), "4": ("Ops @ Delta", "Jobs", "", "Ops @ Delta | Jobs We pay ₱30,000 per month."),
    }
    assert got["1"]["salary_raw"] == "₱30,000 – ₱40,000 a month" and "30,000" in got["4"]["salary_raw"]


def test_cards_of_job_lists(spark):
    card = '<li class="nf-job job-item" data-url="https://t/job-8?x=1#y"><h3><a>Senior Dev</a></h3><p class="text-muted"><small>2 days ago</small></p><div class="nf-job-list-info"><span>Lapu-Lapu, Visayas</span><span>Full-time</span><span>PHP 20,000</span><span>Acme</span></div><div class="nf-job-list-desc"><p class="mb-0">Writes <b>code</b></p></div></li>'
    (r,) = pages.extract_cards(spark.createDataFrame([("u", f"<ul>{card}</ul>")], "url string, html string")).collect()
    assert tuple(r) == ("u", "Senior Dev", "https://t/job-8", "Acme", "Lapu-Lapu, Visayas", "PHP 20,000", "2 days ago", "Writes code")


def test_cards_in_any_shape(spark):
    shapes = [
        '<div class="card"><h3><a href="/1?x">One</a></h3><span>Acme</span><span>Cebu</span></div><div class="card"><a href="/2">Two</a><div><span>Beta</span></div></div>',
        "<ul><li class='job-item x'><a href='/3'>Three</a><ul><li>in<li>side</ul><span>Gamma</span><br><span>Pasig City</span><img src=x><span>&#8369;5</span></li><li class=card><a>Four</a><span>Makati</span><span>Acme, Inc.</span></ul>",
        '<div class="card list"><ul><li class="job-item"><a href="/5">Five</a><span>A, B</span><span>Taguig</span><li class="job-item"><a href="/6">Six</a><script>var a="<span>x</span>";</script></ul></div>',
        '<div class="cardinal job-items"><a href="/7">No</a></div><p class="card"/><article class="card">a</p><a href="/8">Ei<b>ght</b></a>',
        None, "", "card <",
    ]
    df = spark.createDataFrame([(str(i), x) for i, x in enumerate(shapes)], "url string, html string")
    got = sorted(tuple(r)[:5] for r in pages.extract_cards(df).collect())
    assert got == [
        ("0", "One", "/1", "Acme", "Cebu"), ("0", "Two", "/2", "Beta", ""), ("1", "Four", "", "Acme, Inc.", "Makati"), ("1", "Three", "/3", "Gamma", "Pasig City"), ("2", "Five", "/5", "A, B", "Taguig"),
        ("2", "Six", "/6", "", ""), ("3", "", "", "", ""), ("3", "Ei ght", "/8", "", ""),
    ]


def test_nested_lists_stay_in_their_card(spark):
    def block(depth, at):
        inner = "".join(f"<ul><li>{block(depth - 1, f'{at}{i}')}</li></ul>" for i in range(2)) if depth else ""
        return f"<div><span>s{at}</span>{inner}</div>"

    html = "".join(f"<li class=card>{block(d, d)}<a href='/{d}'>T{d}</a></li>" for d in range(5))
    got = [tuple(r)[1:4] for r in pages.extract_cards(spark.createDataFrame([("u", html)], "url string, html string")).collect()]
    assert got == [(f"T{d}", f"/{d}", f"s{d}") for d in range(5)]


JOBS = "id bigint, source string, title string, company string, url string, location string, description string, status string, stage string, scraped_at timestamp, last_seen timestamp, status_updated_at timestamp, applied_at timestamp, score int, salary_display string"


def test_ingest_twice_adds_nothing(spark, tmp_path):
    at = "2026-01-31"
    store = JobBuckets(spark, f"file://{tmp_path}/jobs", spark.createDataFrame([], JOBS).schema, buckets=4)
    raw = spark.range(40).selectExpr("id AS seq", "concat('Dev ', id % 10) AS title", "'Acme' AS company", "concat('https://x/', id % 20) AS job_url", "concat('https://x/', id % 20) AS url_key", "CAST(0 AS INT) AS source_rank", "'' AS location", "'about' AS description", "'indeed' AS site")
    for part in (0, 1):
        raw.repartition(2).write.mode("append").parquet(f"{tmp_path}/raw")
        stream = ingest.read_parquet_stream(spark, f"{tmp_path}/raw", raw)
        ingest.stream_ingest(stream, store, lambda df: projections.to_jobs_rows(df, at), lambda jobs, new: merge.merge_postings(jobs, new, at)[0], f"{tmp_path}/state").awaitTermination()
        jobs = store.read()
        assert jobs.count() == 10 and jobs.agg(F.max("id")).first()[0] == PER_BATCH + 10 and jobs.select("id").distinct().count() == 10


def test_stream_dedupe(spark, tmp_path):
    raw = spark.createDataFrame([("Dev", "Acme", "a", "2026-01-01"), ("dev", "Acme Inc", "b", "2026-01-01"), ("", "", "c", "2026-01-01")], "title string, company string, url_key string, t string").withColumn("t", F.col("t").cast("timestamp"))
    raw.write.parquet(f"{tmp_path}/in")
    out = ingest.stream_dedupe(ingest.read_parquet_stream(spark, f"{tmp_path}/in", raw), "t", "1 day")
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
