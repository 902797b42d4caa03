"""Merges, mining and groups on the small cases that define them."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import dates, experience, salary, text, urls
from millrace.operators import dedupe, merge, mining, projections, reports, scoring

JOBS = "id bigint, title string, company string, url string, location string, description string, status string, stage string, scraped_at timestamp, status_updated_at timestamp, applied_at timestamp, salary_display string"
AT = "2026-01-31 00:00:00"


def jobs(spark, *rows):
    base = {"title": "Dev", "company": "Acme", "url": None, "location": None, "description": None, "status": "NEW", "stage": None, "scraped_at": None, "status_updated_at": None, "applied_at": None, "salary_display": ""}
    names = ["id", *base]
    return spark.createDataFrame([tuple({**base, "url": f"https://x/{r['id']}", **r}[n] for n in names) for r in rows], JOBS)


def one(spark, expression, value):
    return spark.range(1).select(F.lit(value).cast("string").alias("c")).select(expression(F.col("c")).alias("x")).first()["x"]


@pytest.mark.parametrize(("given", "want"), [("https://ph.indeed.com/viewjob?jk=ABC123&from=mobRdr&tk=xyz&xpse=1", "https://ph.indeed.com/viewjob?jk=ABC123"), ("https://PH.TRABAJO.ORG/job-abc/", "https://ph.trabajo.org/job-abc"), ("ph.trabajo.org/job-abc", "https://ph.trabajo.org/job-abc"), ("https://e.com:443/A?b=C&utm_source=x#y", "https://e.com/A?b=C"), ("https://ph.trabajo.org/go/1?url=%2Fjob-q%2F", "https://ph.trabajo.org/job-q"), ("https://e.com/x?q=a+b%2fc&t=%C3%A9*~&z&utm_id=1", "https://e.com/x?q=a+b%2Fc&t=%C3%A9%2A~&z="), ("https://e.com/x?Q=%zz", "https://e.com/x?Q=%25zz"), ("foo.com/?u=http://x.y/z", "foo.com/?u=http://x.y/z"), ("https://user:pw@x.com/a", "https://x.com/a"), ("https://x.com/a;b/job;jsessionid=12A?x=1", "https://x.com/a;b/job?x=1"), ("https://ph.trabajo.org/go/1?redirect=/b&url=/job-1/", "https://ph.trabajo.org/job-1"), ("https://ph.trabajo.org/go/1?redirect=/b&url=&u=https%3A%2F%2Ftrabajo.org%2Fjob-2%2F%3Fx", "https://ph.trabajo.org/job-2"), ("https://a@b@X.com:0080/", "https://x.com"), ("http://[::1]:8080/a", "http://::1:8080/a"), ("://x", "://x"), ("HTTP://X.com:8443?a", "http://x.com:8443?a="), ("", ""), (None, "")])
def test_canonical_url(spark, given, want):
    assert one(spark, urls.canonical_url, given) == want


@pytest.mark.parametrize(("given", "want"), [("Junior Dev 5 days ago … ₱42,000 - ₱60,000 Contract", (42000, 60000, "unknown")), ("1 day ago", (None, None, "unknown")), ("₱30,000 - ₱40,000 per month", (30000, 40000, "monthly")), ("salary 3-5 years experience", (None, None, "unknown")), (None, (None, None, "unknown"))])
def test_salary(spark, given, want):
    p = one(spark, salary.parse_salary, given)
    assert (p["min"], p["max"], p["interval"]) == want


def test_snippets(spark):
    assert one(spark, salary.pay_snippet, "3-5 years experience. Day 1 onboarding.") == "" and one(spark, salary.pay_snippet, None) == ""
    long = "word " * 100 + "we pay ₱30,000 per month to you " + "tail " * 100
    got = one(spark, salary.pay_snippet, long)
    assert "₱30,000 per month" in got and len(got) <= 300 and got.startswith("word ")
    asked = "Intro\nRequirements:\n- Python\n- SQL\nBenefits\nFree lunch"
    assert one(spark, text.quals_section, asked) == "Python\n- SQL" and one(spark, text.quals_section, "none") == ""
    assert one(spark, lambda c: text.desc_snippet(c, 100), "ab " * 60) == "ab " * 32 + "ab…" and one(spark, lambda c: text.desc_snippet(c, 100), "") == "—"
    assert one(spark, text.bare_company, "Acme | LinkedIn Jobs") == "Acme"
    assert one(spark, experience.seniority, "Senior Developer wanted") == "senior developer" and one(spark, experience.seniority, "Fresh graduates welcome, senior developer") is None
    assert [one(spark, dates.short_age_days, x) for x in ("26d ago", "30d+ ago", "5h ago", "")] == [26, 30, 0, None]


def test_status_and_stage(spark):
    df = jobs(spark, {"id": 1}, {"id": 2, "status": "APPLIED", "stage": "TECHNICAL"}, {"id": 3, "status": "SKIP"}, {"id": 4})
    changes = spark.createDataFrame([(1, "APPLIED"), (2, "SKIP"), (3, "SKIP")], "job_id bigint, new_status string")
    after, status, stage = merge.apply_status(df, changes, AT)
    got = {r["id"]: (r["status"], r["stage"], r["applied_at"] is not None) for r in after.collect()}
    assert got == {1: ("APPLIED", "APPLIED", True), 2: ("SKIP", None, False), 3: ("SKIP", None, False), 4: ("NEW", None, False)}
    assert sorted(r["job_id"] for r in status.collect()) == [1, 2] and sorted((r["job_id"], r["new_stage"]) for r in stage.collect()) == [(1, "APPLIED"), (2, None)]
    after, status, stage = merge.apply_stage(df, spark.createDataFrame([(4, "OFFER")], "job_id bigint, new_stage string"), AT)
    assert after.where("id = 4").select("status", "stage").first() == ("APPLIED", "OFFER") and status.count() == stage.count() == 1


def test_edits_and_external(spark):
    df = jobs(spark, {"id": 7, "title": "QA", "location": "Cebu"}, {"id": 9}, {"id": 10, "title": "Ops", "company": ""})
    edits = spark.createDataFrame([(7, "Dev", "Acme", None)], "job_id bigint, title string, company string, location string")
    assert merge.apply_edits(df, edits)[1].collect() == [(7, "collision")]
    edits = spark.createDataFrame([(7, " ", None, None), (9, "Dev", "Acme", ""), (10, None, "Beta", None)], "job_id bigint, title string, company string, location string")
    after, rejects = merge.apply_edits(df, edits)
    assert rejects.collect() == [(7, "blank")] and after.where("id = 10").first()["company"] == "Beta" and after.where("id = 7").first()["title"] == "QA"
    rows = spark.createDataFrame([(1, "https://other/1", "Dev", "Acme Inc", "Manila", "text"), (2, "https://other/2", "Untitled (manual)", "Acme", None, None), (3, "https://other/3", "New", "Co X", None, None)], "seq bigint, url string, title string, company string, location string, description string")
    after, status, stage = merge.add_external(df, rows, AT)
    assert after.count() == 5 and after.where("id = 9").select("status", "stage", "location").first() == ("APPLIED", "APPLIED", "Manila")
    assert status.count() == stage.count() == 3 and after.where("status = 'APPLIED' and stage is null").count() == 0


def test_heal_and_held(spark):
    df = jobs(spark, {"id": 1, "description": "1 day ago"}, {"id": 2, "description": "kept"})
    rows = spark.createDataFrame([("https://x/1", "full text"), ("https://x/2", "other")], "url string, description string")
    assert {r["id"]: r["description"] for r in merge.heal(df, rows).collect()} == {1: "full text", 2: "kept"}
    held = spark.createDataFrame([(1, "Dev", "Acme", "https://x/2", "r", None, False), (2, "QA", "Acme", "https://h", "r", None, False)], "id bigint, title string, company string, url string, filter_reason string, filtered_at timestamp, restored boolean")
    ids = held.select("id")
    held2, df2, report = merge.restore(held, df.withColumn("last_seen", F.col("scraped_at")), ids, AT)
    assert sorted((r["id"], r["job_id"], r["job_status"]) for r in report.collect()) == [(1, 2, "NEW"), (2, 3, "NEW")] and held2.where("restored").count() == 2
    _, df3 = merge.unrestore(held2, df2, ids.where("id = 2"))
    assert df3.count() == 2
    assert merge.reinsert(df, jobs(spark, {"id": 5, "url": "https://x/1"}, {"id": 6, "url": "https://n", "status": "SKIP", "stage": "OFFER"})).where("id > 2").select("id", "stage").collect() == [(6, None)]


def test_fuzzy_groups(spark):
    rows = [("Junior Dev", "Acme Inc", "NEW", "2026-01-02"), ("junior-dev", "Acme", "REVIEWED", "2026-01-03"), ("Junior Dev Grow Frontend", "Acme", "NEW", "2026-01-01"), ("Junior Dev", "Acme", "DUPLICATE", "2026-01-01")]
    df = jobs(spark, *[{"id": i + 1, "title": t, "company": c, "status": s} for i, (t, c, s, _) in enumerate(rows)])
    assert sorted(map(tuple, dedupe.fuzzy_groups(df).collect())) == [(i, 1, 3, True) for i in (1, 2, 3)]
    assert dedupe.default_keeper(df).first()["keeper"] == 2 and dedupe.fuzzy_groups(df.limit(0)).count() == 0
    assert {r["id"] for r in merge.mark_duplicates(df, AT)[0].where("status = 'DUPLICATE'").collect()} == {1, 4}


def test_rule_order_and_verdicts(spark):
    df = spark.createDataFrame([(1, "Cold Caller", "Bad Co", "Cebu City", "docker"), (2, "Cold Caller", "Bad Co", "Makati", "docker"), (3, "Caller", "Bad Co", "Makati", "docker"), (4, "Caller", "Fine", None, "docker"), (5, "Caller", "Fine", None, None)], "seq bigint, title string, company string, location string, description string")
    rules = spark.createDataFrame([("keyword", "cold"), ("location", "cebu"), ("company", "bad co"), ("skill", "Docker")], "kind string, value string")
    lab = mining.labelled(jobs(spark, {"id": 1, "title": "Other", "status": "SKIP"}))
    assert [r["filter_reason"] for r in mining.apply_rules(df, rules, lab).orderBy("seq").collect()] == ["location:cebu", "title-keyword:cold", "company:bad co", "desc-skill:Docker", None]
    seen = mining.labelled(jobs(spark, {"id": 1, "title": "Caller", "company": "Fine", "status": "SKIP"}))
    assert mining.apply_rules(df, rules, seen).where("seq = 5").first()["filter_reason"] == "repeat-seen:skip:Fine|Caller"
    requests = mining.judge_requests(df, lab, size=2, most=2).orderBy("chunk").collect()
    assert [(r["chunk"], r["n"], len(r["bad"]), r["within_budget"]) for r in requests] == [(0, 2, 1, True), (1, 2, 1, True)]
    batch = mining.assign_chunks(df, 2, 2, ["seq"])
    replies = spark.createDataFrame([(0, 'ok [{"i": 0, "decision": "skip"}, {"i": "1", "decision": "KEEP"}]', "p"), (1, "no json", "p")], "chunk int, reply string, provider string")
    assert {r["seq"]: r["filter_reason"] for r in mining.apply_verdicts(batch, replies).collect()} == {1: "ai:p", 2: None, 3: None, 4: None, 5: None}


def test_score(spark):
    kind = "profile_id string, summary struct<variants:array<string>>, skills array<struct<group:string,items:array<string>>>, experience array<struct<title:string,bullets:array<string>>>, soft_skills array<string>"
    profile = spark.createDataFrame([("p", (["x"],), [("g", ["Python"])], None, None)], kind)
    rules = spark.createDataFrame([], "kind string, value string")
    df = spark.createDataFrame([("p", "Dev", "Acme", "Intro docker\nRequirements:\nPython\nno experience"), ("p", "Dev", "Acme", None)], "profile_id string, title string, company string, description string")
    got = [(r["score"], r["score_reason"]) for r in scoring.score(df, profile, rules).collect()]
    assert got == [(70, "+Python; entry-level; quals: Python"), (50, "no skill overlap detected")]


def test_salary_edit_and_reports(spark):
    df = jobs(spark, {"id": 1}, {"id": 2}).withColumns({c: F.lit(None).cast("double") for c in ("salary_min", "salary_max", "salary_monthly_min", "salary_monthly_max")}).withColumns({c: F.lit("") for c in ("salary_raw", "salary_currency")}).withColumn("salary_interval", F.lit("unknown"))
    edits = spark.createDataFrame([(1, "₱30,000 - ₱40,000 per month", None, None, 50000.0, None)], "job_id bigint, salary_raw string, salary_currency string, salary_min double, salary_max double, salary_interval string")
    assert projections.correct_salary(df, edits.withColumn("salary_min", F.lit(35000.0))).where("id = 1").first()["salary_display"] == "PHP 35k–50k/mo"
    blank = spark.createDataFrame([(1, "", None, None, None, None)], edits.schema)
    once = projections.correct_salary(df, edits)
    assert projections.correct_salary(once, blank).where("id = 1").select("salary_display", "salary_min").first() == ("", None)
    notes = spark.createDataFrame([("a", 0, "x"), ("a", 0, "x"), ("b", 3, None)], "source string, rows int, error string")
    assert sorted(map(tuple, reports.source_health(notes).collect())) == [("a", 2, 0, ["x"], True, 1), ("b", 1, 3, [], False, 0)]
    assert merge.heal_report(df, once).first() == (0, 1, 1)
    assert reports.run_summary(spark.createDataFrame([("new",), ("url",), ("held",)], "outcome string")).first() == (3, 0, 1, 1, 1)


def test_sorts_and_small_operators(spark):
    from pyspark.sql.types import IntegerType, StructType

    df = jobs(spark, {"id": 1}, {"id": 2}, {"id": 3}).withColumn("score", F.expr("CASE id WHEN 1 THEN NULL WHEN 2 THEN 5 ELSE 5 END")).withColumn("scraped_at", F.expr("CASE id WHEN 2 THEN TIMESTAMP '2026-01-02' END"))
    assert [r["id"] for r in reports.sort_view(df).collect()] == [2, 3, 1] and [r["id"] for r in reports.sort_view(df, "score", False).collect()] == [2, 3, 1]
    assert [r["id"] for r in reports.sort_applications(df.withColumn("status_updated_at", F.col("scraped_at"))).collect()] == [2, 3, 1]
    runs = spark.createDataFrame([(1, "2026-01-01"), (2, "2026-01-03"), (3, "2026-01-02")], "id bigint, t string").withColumn("started_at", F.col("t").cast("timestamp"))
    assert reports.latest_run(runs).first()["id"] == 2
    assert reports.all_held(df.select("id"), df.select("id", "title"), df.select("title")).where("id is null or title is null").count() == 6
    grown = merge.evolve(df.withColumn("applied_at", F.lit(None).cast("timestamp")), StructType().add("seen", IntegerType()).add("score", IntegerType()), {"seen": 7})
    assert grown.where("id = 2").select("seen", F.col("status_updated_at").cast("date").cast("string")).first() == (7, "2026-01-02")
    rules = spark.createDataFrame([("keyword", "cold"), ("company", "cold")], "kind string, value string")
    assert mining.exclude_guarded(rules, rules.where("kind = 'company'")).collect() == [("keyword", "cold")]
    kind = "profile_id string, summary struct<variants:array<string>>, skills array<struct<group:string,items:array<string>>>, experience array<struct<title:string,bullets:array<string>>>, soft_skills array<string>"
    profile = spark.createDataFrame([("p", (["python"],), None, None, None)], kind)
    stored = df.withColumn("profile_id", F.lit("p")).withColumn("title", F.lit("Python")).withColumn("score_reason", F.lit("old"))
    got = {r["id"]: (r["score"], r["score_reason"]) for r in scoring.rescore(stored, profile, rules).collect()}
    assert got == {1: (55, "+Python"), 2: (5, "old"), 3: (5, "old")}
    postings = spark.createDataFrame([(1, "Dev", "Acme", "https://X/1/", "about", "greenhouse boards", "location:cebu", "Cebu")], "seq bigint, title string, company string, job_url string, description string, site string, filter_reason string, location string")
    assert projections.to_held_rows(postings, AT).select("source", "url", "filter_reason", "restored").first() == ("greenhouse boards", "https://x/1", "location:cebu", False)
    assert merge.untracked(spark.createDataFrame([("https://x/1",), ("https://x/9",)], "url string"), df).collect() == [("https://x/9",)]
