import pytest
from pyspark.sql import functions as F

from millrace.functions import dates, experience, location, salary, text, urls
from millrace.operators import gates


def one(spark, expression, value):
    return spark.range(1).select(F.lit(value).cast("string").alias("c")).select(expression(F.col("c")).alias("x")).first()["x"]


@pytest.mark.parametrize(("given", "want"), [("Accenture in the Philippines", "accenture"), ("Careers at Eucalyptus", "eucalyptus"), ("Acme Corp. PH", "acme"), ("jobs at careers at X Co.", "careers at x"), ("Coca Co Labs", "coca co labs"), ("Company Inc", ""), ("inc", ""), ("", ""), (None, "")])
def test_company(spark, given, want):
    assert one(spark, text.norm_company, given) == want


@pytest.mark.parametrize(("given", "strict", "loose", "remote"), [("Makati, P00, PH", True, True, False), ("", True, True, False), (None, True, True, False), ("Cebu, Philippines", False, False, False), ("Philippines", False, True, False), ("Remote in the Philippines", False, True, False), ("Remote", False, False, True), ("Remote Worldwide", False, False, True), ("PARAÑAQUE", True, True, False)])
def test_location(spark, given, strict, loose, remote):
    assert [one(spark, f, given) for f in (location.in_region, location.in_region_or_country, location.is_remote)] == [strict, loose, remote]


@pytest.mark.parametrize(("given", "want"), [("3-5 years of relevant experience", 5), ("experience: 3 years", 3), ("Fresh graduates welcome, 5 years experience", 0), ("4+ YOE", 4), ("25 years in business", None)])
def test_experience(spark, given, want):
    assert one(spark, experience.max_experience, given) == want


def test_dates(spark):
    day = lambda c: dates.listed_date(c, F.lit("2026-01-31").cast("timestamp")).cast("string")
    assert [one(spark, day, x) for x in ("3 days ago", "2 weeks ago", "5 hours ago", "just now", "")] == ["2026-01-28", "2026-01-17", "2026-01-31", "2026-01-31", None]


def test_salary_and_urls(spark):
    assert [one(spark, salary.parse_amount, x) for x in ("1,200", "42k", "1.5m", "x")] == [1200.0, 42000.0, 1500000.0, None]
    assert one(spark, salary.pay_currency, "Php19,000") == "PHP"
    assert one(spark, salary.pay_interval, "₱30,000 - ₱40,000 per month") == "monthly"
    assert one(spark, urls.site_of, "https://www.Example.com/x") == "example.com"


def test_search_language(spark):
    df = spark.createDataFrame([(1, "Python Backend", "A"), (2, "Junior Dev", "B"), (3, "Backend", "Python Ltd")], "id int, title string, company string")
    ids = lambda q: [r["id"] for r in df.where(gates.compile_search(q)).orderBy("id").collect()]
    assert ids("python backend") == [1, 3] and ids("title:python backend, jr | junior") == [1, 2] and ids("") == [1, 2, 3] and ids('"junior dev"') == [2]
    assert ids("Title:python") == [1] and ids("company:a") == [1] and ids("company:python, a") == [1, 3] and ids("junior or python") == [1, 2, 3]
    more = spark.createDataFrame([(1, "Data, Analyst", "A"), (2, "Data", "B"), (3, "title:x", None), (4, None, "x")], "id int, title string, company string")
    found = lambda q: [r["id"] for r in more.where(gates.compile_search(q)).orderBy("id").collect()]
    assert found('"data, analyst"') == [1] and found("data, x") == [1, 2, 3, 4] and found("x title:x") == [3] and found('""') == [1, 2, 3, 4] and found('data "a') == []


@pytest.mark.parametrize(("given", "want"), [("1 year experience. Senior Developer role", "exp-gap:seniority signal (senior developer)"), ("3\u00a0years experience", "exp-gap:needs 3 yrs (ceiling 2)"), ("2 years experience", None), ("fresh graduates, senior developer, 9 years experience", None), ("", None), (None, None), ("3\u2003+ years preferred", "exp-gap:seniority signal (3 + years preferred)")])
def test_experience_gate(spark, given, want):
    assert one(spark, lambda c: experience.experience_reason(c, 2), given) == want
    assert one(spark, lambda c: experience.experience_reason(c, 0), given) is None
    kept, held = experience.experience_gate(spark.createDataFrame([(given,)], "description string"), 2)
    assert (kept.count(), [r["reason"] for r in held.collect()]) == ((0, [want]) if want else (1, []))


def test_html(spark):
    import html
    import random
    from html.entities import html5

    assert one(spark, text.strip_html, "<p>We&rsquo;re hiring &mdash; caf&eacute; &#8217;</p>\n<script>x</script>\n  R&ampD&nbsp; &amp;lt;") == "We\u2019re hiring \u2014 caf\u00e9 \u2019 \n \n R&D &lt;"
    r, names = random.Random(1), sorted(html5)
    made = ["&notit; & &; &#; &#x; &#0; &#xD800; &#x110000; &#99999999999999999999; &#128; &#x81; &#13; &#1; &#xFFFE; &amp"]
    made += ["".join(r.choice(["&" + r.choice(names), "&" + r.choice(names).rstrip(";"), f"&#{r.randint(0, 70000)};", f"&#x{r.randint(0, 0x11FFFF):x}", " ", "x", "; "]) for _ in range(8)) for _ in range(200)]
    got = spark.createDataFrame(list(enumerate(made)), "i int, t string").select("i", text.unescape(F.col("t")).alias("u")).collect()
    assert all(g["u"] == html.unescape(made[g["i"]]) for g in got)
