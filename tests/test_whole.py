"""Queries over whole tables that have no SQL, against plain loops."""

import html
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.plans import registry
from millrace.plans.bindings import JOBS_SQL
from millrace.sources import pages

SF = "/root/testdata/sf0.001"


def short(v):
    for unit, name in ((1_000_000, "M"), (1_000, "k")):
        if v >= unit and v % unit == 0:
            return f"{int(v // unit)}{name}"
    return f"{v:,.0f}"


def test_every_order_has_its_pay(spark):
    want = {}
    for key, a in duckdb.execute(f"SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) FROM '{SF}/orders.parquet'").fetchall():
        z, kind = a + key % 1000, key % 5
        span = short(a) if a == z else f"{short(a)}–{short(z)}"
        want[key] = [f"PHP {span}/mo" if z >= 5000 else "", f"USD {short(a)}/yr (~USD {short(a / 12)}/mo)", span, "", ""][kind]
    got = {r["id"]: r["display"] for r in registry.QUERIES["fn27_format_salary"](spark, SF).collect()}
    assert got == want and sum("/yr (~USD" in x for x in got.values()) == sum(k % 5 == 1 for k in want) > 0


SHAPES = [(r"(.+?)\s+job in\s+(.+?)\s*-\s*jobstreet\s*", (1, None, 2)), (r"(.+?)\s+hiring\s+(.+?)\s+in\s+(.+?)\s*", (2, 1, 3)), (r"(.+?)\s+in\s+(.+?)\s*-\s*(.+?)\s*", (1, 3, 2))]


def test_every_job_has_its_page_title(spark):
    want = {}
    made = f"WITH {JOBS_SQL} SELECT id, title, company FROM jobs"
    for table in ("orders", "customer", "part"):
        made = made.replace(f" {table} ", f" '{SF}/{table}.parquet' ", 1)
    for key, title, company in duckdb.execute(made).fetchall():
        text = title if key % 4 == 3 else [f"{title} Job in Cebu City - Jobstreet", f"{company} hiring {title} in Cebu City", f"{title} in Cebu City - {company}"][key % 3]
        want[key] = ("", "", "")
        for pattern, parts in SHAPES:
            if found := re.fullmatch(pattern, text.strip(), re.I):
                want[key] = tuple(found[i].strip() if i else "" for i in parts)
                break
    got = {r["id"]: (r["title"], r["company"], r["location"]) for r in registry.QUERIES["fn29_page_titles"](spark, SF).collect()}
    assert got == want
    assert sum(x == ("", "", "") for x in got.values()) > 300 and any(" in " in x[1] for x in got.values())


def loop(text):
    found = re.search(r"(?is)<title>(.*?)</title>", text or "")
    return " ".join(html.unescape(found[1]).split()) if found else ""


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_every_page_has_its_title(spark, sf):
    got = {r["page_id"]: r["title"] for r in registry.QUERIES["src6_page_heads"](spark, sf).collect()}
    want = {i: loop(t) for i, t in duckdb.execute(f"SELECT page_id, html FROM '{sf}/pages.parquet'").fetchall()}
    assert got == want and any("&" in x for x in got.values())


def test_titles_with_entities_and_without(spark):
    rows = [(1, "<title>R&amp;D &lt;lead&gt; caf&eacute;</title><p>x</p>"), (2, "<p>no title</p>"), (3, None), (4, "<TITLE>\n a\t b &#39;c&#39; </TITLE>"), (5, "<title>A & B</title>")]
    got = {r["page_id"]: r["title_tag"] for r in pages.page_tags(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert got == {i: loop(t) for i, t in rows} and got[1] == "R&D <lead> café"


MARK = re.compile(r"(?:₱|PHP|\$|€|£|¥|₹)\s*[0-9][0-9,]*(?:\.[0-9]+)?", re.I)
MONEY = re.compile(r"[₱$€£¥₹]|\b(?:PHP|USD|EUR|GBP|JPY|INR|AUD|CAD|SGD)\b")


def line_around(text):
    """The words within 150 characters of the first amount, as one line of 300."""
    flat = re.sub(r"\s", " ", text)
    m = MARK.search(flat)
    begin, end = max(0, m.start() - 150), min(len(flat), m.end() + 150)
    head = flat[:begin].rsplit(" ", 1)[-1] if begin and flat[begin] != " " else ""
    return re.sub(r"\s+", " ", head + flat[begin:end] + flat[end:].split(" ", 1)[0]).strip()[:300].strip()


def test_pay_is_found_within_whole_texts(spark):
    texts = {i: t or "" for i, t in duckdb.execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()}
    got = {r["doc_id"]: r["snippet"] for r in registry.QUERIES["fn28_pay_snippet"](spark, SF).collect()}
    assert got.keys() == texts.keys()
    plain = {i: t for i, t in texts.items() if not MONEY.search(t)}
    assert len(plain) > 0.5 * len(texts)
    for i, t in plain.items():
        if i % 3 == 0:
            assert got[i] == line_around(f"{t} We pay ₱30,000 per month to you. {t}") and "₱30,000 per month" in got[i]
        elif i % 3 == 1:
            assert got[i] == ""  # fewer pesos than any pay


def test_every_posting_has_its_salary(spark):
    told = {0: ("PHP", 30000.0, 30000.0, "monthly", 30000.0), 1: ("USD", 42000.0, 42000.0, "yearly", 3500.0), 2: ("PHP", 500.0, 500.0, "daily", 11000.0), 3: ("USD", 1500000.0, 1500000.0, "yearly", 125000.0), 4: ("", None, None, "unknown", None)}
    texts = {i: t or "" for i, t in duckdb.execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()}
    rows = registry.QUERIES["prj2_normalize_salary"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        got = tuple(r[f"salary_{c}"] for c in ("currency", "min", "max", "interval", "monthly_min"))
        if r["seq"] % 8 in told:
            assert got == told[r["seq"] % 8], r
        elif not MONEY.search(texts[r["seq"]]):
            assert got == ("", None, None, "unknown", None) and r["salary_display"] == "" and r["salary_raw"] == ""


def test_titles_of_many_large_pages(spark):
    """More html than a worker holds at once: found columns are cut where the pages are, and only those asked for come back."""
    rows = spark.range(60, numPartitions=2).select((F.col("id") + 0).alias("page_id"), F.concat(F.lit("<title>t"), "id", F.lit("</title><p>"), F.repeat(F.lit("x "), 100_000)).alias("html"), F.lit("u").alias("url"))
    out = pages.page_tags(rows, ["title_tag"], ["page_id"])
    assert out.columns == ["page_id", "title_tag"] and sorted(map(tuple, out.collect())) == [(i, f"t{i}") for i in range(60)]
    assert sorted((r["page_id"], r["h1"], r["url"]) for r in pages.page_tags(rows).collect()) == [(i, "", "u") for i in range(60)]
