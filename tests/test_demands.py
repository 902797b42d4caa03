"""Demands in whole texts against plain loops over the same rules."""

import duckdb
import pytest
import regex
from pyspark.sql import functions as F

from millrace.functions import experience
from millrace.plans import registry

SF = "/root/testdata/sf0.01"
SAID = [
    "3-5 years of relevant experience.", "experience: 4 yrs", "6 or more years of backend experience", "12 years in business", "2 plus yrs hands-on coding experience", "4+ YOE", "7 + yrs", "5 years' work", "no  experience needed",
    "Senior Engineer", "seasoned developer", "5 years preferred", "lead a team of 3 years", "0 years experience", "10 to 12 years of industry experience and 3 years in QA", "Fresh graduates welcome, 9 years experience",
]


def loop(text):
    """(years, senior): the rules one after another."""
    low = regex.sub(r"\s+", " ", regex.sub(r"[\x1c-\x1f\x85]", " ", text.lower()))
    if regex.search(experience.NONE, low):
        return 0, None
    found = [int(v) for p, _ in experience.YEARS for m in regex.finditer(p, low) for v in m.groups() if v]
    signs = (regex.search(p, low) for p in experience.SENIOR)
    first = next((m.group(0).strip()[:40] for m in signs if m), None)
    return max(found, default=None), first


@pytest.fixture(scope="module")
def texts():
    rows = duckdb.execute(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall()
    # what is asked stands inside the text, so that words around it count
    return [(i, f"{t[: len(t) // 2]} {SAID[i % len(SAID)]} {t[len(t) // 2 :]} {SAID[i // 7 % len(SAID)] if i % 3 == 0 else ''}") for i, t in rows]


def test_demands_of_whole_texts(spark, texts):
    df = spark.createDataFrame(texts, "i long, t string").repartition(8)
    got = {r.i: (r.d.years, r.d.senior) for r in df.select("i", experience.demands(F.col("t")).alias("d")).collect()}
    want = {i: loop(t) for i, t in texts}
    assert [(i, got[i], want[i]) for i in want if got[i] != want[i]] == []
    assert len({w[0] for w in want.values()}) >= 7 and len({w[1] for w in want.values()}) >= 5
    held = {r.i: r.reason for r in df.select("i", experience.experience_reason(F.col("t"), 2).alias("reason")).collect()}
    for i, (years, senior) in want.items():
        assert held[i] == (f"exp-gap:needs {years} yrs (ceiling 2)" if years is not None and years > 2 else f"exp-gap:seniority signal ({senior})" if senior else None)


def test_registered_queries_follow_the_rules(spark):
    """fn20, fn21 and flt7 over the whole table: the rules on each text that they build."""
    docs = {i: t or "" for i, t in duckdb.execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()}
    got = {r.doc_id: (r.years, r.senior) for r in registry.QUERIES["fn21_demands"](spark, SF).collect()}
    from millrace.plans.queries_rest import _ASKED

    assert got == {i: loop(". ".join([t, _ASKED[i % 12][0]])) for i, t in docs.items()}
