"""Gates and list filters over posting tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.experience import experience_reason
from ..functions.location import location_gate

IN_PROGRESS, OFFERS = ["APPLIED", "INITIAL", "TECHNICAL", "FINAL"], ["OFFER", "ACCEPTED", "DECLINED"]


def _any(c: Column, words: list[str]) -> Column:
    c = F.lower(c)
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w.lower())) for w in words], F.lit(False))


def title_gate(c: Column, include: list[str], exclude: list[str]) -> Column:
    """FLT-5: no excluded substring and, if any are given, an included one; null fails."""
    ok = ~_any(c, exclude)
    return F.coalesce(ok & _any(c, include) if include else ok, F.lit(False))


def company_gate(c: Column, exclude: list[str]) -> Column:
    """FLT-6: no excluded substring; null passes."""
    return F.coalesce(~_any(c, exclude), F.lit(True))


def apply_gates(df: DataFrame, include: list[str], exclude: list[str], companies: list[str], cap: int) -> DataFrame:
    """FLT-20: adds ``outcome``: kept, held (with ``reason``), or dropped.

    A row whose demands are too high is held even if another gate drops it.
    """
    reason = experience_reason(F.col("description"), cap)
    passes = location_gate(F.col("location"), F.col("loose_location")) & title_gate(F.col("title"), include, exclude) & company_gate(F.col("company"), companies)
    df = df.withColumn("reason", reason).withColumn("_ok", passes)
    return df.withColumn("outcome", F.when(F.col("reason").isNotNull(), "held").when(F.col("_ok"), "kept").otherwise("dropped")).drop("_ok")


def list_filter(jobs: DataFrame, status=None, source=None, date_from=None, date_to=None, search=None) -> DataFrame:
    """FLT-11: by status, source, posting date (null dates fail) and text in title or company."""
    for column, value in (("status", status), ("source", source)):
        jobs = jobs.where(F.col(column) == value) if value else jobs
    jobs = jobs.where(F.col("date_posted") >= F.lit(date_from).cast("date")) if date_from else jobs
    jobs = jobs.where(F.col("date_posted") <= F.lit(date_to).cast("date")) if date_to else jobs
    if search:
        jobs = jobs.where(_any(F.col("title"), [search]) | _any(F.col("company"), [search]))
    return jobs


def _alternatives(query: str) -> list[list[str]]:
    """The words of each alternative; commas and bars part them outside quotes, and so does the word or."""
    out: list[list[str]] = []
    for branch in re.findall(r'(?:"[^"]*(?:"|\Z)|[^",|])+', query):
        out.append([])
        for quoted, phrase, word in re.findall(r'("([^"]*)")|(\S+)', branch):
            term = (phrase if quoted else word).lower()
            if term == "or":
                out.append([])
            elif term:
                out[-1].append(term)
    return [words for words in out if words]


def compile_search(query: str) -> Column:
    """FLT-12: the search language as one condition.

    Alternatives by comma, bar or the word or; words of an alternative must all occur, each in the title
    or the company; quotes keep a phrase together, with whatever is in it; title: or company: at the
    start limits the whole query to one column. Without a word everything is found.
    """
    scope, rest = ["title", "company"], (query or "").strip()
    if found := re.match(r"(title|company):", rest, re.I):
        scope, rest = [found[1].lower()], rest[found.end() :].strip()
    hit = lambda word: reduce(lambda a, b: a | b, [_any(F.coalesce(c, F.lit("")), [word]) for c in scope])
    found = [reduce(lambda a, b: a & b, map(hit, words)) for words in _alternatives(rest)]
    return reduce(lambda a, b: a | b, found) if found else F.lit(True)


def hide(jobs: DataFrame, statuses: list[str], sources: list[str], status=None, source=None) -> DataFrame:
    """FLT-13: hidden values go unless one is chosen."""
    jobs = jobs if status or not statuses else jobs.where(~F.col("status").isin(statuses))
    return jobs if source or not sources else jobs.where(~F.col("source").isin(sources))


def is_stale(last_seen: Column, scraped_at: Column, as_of: Column) -> Column:
    """FLT-14: not seen for more than 30 days."""
    return F.coalesce(last_seen, scraped_at) < as_of - F.expr("INTERVAL 30 DAYS")


def is_due(follow_up: Column, as_of: Column) -> Column:
    """FLT-15: the follow-up day has come."""
    return F.coalesce(follow_up <= as_of.cast("date"), F.lit(False))


def applications(jobs: DataFrame, view: str) -> DataFrame:
    """FLT-16: applied jobs: all, in_progress, offers or rejected."""
    stage = F.coalesce("stage", F.lit("APPLIED"))
    jobs = jobs.where("status = 'APPLIED'").withColumn("stage", stage)
    kinds = {"in_progress": IN_PROGRESS, "offers": OFFERS, "rejected": ["OUT"]}
    return jobs.where(F.col("stage").isin(kinds[view])) if view in kinds else jobs


def first_term(text: Column, terms: list[str]) -> Column:
    """FLT-8: the first term with a word of three or more characters that the text holds, or null."""
    out = F.lit(None).cast("string")
    for term in reversed(terms):
        out = F.when(_any(text, [w for w in term.split() if len(w) >= 3]), F.lit(term)).otherwise(out)
    return out


def recent(age_hours: Column, most: float) -> Column:
    """FLT-9: at most so old; an unknown age passes."""
    return F.coalesce(age_hours <= most, F.lit(True))


def has_url(c: Column) -> Column:
    """FLT-10."""
    return F.coalesce(F.trim(c) != "", F.lit(False))
