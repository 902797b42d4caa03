"""Demanded experience as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import flat, let

# Phrases that ask for years, waive them, or speak of seniority. The first letters are looked at before the word boundary, which is what costs.
_YEAR = r"(?:years?['’]?|yrs?|y\.?o\.?e\.?)(?![A-Za-z])"
_WORDS = r"[\p{L}\p{N}_-]+"
_FILL = rf"(?:\s+{_WORDS}){{0,4}}\s+"
_WORK = "(?:experience|work|employment|development|engineering|programming|coding|exposure|testing|design|support|administration|operations|it|software|tech|industry|field|role)"
NONE = r"(?=[nfe0])\b(?:no\s+experience|fresh\s+graduates?|entry[- ]levels?|0\s*years?\s*experience)\b"
YEARS = [
    (rf"(\d{{1,2}})\b(?:\s*[-–to]+\s*(\d{{1,2}}))?\s*\+?\s*{_YEAR}{_FILL}experience\b", 2),
    (rf"experience\s*[:\-]?\s*(?:of|with|for|in)?\s*(\d{{1,2}})\b\s*\+?\s*{_YEAR}", 1),
    (rf"(\d{{1,2}})\s+(?:or\s+more|plus)\s*{_YEAR}{_FILL}experience\b", 1),
    (rf"(\d{{1,2}})\s*\+?\s*{_YEAR}\s+(?:of\s+|in\s+)?(?:{_WORDS}\s+){{0,2}}{_WORK}\b", 1),
    (r"(\d{1,2})\s*\+?\s*y\.?o\.?e\.?(?![A-Za-z])|(\d{1,2})\s*\+\s*yrs?(?![A-Za-z])", 2),
]
SENIOR = [
    r"(?=[slpha])\b(?:senior|sr\.?|lead|principal|staff|head|architect)\s+(?:developer|engineer|programmer|analyst|qa|tester|devops|designer|consultant|specialist|administrator|support)\b"
    r"|(?=t)\b(?:team|tech)\s*lead\b|(?=e)\bengineering\s+manager\b",
    r"(?=[epslm])\b(?:extensive\s+experience|proven\s+(?:experience|track\s+record)|seasoned\s+(?:professional|developer|engineer)|lead\s+a\s+team|manage\s+a\s+team"
    r"|mentor\s+(?:junior|engineers?|a\s+team|your\s+team)|leadership\s+experience)\b",
    r"(?=[1-9])\b([3-9]|1\d)\s*\+?\s*years?\s+(?:preferred|desired|favour(?:ed|able)|favor(?:ed|able)|a\s+plus)\b",
    r"(?=[1-9])\b([3-9]|1\d)\s*\+\s*years?(?![A-Za-z])",
]



def _waived(t: Column) -> Column:
    return t.rlike(NONE)


def _years(t: Column) -> Column:
    """Most years named in a text in lower case; only texts that name a unit are searched."""
    found = F.concat(*[F.regexp_extract_all(t, F.lit(p), g + 1) for p, groups in YEARS for g in range(groups)])
    return F.when(t.rlike("yea|yr|y\\.?o\\.?e"), F.array_max(F.transform(found, lambda x: x.try_cast("int"))))


def _senior(t: Column) -> Column:
    first = F.coalesce(*[F.nullif(F.regexp_extract(t, p, 0), F.lit("")) for p in SENIOR])
    return F.substring(F.trim(first), 1, 40)


def demands(c: Column) -> Column:
    """struct (years, senior): FN-20 and FN-21 of one text, read once."""
    of = lambda t: let(_waived(t), lambda waived: F.struct(F.when(waived, F.lit(0)).otherwise(_years(t)).alias("years"), F.when(~waived, _senior(t)).alias("senior")))
    return let(flat(c), of)


def max_experience(c: Column) -> Column:
    """FN-20: most years asked for; 0 where none are needed, null where nothing is said."""
    return let(flat(c), lambda t: F.when(_waived(t), F.lit(0)).otherwise(_years(t)))


def seniority(c: Column) -> Column:
    """FN-21: the first sign of seniority in lower case, 40 characters at most; null where experience is waived."""
    return let(flat(c), lambda t: F.when(~_waived(t), _senior(t)))


def experience_reason(description: Column, cap: int) -> Column:
    """FLT-7: why a posting is held for its demands, or null: more years than the cap, else a sign of seniority. A cap of 0 holds nothing."""
    if not cap:
        return F.lit(None).cast("string")
    needs = lambda d: F.concat(F.lit("exp-gap:needs "), d["years"], F.lit(f" yrs (ceiling {cap:g})"))
    signal = lambda d: F.concat(F.lit("exp-gap:seniority signal ("), d["senior"], F.lit(")"))
    return let(demands(description), lambda d: F.when(d["years"] > cap, needs(d)).when(d["senior"].isNotNull(), signal(d)))


def experience_gate(df, cap: int) -> tuple:
    """FLT-7: (kept, held with their ``reason``) of postings with a description."""
    told = df.withColumn("reason", experience_reason(F.col("description"), cap))
    return told.where("reason is null").drop("reason"), told.where("reason is not null")
