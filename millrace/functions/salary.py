"""Pay cadence, currency and amounts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean, let

# Symbols, codes, cadence words and month factors.
SYMBOLS = {"₱": "PHP", "$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₹": "INR"}
CODES = "PHP|USD|EUR|GBP|JPY|INR|AUD|CAD|SGD"
CADENCE = {
    "hourly": r"per hour|/hr\b|\bhourly\b|an? hour\b",
    "daily": r"per day|/day\b|\bdaily\b|a day\b",
    "weekly": r"per week|/w(e)?e?k\b|\bweekly\b|a week\b",
    "monthly": r"per month|/m(o|onth)\b|\bmonthly\b|a month\b",
    "yearly": r"per year|per annum|/y(r|ear)\b|\bannual\w*\b|\byearly\b|a year\b|p\.a\.",
}
SIGNALS = [
    "salar", "pay", "wage", "compensation", "remuneration", "per hour", "per day", "per week", "per month", "per year", "a month", "monthly", "yearly", "hourly",
    "/hr", "/day", "/week", "/mo", "/yr", "/year",
]
PHP_FLOOR = {"hourly": 50.0, "daily": 300.0, "weekly": 1000.0, "monthly": 5000.0, "yearly": 60000.0, "unknown": 1000.0}
AGE = r"(?i)\b\d+\s+(?:second|minute|hour|day|week|month|year)s?\s+ago\b"
YEARS_ASKED = (
    r"(?i)\b\d{1,2}\s*(?:[-–—to]+\s*\d{1,2}\s*)?\+?\s*(?:years?['’]?|yrs?|y\.?o\.?e\.?)(?![A-Za-z])(?:\s+[\w-]+){0,4}\s+(?:experience|exp\b|exposure)\b"
    r"|\bexperience\s*[:\-]?\s*(?:of|with|for|in)?\s*\d{1,2}\b\s*\+?\s*(?:years?['’]?|yrs?|y\.?o\.?e\.?)(?![A-Za-z])"
)
AMOUNT = r"([0-9][0-9,]*(?:\.[0-9]+)?[kKmM]?)(?!\w)"
MARK = r"(?:₱|PHP|\$|€|£|¥|₹)"
MONTHLY = {"hourly": 160.0, "daily": 22.0, "weekly": 52.0 / 12.0, "monthly": 1.0, "yearly": 1.0 / 12.0}


def pay_interval(c: Column) -> Column:
    """FN-22: the first cadence with a hit, from hourly to yearly; else unknown."""
    low, out = F.lower(F.coalesce(c, F.lit(""))), F
    for name, pattern in CADENCE.items():
        out = out.when(low.rlike(pattern), F.lit(name))
    return out.otherwise("unknown")


def pay_currency(c: Column) -> Column:
    """FN-23: by symbol, then by code as a word, then by code before a digit; else empty."""
    c, out = F.coalesce(c, F.lit("")), F
    for symbol, code in SYMBOLS.items():
        out = out.when(F.contains(c, F.lit(symbol)), F.lit(code))
    word = F.upper(F.regexp_extract(c, rf"(?i)\b({CODES})\b", 1))
    return out.when(word != "", word).otherwise(F.upper(F.regexp_extract(c, rf"(?i)({CODES})\s?[0-9]", 1)))


def parse_amount(c: Column) -> Column:
    """FN-24: "1,200", "42k", "1.5m" as a number; else null."""
    t = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[,\s]", ""))
    times = F.when(t.endswith("k"), 1e3).when(t.endswith("m"), 1e6).otherwise(1.0)
    return F.regexp_replace(t, "[km]$", "").try_cast("double") * times


def to_monthly(v: Column, interval: Column) -> Column:
    """FN-26: an amount a month; null for an unknown cadence."""
    out = F
    for name, factor in MONTHLY.items():
        out = out.when(interval == name, v / 12.0 if name == "yearly" else v * factor)
    return out


def parse_salary(c: Column) -> Column:
    """FN-25: struct (currency, min, max, interval) of a pay text; no amounts without a sign of pay.

    Ages and demanded years are taken out first. Amounts after a currency mark win, two at
    most; else the first range, else the first number. Implausibly small pesos are no pay.
    """
    return let(let(F.regexp_replace(F.regexp_replace(clean(c), AGE, ""), YEARS_ASKED, ""), _found), _plausible)


def _found(t: Column) -> Column:
    signal = t.rlike(f"[{''.join(SYMBOLS)}]") | t.rlike(rf"(?i)\b(?:{CODES})\b") | F.lower(t).rlike("|".join(SIGNALS))
    span = rf"(?i){AMOUNT}\s*(?:–|—|-|to)\s*{AMOUNT}"
    pair = F.array(F.regexp_extract(t, span, 1), F.regexp_extract(t, span, 2))
    other = F.when(t.rlike(span), pair).otherwise(F.array(F.regexp_extract(t, AMOUNT, 1)))
    texts = let(F.regexp_extract_all(t, F.lit(rf"(?i){MARK}\s*{AMOUNT}"), 1), lambda marked: F.when(F.size(marked) > 0, F.slice(marked, 1, 2)).otherwise(other))
    values = F.filter(F.transform(texts, parse_amount), lambda v: v.isNotNull())
    return F.when(signal, F.struct(pay_currency(t).alias("currency"), pay_interval(t).alias("interval"), values.alias("values"))).otherwise(
        F.struct(F.lit("").alias("currency"), F.lit("unknown").alias("interval"), F.array().cast("array<double>").alias("values"))
    )


def _plausible(p: Column) -> Column:
    high, floor = F.array_max(p["values"]), F
    for name, least in PHP_FLOOR.items():
        floor = floor.when(p["interval"] == name, F.lit(least))
    real = (high > 0) & ~((p["currency"] == "PHP") & (high < floor))
    return F.struct(p["currency"].alias("currency"), F.when(real, F.array_min(p["values"])).alias("min"), F.when(real, high).alias("max"), p["interval"].alias("interval"))


def _short(v: Column) -> Column:
    whole = lambda d: (v / d).cast("long").cast("string")
    return F.when((v >= 1e6) & (v % 1e6 == 0), F.concat(whole(1e6), F.lit("M"))).when((v >= 1e3) & (v % 1e3 == 0), F.concat(whole(1e3), F.lit("k"))).otherwise(F.format_number(v, 0))


def _range(low: Column, high: Column) -> Column:
    return F.when(low == high, _short(low)).otherwise(F.concat(_short(low), F.lit("–"), F.coalesce(_short(high), F.lit(""))))


def format_salary(currency: Column, low: Column, high: Column, interval: Column, month_low: Column, month_high: Column) -> Column:
    """FN-27: "PHP 30k–40k/mo"; yearly pay also shows its monthly estimate; empty without amounts."""
    sign = F.when(F.coalesce(currency, F.lit("")) == "", "").otherwise(F.concat(currency, F.lit(" ")))
    base = F.concat(sign, _range(low, high))
    yearly = F.concat(base, F.lit("/yr (~"), sign, _range(month_low, month_high), F.lit("/mo)"))
    out = F.when(low.isNull(), "").when((interval == "yearly") & month_low.isNotNull(), yearly)
    for name, end in {"monthly": "/mo", "hourly": "/hr", "daily": "/day", "weekly": "/wk"}.items():
        out = out.when(interval == name, F.concat(base, F.lit(end)))
    return out.otherwise(base)


def pay_snippet(c: Column, most: int = 300) -> Column:
    """FN-28: the words around the first marked amount, else the sentences that name money; empty unless it reads as pay."""
    mark = rf"(?i){MARK}\s*[0-9][0-9,]*(?:\.[0-9]+)?"
    cut = F.substr

    def around(flat: Column) -> Column:
        at, n = F.regexp_instr(flat, F.lit(mark)), F.length(F.regexp_extract(flat, mark, 0))
        return let(F.struct(at.alias("at"), F.greatest(F.lit(0), at - 151).alias("begin"), F.least(F.length(flat), at + n + 149).alias("end")), lambda p: window(flat, p))

    def window(flat: Column, p: Column) -> Column:
        begin, end = p["begin"], p["end"]
        head = F.when((begin > 0) & (cut(flat, begin + 1, F.lit(1)) != " "), F.substring_index(cut(flat, F.lit(1), begin), " ", -1)).otherwise("")
        return F.when(p["at"] > 0, F.concat(head, cut(flat, begin + 1, end - begin), F.substring_index(cut(flat, end + 1, F.length(flat)), " ", 1)))

    money = rf"[{''.join(SYMBOLS)}]|PHP|\b(?:USD|EUR|GBP|JPY|INR|AUD|CAD|SGD)\b"
    sentences = F.filter(F.split(F.coalesce(c, F.lit("")), r"(?<=[.!?\n;•·])\s+"), lambda x: x.rlike(money) & x.rlike("[0-9]"))
    found = F.coalesce(let(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s", " "), around), F.array_join(sentences, " "))
    line = F.trim(F.substring(F.trim(F.regexp_replace(found, r"\s+", " ")), 1, most))
    return let(line, lambda out: let(parse_salary(out), lambda pay: F.when((pay["currency"] != "") & pay["min"].isNotNull(), out).otherwise("")))
