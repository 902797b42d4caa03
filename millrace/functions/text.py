"""Text, company and title normal forms as Column expressions."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decorations of company names.
COMPANY_SUFFIXES = ["inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "llc", "plc", "gmbh", "pty", "pvt", "philippines", "ph"]
COMPANY_PHRASES = ["in the philippines"]
COMPANY_PREFIXES = ["careers at ", "jobs at ", "hiring at ", "hiring by ", "jobs by "]
STOP_WORDS = ["and", "the", "for", "with", "hiring", "wanted", "urgent", "role", "job", "jobs", "position", "jr", "sr", "i", "ii", "iii", "iv", "a", "an", "of", "in", "on", "to", "new"]
PLACE_WORDS = ["city", "metro", "manila", "philippines", "ncr", "hybrid", "onsite", "remote"]
WALL_MARKS = ["just a moment", "cf-turnstile", "cf-challenge", "attention required", "access denied", "verify you are human", "are you a robot", "sign in to view", "log in to view", "join now to view"]
# Headings that open the demands of a posting, and those that end them.
_LEAD = r"(?im)^[ \t*•\-#]{0,4}"
DEMANDS = _LEAD + (
    r"(?:qualifications?|requirements?|what\s+(?:you(?:'ll|\s+will)?\s+(?:need|bring|have)|we(?:'re|\s+are)?\s+looking\s+for)|key\s+(?:qualifications?|requirements?|skills?)"
    r"|minimum\s+(?:qualifications?|requirements?)|preferred\s+(?:qualifications?|requirements?|skills?)|(?:must|nice)\s*-?\s*have|job\s+requirements?"
    r"|who\s+you\s+are|about\s+you|ideal\s+candidate|what\s+you\s+bring)\s*:?\s*$"
)
AFTER_DEMANDS = _LEAD + (
    r"(?:responsibilities|duties|what\s+you(?:'ll|\s+will)?\s+do|benefits?(?:\s+and\s+perks?)?|compensation|salary|about\s+(?:us|the\s+(?:company|role|team))|how\s+to\s+apply)\s*:?\s*$"
)
PLACEHOLDER_TITLES = ["", "untitled (manual)"]
#: White space of Unicode, as a class of Java's patterns; its \\s has that of ASCII only.
BLANK = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]{1,30};?)"
#: Named references that count without a semicolon, longest first.
_LEGACY = "^(" + "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))) + ")"
#: What references to the control characters 0x80 to 0x9F stand for: Windows-1252, where that has a character.
_WINDOWS = [bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(0x80, 0xA0)]


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once a row, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def clean(c: Column) -> Column:
    """FN-1: null becomes empty; white space at both ends goes."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"^\s+|\s+$", "")


def norm_text(c: Column) -> Column:
    """FN-2: lower case, everything but letters and digits of ASCII becomes one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def norm_company(c: Column) -> Column:
    """FN-3: normal form without country phrase, leading aggregator words and legal suffixes."""
    s = norm_text(c)

    def without_phrases(x: Column) -> Column:
        out = x
        for phrase in COMPANY_PHRASES:
            out = F.trim(F.regexp_replace(F.replace(out, F.lit(phrase), F.lit(" ")), " +", " "))
        return F.when(reduce(lambda a, b: a | b, [F.contains(x, F.lit(p)) for p in COMPANY_PHRASES]), out).otherwise(x)

    def without_prefixes(x: Column) -> Column:
        out = x
        for prefix in COMPANY_PREFIXES:  # one after another: a later one may not uncover an earlier one
            out = F.regexp_replace(out, f"^(?:{prefix})+", "")
        return F.when(x.rlike(f"^(?:{'|'.join(COMPANY_PREFIXES)})"), out).otherwise(x)

    def without_suffixes(x: Column) -> Column:
        out = F.trim(F.regexp_replace(x, f"(?:(?:^| )(?:{'|'.join(COMPANY_SUFFIXES)}))+$", ""))
        return F.when(F.substring_index(x, " ", -1).isin(COMPANY_SUFFIXES), out).otherwise(F.trim(x))  # none without a last word that is one

    return F.coalesce(let(let(let(s, without_phrases), without_prefixes), without_suffixes), F.lit(""))


def fingerprint(title: Column, company: Column) -> Column:
    """FN-4: company|title in normal form; empty where either is."""
    made = let(F.struct(norm_text(title).alias("t"), norm_company(company).alias("c")), lambda p: F.when((p["t"] == "") | (p["c"] == ""), F.lit("")).otherwise(F.concat_ws("|", p["c"], p["t"])))
    return F.coalesce(made, F.lit(""))  # never null, so joins on it don't test for that


def words(c: Column) -> Column:
    """All runs of letters, digits and + # . of the lower-case text, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9+#.]+"), 0)


def _telling(c: Column) -> Column:
    return F.filter(words(c), lambda w: ~w.isin(STOP_WORDS))


def tokens(c: Column) -> Column:
    """FN-18: distinct words that are no stop-words, in order."""
    return F.array_distinct(_telling(c))


def phrases(c: Column) -> Column:
    """FN-18: distinct pairs of neighbouring words, stop-words left out first."""
    t = _telling(c)
    return F.array_distinct(F.zip_with(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))


def norm_title(c: Column) -> Column:
    """FN-18: the title without stop-words."""
    return F.array_join(_telling(c), " ")


def loc_tokens(c: Column) -> Column:
    """FN-18: distinct words of a place, without numbers and generic words."""
    return F.filter(tokens(c), lambda w: ~w.isin(PLACE_WORDS) & ~w.rlike("^[0-9]+$"))


def is_placeholder(c: Column) -> Column:
    """FN-31: a title that was never filled in."""
    return F.lower(clean(c)).isin(PLACEHOLDER_TITLES)


def est_tokens(c: Column) -> Column:
    """FN-33: a quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(c, F.lit(""))) / 4).cast("int"))


def flat(c: Column) -> Column:
    """Lower case, any white space as one blank; null becomes empty."""
    # single blanks are most of them, and stay as they are; a look at whether a character is a printable one of ASCII spares most of them the class
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"(?=[^!-~])(?:[{BLANK}&&[^ ]][{BLANK}]*| (?=[^!-~])[{BLANK}]+)", " ")


def _character(code: Column) -> Column:
    """The character that a numeric reference stands for."""
    of = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    windows = F.get(F.array(*[F.lit(x) for x in _WINDOWS]), (code - 0x80).cast("int"))
    nothing = code.between(1, 8) | code.isin(0x0B, 0x7F) | code.between(0x0E, 0x1F) | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(0xFFFE) == 0xFFFE)
    return F.when((code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), "\ufffd").when(code.between(0x80, 0x9F), windows).when(nothing, "").otherwise(of)


def _referred(e: Column) -> Column:
    """What one character reference stands for; itself if for nothing."""
    number = F.regexp_replace(e, "^&#[xX]?0*|;$", "")
    value = lambda base: F.when(F.length(number) > 7, 0x110000).when(number == "", 0).otherwise(F.conv(number, base, 10).try_cast("long"))  # noqa: E731  longer ones are no characters
    by_letter: dict[str, dict[str, str]] = {}
    for name, sign in html5.items():
        by_letter.setdefault(name[0], {})[name] = sign
    # a constant; a map is searched entry by entry, so names are parted by their first letter
    letters = F.from_json(F.lit(json.dumps(by_letter)), "map<string,map<string,string>>")
    named = F.try_element_at(letters, F.substr(e, F.lit(2), F.lit(1)))
    legacy = F.regexp_extract(F.substr(e, F.lit(2)), _LEGACY, 1)
    begin = F.when(legacy != "", F.concat(F.try_element_at(named, legacy), F.substr(e, F.length(legacy) + 2))).otherwise(e)
    out = F.when(e == "&amp;", "&").when(e == "&nbsp;", "\xa0").when(e == "&lt;", "<").when(e == "&gt;", ">").when(e == "&quot;", '"')
    return out.when(e.rlike("^&#[xX]"), _character(value(16))).when(e.startswith("&#"), _character(value(10))).otherwise(F.coalesce(F.try_element_at(named, F.substr(e, F.lit(2))), begin))


def unescape(c: Column) -> Column:
    """Character references of HTML, named and numeric, read once; null becomes empty."""
    c = F.coalesce(c, F.lit(""))
    read = F.transform(F.regexp_extract_all(c, F.lit(_REFERENCE), 0), _referred)
    return F.when(F.contains(c, F.lit("&")), F.array_join(F.flatten(F.zip_with(F.split(c, _REFERENCE, -1), read, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")).otherwise(c)


def strip_html(c: Column) -> Column:
    """FN-11: text of HTML: scripts, styles and tags go, all character references are read, blanks collapse; lines stay."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    s = unescape(F.regexp_replace(s, r"(?s)<[^>]+>", " "))
    return F.regexp_replace(F.regexp_replace(s, r"[ \t\xa0]+", " "), rf"^[{BLANK}]+|[{BLANK}]+\z", "")


def quals_section(c: Column) -> Column:
    """FN-19: what stands between the first heading of demands and the next other heading; else empty."""
    tail = F.regexp_extract(F.coalesce(c, F.lit("")), DEMANDS + r"([\s\S]*)", 1)
    return F.substring(F.regexp_replace(F.regexp_replace(tail, AFTER_DEMANDS + r"[\s\S]*", ""), r"^[ \n\t:\-–—]+|[ \n\t:\-–—]+\z", ""), 1, 6000)


def split_page_title(c: Column) -> Column:
    """FN-29: struct (title, company, location) of the three known shapes of page titles, else empty fields."""
    t = clean(c)
    shapes = [
        (r"(?i)^(.+?)\s+job in\s+(.+?)\s*-\s*jobstreet\s*$", 1, None, 2),
        (r"(?i)^(.+?)\s+hiring\s+(.+?)\s+in\s+(.+?)\s*$", 2, 1, 3),
        (r"(?i)^(.+?)\s+in\s+(.+?)\s*-\s*(.+?)\s*$", 1, 3, 2),
    ]

    def field(which: int) -> Column:
        out = F
        for shape in shapes:
            out = out.when(t.rlike(shape[0]), F.trim(F.regexp_extract(t, shape[0], shape[which])) if shape[which] else F.lit(""))
        return out.otherwise("")

    return F.struct(field(1).alias("title"), field(2).alias("company"), field(3).alias("location"))


def bare_company(c: Column) -> Column:
    """FN-29: without the site's decoration after a dash or bar."""
    return F.regexp_replace(clean(c), r"\s+[—–\-|](?:\s+.*)?$", "")


def is_wall(text: Column, title: Column) -> Column:
    """FN-30: a challenge or login page, by its first 20,000 characters."""
    both = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))
    return F.lower(F.substring(both, 1, 20000)).rlike("|".join(WALL_MARKS))


def desc_snippet(c: Column, most: int) -> Column:
    """FN-32: one line of a description, long demands first, cut between words; a dash for nothing."""
    line = lambda x: F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))
    s, q, n = line(c), line(quals_section(c)), max(100, most)
    ahead = (F.length(q) > 200) & ~F.contains(F.left(s, F.length(q) + 10), q)
    s = F.when(ahead, F.concat(F.lit("Requirements: "), q, F.lit(" | Posting: "), s)).otherwise(s)
    cut = F.left(s, F.lit(n))
    cut = F.when(F.contains(cut, F.lit(" ")), F.regexp_replace(cut, " [^ ]*$", "")).otherwise(cut)
    return F.when(s == "", "—").when(F.length(s) > n, F.concat(cut, F.lit("…"))).otherwise(s)


def parse_verdicts(c: Column, n: int) -> Column:
    """FN-34: array of (i, decision) from the JSON list within a reply; KEEP and SKIP for rows 0 to n - 1 only."""
    items = F.from_json(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)\[.*\]", 0), "array<struct<i:string,decision:string>>")
    read = F.transform(F.coalesce(items, F.array()), lambda x: F.struct(x["i"].try_cast("int").alias("i"), F.upper(x["decision"]).alias("decision")))
    return F.filter(read, lambda x: x["i"].between(0, n - 1) & x["decision"].isin("KEEP", "SKIP"))
