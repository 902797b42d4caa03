"""URL keys and parts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean, let

# Known sites, label names, parameters that only track, parameters that identify.
SITES = ["indeed", "linkedin", "jobstreet", "glassdoor", "trabajo", "greenhouse", "lever", "ashby", "remoteok", "kalibrr", "jora", "grabjobs"]
JOB_LABELS = ["indeed", "linkedin", "jobstreet", "glassdoor", "google", "greenhouse", "lever"]
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gclid", "fbclid", "mc_cid", "mc_eid", "igshid", "sk"]
IDENTITY = {"indeed": ["jk", "vjk"]}


def url_key(c: Column) -> Column:
    """FN-5: trimmed, lower case, no slashes at the end."""
    return F.regexp_replace(F.lower(clean(c)), "/+$", "")


def host(c: Column) -> Column:
    return F.lower(F.regexp_extract(clean(c), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#]*@)?([^/?#:]*)", 1))


def _first_name(c: Column, names: list[str], default: Column) -> Column:
    out = F
    for name in names:
        out = out.when(F.contains(c, F.lit(name)), F.lit(name))
    return out.otherwise(default)


def site_of(c: Column, names: list[str] = SITES) -> Column:
    """FN-7: the first known name within the host, else the host without a leading www."""
    bare = F.regexp_replace(host(c), r"^www\.", "")
    return _first_name(bare, names, bare)


def source_label(site: Column, url: Column, names: list[str] = JOB_LABELS) -> Column:
    """FN-8: a known name in the site's text, else that text; with no text, a known name in the URL or empty."""
    text = F.lower(clean(site))
    return F.when(text != "", _first_name(text, names, text)).otherwise(_first_name(F.lower(clean(url)), names, F.lit("")))


def canonical_url(c: Column) -> Column:
    """FN-6: one form of a link: https by default, lower-case scheme and host, no login, default port,
    parameters of the last segment, fragment, tracking parameters or slash at the end; path and query keep
    their case, and the query's names and values are read and escaped anew.

    Sites with parameters that identify a posting keep those alone; a redirect of trabajo
    gives the path it wraps (in url, else u, else redirect). A text without a host is only put in lower case. Empty and null become empty.
    """
    start = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)"
    segment = lambda x: F.regexp_replace(x, r";[^/]*\z", "")
    read = lambda x: F.coalesce(F.try_url_decode(x), x)
    escaped = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    value = lambda p: F.when(F.contains(p, F.lit("=")), F.substr(p, F.instr(p, F.lit("=")) + 1)).otherwise("")
    pair = lambda p: F.struct(read(F.substring_index(p, "=", 1)).alias("n"), read(value(p)).alias("v"))

    def parts(u: Column) -> Column:
        place = F.regexp_replace(F.regexp_extract(u, start, 2), "^.*@", "")
        params = F.transform(F.filter(F.split(F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: p != ""), pair)
        where = F.when(place.startswith("["), F.regexp_extract(place, r"^\[([^\]]*)", 1)).otherwise(F.regexp_extract(place, "^[^:]*", 0))
        port = F.coalesce(F.regexp_extract(place, r":0*([0-9]{1,5})\z", 1).try_cast("int"), F.lit(0))
        return F.struct(u.alias("u"), F.lower(F.regexp_extract(u, start, 1)).alias("scheme"), F.lower(where).alias("where"), port.alias("port"), segment(F.regexp_extract(u, start + "([^?#]*)", 3)).alias("path"), params.alias("params"))

    def target(p: Column) -> Column:
        given = lambda n: F.nullif(F.try_element_at(F.filter(p["params"], lambda x: x["n"] == n), F.lit(-1))["v"], F.lit(""))
        return F.when(F.contains(p["where"], F.lit("trabajo")), F.coalesce(given("url"), given("u"), given("redirect"))).otherwise(F.lit(None))

    def joined(p: Column) -> Column:
        names = F.filter(p["params"], lambda x: ~F.lower(x["n"]).isin(TRACKING))
        only = lambda known: F.filter(p["params"], lambda x: F.lower(x["n"]).isin(known))
        for site, known in IDENTITY.items():
            names = F.when(site_of(p["u"]) == site, only(known)).otherwise(names)
        query = F.array_join(F.transform(names, lambda x: F.concat(escaped(x["n"]), F.lit("="), escaped(x["v"]))), "&")
        wrapped = lambda t: F.when(t.startswith("/"), t).when(F.contains(t, F.lit("trabajo")), segment(F.regexp_extract(t, start + "([^?#]*)", 3))).otherwise("")
        rest = let(let(target(p), wrapped), lambda inner: F.when(inner != "", inner).otherwise(F.concat(F.regexp_replace(p["path"], "/+$", ""), let(query, lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q))))))
        out = F.concat(p["scheme"], F.lit("://"), p["where"], F.when(p["port"].isin(0, 80, 443), "").otherwise(F.concat(F.lit(":"), p["port"].cast("string"))), rest)
        return F.regexp_replace(F.when(p["where"] == "", F.lower(p["u"])).otherwise(out), "/+$", "")

    linked = let(clean(c), lambda raw: F.when(F.contains(raw, F.lit("://")) | (raw == ""), raw).otherwise(F.concat(F.lit("https://"), raw)))
    return let(let(linked, parts), joined)


def clean_id_url(c: Column, name: str) -> Column:
    """FN-10: the link with the one parameter that identifies it; empty where it is missing."""
    value = F.regexp_extract(clean(c), rf"[?&]{name}=([^&#]+)", 1)
    return F.when(value == "", "").otherwise(F.concat(strip_query(c), F.lit(f"?{name}="), value))


def strip_query(c: Column) -> Column:
    """FN-10: without query and fragment."""
    return F.regexp_replace(clean(c), r"[?#].*$", "")
