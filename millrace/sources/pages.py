"""Landed HTML pages as postings."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.salary import pay_snippet
from ..functions.text import bare_company, clean, is_wall, split_page_title, strip_html
from ..functions.urls import canonical_url, site_of

# Where sites keep a posting's place and pay (attribute, values); a class may be one of several.
HOOKS = {
    "place": {"data-automation": ["jobLocation", "job-detail-location"], "data-testid": ["jobsearch-JobInfoHeader-companyLocation", "inlineHeader-companyLocation"], "data-test": ["location"], "class": ["job-location", "location", "top-card-layout__second-subline"]},
    "pay": {"data-automation": ["jobSalary"]},
}
FOUND = ["title_tag", "og_title", "h1", "body", "og_site", "og_text", "main", "place", "pay"]
_METAS = {"og:title": "og_title", "og:site_name": "og_site", "og:description": "og_text"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Tags(HTMLParser):
    """Title, heading, metas, the text outside scripts and styles, and that of the first main part, place and pay."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts = {"title_tag": [], "h1": [], "body": [], "article": [], "main": [], "place": [], "pay": []}
        self.metas = dict.fromkeys(_METAS.values(), "")
        self.open: list[tuple[str, str | None]] = []  # tags, and what is gathered from them
        self.done: set[str] = set()

    def _hook(self, named: dict) -> str | None:
        for name, places in HOOKS.items():
            for attribute, values in places.items():
                have = (named.get(attribute) or "").split() if attribute == "class" else [named.get(attribute)]
                if name not in self.done and any(v in values for v in have):
                    return name
        return None

    def handle_starttag(self, tag, attrs):
        named = dict(attrs)
        if tag == "meta":
            name = _METAS.get(named.get("property") or named.get("name") or "")
            if name and not self.metas[name]:
                self.metas[name] = (named.get("content") or "").strip()
        if tag in _VOID:
            return
        kind = {"title": "title_tag", "h1": "h1", "article": "article", "main": "main", "script": "skip", "style": "skip"}.get(tag) or self._hook(named)
        self.open.append((tag, None if kind in self.done else kind))

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                # the first of each that holds text counts
                self.done |= {kind for _, kind in self.open[at:] if kind and kind != "skip" and any(x.strip() for x in self.parts[kind])}
                del self.open[at:]
                return

    def handle_data(self, data):
        kinds = {kind for _, kind in self.open if kind}
        if "skip" in kinds:
            return
        for kind in kinds if "title_tag" not in kinds else {"title_tag"}:
            self.parts[kind].append(data)
        if "title_tag" not in kinds:
            self.parts["body"].append(data)

    def row(self) -> list[str]:
        line = {kind: " ".join(" ".join(parts).split()) for kind, parts in self.parts.items()} | self.metas
        line["main"] = line["article"] or line["main"]
        return [line[name] for name in FOUND]


#: Characters of html that are parsed before what was found in them is handed on.
PARSED_CHARS = 1 << 22


def page_tags(pages: DataFrame, names: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Adds the columns ``names`` (of ``FOUND``, else all) of each page's html; null html gives empty ones. Of the given columns ``keep`` stay, else all.

    Pages come to Python a few at a time, by their bytes, and are parsed one at a time; only what was found in the last
    ``PARSED_CHARS`` characters is held. Other columns pass through as Arrow arrays.
    """
    names = FOUND if names is None else names
    kept = pages.columns if keep is None else keep
    spots, at = [FOUND.index(c) for c in names], pages.columns.index("html")
    held = [pages.columns.index(c) for c in kept]

    def parse(batches):
        for batch in batches:
            begin, chars, rows = 0, 0, []
            for end, html in enumerate(batch.column(at), 1):
                text = html.as_py() or ""
                tags = _Tags()
                tags.feed(text)
                tags.close()
                row = tags.row()
                rows.append([row[i] for i in spots])
                chars += len(text)
                if chars >= PARSED_CHARS or end == batch.num_rows:
                    found = [pa.array(x, pa.string()) for x in zip(*rows, strict=True)]
                    yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(begin, end - begin) for i in held], *found], [*kept, *names])
                    begin, chars, rows = end, 0, []

    return pages.mapInArrow(parse, StructType([*[pages.schema[c] for c in kept], *[StructField(c, StringType()) for c in names]]))


def _parted(title):
    """struct (title, company) of "title - company" and the like: at the first kind of separator in it, the last part is the company."""
    out = F
    for sep in (" - ", " | ", " at ", " @ "):
        company = F.substring_index(title, sep, -1)
        out = out.when(F.contains(title, F.lit(sep)), F.struct(clean(F.left(title, F.length(title) - F.length(company) - len(sep))).alias("title"), bare_company(company).alias("company")))
    return out.otherwise(F.struct(title.alias("title"), F.lit("").alias("company")))


def extract_pages(pages: DataFrame) -> DataFrame:
    """SRC-6: url, site, title, company, location, description, salary_raw, wall of pages (url, html).

    A shape found in the title tag or og:title gives its parts; else the title is og:title,
    the first heading, or the title tag, parted from the company behind a dash, bar, at or @ (linkedin: at only). A company
    named by og:site_name wins over that but on linkedin. The place that a site marks wins over the title's. The
    description is the article, the main part, og:description, or the whole text, to 8,000 characters; pay
    that a site marks wins over what the description says.
    """
    df = page_tags(pages.select("url", "html"), keep=["url"]).withColumn("_og", split_page_title(F.col("og_title"))).withColumn("_tag", split_page_title(F.col("title_tag"))).withColumn("_site", site_of(F.col("url")))
    first = lambda *c: F.coalesce(*[F.nullif(clean(x), F.lit("")) for x in c], F.lit(""))
    shaped, linkedin = first(F.col("_og.title"), F.col("_tag.title")), F.col("_site") == "linkedin"
    named = F.when(linkedin, "").otherwise(first(F.col("_og.company"), F.col("_tag.company"), F.col("og_site")))
    df = df.withColumn("_plain", first(F.col("og_title"), F.col("h1"), F.col("title_tag"))).withColumn("_named", F.when(linkedin, first(F.col("_og.company"), F.col("_tag.company"))).otherwise(named)).withColumn("_shaped", shaped)
    at_only = F.when(F.contains("_plain", F.lit(" at ")), F.struct(clean(F.substring_index("_plain", " at ", 1)).alias("title"), bare_company(F.substring_index("_plain", " at ", -1)).alias("company"))).otherwise(F.struct(F.col("_plain").alias("title"), F.lit("").alias("company")))
    whole = F.struct(F.col("_plain").alias("title"), F.lit("").alias("company"))
    df = df.withColumn("_parts", F.when((F.col("_shaped") != "") | (F.col("_named") != ""), whole).when(linkedin, at_only).otherwise(_parted(F.col("_plain"))))
    df = df.withColumn("_text", F.left(first(F.col("main"), F.col("og_text"), F.col("body")), F.lit(8000)))
    return df.select(
        canonical_url(F.col("url")).alias("url"), F.col("_site").alias("site"), first(F.col("_shaped"), F.col("_parts.title")).alias("title"),
        bare_company(first(F.col("_named"), F.col("_parts.company"))).alias("company"), bare_company(first(F.col("place"), F.col("_og.location"), F.col("_tag.location"))).alias("location"),
        F.col("_text").alias("description"), F.when(F.col("pay") != "", F.left("pay", F.lit(300))).otherwise(pay_snippet(F.col("_text"))).alias("salary_raw"), is_wall(F.col("body"), F.col("title_tag")).alias("wall"),
    )


_POSTING = (
    "struct<`@type`:string,title:string,datePosted:string,description:string,hiringOrganization:struct<name:string>,jobLocation:string,"
    "baseSalary:struct<currency:string,value:struct<value:string,minValue:string,maxValue:string,unitText:string>>>"
)


def extract_jsonld(pages: DataFrame) -> DataFrame:
    """SRC-7: url, title, company, location, date_posted, description, salary_raw of the first JobPosting in each page's JSON-LD.

    A blob may be an object, a list, or an object with @graph. Pages without a posting give no row; pages that share a url
    are told apart, each gives its own.
    """
    blobs = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), 1)
    many = f"array<{_POSTING}>"

    def items(text):
        graph = F.get_json_object(text, "$.@graph")
        read = F.when(text.startswith("["), F.from_json(text, many)).when(graph.isNotNull(), F.from_json(graph, many)).otherwise(F.array(F.from_json(text, _POSTING)))
        return F.coalesce(read, F.array().cast(many))

    found = F.filter(F.flatten(F.transform(blobs, lambda x: items(F.trim(x)))), lambda p: p["@type"] == "JobPosting")
    p = pages.select("url", F.explode(F.slice(found, 1, 1)).alias("p"))
    place = F.when(F.col("p.jobLocation").startswith("["), F.get_json_object("p.jobLocation", "$[0].address")).otherwise(F.get_json_object("p.jobLocation", "$.address"))
    value = F.col("p.baseSalary.value")
    low, high = F.coalesce(value["minValue"], value["value"]), F.coalesce(value["maxValue"], value["value"])
    unit = F.concat(F.lit(" per "), F.lower(value["unitText"]))
    marked = lambda c: F.concat_ws(" ", "p.baseSalary.currency", c)
    pay = F.when(low.isNotNull(), F.concat(F.when(low == high, marked(low)).otherwise(F.concat(marked(low), F.lit(" - "), marked(high))), F.coalesce(unit, F.lit(""))))
    region = F.concat_ws(", ", F.get_json_object(place, "$.addressLocality"), F.get_json_object(place, "$.addressRegion"))
    return p.select("url", clean(F.col("p.title")).alias("title"), clean(F.col("p.hiringOrganization.name")).alias("company"), region.alias("location"), F.to_date(F.left(F.col("p.datePosted"), F.lit(10))).alias("date_posted"), strip_html(F.col("p.description")).alias("description"), F.coalesce(pay, F.lit("")).alias("salary_raw"))


class _Node:
    """A tag with its attributes and what it holds: texts and tags."""

    def __init__(self, tag: str, attrs: dict[str, str | None]) -> None:
        self.tag, self.attrs, self.held = tag, attrs, []

    def has(self, name: str) -> bool:
        return name in (self.attrs.get("class") or "").split()

    def tags(self):
        """All tags inside, in order."""
        for x in self.held:
            if isinstance(x, _Node):
                yield x
                yield from x.tags()

    def texts(self):
        for x in self.held:
            if isinstance(x, str):
                yield x
            elif x.tag not in ("script", "style"):
                yield from x.texts()

    def text(self) -> str:
        return " ".join(" ".join(self.texts()).split())

    def first(self, *tests) -> _Node | None:
        """The first tag inside that passes the first test, inside that the next, and so on."""
        if not tests:
            return self
        return next((found for x in self.tags() if tests[0](x) and (found := x.first(*tests[1:]))), None)


class _Tree(HTMLParser):
    """The tags of a page as a tree. An end tag closes the nearest open one of its name; a list item ends where the next begins."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag == "li":
            for at in range(len(self.open) - 1, 0, -1):
                if self.open[at].tag in ("ul", "ol", "menu"):
                    break
                if self.open[at].tag == "li":
                    del self.open[at:]
                    break
        node = _Node(tag, dict(attrs))
        self.open[-1].held.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                del self.open[at:]
                return

    def handle_data(self, data):
        self.open[-1].held.append(data)


# Classes of cards, kinds of contract.
CARD_CLASSES = ["card", "job-item"]
CONTRACTS = ["full-time", "full time", "part-time", "part time", "contract", "permanent", "temporary", "internship", "freelance"]
_AGO, _PAY = re.compile(r"\bago\b|^today$|^just now$", re.I), re.compile(r"[₱$€£¥₹]|\bPHP\b", re.I)
_REGION = re.compile(r"manila|makati|taguig|quezon|pasig|cebu|davao|philippines|\bcity\b|remote", re.I)
CARD = ["title", "job_url", "company", "location", "salary_raw", "age", "description"]


def _card(node: _Node) -> list[str]:
    tag, of = lambda name: lambda x: x.tag == name, lambda name, kind: lambda x: x.tag == name and x.has(kind)
    found = dict.fromkeys(CARD, "")
    for x in (node.first(lambda x: x.has("nf-job-list-info")) or node).tags():
        text = x.text() if x.tag == "span" else ""
        if not text or text.lower() in CONTRACTS:
            continue
        named = bool(_REGION.search(text))
        if _AGO.search(text):
            found["age"] = found["age"] or text
        elif _PAY.search(text):
            found["salary_raw"] = found["salary_raw"] or text
        elif not found["location"] and (named or "," in text):
            found["location"] = text
        elif not found["company"]:
            found["company"] = text
        elif not found["location"]:
            found["location"] = text
    if _REGION.search(found["company"]) and found["location"] and not _REGION.search(found["location"]):
        # a place stands where the employer does, and the employer's comma made it a place
        found["company"], found["location"] = found["location"], found["company"]
    link = node.first(tag("h3"), tag("a")) or node.first(tag("a"))
    muted = node.first(of("p", "text-muted"), tag("small")) or node.first(of("p", "text-muted"))
    told = node.first(lambda x: x.has("nf-job-list-desc"), of("p", "mb-0")) or node.first(of("p", "mb-0"))
    found["title"] = link.text() if link else ""
    found["job_url"] = re.sub(r"[?#].*$", "", ((link and link.attrs.get("href")) or node.attrs.get("data-url") or "").strip(), flags=re.S)
    found["age"] = (muted.text() if muted else "") or found["age"]
    found["description"] = told.text() if told else ""
    return [found[c] for c in CARD]


def _cards(html: str) -> list[list[str]]:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    is_card = lambda x: any(x.has(c) for c in CARD_CLASSES)
    return [_card(x) for x in tree.root.tags() if is_card(x) and not any(is_card(y) for y in x.tags())]


def extract_cards(pages: DataFrame) -> DataFrame:
    """SRC-5: url, title, job_url, company, location, salary_raw, age, description of each card in result pages (url, html).

    A card is a tag of class card or job-item, whatever its name, with all it holds; one that holds other cards is
    their list. The link in its heading, else its first, is the posting, without query and fragment; data-url
    stands in for a missing one. Spans are told apart by content: an age, pay, a kind of contract, a
    place (of the region or country, or with a comma); the first other is the company, and a second one the
    location if there is none. A company that is a place of the region changes with a location that only has a comma. A muted paragraph is the age; the paragraph of
    class mb-0 describes. Pages without the name of such a class are not parsed.
    """

    def parse(batches):
        for batch in batches:
            rows = [(url, *card) for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for card in _cards(html)]
            columns = list(zip(*rows, strict=True)) or [()] * (len(CARD) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in columns], ["url", *CARD])

    named = pages.where(F.col("html").rlike("|".join(CARD_CLASSES))).select(F.col("url").cast("string").alias("url"), "html")
    return named.mapInArrow(parse, ", ".join(f"{c} string" for c in ["url", *CARD]))
