"""Skills, rules and experience turned into a score from 0 to 100."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.experience import demands
from ..functions.text import let, norm_title, quals_section, tokens
from .patterns import rule_hits

# Skills and what counts as a mention.
SKILLS = {
    "Python": ["python"],
    "JavaScript": ["javascript", "js"],
    "TypeScript": ["typescript", "ts"],
    "React": ["react"],
    "Next.js": ["next.js", "nextjs"],
    "Node.js": ["node.js", "nodejs", "node"],
    "Java": ["java"],
    "C#": ["c#", "c sharp", "csharp"],
    "SQL": ["sql"],
    "PostgreSQL": ["postgresql", "postgres"],
    "MySQL": ["mysql"],
    "MongoDB": ["mongodb", "mongo"],
    "Firebase": ["firebase"],
    "Supabase": ["supabase"],
    "Git/GitHub": ["git", "github"],
    "Docker": ["docker"],
    "CI/CD": ["ci/cd", "cicd", "continuous integration"],
    "Linux": ["linux", "ubuntu"],
    "Bash": ["bash", "shell scripting"],
    "REST APIs": ["rest", "restful", "api"],
    "OAuth": ["oauth"],
    "HTML/CSS": ["html", "css"],
    "Agile/Scrum": ["agile", "scrum"],
    "QA/Testing": ["qa", "quality assurance", "testing", "software test"],
    "Troubleshooting": ["troubleshoot"],
    "Hardware support": ["hardware"],
    "Networking": ["networking", "tcp/ip", "lan", "wan"],
    "DNS/DHCP": ["dns", "dhcp"],
    "VPN/Firewall": ["vpn", "firewall"],
    "Windows administration": ["windows server", "active directory"],
    "Office 365": ["office 365", "microsoft office", "o365"],
    "Helpdesk": ["helpdesk", "help desk", "service desk"],
    "LLM integration": ["llm", "large language model"],
    "Prompt engineering": ["prompt engineering", "prompting"],
    "PyTorch": ["pytorch"],
    "Data analysis": ["data analysis", "analytics"],
    "Excel": ["excel", "spreadsheet"],
}
# Weights.
BASE, PER_MATCH, MATCH_CAP, PER_MISSING, MISSING_CAP, SENIOR_COST = 50, 5, 30, 4, 20, 15
COMPANY_COST, WORD_COST, WORD_CAP = 25, 10, 20


def mentions(c: Column, aliases: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(a)) for a in aliases])


def skill_hits(c: Column, lexicon: dict[str, list[str]] | None = None) -> Column:
    """JON-7: skills mentioned in a text, in the order of the lexicon; a mention is a substring.

    The lexicon is configuration, so each alias is one native test; nothing is joined. The
    text in lower case is bound once instead of being made again for each alias.
    """
    found = lambda low: F.array_compact(F.array(*[F.when(mentions(low, aliases), F.lit(skill)) for skill, aliases in (lexicon or SKILLS).items()]))
    return let(F.lower(F.coalesce(c, F.lit(""))), found)


def flatten_profiles(profiles: DataFrame) -> DataFrame:
    """SRC-10: (profile_id, text): all words of a nested profile in lower case, a part a line."""
    parts = F.concat(
        F.array(F.array_join(F.coalesce(F.col("summary.variants"), F.array()), " ")),
        F.flatten(F.transform(F.coalesce("skills", F.array()), lambda g: F.concat(F.array(F.coalesce(g["group"], F.lit(""))), F.coalesce(g["items"], F.array())))),
        F.flatten(F.transform(F.coalesce("experience", F.array()), lambda g: F.concat(F.array(F.coalesce(g["title"], F.lit(""))), F.coalesce(g["bullets"], F.array())))),
        F.coalesce("soft_skills", F.array()),
    )
    return profiles.select("profile_id", F.lower(F.array_join(parts, "\n")).alias("text"))


def penalty(df: DataFrame, patterns: DataFrame) -> DataFrame:
    """SCO-2: adds ``penalty`` (0 or less) and ``penalty_notes`` for a posting's company and title."""
    company = F.lower(F.trim(F.coalesce("company", F.lit(""))))
    df = rule_hits(df, patterns, {"keyword": tokens(F.col("title")), "company": F.array(company)}, norm_title(F.col("title")))
    df = df.withColumn("_avoided", F.size("_hits.company") > 0).withColumn("_words", F.col("_hits.keyword")).withColumn("_inside", F.slice("_hits.phrase", 1, 2)).drop("_hits")
    avoided, hits, inside = F.col("_avoided"), F.col("_words"), F.col("_inside")
    words = F.when(F.size(hits) > 0, F.least(F.size(hits) * WORD_COST, F.lit(WORD_CAP))).when(F.size(inside) > 0, WORD_COST).otherwise(0)
    notes = F.array_compact(F.array(
        F.when(avoided, F.concat(F.lit("avoided company ("), F.trim("company"), F.lit(")"))),
        F.when(F.size(hits) > 0, F.concat(F.lit("reject-pattern: "), F.array_join(F.slice(hits, 1, 3), ","))).when(F.size(inside) > 0, F.concat(F.lit("reject-pattern: "), F.array_join(inside, "|"))),
    ))
    cost = -(F.when(avoided, COMPANY_COST).otherwise(0) + words)
    return df.withColumn("penalty", cost.cast("int")).withColumn("penalty_notes", notes).drop("_avoided", "_words", "_inside")


def score(df: DataFrame, profiles: DataFrame, patterns: DataFrame, lexicon: dict[str, list[str]] | None = None) -> DataFrame:
    """SCO-1, SCO-3: each posting against the profile named in its ``profile_id`` column.

    Adds score, score_reason, matched, missing. Evidence is title and demands where a block
    of demands is found (its hits count twice), else title and description.
    """
    known = flatten_profiles(profiles).select("profile_id", skill_hits(F.col("text"), lexicon).alias("_own"))
    quals = quals_section(F.col("description"))
    evidence = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.when(F.col("_quals") != "", F.col("_quals")).otherwise(F.coalesce("description", F.lit(""))))
    df = penalty(df, patterns).join(known, "profile_id", "left").withColumn("_own", F.coalesce("_own", F.array().cast("array<string>")))
    df = df.withColumn("_quals", quals).withColumn("_asked", skill_hits(evidence, lexicon)).withColumn("_named", F.when(F.col("_quals") != "", skill_hits(F.col("_quals"), lexicon)).otherwise(F.array()))
    df = df.withColumn("matched", F.array_intersect("_asked", "_own")).withColumn("missing", F.array_except("_asked", "_own")).withColumn("_twice", F.array_intersect("matched", "_named"))
    df = df.withColumn("_demands", demands(F.col("description"))).withColumn("_years", F.col("_demands.years")).withColumn("_senior", F.col("_demands.senior"))
    points = F.least((F.size("matched") + F.size("_twice")) * PER_MATCH, F.lit(MATCH_CAP)) - F.least(F.size("missing") * PER_MISSING, F.lit(MISSING_CAP))
    junior = F.when(F.col("_years") == 0, 10).when(F.col("_years") == 1, 5).otherwise(0)
    total = F.lit(BASE) + points + junior - F.when(F.col("_senior").isNotNull(), SENIOR_COST).otherwise(0) + F.col("penalty")
    top = lambda c, n: F.array_join(F.slice(c, 1, n), ", ")
    notes = F.concat(F.array_compact(F.array(
        F.when(F.size("matched") > 0, F.concat(F.lit("+"), top("matched", 4))),
        F.when(F.size("matched") > 4, F.concat(F.lit("+"), F.size("matched") - 4, F.lit(" more"))),
        F.when(F.size("missing") > 0, F.concat(F.lit("missing "), top("missing", 3))),
        F.when(F.col("_years") == 0, "entry-level").when(F.col("_years") == 1, "1-yr fit"),
        F.when(F.size("_twice") > 0, F.concat(F.lit("quals: "), top("_twice", 3))),
        F.when(F.col("_senior").isNotNull(), F.concat(F.lit("seniority flag ("), F.col("_senior"), F.lit(")"))),
    )), F.col("penalty_notes"))
    df = df.withColumn("_notes", notes)
    reason = F.when(F.size("_notes") > 0, F.substring(F.array_join("_notes", "; "), 1, 280)).otherwise("no skill overlap detected")
    df = df.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int")).withColumn("score_reason", reason)
    return df.drop("_own", "_quals", "_asked", "_named", "_twice", "_demands", "_years", "_senior", "_notes", "penalty", "penalty_notes")


def rescore(jobs: DataFrame, profiles: DataFrame, patterns: DataFrame, only_zero: bool = True, with_description: bool = False) -> DataFrame:
    """SCO-4: new scores of stored jobs by title (and description if asked); with only_zero, scores above 0 stay."""
    due = (F.coalesce("score", F.lit(0)) == 0) if only_zero else F.lit(True)
    text = F.col("description") if with_description else F.lit("")
    new = score(jobs.where(due).select("id", "title", "company", text.alias("description"), "profile_id"), profiles, patterns)
    new = new.select("id", F.col("score").alias("_score"), F.col("score_reason").alias("_reason"))
    out = jobs.join(new, "id", "left").withColumn("score", F.coalesce("_score", "score"))
    return out.withColumn("score_reason", F.coalesce("_reason", "score_reason")).drop("_score", "_reason")


def skill_gap(postings: DataFrame, profiles: DataFrame, n: int = 10, lexicon: dict[str, list[str]] | None = None) -> DataFrame:
    """SCO-5: (id, matched, suggested_add, suggested_remove) of each posting and the profile of its profile_id.

    suggested_remove holds the profile's skill items that share no word of three or more
    characters with the description, stop-words left out.
    """
    known = flatten_profiles(profiles).select("profile_id", skill_hits(F.col("text"), lexicon).alias("_own"))
    items = profiles.select("profile_id", F.array_distinct(F.flatten(F.transform(F.coalesce("skills", F.array()), lambda g: F.coalesce(g["items"], F.array())))).alias("_items"))
    long = lambda c: F.filter(tokens(c), lambda w: F.length(w) >= 3)
    df = postings.join(known, "profile_id").join(items, "profile_id").withColumn("_asked", skill_hits(F.col("description"), lexicon)).withColumn("_words", long(F.col("description")))
    idle = F.filter("_items", lambda x: (F.size(long(x)) > 0) & ~F.arrays_overlap(long(x), F.col("_words")))
    return df.select("id", F.array_intersect("_asked", "_own").alias("matched"), F.slice(F.array_except("_asked", "_own"), 1, n).alias("suggested_add"), F.slice(idle, 1, n).alias("suggested_remove"))
