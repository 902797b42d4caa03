"""The best postings of many profiles against every pair scored."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import ranking, scoring

KIND = "profile_id string, summary struct<variants:array<string>>, skills array<struct<group:string,items:array<string>>>, experience array<struct<title:string,bullets:array<string>>>, soft_skills array<string>"
POSTING = "id long, title string, company string, description string"
RULES = [("keyword", "widget"), ("phrase", "night shift"), ("company", "acme")]


def profile(name, items):
    return name, None, [("Core", items)] if items is not None else None, None, None


def tables(spark, r, many, lexicon):
    names = list(lexicon)
    people = [profile(f"p{i}", r.sample(names, r.randint(0, min(9, len(names))))) for i in range(25)] + [profile("same", ["SQL"]), profile("same", ["SQL"]), profile(None, None)]
    rows = [(None, "Python", "x", "sql")]
    for i in range(many):
        asked = " ".join(lexicon[k][0] for k in r.sample(names, r.randint(0, min(6, len(names)))))
        text = r.choice([asked, f"Intro java\nRequirements:\n- {asked}\nBenefits\nlinux lunch", None, f"{asked}. Fresh graduates welcome", f"1 year experience. Senior Developer, {asked}"])
        rows.append((r.choice([i, 3, -i]), r.choice(["Python Dev", "widget packer", "Night shift clerk", None]), r.choice(["Acme", "Other", None]), text))
    return spark.createDataFrame(people, KIND), spark.createDataFrame(rows, POSTING), spark.createDataFrame(RULES, "kind string, value string")


def brute(profiles, postings, rules, n, lexicon):
    """Every pair by the scoring function, then plain sorting."""
    owners = profiles.withColumn("profile_id", F.concat_ws("/", F.coalesce("profile_id", F.lit("-")), F.monotonically_increasing_id().cast("string")))
    pairs = postings.where("id is not null").crossJoin(owners.select("profile_id"))
    found = {}
    for x in scoring.score(pairs, owners, rules, lexicon).select("profile_id", "id", "score").collect():
        found.setdefault(x.profile_id.split("/")[0], {}).setdefault(x.profile_id, []).append((-x.score, x.id))
    return sorted((k, i, x, -s) for k, each in found.items() for v in each.values() for i, (s, x) in enumerate(sorted(v)[:n], 1))


@pytest.mark.parametrize(("n", "many", "small"), [(5, 300, {}), (5, 300, {"head": 4, "shard": 7, "block": 3, "step": 2}), (40, 200, {"head": 1, "shard": 20, "block": 50, "step": 3}), (500, 60, {"head": 3, "shard": 10})])
def test_all_pairs(spark, n, many, small):
    given = tables(spark, random.Random(n + many), many, scoring.SKILLS)
    got = sorted((x.profile_id or "-", x.rank, x.id, x.score) for x in ranking.top_postings(*given, n=n, **small).collect())
    assert got == brute(*given, n, scoring.SKILLS)


def test_long_lexicon(spark):
    lexicon = {f"s{i}x": [f"s{i}x", f"alias{i}x"] for i in range(150)} | {"SQL": ["sql"]}
    given = tables(spark, random.Random(4), 150, lexicon)
    got = sorted((x.profile_id or "-", x.rank, x.id, x.score) for x in ranking.top_postings(*given, n=6, lexicon=lexicon, head=5, shard=16, block=4).collect())
    assert got == brute(*given, 6, lexicon)


def test_empty(spark):
    people, postings, rules = tables(spark, random.Random(1), 5, scoring.SKILLS)
    assert ranking.top_postings(people.limit(0), postings, rules).count() == 0
    assert ranking.top_postings(people, postings.limit(0), rules).count() == 0
    assert ranking.top_postings(people, postings, rules.limit(0), n=1).count() == people.count()


def test_shards_that_can_not_help_are_not_visited(spark):
    """The best classes settle nearly all queries, so few (query, shard) pairs remain."""
    r = random.Random(7)
    names = list(scoring.SKILLS)
    rows = [(i, " ".join(scoring.SKILLS[k][0] for k in r.sample(names, r.randint(1, 12))), "x", r.choice(["", "Fresh graduates welcome", "5 years of experience, lead a team"])) for i in range(4000)]
    people = spark.createDataFrame([profile(f"p{i}", r.sample(names, 20)) for i in range(60)], KIND)
    postings = spark.createDataFrame(rows, POSTING)
    classes = ranking._classes(postings, spark.createDataFrame([], "kind string, value string"), 5, scoring.SKILLS).toPandas()
    assert len(classes) > 3000
    index, read = ranking._Shard(classes), []
    plain = ranking._Shard.scores
    for text in scoring.flatten_profiles(people).select(F.array_join(ranking.masks(F.col("text"), scoring.SKILLS).cast("array<string>"), ",").alias("own")).toPandas()["own"]:
        seen = []
        index.scores = lambda own, at, seen=seen: seen.append(at) or plain(index, own, at)
        index.best(ranking._own(text), 5, None, 64)
        read.append(len(seen) * 64)
    assert sum(read) / len(read) < len(classes) / 3


def test_texts_are_read_once_for_all_aliases(spark):
    lexicon = {f"s{i}": [f"word{i} ", "ord6" if i == 3 else f"x{i}y"] for i in range(70)} | {"all": [""], "same": ["x1y"], "accent": ["café"]}
    df = spark.createDataFrame([("Word61 X1Y",), ("CAFÉ x69yx2y",), ("",), (None,)], "t string")
    found = df.select(ranking.masks(F.col("t"), lexicon).alias("m"))
    assert "contains(" not in found._jdf.queryExecution().executedPlan().toString().lower()
    for row, text in zip(found.collect(), ["word61 x1y", "café x69yx2y", "", ""], strict=True):
        want = sum(1 << i for i, aliases in enumerate(lexicon.values()) if any(a in text for a in aliases))
        assert row["m"] == [want & ((1 << 62) - 1), want >> 62]
