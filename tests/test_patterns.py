"""Rules in one pass against plain loops, and at a million phrases."""

import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from millrace.operators import mining, patterns


def test_hits_in_any_number_of_shards(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choices("ab é", k=r.randint(1, 4)))
    rules = [(r.choice(patterns.KINDS), word()) for _ in range(300)] + [("phrase", ""), ("phrase", None), (None, "a"), ("other", "a")]
    rows = [(i, "".join(r.choices("ab é", k=r.randint(0, 12))), [word() for _ in range(r.randint(0, 5))]) for i in range(200)] + [(500, None, None), (501, "", [])]
    df, rules_df = spark.createDataFrame(rows, "i int, t string, w array<string>"), spark.createDataFrame(rules, "kind string, value string")
    by = {k: {v for kind, v in rules if kind == k and v} for k in patterns.KINDS}
    want = {i: tuple(sorted(by[k] & set(w or [])) if k != "phrase" else sorted(p for p in by[k] if p in (t or "")) for k in patterns.KINDS) for i, t, w in rows}
    for size in (1 << 25, 200):
        got = patterns.rule_hits(df, rules_df, dict.fromkeys(patterns.KINDS[:-1], F.col("w")), F.col("t"), shard_bytes=size)
        assert {x["i"]: tuple(x["_hits"]) for x in got.collect()} == want and got.columns == ["i", "t", "w", "_hits"]
    none = patterns.rule_hits(df, rules_df.limit(0), {}, F.col("t"))
    assert none.where("size(_hits.phrase) > 0").count() == 0


def test_a_million_phrases(spark):
    phrases = spark.range(1_000_000).select(F.lit("phrase").alias("kind"), F.format_string("w%d x%d", F.col("id") % 5000, (F.col("id") * 7919) % 200_003).alias("value"))
    titles = spark.range(20_000).select("id", F.format_string("senior w%d x%d dev", F.col("id") % 6000, (F.col("id") * 7919) % 200_003).alias("title"))
    began = time.time()
    found = {r["id"]: r["phrase_hits"] for r in mining.phrase_hits(titles, phrases).collect()}
    assert time.time() - began < 120
    values = {f"w{i % 5000} x{i * 7919 % 200_003}" for i in range(1_000_000)}
    for i in range(0, 20_000, 37):
        w, x = f"w{i % 6000}", f"x{i * 7919 % 200_003}"
        assert found[i] == sorted(v for v in (f"{w} {x[:n]}" for n in range(2, len(x) + 1)) if v in values)


def test_values_of_a_batch_are_looked_up_once():
    r = random.Random(5)
    words = [f"w{i}" for i in range(40)] + [None]
    lists = [None if i % 9 == 0 else r.choices(words, k=r.randrange(6)) for i in range(500)]
    texts = [None if i % 7 == 0 else " ".join(w or "" for w in x or []) for i, x in enumerate(lists)]
    for known in (set(), {"w1"}, {"w39", "w7", "w11", "none"}):
        array = pa.array([["w7"], *lists], pa.list_(pa.string())).slice(1)
        assert patterns._among(array, known).to_pylist() == [sorted(known.intersection(x or [])) for x in lists]
        found = patterns._inside(pa.array(["w7", *texts]).slice(1), patterns.Phrases(sorted(known)))
        assert found.to_pylist() == [sorted(k for k in known if k in (t or "")) for t in texts]
    assert patterns._among(pa.array([], pa.list_(pa.string())), {"a"}).to_pylist() == []


def test_decided_rows_need_no_other_rule(spark):
    df = spark.createDataFrame([(1, "Cold Caller", "Acme", None, "docker"), (2, "Cold Caller", "Beta", None, "docker")], "seq bigint, title string, company string, location string, description string")
    lab = spark.createDataFrame([(1, "SKIP", "Cold Caller", "Acme", "2026-01-01")], "id long, status string, title string, company string, status_updated_at string")
    rules = spark.createDataFrame([("keyword", "cold"), ("skill", "Docker")], "kind string, value string")
    out = mining.apply_rules(df, rules, lab)
    assert out.columns == [*df.columns, "filter_reason"]
    assert {r["seq"]: r["filter_reason"] for r in out.collect()} == {1: "repeat-seen:skip:Acme|Cold Caller", 2: "title-keyword:cold"}
