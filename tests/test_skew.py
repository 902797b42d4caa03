"""Groups, sums and reports where one key holds all rows."""

import glob
import random
from collections import Counter

from pyspark.sql import functions as F

from millrace.operators import dedupe, mining, reports
from millrace.plans import registry

SF = "/root/testdata/sf0.001"


def found(edges):
    return {r.id: r.component for r in dedupe.components(edges).collect()}


def brute(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_components(spark):
    r = random.Random(3)
    for n, m in ((40, 30), (200, 190), (50, 200)):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)]
        assert found(spark.createDataFrame(edges, "a long, b long")) == brute(edges)
    assert found(spark.createDataFrame([], "a long, b long")) == {}


def test_star_and_chain(spark, monkeypatch):
    rounds = []
    plain = dedupe.cut
    monkeypatch.setattr(dedupe, "cut", lambda df: rounds.append(1) or plain(df))
    for hub in (0, 200_000):  # the smallest id, and the largest
        star = dedupe.components(spark.range(1, 200_000).select(F.lit(hub).alias("a"), F.col("id").alias("b")))
        assert star.where(f"component != {min(hub, 1)}").count() == 0 and star.count() == 200_000
    assert len(rounds) <= 14
    rounds.clear()
    n = 100_000  # a chain in a mixed order of ids
    name = lambda c: F.pmod(c * 48_271, F.lit(n + 1)) if (n + 1) % 48_271 else c
    chain = dedupe.components(spark.range(n).select(name(F.col("id")).alias("a"), name(F.col("id") + 1).alias("b")))
    assert chain.where("component != 0").count() == 0 and chain.count() == n + 1 and len(rounds) <= 2 * 20


def test_one_bucket_and_day(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") < 10, "x").when(F.col("id") > 4990, F.lit(None)).otherwise("hot").alias("bucket"), F.expr("timestamp'2026-01-01' + make_dt_interval(0, 0, 0, (id * 7919) % 3000)").alias("ts"), (F.col("id") % 13).alias("tokens"))
    got = {r.id: (r.calls, r.total, r.over) for r in reports.usage_budget(rows, 4000, 10**9).collect()}
    calls, totals = {}, {}
    for r in sorted(rows.collect(), key=lambda r: (r.ts, r.id)):
        calls[r.bucket], totals[r.bucket] = calls.get(r.bucket, 0) + 1, totals.get(r.bucket, 0) + r.tokens
        assert got[r.id] == (calls[r.bucket], totals[r.bucket], calls[r.bucket] > 4000)


def test_errors_of_a_source(spark):
    notes = spark.createDataFrame([("a", 0, f"e{i % 7}") for i in range(20)] + [("a", 0, None), ("b", 3, None), (None, 0, "x" * 200)], "source string, rows int, error string")
    got = {r.source: tuple(r)[1:] for r in reports.source_health(notes, most=3).collect()}
    assert got == {"a": (21, 0, ["e0", "e1", "e2"], True, 7), "b": (1, 3, [], False, 0), None: (1, 0, ["x" * 160], True, 1)}


def test_all_errors_of_a_source(spark):
    notes = spark.range(5000).select(F.lit("a").alias("source"), F.lit(0).alias("rows"), F.concat(F.lit("timeout of "), F.col("id") % 2500).alias("error"))
    got = reports.source_health(notes).first()
    assert got.errors == sorted(f"timeout of {i}" for i in range(2500)) and got.n_errors == 2500


def test_payloads_are_written_by_many_tasks(spark):
    found = [x for x in glob.glob(f"{registry.queries_rest._landed(spark, SF, 'struct(doc_id)', None).removeprefix('file://')}/**", recursive=True) if x.endswith(".txt")]
    files = spark.read.parquet(f"{SF}/documents.parquet").select(F.floor(F.col("doc_id") / 50)).distinct().count()
    assert len(found) == files > 1 and len({x.rsplit("/", 1)[0] for x in found}) == 1 and len({x.rsplit("/", 1)[1].split("-")[1] for x in found}) > 1


def test_rows_without_a_title_meet_in_no_task(spark):
    df = spark.range(1000).select(F.col("id").alias("seq"), F.when(F.col("id") % 100 == 0, "Dev").alias("title"), F.lit("Acme").alias("company"), F.repeat(F.lit("word "), 100).alias("description"))
    lab = spark.createDataFrame([(1, "SKIP", "BAD", "Dev", "Acme", "2026-01-01")], "id long, status string, label string, title string, company string, status_updated_at string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = mining.already_judged(df, lab).select("seq", "judged.status", F.spark_partition_id().alias("at")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    counts = Counter(r["at"] for r in got if r.status is None)
    assert {r.seq for r in got if r.status == "SKIP"} == set(range(0, 1000, 100)) and len(got) == 1000 and len(counts) == 4 and max(counts.values()) < 500
    asked = mining.judge_requests(df, lab, size=3, most=2).orderBy("chunk").collect()
    assert [[x.split(" | ")[0] for x in r["rows"]] for r in asked] == [["0", "1", "2"]] * 2 and all("word word" in x for r in asked for x in r["rows"])


def test_pairs_within_one_company(spark):
    r = random.Random(8)
    titles = [" ".join(r.sample(["dev", "java", "senior", "web", "lead", *[f"x{i}" for i in range(12)]], r.randint(1, 6))) for _ in range(250)]
    jobs = spark.createDataFrame([(i, "dev " + t if i % 2 else t, "Acme", "NEW") for i, t in enumerate(titles)], "id long, title string, company string, status string")
    want = None
    for most in (1000, 7):
        got = {(x.a, x.b): x.subset for x in dedupe.fuzzy_pairs(jobs, most=most).collect()}
        assert want is None or got == want
        want = got
    first = {}
    for x in jobs.collect():
        first.setdefault(x.title, (x.id, frozenset(x.title.split())))
    brute = {}
    for i, (a, s) in enumerate(sorted(first.values(), key=lambda v: v[0])):
        for b, t in sorted(first.values(), key=lambda v: v[0])[i + 1 :]:
            k = len(s & t)
            if k == min(len(s), len(t)) or k >= 0.6 * max(len(s), len(t)):
                brute[a, b] = k == min(len(s), len(t))
    assert want == brute
