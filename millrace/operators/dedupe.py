"""First-seen dedupe, caps per group, matching and duplicate groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fingerprint, norm_company, norm_text, words
from ..functions.urls import url_key
from .lineage import cut
from .spread import spread_join

ARCHIVED = ["DUPLICATE", "EXPIRED"]


def dedupe_first(df: DataFrame, key: Column, order: list) -> DataFrame:
    """WIN-1: the first row of each key; rows with an empty key all stay."""
    keyed = df.withColumn("_k", F.coalesce(key, F.lit("")))
    w = Window.partitionBy("_k").orderBy(*order)
    firsts = keyed.where("_k != ''").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return firsts.unionByName(keyed.where("_k = ''")).drop("_k")


def dedupe_fingerprint(df: DataFrame, order: list) -> DataFrame:
    """WIN-2: the first row of each title and company; rows without pass."""
    return dedupe_first(df, fingerprint(F.col("title"), F.col("company")), order)


def cap_per_group(df: DataFrame, keys: list[str], n: int, order: list) -> DataFrame:
    """WIN-3: at most n rows of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def fingerprint_index(jobs: DataFrame) -> DataFrame:
    """JON-3: the smallest id of each fingerprint."""
    found = jobs.select(fingerprint(F.col("title"), F.col("company")).alias("fp"), "id").groupBy("fp").agg(F.min("id").alias("id"), F.bool_or(F.col("fp") != "").alias("_real"))
    return found.where("_real").drop("_real")  # a test of fp itself would be moved below and make it twice


def match_ladder(df: DataFrame, jobs: DataFrame) -> DataFrame:
    """JON-2: adds ``job_id`` and ``tier``: fingerprint, then url; empty keys match nothing."""
    by_fp = fingerprint_index(jobs).withColumnRenamed("id", "_by_fp")
    by_url = jobs.select(F.lower(F.rtrim(F.col("url"), F.lit("/"))).alias("_url"), "id").where("_url != ''").groupBy("_url").agg(F.min("id").alias("_by_url"))
    df = df.withColumn("fp", fingerprint(F.col("title"), F.col("company")))
    df = df.join(by_fp, "fp", "left").join(by_url, F.col("url_key") == F.col("_url"), "left")
    tier = F.when(F.col("_by_fp").isNotNull(), "fingerprint").when(F.col("_by_url").isNotNull(), "url").otherwise("new")
    return df.withColumn("job_id", F.coalesce("_by_fp", "_by_url")).withColumn("tier", tier).drop("_by_fp", "_by_url", "_url")


def edit_collisions(jobs: DataFrame, edits: DataFrame) -> DataFrame:
    """JON-10: edits (job_id, title, company) that land on another job's fingerprint."""
    fp = fingerprint(F.col("title"), F.col("company")).alias("fp")
    keyed = jobs.select(fp, "id")
    held = keyed.groupBy("fp").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.bool_or(F.col("fp") != "").alias("_real")).where("_real").drop("_real")
    met = edits.select("job_id", fp).join(held, "fp")
    first = met.where("low != job_id").select("job_id", F.col("low").alias("other_id"))
    # an edit of the job with the smallest id meets the next one; there is one such job a fingerprint
    own = met.where("low = job_id and high != job_id").select("fp", "job_id").distinct()
    after = keyed.join(own, "fp").where("id != job_id").groupBy("job_id").agg(F.min("id").alias("other_id"))
    return first.unionByName(after).groupBy("job_id").agg(F.min("other_id").alias("other_id"))


def exact_groups(jobs: DataFrame) -> DataFrame:
    """DUP-1: key, size and smallest id of titles and companies held more than once."""
    live = jobs.where(~F.col("status").isin(ARCHIVED)).select("id", F.concat_ws("|", norm_company(F.col("company")), norm_text(F.col("title"))).alias("key"))
    return live.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first_id")).where("size > 1")


def default_keeper(jobs: DataFrame) -> DataFrame:
    """WIN-4: the job to keep of each exact group: best status, earliest scraped, smallest id."""
    live = jobs.where(~F.col("status").isin(ARCHIVED)).withColumn("key", F.concat_ws("|", norm_company(F.col("company")), norm_text(F.col("title"))))
    rank = F.when(F.col("status") == "APPLIED", 0).when(F.col("status") == "REVIEWED", 1).when(F.col("status") == "NEW", 2).otherwise(3)
    best = live.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min_by("id", F.struct(rank, F.col("scraped_at").isNull(), "scraped_at", "id")).alias("keeper"))
    return best.where("size > 1")


def title_classes(jobs: DataFrame) -> DataFrame:
    """Live jobs by normal company and title: (company, title, first_id, size, words); either empty: left out."""
    live = jobs.where(~F.col("status").isin(ARCHIVED)).select("id", norm_company(F.col("company")).alias("company"), norm_text(F.col("title")).alias("title"))
    classes = live.where("company != '' and title != ''").groupBy("company", "title").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("size"))
    return classes.withColumn("words", F.array_distinct(words(F.col("title"))))


def fuzzy_pairs(jobs: DataFrame, overlap: float = 0.6, most: int = 1000) -> DataFrame:
    """JON-11: (a, b, subset): pairs of titles of one company whose words are subsets or overlap enough.

    Copies of a title are one class, named by its smallest id. Candidates share a rare word:
    a subset holds the rarest word of the smaller title, and titles that overlap by a share t of
    the larger one share one of the n - ceil(t * n) + 1 rarest words of each, and are not further apart in length than t. A word of a company
    that more than ``most`` titles hold is cut into parts of about that many; the other side goes to each part.
    """
    classes = title_classes(jobs).select(F.col("first_id").alias("id"), F.col("company").alias("c"), F.col("words").alias("t"), F.size("words").alias("n"))
    each = cut(classes.withColumn("w", F.explode("t")).withColumn("k", F.xxhash64("c", "w")))
    often = each.groupBy("k").agg(F.count(F.lit(1)).alias("often"))  # only orders words and sizes parts, so a chance meeting of hashes is no matter
    place = F.row_number().over(Window.partitionBy("id").orderBy("often", "w"))
    each = spread_join(each, often, "k").drop("k").withColumn("at", place).withColumn("first", F.col("at") <= F.col("n") - F.ceil(F.col("n") * F.lit(overlap)) + 1)
    parts = F.ceil(F.col("often") / F.lit(most)).cast("int")
    probe = each.where("first or at = 1").select("c", "w", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), *[F.col(x).alias(f"{x}1") for x in ("id", "t", "n", "at", "first")])
    index = each.select("c", "w", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), *[F.col(x).alias(f"{x}2") for x in ("id", "t", "n", "first")])
    near = (F.least("n1", "n2") >= F.lit(overlap) * F.greatest("n1", "n2")) & F.col("first1") & F.col("first2")
    met = probe.join(index, ["c", "w", "part"]).where((F.col("id1") != F.col("id2")) & (F.expr("at1 = 1 and n1 <= n2") | near))
    pairs = met.select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b"), F.size(F.array_intersect("t1", "t2")).alias("k"), F.least("n1", "n2").alias("low"), F.greatest("n1", "n2").alias("high"))
    subset = F.col("k") == F.col("low")
    return pairs.where(subset | (F.col("k") >= F.lit(overlap) * F.col("high"))).dropDuplicates(["a", "b"]).select("a", "b", subset.alias("subset"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each end of the edges (a, b) can reach.

    Alternating stars: the larger neighbours of each id are tied to the smallest id next to it, then the
    smaller ones, until every id is tied to its component's smallest. Chains halve, so rounds grow with the logarithm of
    their length; a hub's edges move to its smallest neighbour and are never one task's group: an id with more than a
    thousandth of the edges gets its minimum by broadcast. Each round is a checkpoint.
    """
    up, down = F.greatest("a", "b"), F.least("a", "b")
    now = cut(edges.where("a != b").select(up.alias("u"), down.alias("v")).distinct())
    while True:
        total = now.count()
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = cut(spread_join(both.where("v > u"), low, "u", total).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, low, "u", total).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = cut(small.distinct())
        roots = now.select("v").distinct()
        # done when no id is tied twice and none that others are tied to is tied itself
        if not now.select("u").unionByName(roots.withColumnRenamed("v", "u")).groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select(F.col("v").alias("id"), F.col("v").alias("component")))


def fuzzy_groups(jobs: DataFrame, overlap: float = 0.6) -> DataFrame:
    """DUP-2: (id, group_id, size, likely) of each job in a group of nearly equal titles of one company.

    A group is a component of fuzzy pairs with all copies of its titles; likely if every
    link is one of subsets.
    """
    pairs = cut(fuzzy_pairs(jobs, overlap))
    member = components(pairs)
    likely = pairs.join(member, pairs["a"] == member["id"]).groupBy("component").agg(F.bool_and("subset").alias("likely"))
    classes = title_classes(jobs).join(member, F.col("first_id") == member["id"]).drop("id")
    sizes = classes.groupBy("component").agg(F.sum("size").alias("size")).join(likely, "component")
    live = jobs.where(~F.col("status").isin(ARCHIVED)).select("id", norm_company(F.col("company")).alias("company"), norm_text(F.col("title")).alias("title"))
    return live.join(classes.select("company", "title", "component"), ["company", "title"]).join(sizes, "component").select("id", F.col("component").alias("group_id"), "size", "likely")


def dupe_summary(groups: DataFrame) -> DataFrame:
    """AGG-11: one row (groups, rows, surplus) of groups with a size."""
    total = F.coalesce(F.sum("size"), F.lit(0))
    return groups.agg(F.count(F.lit(1)).alias("groups"), total.alias("rows"), (total - F.count(F.lit(1))).alias("surplus"))


def flag_known(df: DataFrame, jobs: DataFrame) -> DataFrame:
    """JON-1: adds ``known``: whether a stored job has the row's url key; an empty key is never known."""
    stored = jobs.select(url_key(F.col("url")).alias("_key")).where("_key != ''").distinct().withColumn("known", F.lit(True))
    return df.withColumn("_key", url_key(F.col("job_url"))).join(stored, "_key", "left").drop("_key").withColumn("known", F.coalesce("known", F.lit(False)))
