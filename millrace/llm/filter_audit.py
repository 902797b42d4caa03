"""Audit of how filters interact over all orders in which they can be applied.

Each document has a mask of the filters that it fails. For a mask, the step of an order at which the
document goes depends on a prefix of the order alone, and the orders with one prefix have
consecutive ranks when all orders are sorted (the Lehmer code is the rank's digits). So each mask and step has
a few intervals of ranks. A difference array per part and step takes the mask's counts at the intervals'
first ranks and their negatives after the last, and its prefix sums over the ranks are what each order removes.

Documents are only counted by part and mask; what follows is a few hundred rows a part.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

WORD, SPECIAL = r"[^\x20\x09-\x0D]+", r"[#$%&*|]"
FILTERS = "ABCDE"
_COUNTS = ("removed", "good_lost", "toxic_lost")


def orders(filters: str) -> list[str]:
    """All orders by rank."""
    return ["".join(p) for p in permutations(sorted(filters))]


def rank(prefix: tuple[int, ...], n: int) -> int:
    """The first rank of the orders of n filters that start with these: its Lehmer code in the factorial system."""
    left, out = list(range(n)), 0
    for i, x in enumerate(prefix):
        out += left.index(x) * factorial(n - 1 - i)
        left.remove(x)
    return out


def intervals(mask: int, n: int) -> list[tuple[int, int, int]]:
    """(step from 1, first rank, last rank + 1) of the orders in which documents of the mask go at that step."""
    passed = [i for i in range(n) if not mask >> i & 1]
    failed = [i for i in range(n) if mask >> i & 1]
    found = []
    for before in range(len(passed) + 1 if failed else 0):
        for prefix in permutations(passed, before):
            for x in failed:
                first = rank((*prefix, x), n)
                found.append((before + 1, first, first + factorial(n - 1 - before)))
    merged: list[tuple[int, int, int]] = []
    for step, first, end in sorted(found):
        if merged and merged[-1][0] == step and merged[-1][2] == first:
            merged[-1] = (step, merged[-1][1], end)
        else:
            merged.append((step, first, end))
    return merged


def conditions(text: Column) -> list[Column]:
    """Whether a text that is not null fails the filters A to D (E needs the other texts)."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [n < 50, 100 * F.size(F.array_distinct(words)) < 65 * n, 100 * capitals.cast("long") > 5 * F.length(text).cast("long"), text.rlike(SPECIAL)]


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents by part and mask: part, mask, n, good, toxic.

    Texts are read once, into a table of ids and digests. Copies meet as one minimum a digest, which goes back to the
    row of that id alone, so a text of a third of all rows is no group anywhere.
    """
    text = F.coalesce("text", F.lit(""))
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions(F.col("_text")))]
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("_text"))
    rows = plain.select("doc_id", "part", F.sha2("_text", 256).alias("digest"), sum(bits[1:], bits[0]).alias("mask"))
    rows = stored(rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n")), compression="zstd")
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    later = F.col("first").isNull() & F.col("doc_id").isNotNull()
    marks = labels.where("quality = 1 or toxic = 1").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    rows = rows.join(first, ["digest", "doc_id"], "left").join(marks, "doc_id", "left").withColumn("mask", F.col("mask") + F.when(later, 16).otherwise(0))
    of = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).alias(c)
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def audit(spark: SparkSession, counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """All orders and steps of each part, from documents counted by part and mask."""
    n, every = len(filters), orders(filters)
    ends = [(m, step, at, sign) for m in range(1 << n) for step, first, end in intervals(m, n) for at, sign in ((first, 1), (end, -1))]
    # fixed tables: the ends of all intervals, and a row for each rank and step
    ends = spark.createDataFrame(ends, "mask int, step int, rank int, sign int")
    grid = spark.createDataFrame([(r, s + 1, filters.index(o[s]), o) for r, o in enumerate(every) for s in range(n)], "rank int, step int, filter int, filter_order string")
    counts = stored(counts)
    changes = counts.join(F.broadcast(ends), "mask").groupBy("part", "step", "rank").agg(
        F.sum(F.col("sign") * F.col("n")).alias("removed"), F.sum(F.col("sign") * F.col("good")).alias("good_lost"), F.sum(F.col("sign") * F.col("toxic")).alias("toxic_lost")
    )
    bit = lambda i: F.col("mask").bitwiseAND(1 << i) > 0
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    parts = counts.groupBy("part").agg(F.sum("n").alias("total"), F.array(*[of(bit(i)) for i in range(n)]).alias("fails"), F.array(*[of(F.col("mask") == 1 << i) for i in range(n)]).alias("only"))
    steps = F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(("rank", "step"), (r, s + 1), strict=True)]) for r in range(len(every)) for s in range(n)])
    rows = parts.withColumn("_at", F.explode(steps)).select("*", "_at.*").drop("_at").join(F.broadcast(grid), ["rank", "step"]).join(changes, ["part", "step", "rank"], "left")
    ranks = Window.partitionBy("part", "step").orderBy("rank")
    sums = rows.select("part", "total", "fails", "only", "rank", "step", "filter", "filter_order", *[F.sum(F.coalesce(c, F.lit(0))).over(ranks).alias(c) for c in _COUNTS])
    so_far = F.sum("removed").over(Window.partitionBy("part", "rank").orderBy("step"))
    sums = sums.withColumn("kept", F.col("total") - so_far).withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))
    at = F.col("filter")
    return sums.select(
        "part", "filter_order", "step", "kept", "removed", (F.get("fails", at) - F.col("removed")).alias("redundant"), F.get("only", at).alias("unique_fails"), "good_lost", "toxic_lost", "shapley"
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What five filters remove from ``docs`` in each of their 120 orders, by source.

    Returns part, filter_order, step, and counts of documents: kept (after the step), removed (at it), redundant
    (failing its filter, removed before), unique_fails (failing its filter alone), good_lost and toxic_lost (removed at
    it with quality or toxic 1), shapley (removed by its filter over all orders).

    Filters, on whole texts: A under 50 words; B 100 * distinct words < 65 * words; C 100 * capitals > 5 * code points;
    D any of ``#$%&*|``; E equal to the text of a smaller id.

    Defined cases: a null text is empty and fails A (and E after a smaller id with an empty text); a null source is the part ''; rows
    with a null id are never later copies and make none; rows that share an id count each, and none of them is the other's
    copy; where labels repeat an id, one row with 1 is enough; documents without labels are neither good nor toxic; a table
    without rows gives none; extra columns are ignored.
    """
    return audit(docs.sparkSession, masks(docs, labels))
