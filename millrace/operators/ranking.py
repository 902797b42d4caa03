"""The best postings of each of many profiles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.experience import demands
from ..functions.text import quals_section
from .lineage import cut
from .scoring import BASE, MATCH_CAP, MISSING_CAP, PER_MATCH, PER_MISSING, SENIOR_COST, SKILLS, flatten_profiles, penalty
from .spread import spread_join

#: Skills in a word of a mask; a signed long has 63 bits.
BITS = 62
#: Parts that a class of postings is cut into before its first ids are found.
PARTS = 16
_FOUND = "own string, found array<struct<score: int, id: bigint>>"


_automata: dict[tuple, tuple] = {}


def _aliases(entries: tuple[tuple[str, ...], ...]) -> tuple:
    """(automaton over all aliases, bits of those that every text holds), built once a worker; its values are the skills as bits of one number."""
    if entries not in _automata:
        import ahocorasick

        automaton, bits = ahocorasick.Automaton(), {}
        for i, aliases in enumerate(entries):
            for alias in aliases:
                bits[alias] = bits.get(alias, 0) | 1 << i
        always = bits.pop("", 0)
        for alias, value in bits.items():
            automaton.add_word(alias, value)
        automaton.make_automaton()
        _automata[entries] = automaton, always
    return _automata[entries]


def masks(c: Column, lexicon: dict[str, list[str]]) -> Column:
    """The skills mentioned in a text as bits, in words of 62; null is a text without any. A text is read once, whatever the number of aliases."""
    entries = tuple(tuple(aliases) for aliases in lexicon.values())
    words, all_bits = range(0, len(entries), BITS), (1 << BITS) - 1

    @F.arrow_udf("array<bigint>")
    def read(text: pa.Array) -> pa.Array:
        automaton, always = _aliases(entries)
        out = []
        for t in text:
            found = always
            if len(automaton):
                for _, bits in automaton.iter(t.as_py()):
                    found |= bits
            out.append([found >> i & all_bits for i in words])
        return pa.array(out, pa.list_(pa.int64()))

    return read(F.lower(F.coalesce(c, F.lit(""))))


def _classes(postings: DataFrame, patterns: DataFrame, n: int, lexicon: dict[str, list[str]]) -> DataFrame:
    """Postings that score the same against any profile: (asked, named, own, ids, top, first, code), ids the n smallest.

    ``own`` is what a posting scores by itself, ``top`` the most that it can score, ``code`` orders what repeated ids leave tied. A class of any size is cut into parts first, and
    each task keeps n rows of a part before the shuffle.
    """
    df = penalty(postings.select(F.col("id").cast("long").alias("id"), "title", "company", "description").where("id is not null"), patterns)
    df = df.withColumn("_quals", quals_section(F.col("description"))).withColumn("_demands", demands(F.col("description")))
    evidence = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.when(F.col("_quals") != "", F.col("_quals")).otherwise(F.coalesce("description", F.lit(""))))
    years = F.when(F.col("_demands.years") == 0, 10).when(F.col("_demands.years") == 1, 5).otherwise(0)
    alone = years - F.when(F.col("_demands.senior").isNotNull(), SENIOR_COST).otherwise(0) + F.col("penalty")
    df = df.select("id", masks(evidence, lexicon).alias("asked"), masks(F.col("_quals"), lexicon).alias("named"), alone.cast("int").alias("own"))
    key = ["asked", "named", "own"]
    df = df.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(PARTS)))
    for by in ([*key, "_part"], key):
        df = df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("_n") <= n)
    df = df.groupBy(*key).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    bits = lambda c: F.aggregate(c, F.lit(0), lambda s, w: s + F.bit_count(w))
    best = F.lit(BASE) + F.least((bits("asked") + bits("named")) * PER_MATCH, F.lit(MATCH_CAP)) + F.col("own")
    df = df.withColumn("top", F.greatest(F.lit(0), F.least(F.lit(100), best)).cast("int")).withColumn("first", F.col("ids")[0])
    return df.withColumn("code", F.xxhash64(*key))


class _Shard:
    """Classes in descending order of what they can score, then by first id."""

    def __init__(self, rows: pd.DataFrame) -> None:
        rows = rows.sort_values(["top", "first"], ascending=[False, True])
        self.asked, self.named = (np.array(rows[c].tolist(), np.int64).reshape(len(rows), -1).view(np.uint64) for c in ("asked", "named"))
        self.own, self.top, self.first = (rows[c].to_numpy(np.int64) for c in ("own", "top", "first"))
        self.ids, self.sizes = [np.asarray(x, np.int64) for x in rows["ids"]], np.array([len(x) for x in rows["ids"]], np.int64)
        self.n_asked = np.bitwise_count(self.asked).sum(1, dtype=np.int64)

    def scores(self, own: np.ndarray, at: slice) -> np.ndarray:
        met, twice = (np.bitwise_count(m[at] & own).sum(1, dtype=np.int64) for m in (self.asked, self.named))
        points = np.minimum((met + twice) * PER_MATCH, MATCH_CAP) - np.minimum((self.n_asked[at] - met) * PER_MISSING, MISSING_CAP)
        return np.clip(BASE + points + self.own[at], 0, 100)

    def best(self, own: np.ndarray, n: int, floor: tuple[int, int] | None, step: int) -> list[tuple[int, int]]:
        """The n best (score, id), as (-score, id); only such as come before ``floor``, the nth known elsewhere."""
        found: list[tuple[int, int]] = []
        for start in range(0, len(self.own), step):
            if floor and (-int(self.top[start]), int(self.first[start])) > floor:
                break  # all that follows can score no more, or the same with a larger id
            scores = self.scores(own, slice(start, start + step))
            held = np.bincount(scores, self.sizes[start : start + step], 101)[::-1].cumsum()
            least = max(100 - int(np.searchsorted(held, n)), -floor[0] if floor else 0)  # the nth score of this step, or the floor's
            above, level = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
            if len(level) > n:
                level = level[np.argpartition(self.first[start + level], n - 1)[:n]]  # others have n smaller ids before them
            new = [(-int(scores[i]), int(x)) for i in (*above, *level) for x in self.ids[start + i]]
            found = sorted([*found, *(f for f in new if not floor or f < floor)])[:n]
            if len(found) == n:
                floor = found[-1]
        return found


def _own(text: str) -> np.ndarray:
    return np.array([int(w) for w in text.split(",")], np.int64).view(np.uint64)


def top_postings(profiles: DataFrame, postings: DataFrame, patterns: DataFrame, n: int = 50, lexicon: dict[str, list[str]] | None = None, head: int = 4096, shard: int = 32768, block: int = 1024, step: int = 4096) -> DataFrame:
    """SRC-10 with SCO-1: (profile_id, rank, id, score), the n best postings of each profile by score, ties to the smaller id.

    Scores are those of ``scoring.score``. Skills are bits, so a pair is scored by counting bits. Postings that no profile can tell
    apart are one class, profiles with the same skills one query, and neither is ever paired with all of the other: the ``head``
    classes that can score most (a bounded broadcast) give each query its nth result so far, and with it a query visits only those
    shards of the other classes that can still beat it, best first, stopping inside a shard as soon as nothing can. Shards of ``shard``
    classes meet ``block`` queries a task. Postings without an id take no part; a repeated id counts as often as it occurs;
    profiles without known skills are queries like others. With fewer than n postings all are returned.
    """
    lexicon = lexicon or SKILLS
    classes = cut(_classes(postings, patterns, n, lexicon))
    owners = cut(flatten_profiles(profiles).select("profile_id", F.array_join(masks(F.col("text"), lexicon).cast("array<string>"), ",").alias("own")))
    queries = cut(owners.select("own").distinct())
    tasks = max(owners.sparkSession.sparkContext.defaultParallelism, math.ceil(queries.count() / block))
    first = classes.orderBy(F.col("top").desc(), "first", "code").limit(head).toPandas()  # at most ``head`` rows of n ids
    held = profiles.sparkSession.sparkContext.broadcast(first)

    def in_head(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = _Shard(held.value) if len(held.value) else None
        for part in parts:
            hits = [[(-s, i) for s, i in index.best(_own(o), n, None, step)] if index else [] for o in part["own"]]
            yield pd.DataFrame({"own": part["own"], "found": hits})

    best = cut(queries.repartition(tasks, "own").mapInPandas(in_head, _FOUND))
    total = classes.count()
    if total > head:
        best = _beyond(best, classes, first, total, n, shard, block, step)
    out = spread_join(owners, best, "own")
    out = out.select("profile_id", F.posexplode("found").alias("rank", "_hit"))
    return out.select("profile_id", (F.col("rank") + 1).alias("rank"), F.col("_hit.id").alias("id"), F.col("_hit.score").alias("score"))


def _beyond(best: DataFrame, classes: DataFrame, first: pd.DataFrame, total: int, n: int, shard: int, block: int, step: int) -> DataFrame:
    """The results of the head with those of the shards that can beat them."""
    last = first.iloc[-1]
    rest = classes.where(F.struct(-F.col("top"), "first", "code") > F.struct(F.lit(-int(last["top"])), F.lit(int(last["first"])).cast("long"), F.lit(int(last["code"])).cast("long")))
    shards = max(1, math.ceil((total - len(first)) / shard))
    rest = cut(rest.repartitionByRange(shards, F.col("top").desc(), F.col("first")).withColumn("shard", F.spark_partition_id()))
    tops = rest.groupBy("shard").agg(F.min(F.struct((-F.col("top")).alias("s"), F.col("first").alias("id"))).alias("key"))
    nth = F.when(F.size("found") >= n, F.struct((-F.col("found")[n - 1]["score"]).alias("s"), F.col("found")[n - 1]["id"].alias("id")))
    blocks = max(1, math.ceil(best.count() / block))
    asks = best.select("own", nth.alias("floor"), F.pmod(F.xxhash64("own"), F.lit(blocks)).alias("block"))
    keys = F.broadcast(tops.agg(F.collect_list(F.struct("shard", "key")).alias("_tops")))  # a row a shard
    asks = asks.join(keys).withColumn("shard", F.explode(F.filter("_tops", lambda t: F.col("floor").isNull() | (t["key"] <= F.col("floor"))))).select("own", F.col("floor.s").alias("s"), F.col("floor.id").alias("floor_id"), "block", F.col("shard.shard").alias("shard"))
    asks = cut(asks)
    met = asks.select(F.col("shard").alias("at"), F.col("block").alias("of")).distinct()
    copies = rest.join(met, F.col("shard") == F.col("at")).drop("shard")
    def in_shard(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        index = _Shard(rows)
        out = []
        for own, s, i in zip(asked["own"], asked["s"], asked["floor_id"], strict=True):
            out += [(own, -a, b) for a, b in index.best(_own(own), n, None if pd.isna(s) else (int(s), int(i)), step)]
        return pd.DataFrame(out, columns=["own", "score", "id"])

    found = asks.groupBy("shard", "block").cogroup(copies.groupBy("at", "of")).applyInPandas(in_shard, "own string, score int, id bigint")
    both = found.unionByName(best.select("own", F.inline_outer("found").alias("score", "id")).where("id is not null"))
    both = both.withColumn("_n", F.row_number().over(Window.partitionBy("own").orderBy(F.col("score").desc(), "id"))).where(F.col("_n") <= n)
    ranked = both.groupBy("own").agg(F.sort_array(F.collect_list(F.struct("_n", "score", "id"))).alias("found"))
    return ranked.select("own", F.transform("found", lambda x: F.struct(x["score"].alias("score"), x["id"].alias("id"))).alias("found"))
