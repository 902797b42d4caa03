"""Matching of any number of rules in one pass over the rows.

Phrases are substrings, so they go into an Aho-Corasick automaton that reads each title once
whatever their number; words, places, companies and skills are looked up in sets. Both are built once in each
Python worker from a broadcast shard of the rules. A shard holds at most about ``SHARD_BYTES`` of values; where there are more,
one shard after another runs over the rows, with a checkpoint between, so a worker never holds two.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut

KINDS = ["keyword", "location", "company", "skill", "phrase"]
SHARD_BYTES = 1 << 25
_HITS = "struct<" + ", ".join(f"{k}: array<string>" for k in KINDS) + ">"
_built: dict[str, tuple] = {}


class Phrases:
    """An Aho-Corasick automaton over phrases."""

    def __init__(self, values: list[str]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for v in values:
            self.automaton.add_word(v, v)
        self.automaton.make_automaton()

    def inside(self, text: str | None) -> list[str]:
        """The phrases that the text holds, each once, sorted."""
        return sorted({v for _, v in self.automaton.iter(text)}) if text and len(self.automaton) else []


def _matchers(shard) -> tuple[dict[str, set], Phrases]:
    """Sets and automaton of a broadcast shard, built once a worker; one shard is held at a time."""
    if shard.value["number"] not in _built:
        _built.clear()
        _built[shard.value["number"]] = {k: set(shard.value[k]) for k in KINDS[:-1]}, Phrases(shard.value["phrase"])
    return _built[shard.value["number"]]


def _lists(n: int, rows: np.ndarray, values: pa.Array) -> pa.Array:
    """n lists; ``values`` are in the order of the rows that hold them."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _among(lists: pa.Array, known: set) -> pa.Array:
    """Of each list the known values, each once, sorted. A value is looked up once, however many rows of the batch hold it."""
    parents, values = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_flatten(lists).dictionary_encode()
    names = values.dictionary.to_pylist()
    met = sorted(v for v in names if v in known)
    place = {v: i for i, v in enumerate(met)}
    places = np.array([place.get(v, -1) for v in names] + [-1], np.int64)[values.indices.fill_null(len(names)).to_numpy(zero_copy_only=False)]
    keep = places >= 0
    pairs = np.unique(parents[keep] * max(1, len(met)) + places[keep])
    return _lists(len(lists), pairs // max(1, len(met)), pa.array(met, pa.string()).take(pa.array(pairs % max(1, len(met)))))


def _inside(texts: pa.Array, phrases: Phrases) -> pa.Array:
    """The phrases that each text holds; equal texts of a batch are read once."""
    coded = texts.dictionary_encode()
    found = pa.array([phrases.inside(t) for t in coded.dictionary.to_pylist()] + [[]], pa.list_(pa.string()))
    return found.take(coded.indices.fill_null(len(coded.dictionary)))


def _matcher(shard):
    @F.arrow_udf(_HITS)
    def match(keyword: pa.Array, location: pa.Array, company: pa.Array, skill: pa.Array, text: pa.Array) -> pa.Array:
        sets, phrases = _matchers(shard)
        found = [_among(a, sets[k]) for k, a in zip(KINDS, (keyword, location, company, skill), strict=False)]
        return pa.StructArray.from_arrays([*found, _inside(text, phrases)], KINDS)

    return match


def rule_hits(df: DataFrame, patterns: DataFrame, values: dict[str, Column], text: Column | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Adds ``_hits``, a struct of sorted arrays by kind: the rules (kind, value) met by each row.

    ``values`` gives the row's values by kind (arrays of strings); a rule of that kind is met if it is among them. A phrase is met
    if it is a substring of ``text``. Empty and null rules are left out, a null is met by none.
    """
    spark = df.sparkSession
    rules = cut(patterns.where(F.col("kind").isin(KINDS) & (F.col("value") != "")).select("kind", "value").distinct())
    volume = rules.agg(F.sum(F.octet_length("value"))).first()[0] or 0
    shards = max(1, math.ceil(volume / shard_bytes))
    none = F.array().cast("array<string>")
    given = [values.get(k, none) for k in KINDS[:-1]] + [F.lit(None).cast("string") if text is None else text]
    df = df.withColumn("_given", F.struct(*[c.alias(k) for k, c in zip(KINDS, given, strict=True)]))
    for number in range(shards):
        held = {k: [] for k in KINDS}
        for kind, value in rules.where(F.pmod(F.xxhash64("value"), F.lit(shards)) == number).collect():  # about shard_bytes
            held[kind].append(value)
        found = _matcher(spark.sparkContext.broadcast(held | {"number": uuid.uuid4().hex}))(*[F.col(f"_given.{k}") for k in KINDS])
        df = df.withColumn("_new", found)
        if number:
            both = [F.sort_array(F.concat(F.col(f"_hits.{k}"), F.col(f"_new.{k}"))).alias(k) for k in KINDS]
            df = df.withColumn("_hits", F.struct(*both)).drop("_new")
        else:
            df = df.withColumnRenamed("_new", "_hits")
        if shards > 1:
            df = cut(df)
    return df.drop("_given")
