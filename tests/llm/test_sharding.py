"""Minimax sharding against dynamic programming over the ordered groups."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import sharding
from millrace.llm.common import read_table


def least_capacity(sizes, shards):
    """Smallest possible size of the largest of ``shards`` contiguous parts, by trying every last cut."""
    total = [0]
    for x in sizes:
        total.append(total[-1] + x)
    best = total[:]
    for _ in range(shards - 1):
        best = [0] + [min(max(best[j], total[i] - total[j]) for j in range(i)) for i in range(1, len(total))]
    return best[-1]


def check(df, shards, **options):
    got = sharding.shard(df, shards, **options).collect()
    want = [(r["doc_id"], r["text"] or "", r["h"]) for r in df.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).collect()]
    size = lambda t: len(t.encode()) + 16
    plain = lambda rows: sorted((-1 if i is None else i, s, c) for i, s, c in rows)
    assert plain((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == plain((i, size(t), zlib.crc32(t.encode())) for i, t, _ in want)
    groups, place = {}, {}
    for _, t, h in want:
        groups[h] = groups.get(h, 0) + size(t)
    by_shard = {}
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        by_shard.setdefault(r["shard"], []).append(r)
        place.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert all(len(s) == 1 for s in place.values())
    assert all(sorted(r["slot"] for r in rows) == list(range(len(rows))) for rows in by_shard.values())
    if got:
        assert max(sum(r["size"] for r in rows) for rows in by_shard.values()) == least_capacity([groups[h] for h in sorted(groups)], shards)
    return by_shard


@pytest.mark.parametrize("bits", [1, 4, 13])
def test_largest_shard_is_the_least_possible(spark, bits):
    rng = random.Random(bits)
    texts = [f"t{i} " + "x" * rng.choice((0, 5, 50, 700)) for i in range(60)]
    rows = [(i, rng.choice(texts)) for i in range(200)] + [(None, texts[0]), (7, None), (7, None), (7, ""), (8, "\u00e9" * 30), (8, "\u00e9" * 30)]
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], "doc_id long, text string, shard string, hash string")
    check(df, 7, bits=bits, step=2, slot_rows=16)
    assert sharding.shard(df.limit(0), 7).count() == 0


def test_a_giant_group_and_fewer_groups_than_shards(spark):
    rows = [(i, "very common " * 40) for i in range(300)] + [(1000 + i, f"rare {i}") for i in range(5)]
    by_shard = check(spark.createDataFrame(rows, "doc_id long, text string"), 40, bits=2, slot_rows=32)
    assert len(by_shard) <= 6


def test_the_given_documents(spark):
    check(read_table(spark, "/root/testdata/sf0.001", "documents"), 40, bits=2, step=3)


def test_search_over_cells_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(300):
        sizes = [rng.randint(1, rng.choice((5, 100))) for _ in range(rng.randint(1, 25))]
        shards = rng.randint(1, 8)
        capacity = sharding.smallest_capacity(sizes, shards)
        assert capacity == least_capacity(sizes, shards)
        cuts = [0, *sharding.cut_points(sizes, shards), len(sizes)]
        assert cuts == sorted(cuts) and len(cuts) == shards + 1
        assert max(sum(sizes[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)) == capacity
