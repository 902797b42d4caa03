"""Contiguous minimax sharding with DataFrame functions only.

Documents are put in order of a hash of their text. Equal texts are one atomic group and
are never parted. The smallest capacity at which the ordered groups fit into the
shards is found by binary search with a greedy check, and the order is cut there, each
shard filled as close to an even share as that capacity and the shards that remain allow.

The driver never holds all groups. It starts with sums over ranges of the hash and
searches twice: with ranges that can't be parted (a capacity that is enough) and with
ranges that can be parted anywhere (a capacity that is needed). Where both differ, the
ranges in which a cut may fall are parted further, until both agree; in the end such
ranges hold one group each. So the capacity is the least over all groups, whatever
their number. A round brings the driver about ``shards ** 2 / 2`` ranges times ``2 ** step`` rows,
and there are at most 64 / ``step`` rounds; neither grows with the data.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


class Cell(NamedTuple):
    """A range of hashes: its first hash, how many bits it leaves open, bytes, rows, groups."""

    first: int
    shift: int
    bytes: int
    rows: int
    groups: int


def ends(total: list[int], whole: list[bool], capacity: int, shards: int) -> list[int]:
    """How many bytes 1, 2, ... greedily filled shards hold, where only cells that aren't ``whole`` may be parted.

    ``total`` are the running sums of the cells, from 0 on.
    """
    at, out = 0, []
    for _ in range(shards):
        reach = at + capacity
        if reach >= total[-1]:
            at = total[-1]
        else:
            cell = bisect_right(total, reach) - 1  # total[cell] <= reach < total[cell + 1]
            at = max(at, total[cell] if whole[cell] else reach)
        out.append(at)
    return out


def smallest(total: list[int], whole: list[bool], shards: int) -> int:
    """The smallest capacity with which the greedy check fills at most ``shards`` shards."""
    low, high = -(-total[-1] // shards), total[-1]
    while low < high:
        middle = (low + high) // 2
        if ends(total, whole, middle, shards)[-1] == total[-1]:
            high = middle
        else:
            low = middle + 1
    return low


def smallest_capacity(sizes: list[int], shards: int) -> int:
    return smallest([0, *accumulate(sizes)], [True] * len(sizes), shards)


def open_cells(cells: list[Cell], shards: int) -> list[Cell]:
    """The cells of several groups in which a cut at the least capacity may fall; none if that capacity is known."""
    total = [0, *accumulate(c.bytes for c in cells)]
    alone = [c.groups < 2 for c in cells]
    enough, needed = smallest(total, [True] * len(cells), shards), smallest(total, alone, shards)
    if enough == needed:
        return []
    found: set[int] = set()
    for low, high in zip(ends(total, [True] * len(cells), needed, shards), ends(total, alone, enough, shards), strict=True):
        found.update(range(max(0, bisect_right(total, low) - 1), min(len(cells), bisect_right(total, high))))
    return [cells[i] for i in sorted(found) if not alone[i]]


def cut_points(sizes: list[int], shards: int) -> list[int]:
    """First cell of shards 1, 2, ...: no shard is above the smallest capacity, and each is near an even share of what is left."""
    capacity = smallest_capacity(sizes, shards)
    need, room = [0] * (len(sizes) + 1), 0
    for i in range(len(sizes) - 1, -1, -1):  # shards that the cells from i on need
        new = sizes[i] > room
        need[i] = need[i + 1] + new
        room = (capacity if new else room) - sizes[i]
    total, cuts, at = [0, *accumulate(sizes)], [], 0
    for left in range(shards, 1, -1):
        begin, share = at, (total[-1] - total[at]) / left
        while at < len(sizes) and total[at + 1] - total[begin] <= capacity:
            held = total[at] - total[begin]
            if need[at] <= left - 1 and held and held + sizes[at] / 2 > share:
                break
            at += 1
        cuts.append(at)
    return cuts


def _cells(groups: DataFrame, shift: int) -> list[Cell]:
    """The groups' ranges with ``shift`` open bits, in order."""
    key = F.shiftright("hash", shift)
    found = groups.groupBy(key.alias("key")).agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("groups")).collect()
    return sorted(Cell(r["key"] << shift, shift, r["bytes"], r["rows"], r["groups"]) for r in found)


def ordered_cells(groups: DataFrame, shards: int, bits: int, step: int) -> list[Cell]:
    """Cells of (hash, bytes, rows), parted as far as the least capacity needs."""
    cells = _cells(groups, 64 - bits)
    while cells and (wanted := open_cells(cells, shards)):
        by_shift: dict[int, list[Cell]] = {}
        for c in wanted:
            by_shift.setdefault(c.shift, []).append(c)
        new = []
        for shift, some in by_shift.items():
            keys = groups.sparkSession.createDataFrame([(c.first >> shift,) for c in some], "key long")
            new += _cells(groups.join(F.broadcast(keys), F.shiftright("hash", shift) == F.col("key"), "left_semi"), max(0, shift - step))
        cells = sorted(set(cells).difference(wanted).union(new))
    return cells


def shard(docs: DataFrame, shards: int = 40, bits: int = 13, step: int = 6, slot_rows: int = 1 << 14, overhead: int = 16) -> DataFrame:
    """Puts every document into one of ``shards`` shards of near equal bytes.

    Returns doc_id, size (UTF-8 bytes of the text plus ``overhead``), text_crc32,
    law ("bytes"), shard, slot (gapless from 0 in each shard) and grown_shard (null:
    the law is not by key). The largest shard is as small as cuts between groups of equal texts
    allow in this order. The search starts with ``2 ** bits`` ranges; slots are dealt
    in parts of about ``slot_rows`` rows by a hash of id and text, so a very common text spreads over tasks.

    Defined cases: a null text has the size and checksum of an empty one and lies
    with empty texts; repeated rows and ids each get a row and slot of their own; ids
    may be null; a table without rows gives none; fewer groups than shards leave
    shards empty. Extra columns are ignored. A group of equal texts larger than an
    even share makes a shard of its own as large as it must be.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stored(docs.select(F.col("doc_id"), (F.octet_length(text).cast("long") + overhead).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("hash")))
    groups = stored(rows.groupBy("hash").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")))
    cells = ordered_cells(groups, shards, bits, step)
    cuts = cut_points([c.bytes for c in cells], shards)
    number, parts = F.lit(0), F.lit(1)
    for c in cuts:
        number = number + (F.col("hash") >= F.lit(cells[c].first)).cast("int") if c < len(cells) else number
    for n, (i, j) in enumerate(zip([0, *cuts], [*cuts, len(cells)], strict=True)):
        parts = F.when(F.col("shard") == n, F.lit(1 + sum(c.rows for c in cells[i:j]) // slot_rows)).otherwise(parts)
    placed = rows.withColumn("shard", number).withColumn("part", F.pmod(F.xxhash64("doc_id", "hash"), parts))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")  # a row for each slot_rows rows
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32")
    placed = placed.withColumn("at", F.row_number().over(within)).join(F.broadcast(starts), ["shard", "part"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), (F.col("base") + F.col("at") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
