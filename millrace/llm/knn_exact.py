"""Exact top-k inner products with a KD-tree for each shard.

A shard's tree splits at the median of its widest coordinate down to small leaves and
keeps the tight bounding box of every node. The largest inner product a query can
have inside a box is q+ . high + q- . low. The search takes the node with the largest
bound first and stops when that bound is below the kth score so far, which is
carried from leaf to leaf. The bounds of all nodes are one matrix product for a batch
of queries, less than a hundredth of a scan's.

A query first asks the shard that holds its own row. The kth score found there goes
with it to all other shards: one whose whole box lies below is left at the root, and in
the others the search begins with it.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .vectors import Search, own_rows, saved, top, usable


def kd_tree(x: np.ndarray, leaf: int = 256) -> dict[str, np.ndarray]:
    """Rows in order of the leaves; of each node its range of rows, children (-1: none) and box."""
    order, low, high, rows, kids = np.arange(len(x)), [], [], [], []
    stack = [(0, len(x), -1, 0)]
    while stack:
        i, j, parent, side = stack.pop()
        node, part = len(rows), order[i:j]
        low.append(x[part].min(0))
        high.append(x[part].max(0))
        rows.append((i, j))
        kids.append([-1, -1])
        if parent >= 0:
            kids[parent][side] = node
        width = high[-1] - low[-1]
        axis = int(np.argmax(width))
        if j - i > leaf and width[axis] > 0:
            half = (j - i) // 2
            order[i:j] = part[np.argpartition(x[part, axis], half)]
            stack += [(i, i + half, node, 0), (i + half, j, node, 1)]
    return {"order": order, "low": np.array(low), "high": np.array(high), "rows": np.array(rows), "kids": np.array(kids)}


def bounds(tree: dict, q: np.ndarray) -> np.ndarray:
    """(queries x nodes) largest inner product possible inside each node's box."""
    return np.maximum(q, 0) @ tree["high"].T + np.minimum(q, 0) @ tree["low"].T


def best(tree: dict, q: np.ndarray, bound: np.ndarray, kth: float, own: int, k: int, looked: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k best rows but ``own`` that reach ``kth``; ``looked`` collects the leaves scanned."""
    found, scores = np.zeros(0, np.int64), np.zeros(0)
    heap, kids, rows = [(-bound[0], 0)], tree["kids"], tree["rows"]
    while heap and -heap[0][0] >= kth:
        _, node = heapq.heappop(heap)
        if kids[node, 0] >= 0:
            for child in kids[node]:
                if bound[child] >= kth:
                    heapq.heappush(heap, (-bound[child], child))
            continue
        i, j = rows[node]
        if looked is not None:
            looked.append(int(node))
        s = tree["x"][i:j] @ q
        good = (s >= kth) & (tree["order"][i:j] != own)
        if good.any():
            found, scores = np.concatenate((found, tree["ids"][i:j][good])), np.concatenate((scores, s[good]))
            keep = top(found, scores, k)
            found, scores = found[keep], scores[keep]
            if len(found) == k:
                kth = scores[-1]
    return found, scores


def exact_top_k(df: DataFrame, every: int, k: int = 10, scale: float = 1024, key: str = "vec_id", vector: str = "embedding", shard_bytes: int = 1 << 25) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of floor(scale * x).

    Queries are the rows whose id is divisible by ``every``; candidates of a query are all rows but
    its own. Ties go to the smaller id. Every query visits every shard, so what is shuffled
    is the number of queries times that of shards; ``shard_bytes`` (of vectors, in a task's memory)
    sets the latter.

    Defined cases: rows with a null id, or a vector that is null, empty or holds null or
    non-finite components take no part; vectors meet only those of equal length; of
    rows that share an id, each is a candidate, also of the others, and each that is a query has
    k rows of its own (in no stated order of the query rows); no rows give none; extra columns are
    ignored. Products are exact below 2**53.
    """
    rows = usable(df, key, vector, False)
    rows = rows.withColumn("_v", F.transform("_v", lambda x: F.floor(x * scale).cast("double")))

    def build(ids, x):
        tree = kd_tree(x)
        return saved(x=x[tree["order"]], ids=ids[tree["order"]], sorted=ids, place=np.argsort(tree["order"]), **tree)

    def answer(tree, qids, q, kth):
        own, out = own_rows(tree["sorted"], tree["x"], tree["place"], qids, q), ([], [], [])
        for n, bound in enumerate(bounds(tree, q)):
            found, scores = best(tree, q[n], bound, -np.inf if np.isnan(kth[n]) else kth[n], own[n], k)
            for column, x in zip(out, (np.full(len(found), n), found, scores.astype(np.int64)), strict=True):
                column.append(x)
        return tuple(np.concatenate(c).astype(np.int64) for c in out)

    search = Search(rows, every, build, shard_bytes)
    first = search.ask(search.queries.withColumn("shard", search.home).withColumn("kth", F.lit(None).cast("double")), answer, "long")
    if search.shards == 1:
        return search.best(first, k)
    first = stored(first)
    kth = first.groupBy(F.col("query_id").alias("_id"), "key").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("kth"))
    others = search.queries.join(kth, ["_id", "key"], "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(search.shards - 1)))).where(F.col("shard") != search.home)
    return search.best(first.unionByName(search.ask(others, answer, "long")), k)
