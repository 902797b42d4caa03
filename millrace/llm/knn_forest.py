"""Approximate nearest neighbours with a forest of random-projection trees.

Each shard holds a forest over all its rows, built once and stored. Trees see directions
(rows divided by their norm). A tree draws a random way for each of its levels and splits every
node at the median of its rows' projections, so all leaves hold about ``leaf`` rows,
copies of one vector included.

A query's search has one priority queue for the leaves of all trees: a leaf is worth minus
the sum of squared distances to the splits on whose far side it lies. As this sum only
grows on the way down, taking leaves in order of it is what a best-first search from all
roots does, and the queue is one partial sort. Leaves are taken until they hold the
``reach``-th part of the rows of all trees.

Rows met in many trees have a direction near the query's. How near, a shard learns when it is built: for
``SAMPLE`` of its rows as queries it takes the mean cosine of the rows met so often. That cosine times a row's norm estimates
its inner product, so long vectors count for what they are. The ``part`` of the shard's rows with the
highest estimates (``spread * k`` at least) are the candidates, whose inner products are computed in full.

The work grows with the table: every query looks at ``reach`` of the leaves and at ``part`` of the rows. On vectors without
structure in 64 dimensions fewer do not hold nine tenths of the nearest (README has figures).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import Search, own_rows, saved, top, usable


#: Rows of a shard from which it learns what meeting in so many trees means.
SAMPLE = 64


def forest(x: np.ndarray, trees: int, leaf: int, seed: int = 11) -> dict[str, np.ndarray]:
    """Directions (trees x levels x dim), cuts (trees x nodes, level by level), rows of the leaves (trees * leaves x size; -1 fills up), and the mean taken off first."""
    n, dim = x.shape
    levels = max(0, int(np.ceil(np.log2(max(1.0, n / leaf)))))
    rng = np.random.default_rng(seed)
    ways = rng.normal(size=(trees, levels, dim))
    ways /= np.linalg.norm(ways, axis=2, keepdims=True)
    mean, edges = x.mean(0), [0, n]
    cuts, rows = np.zeros((trees, (1 << levels) - 1)), np.tile(np.arange(n, dtype=np.int32), (trees, 1))
    projected = [(x - mean) @ way.T for way in ways]
    for level in range(levels):
        halves = [(i, (i + j) // 2, j) for i, j in zip(edges[:-1], edges[1:], strict=True)]
        for t in range(trees):
            p = projected[t][rows[t], level]
            for node, (i, half, j) in enumerate(halves):
                if i < half:
                    order = np.argpartition(p[i:j], half - i)
                    rows[t, i:j], split = rows[t, i:j][order], p[i:j][order]
                    cuts[t, (1 << level) - 1 + node] = (split[: half - i].max() + split[half - i]) / 2
        edges = [0, *[e for _, half, j in halves for e in (half, j)]]
    size = max(j - i for i, j in zip(edges[:-1], edges[1:], strict=True))
    leaves = np.full((trees, len(edges) - 1, size), -1, np.int32)
    for number, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        leaves[:, number, : j - i] = rows[:, i:j]
    return {"ways": ways, "cuts": cuts, "leaves": leaves.reshape(-1, size), "mean": mean}


def far_sides(f: dict, q: np.ndarray) -> np.ndarray:
    """(queries x leaves of all trees) sums of squared distances to the splits on the other side of which the query lies."""
    trees, levels, dim = f["ways"].shape
    p = ((q - f["mean"]) @ f["ways"].reshape(-1, dim).T).reshape(len(q), trees, levels)
    out = np.zeros((len(q), trees, 1))
    for level in range(levels):
        m = p[:, :, level, None] - f["cuts"][None, :, (1 << level) - 1 : (2 << level) - 1]
        out = np.stack((out + np.maximum(m, 0) ** 2, out + np.minimum(m, 0) ** 2), axis=3).reshape(len(q), trees, -1)
    return out.reshape(len(q), -1)


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of norm 1, norms) of rows that are not zero, however large or small they are."""
    largest = np.abs(x).max(1)
    u = x / largest[:, None]
    norms = np.linalg.norm(u, axis=1)
    return u / norms[:, None], np.minimum(largest, np.finfo(float).max / norms) * norms


def meetings(f: dict, worth: np.ndarray, n: int, reach: float) -> np.ndarray:
    """In how many trees each of n rows lies in one of the leaves taken; ``worth``: the query's ``far_sides``."""
    take = min(len(worth), max(len(f["ways"]), int(reach * len(worth))))
    near = np.argpartition(worth, take - 1)[:take]
    return np.bincount(f["leaves"][near].ravel() + 1, minlength=n + 1)[1:]


def cosines(f: dict, u: np.ndarray, reach: float, seed: int = 13) -> np.ndarray:
    """The mean cosine of rows that a query meets in 0, 1, ... trees, never falling; from a sample of the rows as queries."""
    n, trees = len(u), len(f["ways"])
    sums, counts = np.zeros(trees + 1), np.zeros(trees + 1)
    chosen = np.random.default_rng(seed).choice(n, min(n, SAMPLE), replace=False)
    for i, worth in zip(chosen, far_sides(f, u[chosen]), strict=True):
        met, others = meetings(f, worth, n, reach), np.arange(n) != i
        sums += np.bincount(met[others], (u @ u[i])[others], trees + 1)
        counts += np.bincount(met[others], minlength=trees + 1)
    have = np.flatnonzero(counts)
    if not len(have):
        return np.linspace(0, 1, trees + 1)
    return np.interp(np.arange(trees + 1), have, np.maximum.accumulate(sums[have] / counts[have]))


def candidates(f: dict, worth: np.ndarray, norms: np.ndarray, gains: np.ndarray, reach: float, most: int) -> np.ndarray:
    """The ``most`` rows of the highest estimated inner products."""
    n = len(norms)
    if most >= n:
        return np.arange(n)
    return np.argpartition(-norms * gains[meetings(f, worth, n, reach)], most - 1)[:most]


def approximate_top_k(
    df: DataFrame, every: int, k: int = 20, trees: int = 64, leaf: int = 48, reach: float = 0.2, part: float = 0.1, spread: int = 18, key: str = "vec_id", vector: str = "embedding", shard_bytes: int = 1 << 25
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found by inner product, nearest first.

    Queries are the rows whose id is divisible by ``every``; candidates of a query are all rows but
    its own. Scores are exact inner products in double precision; ties go to the smaller
    id. Every query visits every shard and ranks ``part`` of its rows in full, or
    ``spread * k`` if that is more.

    Defined cases: rows with a null id, or a vector that is null, empty, zero or holds null
    or non-finite components take no part; vectors meet only those of equal length; of
    rows that share an id, each is a candidate, also of the others, and each that is a query has
    rows of its own; fewer candidates than k give all of them; no rows give none; extra columns are ignored.
    """

    def build(ids, x):
        u, norms = directions(x)
        f = forest(u, trees, leaf)
        return saved(x=x, ids=ids, norms=norms, gains=cosines(f, u, reach), **f)

    def answer(f, qids, q, kth):
        x, ids = f["x"], f["ids"]
        own, out = own_rows(ids, x, np.arange(len(ids)), qids, q), ([], [], [])
        most = max(int(np.ceil(part * len(x))), spread * k + 1)
        for i in range(0, len(q), 64):
            some = q[i : i + 64]
            for n, worth in enumerate(far_sides(f, directions(some)[0]), i):
                rows = candidates(f, worth, f["norms"], f["gains"], reach, most)
                rows = rows[rows != own[n]]
                scores = x[rows] @ q[n]
                keep = top(ids[rows], scores, k)
                for column, found in zip(out, (np.full(len(keep), n), ids[rows][keep], scores[keep]), strict=True):
                    column.append(found)
        return tuple(np.concatenate(c) for c in out)

    search = Search(usable(df, key, vector, True), every, build, shard_bytes)
    asked = search.queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(search.shards - 1)))).withColumn("kth", F.lit(None).cast("double"))
    return search.best(search.ask(asked, answer, "double"), k)
