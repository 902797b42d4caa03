"""What both vector searches share: valid vectors, stored indexes of shards, streams of queries.

Rows go to shards by a hash of their id. Each shard's index is built once, in a task of its
own, and written to the shared folder as one row. A search then sends every query to the
shards it has to ask; in a task the index of a shard comes first and its queries
stream past it in batches, so a task holds one index and one batch, and no vector but
the queries' is sent twice.
"""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces_for, shuffle_partitions, stored


def usable(df: DataFrame, key: str, vector: str, nonzero: bool) -> DataFrame:
    """Rows with an id and a whole, finite (and non-zero) vector: _id, _v (doubles), _dim."""
    v = F.col(vector).cast("array<double>")
    good = F.col(key).isNotNull() & F.col(vector).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if nonzero:
        good &= F.exists(v, lambda x: x != 0)
    return df.where(good & (F.size(vector) > 0)).select(F.col(key).cast("long").alias("_id"), v.alias("_v")).withColumn("_dim", F.size("_v"))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in chunks]).astype(np.float64).reshape(-1, dim)


def saved(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def loaded(data: bytes) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(data)))


class Search:
    """The shards of a table, their indexes, and its queries.

    ``build(ids, vectors)`` gives an index as bytes, for rows in order of their id.
    Queries are the rows whose id is divisible by ``every``; equal rows are asked once and answered
    as often as they occur. Vectors meet only those of equal length.
    """

    def __init__(self, rows: DataFrame, every: int, build: Callable, shard_bytes: int):
        spark = rows.sparkSession
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_dim").cast("long") * 8).alias("bytes")).first()
        self.shards = pieces_for(size["bytes"] or 0, shard_bytes, min(shuffle_partitions(spark), -(-size["n"] // 4096)))
        self.home = F.pmod(F.xxhash64("_id"), F.lit(self.shards)).cast("int")

        def index(table: pa.Table) -> pa.Table:
            table = table.sort_by("_id")
            dim = table["_dim"][0].as_py()
            made = build(table["_id"].to_numpy(), matrix(table["_v"], dim))
            return pa.table({"shard": table["shard"][:1].cast(pa.int32()), "dim": pa.array([dim], pa.int32()), "index": pa.array([made], pa.large_binary()).cast(pa.binary())})

        self.index = stored(rows.withColumn("shard", self.home).groupBy("shard", "_dim").applyInArrow(index, "shard int, dim int, index binary"), compression="none")
        asked = rows.where(F.col("_id") % every == 0).groupBy("_id", "_v", "_dim").agg(F.count(F.lit(1)).alias("times"))
        self.queries = stored(asked.withColumn("key", F.xxhash64("_v")))

    def ask(self, queries: DataFrame, answer: Callable, score: str) -> DataFrame:
        """query, key, vec_id, score of ``answer(index, ids, vectors, kths)`` for queries with a ``shard`` and a ``kth``.

        ``answer`` gives arrays (number of query, id, score).
        """
        index = self.index.select("shard", "dim", F.lit(0).alias("kind"), "index", *[F.lit(None).cast(k).alias(c) for c, k in (("_id", "long"), ("key", "long"), ("_v", "array<double>"), ("kth", "double"))])
        asked = queries.select("shard", F.col("_dim").alias("dim"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("index"), "_id", "key", "_v", "kth")
        both = index.unionByName(asked).repartition(self.shards, "shard").sortWithinPartitions("shard", "dim", "kind")
        number = pa.int64() if score == "long" else pa.float64()

        def scan(batches):
            held, at = None, None
            for batch in batches:
                place = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()], axis=1)
                edges = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]).any(1), [True])))
                for i, j in zip(edges[:-1], edges[1:], strict=True):
                    part = batch.slice(i, j - i)
                    if not place[i, 2]:
                        held, at = loaded(part.column(3)[0].as_py()), tuple(place[i, :2])
                        continue
                    if at != tuple(place[i, :2]):
                        continue  # no row of this length in the shard
                    for b in range(0, len(part), 512):
                        some = part.slice(b, 512)
                        ids = some.column(4).to_numpy()
                        q, found, scores = answer(held, ids, matrix(some.column(6), at[1]), some.column(7).to_numpy(zero_copy_only=False))
                        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(some.column(5).to_numpy()[q]), pa.array(found, pa.int64()), pa.array(scores, number)], ["query_id", "key", "vec_id", "score"])

        return both.mapInArrow(scan, f"query_id long, key long, vec_id long, score {score}")

    def best(self, found: DataFrame, k: int) -> DataFrame:
        """The k best of what was found for each query row: query_id, rank, vec_id, score."""
        order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        again = self.queries.where("times > 1").select(F.col("_id").alias("query_id"), "key", "times")
        each = ranked.join(again, ["query_id", "key"], "left").withColumn("_n", F.explode(F.sequence(F.lit(1), F.coalesce("times", F.lit(1)).cast("int"))))
        return each.select("query_id", "rank", "vec_id", "score")


def own_rows(ids: np.ndarray, x: np.ndarray, place: np.ndarray, query_ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Number of each query's own row, or -1; ``place`` has the places in x of the rows by id. Of equal rows the first."""
    low, high = np.searchsorted(ids, query_ids), np.searchsorted(ids, query_ids, "right")
    out = np.full(len(query_ids), -1)
    for n in np.flatnonzero(high > low):
        same = np.flatnonzero((x[place[low[n] : high[n]]] == queries[n]).all(1))
        if len(same):
            out[n] = low[n] + same[0]
    return out


def top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        kept = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return kept[np.lexsort((ids[kept], -scores[kept]))[:k]]
    return np.lexsort((ids, -scores))[:k]
