"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of the rows is hot, so there are fewer than its inverse.
SHARE = 1000


def hot_keys(left: DataFrame, key: str, total: int | None = None) -> list:
    """Keys of more than a thousandth of the rows (fewer than a thousand), counted before the shuffle; ``total``: as many rows or more."""
    total = left.count() if total is None else total
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return [r[0] for r in counts.where((F.col("_n") * SHARE > total) & (F.col("_n") > SHARE)).select(key).collect()]


def spread_join(left: DataFrame, right: DataFrame, key: str, total: int | None = None) -> DataFrame:
    """Inner join with a right side of one row a key: hot keys of more than a thousand rows are broadcast, the rest is shuffled."""
    hot = hot_keys(left, key, total)
    if not hot:
        return left.join(right, key)
    is_hot = F.col(key).isin(hot)
    return left.where(~is_hot).join(right.where(~is_hot), key).unionByName(left.where(is_hot).join(F.broadcast(right.where(is_hot)), key))
