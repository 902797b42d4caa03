"""SRC-9: stored jobs in hash buckets, so that a batch reads and rewrites only the buckets it touches.

Plain Parquet folders that Spark partitions by ``bucket``; dynamic partition overwrite replaces the touched ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import fingerprint
from ..functions.urls import url_key
from ..operators.lineage import cut

#: Ids that one batch can give to new jobs.
PER_BATCH = 1 << 32


class JobBuckets:
    """Jobs by a hash of their fingerprint (of their url where they have none), and an index of their urls.

    All jobs that a posting can match by fingerprint lie in its own bucket; those it matches by
    url are found through the index, which is bucketed by url. Both carry ``since``, the batch
    that added the row, and a batch ignores what it added itself. So a batch that is run again,
    also after a failure between or within its two writes, leaves the same tables, if ``merge`` gives the same
    result when its updates are there already (as merge_postings does for one as_of).

    Choose ``buckets`` so that one holds about 100 MB of jobs. One writer at a time; batch numbers ascend, so a store belongs
    to one checkpoint.
    """

    def __init__(self, spark: SparkSession, path: str, like: StructType, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.columns = like.fieldNames()
        self.schemas = {
            "jobs": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like) + ", since bigint, bucket int",
            "urls": "url_key string, id bigint, home int, since bigint, bucket int",
        }
        for name in self.schemas:  # so that there is a folder to read
            self._write(spark.createDataFrame([], self.schemas[name]), name, "append")

    def _write(self, df: DataFrame, name: str, mode: str = "overwrite") -> None:
        df.repartition("bucket").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/{name}")

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.path}/{name}")

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def home(self, title: str = "title", company: str = "company", url: str = "url") -> Column:
        fp = fingerprint(F.col(title), F.col(company))
        return self.bucket(F.when(fp != "", fp).otherwise(F.concat(F.lit("|"), F.coalesce(url_key(F.col(url)), F.lit("")))))

    def read(self) -> DataFrame:
        return self._table("jobs").select(*self.columns)

    def load(self, jobs: DataFrame) -> None:
        """Adds jobs that have ids already and are known to be new."""
        placed = jobs.select(*self.columns, F.lit(-1).cast("long").alias("since"), self.home().alias("bucket"))
        self._write(self._urls(placed), "urls", "append")
        self._write(placed, "jobs", "append")

    def _urls(self, placed: DataFrame) -> DataFrame:
        keyed = placed.select(url_key(F.col("url")).alias("url_key"), "id", F.col("bucket").alias("home"), "since").where("url_key != ''")
        return keyed.withColumn("bucket", self.bucket(F.col("url_key")))

    def _touched(self, df: DataFrame, column: str) -> list[int]:
        return [r[0] for r in df.select(column).distinct().collect()]  # numbers of buckets

    def merge(self, rows: DataFrame, number: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Applies ``merge(jobs, rows)`` to the touched buckets; ``rows`` need title, company and url. Returns those buckets.

        New jobs get ids above ``(number + 1) * PER_BATCH``, without gaps.
        """
        rows = cut(rows)
        keyed = rows.select(url_key(F.col("url")).alias("url_key"), self.home().alias("home")).where("url_key is not null")
        asked = self._touched(keyed.where("url_key != ''").select(self.bucket(F.col("url_key")).alias("bucket")), "bucket")
        index = self._table("urls").where(F.col("bucket").isin(asked))
        if index.where(F.col("since") > number).limit(1).count():
            raise ValueError(f"{self.path} holds batches after {number}")
        known = index.where(F.col("since") < number)
        met = known.join(keyed.select("url_key").distinct(), "url_key", "left_semi").select("home")
        touched = self._touched(keyed.select("home").unionByName(met), "home")
        old = self._table("jobs").where(F.col("bucket").isin(touched) & (F.col("since") < number))
        top = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        new = F.col("since").isNull()
        merged = merge(old, rows).withColumn("id", F.when(new, F.col("id") - top + (number + 1) * PER_BATCH).otherwise(F.col("id")))
        merged = merged.withColumn("bucket", F.coalesce("bucket", self.home())).withColumn("since", F.coalesce("since", F.lit(number)))
        added = cut(self._urls(merged.where(F.col("since") == number)))
        here = known.where(F.col("bucket").isin(self._touched(added, "bucket")))
        self._write(here.select(*added.columns).unionByName(added), "urls")
        self._write(merged.select(*self.columns, "since", "bucket"), "jobs")
        return sorted(touched)
