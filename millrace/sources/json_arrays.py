"""JSON arrays of any size, read by many tasks.

Spark's text reader splits a file at any byte and can end its lines with ``}``, so each line is a piece up to
the next closing brace, in a string or not. Whether a piece starts inside a string is the parity of the
quotes before it, and how deep it lies the sum of brackets outside strings; both are prefix sums, taken within each
split of a file and then, over one row a split, across splits. A piece after which the depth is that of the
array ends an object. Objects inside a split are joined there; only the pieces at its borders meet those of other splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SPLIT = ["file", "block"]


def _depth(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\[{]+", "")) - F.length(F.regexp_replace(text, r"[^\]]+", ""))


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """file, at (number of the object in its file, from 0) and text of each object of the arrays under the path: one array of objects a file, UTF-8.

    Escapes, brackets and braces in strings, white space and objects longer than a split are no matter. An empty array or file has no rows.
    Elements that are no objects stay before the text of the next object, so they do not parse with it.
    """
    read = spark.read.text(path, lineSep="}")
    pieces = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value")
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"', -1)  # in turn outside and inside strings, or the other way round
    side = lambda rest: _depth(F.array_join(F.filter("parts", lambda x, i: i % 2 == rest), ""))
    pieces = pieces.withColumn("parts", parts).withColumn("quotes", F.size("parts") - 1).withColumn("even", side(0)).withColumn("odd", side(1)).drop("parts")
    before = Window.partitionBy(*_SPLIT).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    until = Window.partitionBy(*_SPLIT).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    pieces = pieces.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)

    def delta(start: int) -> Column:
        """How the depth changes over the piece and its brace, where the split starts outside (0) or inside (1) a string."""
        inside = (F.col("inside") + start) % 2
        return F.when(inside == 0, F.col("even")).otherwise(F.col("odd")) - F.when((inside + F.col("quotes")) % 2 == 0, 1).otherwise(0)

    for start in (0, 1):
        pieces = pieces.withColumn(f"depth{start}", F.sum(delta(start)).over(until))
    # a row a split from here
    splits = pieces.groupBy(*_SPLIT).agg(F.sum("quotes").alias("quotes"), F.max_by("depth0", "seq").alias("depth0"), F.max_by("depth1", "seq").alias("depth1"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("start", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    splits = splits.withColumn("base", F.coalesce(F.sum(F.when(F.col("start") == 0, F.col("depth0")).otherwise(F.col("depth1"))).over(earlier), F.lit(0))).select(*_SPLIT, "start", "base")
    pieces = pieces.join(F.broadcast(splits), _SPLIT)
    depth = F.col("base") + F.when(F.col("start") == 0, F.col("depth0")).otherwise(F.col("depth1"))
    closed = (F.col("start") + F.col("inside") + F.col("quotes")) % 2 == 0
    pieces = pieces.withColumn("ends", F.when(closed & (depth == 1), 1).otherwise(0)).withColumn("n", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda x: F.concat(x["value"], F.lit("}"))), "")
    joined = pieces.groupBy(*_SPLIT, "n").agg(text.alias("text"), F.max("ends").alias("ended"))
    counts = joined.groupBy(*_SPLIT).agg(F.sum("ended").alias("objects"))
    counts = counts.select(*_SPLIT, F.coalesce(F.sum("objects").over(earlier), F.lit(0)).alias("offset"))
    joined = joined.join(F.broadcast(counts), _SPLIT).withColumn("at", F.col("offset") + F.col("n"))
    whole = joined.where("n > 0 and ended = 1").select("file", "at", "text")
    border = joined.where("n = 0 or ended = 0").groupBy("file", "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "").alias("text"), F.max("ended").alias("ended"))
    return whole.unionByName(border.where("ended = 1").drop("ended")).withColumn("text", F.regexp_replace("text", r"^[\s,\[\x{FEFF}]+", ""))


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of the arrays under the path as rows of the schema."""
    return read_objects(spark, path).select(F.from_json("text", schema).alias("_o")).select("_o.*")
