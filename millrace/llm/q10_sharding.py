"""Query op10: documents in 40 shards of near equal bytes."""

from .common import read_table
from .sharding import shard

NAME = "op10_sharding"
SQL = None  # the order is that of a hash which DuckDB does not have


def query(spark, sf_dir):
    return shard(read_table(spark, sf_dir, "documents"), shards=40)
