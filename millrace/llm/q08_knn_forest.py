"""Query op8: twenty nearest vectors found for every twentieth vector."""

from .common import read_table
from .knn_forest import approximate_top_k

NAME = "op8_knn_forest"
SQL = None  # approximate


def query(spark, sf_dir):
    return approximate_top_k(read_table(spark, sf_dir, "embeddings"), every=20, k=20)
