"""Query op2: personal data in documents."""

from .common import read_table
from .pii import digest

NAME = "op2_pii"
SQL = None  # added kinds need look-behind, which DuckDB's patterns do not have


def query(spark, sf_dir):
    return digest(read_table(spark, sf_dir, "documents"))
