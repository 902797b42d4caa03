"""Query op9: pages written as WARC archives and read back."""

from .common import read_table
from .warc import round_trip

NAME = "op9_warc"
SQL = None  # DuckDB has no base32; tested against a plain loop


def query(spark, sf_dir):
    return round_trip(read_table(spark, sf_dir, "pages"))
