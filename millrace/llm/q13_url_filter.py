"""Query op13: verdicts on the URLs of pages."""

from .common import read_table
from .url_filter import judge

NAME = "op13_url_filter"
SQL = None  # a model over split names


def query(spark, sf_dir):
    return judge(read_table(spark, sf_dir, "pages"))
