"""Every registered query of the library gives the rows of its SQL."""

import os

import duckdb
import pytest

from millrace.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda df: sorted(map(tuple, df[columns].astype(str).replace({"None": "", "nan": "", "<NA>": "", "NaT": ""}).replace({r"\.0$": "", " 00:00:00$": ""}, regex=True).values.tolist()))
    assert plain(got) == plain(want)
