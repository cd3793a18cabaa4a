import glob
import os

import duckdb
import pytest

from quillspark.llm import queries
from tests.test_queries import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, duck, name):
    df, rel = queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLES[name])
    assert table(df.columns, df.collect()) == table(rel.columns, rel.fetchall())
