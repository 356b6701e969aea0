"""Registered corpus queries against their DuckDB SQL."""

import glob
import os

import duckdb
import pytest

from mnemolith.llm.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM '{path}'")
    ours, theirs = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE_SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    rows = [sorted(map(str, f[columns].astype(object).itertuples(index=False, name=None))) for f in (ours, theirs)]
    assert rows[0] == rows[1]
