import glob
import os

import duckdb
import pytest
from pyspark.errors import AnalysisException

import __spark_entry__ as entry
from mnemolith.plans.oracles import ORACLE_SQL
from mnemolith.plans.queries import QUERIES
from mnemolith.scratch import clear, shared_path

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        found.execute(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM '{path}'")
    return found


def normal(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(str, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, con, name):
    assert normal(QUERIES[name](spark, SF).toPandas()) == normal(con.execute(ORACLE_SQL[name]).df())


def test_scratch_tables_can_be_cleared(spark):
    path = shared_path(spark, "some")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    other = spark.newSession()
    assert shared_path(other, "none") != path
    assert clear(other) >= 1 and clear(spark) == 0
    with pytest.raises(AnalysisException):
        spark.read.parquet(path).count()


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
