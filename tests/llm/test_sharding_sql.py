import duckdb
import pytest

from boutlog.llm import sharding
from boutlog.llm.queries import op6_sharding

SF = "/root/testdata/sf0.001"


def test_shards_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    wanted = {r[0]: r[1:] for r in con.execute(sharding.oracle_sql()).fetchall()}
    got = {r.doc_id: (r.size, r.shard, r.grown_shard) for r in op6_sharding(spark, SF).collect()}
    assert got == wanted and all(a == b or b == 24 for _, a, b in got.values())


def test_other_counts_are_refused(spark):
    with pytest.raises(ValueError):
        sharding.shard_rows(spark.createDataFrame([], "doc_id long, text string"), 20)
