"""Every query of the subpackage runs over the smallest tables with the columns that are fixed for it."""

import os

import pytest

from corpuscle.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
FIXED = {
    "p1_found": [("chunk_a", "string"), ("chunk_b", "string")],
    "p2_found": [("repo_path", "string"), ("path", "string"), ("name", "string"), ("start_line", "int")],
    "p3_found": [("repo_path", "string"), ("path", "string")],
    "p4_found": [("repo_path", "string"), ("path", "string")],
    "p5_found": [("repo_path", "string"), ("path", "string"), ("name", "string"), ("start_line", "int")],
    "p6_found": [("tbl", "string"), ("rec_key", "string"), ("line_no", "int")],
    "p7_found": [("repo_path", "string"), ("path", "string")],
    "p8_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
    "p9_found": [("doc_id", "bigint"), ("item_id", "bigint")],
    "p10_found": [("doc_id", "bigint")],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    if name in FIXED:
        assert df.dtypes == FIXED[name]
        plain = [repr(r) for r in rows]
        assert rows and len(plain) == len(set(plain))


def test_p8_covers_all_documents(spark):
    assert QUERIES["p8_ids"](spark, DATA).count() == spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").distinct().count()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW elements AS SELECT * FROM '{DATA}/elements.parquet'")
    want = con.execute(ORACLE_SQL[name]).fetchall()
    got = QUERIES[name](spark, DATA).collect()
    assert sorted(map(tuple, got)) == sorted(want)
