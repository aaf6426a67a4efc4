"""The operators that SQL can express give the SQL's rows."""

import os

import duckdb
import pytest

from lumenfold.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n in ORACLES if n != "op12_click_windows"])  # which has a test of its own, and starts ten queries
def test_as_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    rows = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(str).itertuples(index=False, name=None)))
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want) and len(got)


def test_vectors_as_sql_where_there_are_links(spark, tmp_path):
    from tests.llm.test_embedding_dedup import SCHEMA, planted

    spark.createDataFrame(planted()[:400], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.sql(f"SELECT vec_id, n_links, component_id, kept FROM ({ORACLES['op11_near_vectors']})").fetchall())
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in QUERIES["op11_near_vectors"](spark, str(tmp_path)).collect())
    assert got == want and sum(r[1] for r in got) > 1000
