"""Every query with SQL gives the SQL's rows; the others give rows."""

import duckdb
import pytest

from lumenfold.plans.catalog import ENTRY, ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(repr, df.astype(str).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want) and len(got)


def test_entry(spark):
    assert ENTRY(spark, SF).count() > 0


def test_library_stands_alone():
    """Nothing outside the training-data operators imports them."""
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    for p in root.joinpath("lumenfold").rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "lumenfold.llm" not in p.read_text()


def test_rule_texts_of_customer_9999(spark, duck, tmp_path):
    """A customer's number that is the mark of an open end elsewhere is a number here."""
    path = str(tmp_path / "orders.parquet")
    duck.sql(f"COPY (SELECT * REPLACE (9999 AS o_custkey) FROM orders LIMIT 6) TO '{path}' (FORMAT parquet)")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{path}'")
    got = QUERIES["rule_texts"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(con.sql(ORACLES["rule_texts"]).df()) and set(got.progressive) == {"A partir de 3 meses", "De 3 até 9999 meses"}
