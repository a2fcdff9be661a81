"""Each query of the engine against its SQL."""

import duckdb
import pytest

from sievio import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(data):
    return sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in data)


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, sf, db, name):
    df = catalogue.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    want = db.sql(catalogue.ORACLES[name])
    assert sorted(want.columns) == columns
    listed = ", ".join(f'"{c}"' for c in columns)
    assert rows(df.select(*[f"`{c}`" for c in columns]).collect()) == rows(db.sql(f"SELECT {listed} FROM ({catalogue.ORACLES[name]})").fetchall())


def test_whole_lists_are_indexed(spark, sf):
    """The values of all components count, not of the first three only."""
    row = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("count(*) n", "sum(size(embedding)) m").first()
    counts = catalogue.vectors(spark, sf).query({}).matches().selectExpr("count(*) n", "sum(size(v)) m").first()
    assert counts == row and row["m"] > 3 * row["n"]


def test_entry(spark):
    import __spark_entry__ as entry

    assert 0 < entry.entry(spark).count() <= 20
    assert set(entry.oracle_sql()) <= set(entry.queries())
