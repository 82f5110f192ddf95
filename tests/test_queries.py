"""Every query with SQL gives the rows that DuckDB gives; the others run and keep their columns."""

import math

import duckdb
import pandas as pd
import pytest

from loomspark import plans

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = plans.queries(), plans.oracles()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def one(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return None
        return f"{float(x):.6g}" if isinstance(x, (int, float)) or hasattr(x, "dtype") or type(x).__name__ == "Decimal" else str(x)

    return sorted((tuple(one(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    found, expected = QUERIES[name](spark, DIR).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert plain(found) == plain(expected)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_same_rows_again(spark, name):
    """Beyond SQL: rows there are, and the same rows on other partitions."""
    first = plain(QUERIES[name](spark, DIR).toPandas())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert first and plain(QUERIES[name](spark, DIR).toPandas()) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
