"""Every query with an oracle gives the rows that DuckDB gives for the SQL, on the smallest tables."""

import datetime
import os

import duckdb
import pytest

from hydrospark.catalog import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(names: list[str], rows: list) -> list:
    """Rows with their columns by name, sorted; whole numbers, fractions and nulls stay what they are."""

    def one(x):
        if isinstance(x, float):
            return "NaN" if x != x else float(f"{x:.9g}")
        if isinstance(x, datetime.datetime):
            return x.isoformat()
        if isinstance(x, datetime.date):
            return datetime.datetime.combine(x, datetime.time()).isoformat()
        return x

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(one(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    got, want = QUERIES[name](spark, SF), duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got.columns, got.collect()) == plain(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
