"""Every registered query with an oracle gives DuckDB's rows at the smallest scale."""

import duckdb
import pytest

from voxelweave.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF}/events.parquet')")
    return c


def _sorted(df):
    c = sorted(df.columns)
    return df[c].sort_values(c).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_oracle(spark, duck, name):
    got, want = _sorted(catalogue.QUERIES[name](spark, SF).toPandas()), _sorted(duck.execute(catalogue.SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for c in got.columns:
        same = (got[c] == want[c]) | (got[c].isna() & want[c].isna())
        assert same.all(), c


def test_every_query_but_two_has_an_oracle():
    """export_rows gives maps, which export_rows_unnested takes apart; lru_replay is a fold, tested against a model."""
    assert set(catalogue.QUERIES) - set(catalogue.SQL) == {"export_rows", "lru_replay"}
