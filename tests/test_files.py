"""Octree files of derived points: ids beyond a float's 24 bits, and how they are shuffled."""

import duckdb
import pytest

from voxelweave.plans import catalogue, files

START = (1 << 24) - 100


@pytest.fixture(scope="module")
def late(tmp_path_factory):
    """The events of sf0.001 with ids around 2**24 and, one in four of them, 2**33."""
    path = str(tmp_path_factory.mktemp("late"))
    duckdb.sql(f"COPY (SELECT event_id + {START} + CASE WHEN event_id % 4 = 1 THEN 1::BIGINT << 33 ELSE 0 END AS event_id, * EXCLUDE (event_id) FROM '/root/testdata/sf0.001/events.parquet') TO '{path}/events.parquet' (FORMAT parquet)")
    return path


@pytest.mark.parametrize("name", ["source_points_coded", "source_points_raw", "source_points_of_layer", "source_points_in_box", "source_core_streams"])
def test_ids_beyond_a_float_s_bits(spark, late, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{late}/events.parquet')")
    want = c.execute(catalogue.SQL[name]).df()
    got = catalogue.QUERIES[name](spark, late).toPandas()[list(want.columns)]
    assert len(got) and sorted(map(tuple, got.itertuples(index=False))) == sorted(map(tuple, want.itertuples(index=False)))


def test_points_are_shuffled_once_before_they_are_written(spark, late):
    rows = files.in_files(spark, catalogue._points(spark, late))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Sort [") == 1, plan
