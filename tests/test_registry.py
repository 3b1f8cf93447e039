"""A cross-section of the registered queries against their SQL; ``check.py`` runs all of them."""

import duckdb
import pytest

from registry import QUERIES

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["arrival_short_cycle", "geo_grid", "taxi_csv_scan", "running_max_split_slices", "flags_house_mean_shift",
          "taxi_mean_shift_windows", "per_key_fixed_windows", "combined_split_watermark", "taxi_speculative_updates",
          "house_comparison", "zone_errors", "stream_house_fixed_slack"]


def test_every_sql_belongs_to_a_query():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for table in ("events", "lineitem", "orders"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    result = db.execute(QUERIES[name].sql)
    columns = [d[0] for d in result.description]
    frame = QUERIES[name].run(spark, FOLDER)
    assert sorted(frame.columns) == sorted(columns)
    mine = sorted(([r[c] for c in columns] for r in frame.collect()), key=repr)
    assert mine == sorted((list(r) for r in result.fetchall()), key=repr)
