"""A sample of the registered queries against their SQL, and shape checks for all."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerops.sources.tables import BASE_TABLES

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "a02_indexing_progress", "r04_migration_plan", "r10_retention_check", "w05_missing_ranges", "w03_alert_state",
    "l05_notifications", "j09_instant_vector", "c04_token_balances", "g02_classify_log", "t02_stream_rate",
]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the stored tables")
def test_entry(spark):
    assert entry.entry(spark).count() == 2


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the stored tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_sample(spark, name):
    duck = duckdb.connect()
    for t in BASE_TABLES:
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF).toArrow()
    want = duck.sql(entry.oracle_sql()[name]).to_arrow_table().select(got.column_names)

    def plain(table):
        return sorted(str([f"{v:.9g}" if isinstance(v, float) else v for v in r.values()]) for r in table.to_pylist())

    assert plain(got) == plain(want)
