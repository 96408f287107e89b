"""Inputs of the registered queries: frames derived from the stored tables.

``*_SQL`` texts run unchanged in Spark SQL and in the checking database, so both sides
read the same rows.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from ledgerops.functions.times import day_after_last
from ledgerops.sources.tables import CHAIN_VIEWS, base_table, load_table

# table -> (stored table, control column): the reproducible 'now' is the midnight after
# the newest row.
_CLOCKS = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}


def now_of(spark: SparkSession, sf: str, table: str) -> datetime:
    return day_after_last(base_table(spark, sf, table), _CLOCKS[table])


def now_sql(table: str) -> str:
    return f"(SELECT CAST(CAST(max({_CLOCKS[table]}) AS DATE) + 1 AS TIMESTAMP) FROM {table})"


def view_sql(name: str) -> str:
    """The stand-in view of a chain table as SQL."""
    source, columns = CHAIN_VIEWS[name]
    cols = ", ".join(f'{body} AS "{alias}"' for alias, body in columns.items())
    return f"(SELECT {cols} FROM {source})".replace("as string", "as varchar")


def sql_frame(spark: SparkSession, sf: str, text: str, *tables: str) -> DataFrame:
    """Run a shared SQL text over the named stored tables."""
    return spark.sql(text.format(**{t: f"{{{t}}}" for t in tables}), **{t: load_table(spark, sf, t) for t in tables})


def age_sql(col: str, now: str) -> str:
    return f"(epoch_us({now}) - epoch_us({col})) / 1e6"


# One registered parent per supplier, every field a function of its columns.
CONFIG_SQL = """
SELECT concat('public.', s_name) AS parent_table, 'inserted_at' AS control,
       CASE WHEN s_nationkey % 3 = 0 THEN '12 hours' ELSE '1 day' END AS partition_interval,
       CAST(3 + s_nationkey % 5 AS INT) AS premake,
       CASE s_suppkey % 4 WHEN 0 THEN '90 days' WHEN 1 THEN '30d' WHEN 2 THEN '720h'
            ELSE concat(CAST(30 + s_suppkey % 61 AS STRING), ' days') END AS retention,
       false AS retention_keep_table, s_suppkey % 2 = 0 AS infinite_time_partitions,
       CASE WHEN s_suppkey % 3 = 0 THEN 'off' ELSE 'on' END AS automatic_maintenance
FROM {supplier}
"""

# Partitions that exist: the days that hold rows, per chain table.
PARTITIONS_SQL = """
SELECT parent_table, concat(parent_table, '_p', replace(CAST(d AS STRING), '-', '')) AS partition_name,
       CAST(d AS TIMESTAMP{ntz}) AS lo, CAST(d + INTERVAL 1 DAY AS TIMESTAMP{ntz}) AS hi
FROM (SELECT 'blocks' AS parent_table, CAST(o_orderdate AS DATE) AS d FROM {orders} GROUP BY 2
      UNION ALL
      SELECT 'transactions', CAST(l_shipdate AS DATE) FROM {lineitem} GROUP BY 2
      UNION ALL
      SELECT 'samples', CAST(ts AS DATE) FROM {events} GROUP BY 2) q
"""


def partitions_frame(spark: SparkSession, sf: str) -> DataFrame:
    text = PARTITIONS_SQL.replace("TIMESTAMP{ntz}", "TIMESTAMP_NTZ")
    return sql_frame(spark, sf, text, "orders", "lineitem", "events")


def partitions_sql() -> str:
    return "(" + PARTITIONS_SQL.replace("{ntz}", "").format(orders="orders", lineitem="lineitem", events="events") + ")"


def parents_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Registered parents: the chain tables with rows, and one per region that has none."""
    text = """
      SELECT parent_table, '1 day' AS partition_interval, 5 AS premake, '90 days' AS retention
      FROM (SELECT 'blocks' AS parent_table FROM {orders} UNION SELECT 'transactions' FROM {lineitem}
            UNION SELECT 'samples' FROM {events} UNION SELECT concat('empty_', r_name) FROM {region}) p
    """
    return sql_frame(spark, sf, text, "orders", "lineitem", "events", "region")


PARENTS_SQL = """(SELECT parent_table FROM (SELECT 'blocks' AS parent_table UNION SELECT 'transactions'
  UNION SELECT 'samples' UNION SELECT concat('empty_', r_name) FROM region) p)"""
