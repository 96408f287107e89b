"""Calendars, migration, retention and maintenance over stored tables."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ledgerops.functions.times import as_datetime, ntz
from ledgerops.operators import filters
from ledgerops.operators import partitions as parts
from ledgerops.plans.inputs import (
    CONFIG_SQL, PARENTS_SQL, now_of, now_sql, parents_frame, partitions_frame, partitions_sql,
    sql_frame, view_sql,
)
from ledgerops.plans.registry import query
from ledgerops.session import scratch_path
from ledgerops.sources import files
from ledgerops.sources.tables import load_table

_CONFIG = "(" + CONFIG_SQL.format(supplier="supplier") + ")"


def config_frame(spark, sf):
    now = ntz(now_of(spark, sf, "events"))
    config = sql_frame(spark, sf, CONFIG_SQL, "supplier")
    number = F.regexp_extract("parent_table", "([0-9]+)$", 1).cast("bigint")
    last = F.when(number % 10 != 0, F.timestamp_add("MINUTE", -number * 7, now))
    return config.withColumn("maintenance_last_run", last)


@query(
    "r01_partition_calendar",
    f"""SELECT 'blocks' AS parent_table, concat('blocks_p', strftime(lo, '%Y%m%d')) AS partition_name, lo, lo + INTERVAL 1 DAY AS hi
        FROM (SELECT unnest(generate_series(CAST((SELECT CAST(min(o_orderdate) AS DATE) FROM orders) AS TIMESTAMP),
              {now_sql('orders')} + INTERVAL 7 DAY, INTERVAL 1 DAY)) AS lo) q""",
)
def calendar(spark, sf):
    blocks = load_table(spark, sf, "blocks")
    return parts.calendar_of(blocks, "blocks", "inserted_at", now_of(spark, sf, "orders"), "1 day", 7).frame(spark)


@query(
    "r01_partition_calendar_hours",
    f"""SELECT 'samples' AS parent_table, concat('samples_p', strftime(lo, '%Y%m%d_%H%M%S')) AS partition_name, lo, lo + INTERVAL 6 HOUR AS hi
        FROM (SELECT unnest(generate_series(CAST((SELECT CAST(min(ts) AS DATE) FROM events) AS TIMESTAMP),
              {now_sql('events')} + INTERVAL 18 HOUR, INTERVAL 6 HOUR)) AS lo) q
        WHERE lo + INTERVAL 6 HOUR > (SELECT min(ts) FROM events)""",
)
def calendar_hours(spark, sf):
    samples = load_table(spark, sf, "samples")
    return parts.calendar_of(samples, "samples", "ts", now_of(spark, sf, "events"), "6 hours", 3).frame(spark)


@query(
    "r02_assign_partition",
    f"""SELECT number, CASE WHEN inserted_at >= {now_sql('orders')} - INTERVAL 365 DAY
          THEN concat('blocks_p', strftime(inserted_at, '%Y%m%d')) ELSE 'default' END AS partition_name
        FROM {view_sql('blocks')}""",
)
def assigned(spark, sf):
    now = now_of(spark, sf, "orders")
    cal = parts.partition_calendar("blocks", parts.cutoff(now, "365 days"), now)
    return parts.assign_partition(load_table(spark, sf, "blocks"), "inserted_at", cal).select("number", "partition_name")


@query(
    "r03_register_config",
    f"""SELECT parent_table, premake, CASE WHEN infinite_time_partitions THEN '45 days' ELSE retention END AS retention
        FROM {_CONFIG} WHERE automatic_maintenance = 'off' OR infinite_time_partitions""",
)
def registered(spark, sf):
    config = sql_frame(spark, sf, CONFIG_SQL, "supplier")
    existing = config.where("automatic_maintenance = 'off'").select("parent_table", "premake", "retention")
    desired = config.where("infinite_time_partitions").select("parent_table", "premake", "retention")
    return parts.register_config(existing, desired, {"retention": F.lit("45 days")})


@query(
    "r04_migration_plan",
    f"""WITH src AS (SELECT 1 AS table_ord, 'blocks' AS table_name, CAST(CAST(inserted_at AS DATE) AS TIMESTAMP) AS lo, hash AS k FROM {view_sql('blocks')}
          UNION ALL SELECT 2, 'transactions', CAST(CAST(inserted_at AS DATE) AS TIMESTAMP), hash FROM {view_sql('transactions')}),
        ranked AS (SELECT table_ord, table_name, lo, (row_number() OVER (PARTITION BY table_ord, lo ORDER BY k) - 1) // 10 AS b FROM src),
        batches AS (SELECT table_ord, table_name, lo, b, count(*) AS rows_moved FROM ranked GROUP BY 1, 2, 3, 4)
        SELECT table_ord, table_name, lo, row_number() OVER w AS batch_no, rows_moved,
               CAST(sum(rows_moved) OVER w AS BIGINT) AS total_moved, (row_number() OVER w) % 10 = 0 AS log_line
        FROM batches WINDOW w AS (PARTITION BY table_ord ORDER BY lo, b)""",
)
def plan(spark, sf):
    tables = [(n, load_table(spark, sf, n), "inserted_at") for n in ("blocks", "transactions")]
    return parts.migration_plan(tables, "1 day", 10)


@query(
    "r04_assign_batches",
    """SELECT event_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS lo,
       (row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) - 1) // 100 + 1 AS batch FROM events""",
)
def batches(spark, sf):
    events = load_table(spark, sf, "events").select("event_id", "ts")
    return parts.assign_batches(events, "ts", ["event_id"], 100).select("event_id", "lo", "batch")


@query(
    "r04_migrate",
    f"""SELECT CASE WHEN ts >= {now_sql('events')} - INTERVAL 20 DAY THEN CAST(ts AS DATE) END AS p_day,
        count(*) AS "rows", min(event_id) AS first_id FROM events GROUP BY 1""",
)
def migrated(spark, sf):
    now, path = now_of(spark, sf, "events"), scratch_path(spark, "migrated")
    cal = parts.partition_calendar("events", parts.cutoff(now, "20 days"), now)
    parts.migrate(load_table(spark, sf, "events"), path, "ts", cal)
    return spark.read.parquet(path).groupBy("p_day").agg(
        F.count(F.lit(1)).alias("rows"), F.min("event_id").alias("first_id")
    )


@query(
    "r04_migrate_resumed",
    f"""WITH d AS (SELECT CASE WHEN ts >= {now_sql('events')} - INTERVAL 20 DAY THEN CAST(ts AS DATE) END AS p_day, count(*) AS n FROM events GROUP BY 1),
        c AS (SELECT *, coalesce(sum(n) OVER (ORDER BY p_day NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d),
        b AS (SELECT CASE WHEN p_day IS NULL THEN 1000000 ELSE before // 100 END AS b, CAST(min(p_day) AS VARCHAR) AS first_day,
                CAST(max(p_day) AS VARCHAR) AS last_day, CAST(sum(n) AS BIGINT) AS rows_moved FROM c GROUP BY 1)
        SELECT row_number() OVER (ORDER BY b) AS batch_no, first_day, last_day, rows_moved, CAST(sum(rows_moved) OVER (ORDER BY b) AS BIGINT) AS total_moved,
               row_number() OVER (ORDER BY b) % 10 = 0 AS log_line, rows_moved AS rows_stored FROM b""",
)
def resumed(spark, sf):
    """A migration stopped after three batches and run again; what the log says next to what the table holds."""
    now, path = now_of(spark, sf, "events"), scratch_path(spark, "batched")
    cal = parts.partition_calendar("events", parts.cutoff(now, "20 days"), now)
    events = load_table(spark, sf, "events")
    parts.migrate_in_batches(events, path, "ts", cal, 100, stop_after=3)
    log = parts.migrate_in_batches(events, path, "ts", cal, 100)
    stored = spark.read.parquet(path).groupBy(F.col("p_day").cast("string").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    inside = (F.col("d") >= F.col("first_day")) & (F.col("d") <= F.col("last_day")) | F.col("d").isNull() & F.col("first_day").isNull()
    return log.join(F.broadcast(stored), inside).groupBy(*log.columns).agg(F.sum("n").alias("rows_stored"))


@query(
    "r05_reconcile",
    """SELECT (SELECT count(*) FROM lineitem) AS source_rows, (SELECT count(*) FROM lineitem WHERE l_returnflag <> 'R') AS target_rows,
       CAST(sum(greatest(s - d, 0)) AS BIGINT) AS missing_rows, CAST(sum(greatest(d - s, 0)) AS BIGINT) AS surplus_rows,
       (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS difference, sum(abs(s - d)) = 0 AS passed
       FROM (SELECT l_orderkey, l_linenumber, count(*) AS s, count(*) FILTER (WHERE l_returnflag <> 'R') AS d FROM lineitem GROUP BY 1, 2) q""",
)
def reconciled(spark, sf):
    lines = load_table(spark, sf, "lineitem")
    return parts.reconcile(lines, lines.where("l_returnflag <> 'R'"), ["l_orderkey", "l_linenumber"])


@query(
    "r06_default_partition_rows",
    f"""SELECT 'blocks' AS parent_table, count(*) AS default_rows FROM orders WHERE o_orderdate < {now_sql('orders')} - INTERVAL 90 DAY
        UNION ALL SELECT 'transactions', count(*) FROM lineitem WHERE l_shipdate < {now_sql('lineitem')} - INTERVAL 90 DAY""",
)
def default_rows(spark, sf):
    out = []
    for name, clock in (("blocks", "orders"), ("transactions", "lineitem")):
        now = now_of(spark, sf, clock)
        cal = parts.partition_calendar(name, parts.cutoff(now, "90 days"), now)
        out.append((load_table(spark, sf, name), "inserted_at", cal))
    return parts.default_partition_rows(out)


@query(
    "r07_partition_counts",
    f"""SELECT p.parent_table, count(c.partition_name) AS partition_count FROM {PARENTS_SQL} p
        LEFT JOIN {partitions_sql()} c ON c.parent_table = p.parent_table GROUP BY 1""",
)
def counts(spark, sf):
    return parts.partition_counts(parents_frame(spark, sf), partitions_frame(spark, sf), "left")


query(
    "j02_left_join_counts",
    f"""SELECT p.parent_table, count(c.partition_name) AS partition_count FROM {PARENTS_SQL} p
        LEFT JOIN {partitions_sql()} c ON c.parent_table = p.parent_table GROUP BY 1""",
)(counts)


@query(
    "j01_inner_join_counts",
    f"""SELECT p.parent_table, count(c.partition_name) AS partition_count FROM {PARENTS_SQL} p
        JOIN {partitions_sql()} c ON c.parent_table = p.parent_table GROUP BY 1""",
)
def inner_counts(spark, sf):
    return parts.partition_counts(parents_frame(spark, sf), partitions_frame(spark, sf), "inner")


@query(
    "r08_retention_candidates",
    f"""SELECT *, 'would be dropped' AS status FROM {partitions_sql()} q WHERE hi <= {now_sql('orders')} - INTERVAL 365 DAY""",
)
def candidates(spark, sf):
    return parts.retention_candidates(partitions_frame(spark, sf), now_of(spark, sf, "orders"), "365 days")


@query(
    "r09_apply_retention",
    f"SELECT number, inserted_at FROM {view_sql('blocks')} WHERE CAST(inserted_at AS DATE) + 1 > {now_sql('orders')} - INTERVAL 365 DAY",
)
def retained(spark, sf):
    blocks = load_table(spark, sf, "blocks").select("number", "inserted_at")
    return parts.apply_retention(blocks, "inserted_at", now_of(spark, sf, "orders"), "365 days")


def daily_table(spark, sf):
    """Events as a daily partitioned catalog table in the shared folder."""
    path = scratch_path(spark, "daily")
    name = "daily_" + path.rsplit("-", 1)[1]
    rows = files.with_partition(load_table(spark, sf, "events"), "ts")
    rows.hint("rebalance", F.col("p_day")).write.option("path", path).partitionBy("p_day").saveAsTable(name)
    return name, path


@query(
    "r09_drop_partitions",
    f"""SELECT CAST(ts AS DATE) AS p_day, count(*) AS "rows" FROM events
        WHERE CAST(ts AS DATE) + 1 > {now_sql('events')} - INTERVAL 10 DAY GROUP BY 1""",
)
def dropped(spark, sf):
    name, _ = daily_table(spark, sf)
    parts.drop_partitions(spark, name, now_of(spark, sf, "events"), "10 days")
    return spark.table(name).groupBy("p_day").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "r10_retention_check",
    f"""SELECT (SELECT count(*) FROM orders WHERE CAST(o_orderdate AS DATE) + 1 > {now_sql('orders')} - INTERVAL 365 DAY) AS rows_kept,
        (SELECT count(*) FROM orders WHERE o_orderdate > {now_sql('orders')} - INTERVAL 365 DAY) AS rows_expected,
        0::BIGINT AS young_lost, true AS passed""",
)
def checked(spark, sf):
    now, blocks = now_of(spark, sf, "orders"), load_table(spark, sf, "blocks")
    after = parts.apply_retention(blocks, "inserted_at", now, "365 days")
    return parts.retention_check(blocks, after, "inserted_at", ["hash"], now, "365 days")


@query(
    "r11_read_range",
    f"""SELECT event_id, ts, user_id FROM events WHERE ts >= {now_sql('events')} - INTERVAL 2 DAY
        AND ts < {now_sql('events')} - INTERVAL 6 HOUR""",
)
def ranged(spark, sf):
    now = now_of(spark, sf, "events")
    path = files.write_partitioned(load_table(spark, sf, "events"), scratch_path(spark, "events"), "ts")
    lo, hi = parts.cutoff(now, "2 days"), parts.cutoff(now, "6 hours")
    return files.read_range(spark, path, "ts", lo, hi).select("event_id", "ts", "user_id")


@query(
    "r12_config_status",
    f"""SELECT parent_table, CASE WHEN automatic_maintenance = 'on' THEN 1 ELSE 0 END AS automatic_maintenance, premake,
        CASE WHEN retention IN ('30d', '720h') THEN 2592000::BIGINT ELSE CAST(replace(retention, ' days', '') AS BIGINT) * 86400 END AS retention_seconds,
        CASE WHEN infinite_time_partitions THEN 1 ELSE 0 END AS infinite_time_partitions FROM {_CONFIG} q""",
)
def status(spark, sf):
    return parts.config_status(config_frame(spark, sf))


@query(
    "r13_maintenance_age",
    """SELECT concat('public.', s_name) AS parent_table, CASE WHEN s_suppkey % 10 = 0 THEN 0.0::DOUBLE ELSE s_suppkey * 420.0::DOUBLE END AS seconds_since_maintenance,
       s_suppkey % 10 <> 0 AND s_suppkey * 420 > 7200 AS overdue FROM supplier""",
)
def maintenance(spark, sf):
    return parts.maintenance_age(config_frame(spark, sf), now_of(spark, sf, "events"))


@query(
    "r14_run_maintenance",
    f"""WITH n AS (SELECT {now_sql('orders')} AS now), parents AS {PARENTS_SQL},
        parts AS {partitions_sql()},
        wanted AS (SELECT parent_table, unnest(generate_series(now, now + INTERVAL 5 DAY, INTERVAL 1 DAY)) AS lo FROM parents, n),
        made AS (SELECT w.parent_table, count(*) AS created FROM wanted w LEFT JOIN parts p ON p.parent_table = w.parent_table AND p.lo = w.lo
                 WHERE p.lo IS NULL GROUP BY 1),
        present AS (SELECT parent_table, count(*) AS total, count(*) FILTER (WHERE hi <= now - INTERVAL 90 DAY) AS dropped FROM parts, n GROUP BY 1),
        outside AS (SELECT 'blocks' AS parent_table, count(*) AS default_rows FROM orders, n WHERE o_orderdate < now - INTERVAL 90 DAY OR o_orderdate >= now + INTERVAL 6 DAY
                    UNION ALL SELECT 'transactions', count(*) FROM lineitem, n WHERE l_shipdate < now - INTERVAL 90 DAY OR l_shipdate >= now + INTERVAL 6 DAY)
        SELECT p.parent_table, coalesce(created, 0) AS created, coalesce(dropped, 0) AS dropped,
               coalesce(total, 0) - coalesce(dropped, 0) + coalesce(created, 0) AS partition_count, coalesce(default_rows, 0) AS default_rows
        FROM parents p LEFT JOIN made USING (parent_table) LEFT JOIN present USING (parent_table) LEFT JOIN outside USING (parent_table)""",
)
def maintained(spark, sf):
    now, config = now_of(spark, sf, "orders"), parents_frame(spark, sf)
    tables = {n: (load_table(spark, sf, n), "inserted_at") for n in ("blocks", "transactions")}
    return parts.maintenance_report(
        config, partitions_frame(spark, sf), parts.check_default(tables, config, now), now
    )


@query(
    "r14_run_maintenance_table",
    f"""SELECT 'events' AS parent_table, 4::BIGINT AS created, count(DISTINCT CAST(ts AS DATE)) FILTER (WHERE ts < {now_sql('events')} - INTERVAL 10 DAY) AS dropped,
        count(DISTINCT CAST(ts AS DATE)) FILTER (WHERE ts >= {now_sql('events')} - INTERVAL 10 DAY) + 4 AS partition_count, 0::BIGINT AS default_rows FROM events""",
)
def maintained_table(spark, sf):
    name, _ = daily_table(spark, sf)
    config = spark.createDataFrame(
        [("events", "1 day", 3, "10 days", "on")],
        "parent_table string, partition_interval string, premake int, retention string, automatic_maintenance string",
    )
    return parts.run_maintenance(spark, config, {"events": name}, now_of(spark, sf, "events"))


@query(
    "r14_maintenance_versions",
    f"""WITH h AS (SELECT DISTINCT epoch_us(ts) // 43200000000 AS half FROM events), n AS (SELECT epoch_us({now_sql('events')}) AS now),
        have AS (SELECT half FROM h, n WHERE (half + 1) * 43200000000 > now - 864000000000
                 UNION SELECT now // 43200000000 + unnest(range(4)) FROM n)
        SELECT 'events' AS parent_table, 0::BIGINT AS created_again, 3600.0::DOUBLE AS seconds_since_maintenance, false AS overdue, count(*) AS partition_count FROM have""",
)
def maintained_twice(spark, sf):
    """Half-day folders, a stored configuration, two runs an hour apart, and the age of the last one an hour later."""
    path = scratch_path(spark, "halves")
    name, now = "halves_" + path.rsplit("-", 1)[1], now_of(spark, sf, "events")
    rows = files.with_partition(load_table(spark, sf, "events"), "ts", "12 hours")
    rows.hint("rebalance", F.col("p_day")).write.option("path", path).partitionBy("p_day").saveAsTable(name)
    config = spark.createDataFrame(
        [("events", "12 hours", 3, "10 days", "on", True, False)],
        "parent_table string, partition_interval string, premake int, retention string, automatic_maintenance string, infinite_time_partitions boolean, retention_keep_table boolean",
    )
    store = scratch_path(spark, "config")
    parts.write_config(config, store)
    parts.maintain_registered(spark, store, {"events": name}, now)
    again = parts.maintain_registered(spark, store, {"events": name}, now)
    age = parts.maintenance_age(parts.read_config(spark, store), as_datetime(now) + timedelta(hours=1))
    return age.join(again, "parent_table").select(
        "parent_table", F.col("created").alias("created_again"), "seconds_since_maintenance", "overdue", "partition_count"
    )


@query(
    "r15_partition_sizes",
    """SELECT CAST(ts AS DATE) AS p_day, count(*) AS "rows", true AS has_bytes FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 10""",
)
def partition_listing(spark, sf):
    path = files.write_partitioned(load_table(spark, sf, "events"), scratch_path(spark, "events"), "ts")
    return parts.partition_sizes(spark.read.parquet(path), 10).select("p_day", "rows", (F.col("bytes") > 0).alias("has_bytes"))


_BACKUPS = """SELECT concat('backup-', CAST(o_orderkey AS STRING)) AS name,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'running' END AS phase,
  o_orderdate AS started, o_orderdate + INTERVAL 3 HOUR AS completed FROM {orders}"""


@query(
    "r16_latest_backup",
    f"""SELECT * FROM ({_BACKUPS.format(orders='orders')}) b WHERE phase = 'completed' AND completed <= {now_sql('orders')} - INTERVAL 100 DAY
        ORDER BY completed DESC, name DESC LIMIT 1""",
)
def newest_backup(spark, sf):
    backups = sql_frame(spark, sf, _BACKUPS, "orders")
    return parts.latest_backup(backups, parts.cutoff(now_of(spark, sf, "orders"), "100 days"))


@query(
    "r16_expired_backups",
    f"""SELECT * FROM ({_BACKUPS.format(orders='orders')}) b WHERE phase = 'completed' AND completed <= {now_sql('orders')} - INTERVAL 30 DAY""",
)
def old_backups(spark, sf):
    return parts.expired_backups(sql_frame(spark, sf, _BACKUPS, "orders"), now_of(spark, sf, "orders"), "30 days")


@query(
    "y02_check_default",
    f"""SELECT 'blocks' AS parent_table, count(*) AS default_rows FROM orders, (SELECT {now_sql('orders')} AS now) n
          WHERE o_orderdate < now - INTERVAL 90 DAY OR o_orderdate >= now + INTERVAL 6 DAY
        UNION ALL SELECT 'transactions', count(*) FROM lineitem, (SELECT {now_sql('orders')} AS now) n
          WHERE l_shipdate < now - INTERVAL 90 DAY OR l_shipdate >= now + INTERVAL 6 DAY""",
)
def default_check(spark, sf):
    tables = {n: (load_table(spark, sf, n), "inserted_at") for n in ("blocks", "transactions")}
    return parts.check_default(tables, parents_frame(spark, sf), now_of(spark, sf, "orders"))


@query(
    "f01_recent_count",
    f"SELECT count(*) AS \"rows\" FROM lineitem WHERE l_shipdate > {now_sql('lineitem')} - INTERVAL 2 DAY",
)
def recent_count(spark, sf):
    found = filters.recent(load_table(spark, sf, "transactions"), "inserted_at", now_of(spark, sf, "lineitem"), "2 days")
    return found.agg(F.count(F.lit(1)).alias("rows"))


