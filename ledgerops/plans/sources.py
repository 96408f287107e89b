"""Scans, sources, sinks, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerops.functions.times import micros
from ledgerops.operators import health
from ledgerops.plans.inputs import age_sql, now_of, now_sql, view_sql
from ledgerops.plans.registry import query
from ledgerops.session import scratch_path
from ledgerops.sources import files
from ledgerops.sources.swap import rollback_swap, swap_tables
from ledgerops.sources.tables import load_table

for _name in ("blocks", "transactions", "logs", "token_transfers", "internal_transactions"):
    query(f"s01_{_name}", f"SELECT * FROM {view_sql(_name)}")(
        lambda spark, sf, _n=_name: load_table(spark, sf, _n)
    )


@query(
    "s01_samples",
    "SELECT event_type AS metric, CAST(user_id % 5 AS VARCHAR) AS instance, concat('job-', user_id % 2) AS job, ts, value FROM events",
)
def scan_samples(spark, sf):
    return load_table(spark, sf, "samples").select(
        "metric", F.col("labels")["instance"].alias("instance"), F.col("labels")["job"].alias("job"), "ts", "value"
    )


@query(
    "s02_read_landed_json",
    """SELECT CAST(number AS DECIMAL(38,0)) AS number, lower(hash) AS hash, concat('0x', lpad(miner_hash, 40, 'a')) AS miner,
       CAST(epoch_us("timestamp") // 1000000 AS DECIMAL(38,0)) AS "timestamp"
       FROM """ + view_sql("blocks"),
)
def landed_blocks(spark, sf):
    path = scratch_path(spark, "landed")
    blocks = load_table(spark, sf, "blocks")
    quantity = lambda c: F.concat(F.lit("0x"), F.hex(c))
    blocks.select(
        F.to_json(
            F.struct(
                quantity(F.col("number")).alias("number"),
                F.col("hash"),
                F.concat(F.lit("0x"), F.lpad("miner_hash", 40, "A")).alias("miner"),
                quantity((micros("timestamp") / 1_000_000).cast("bigint")).alias("timestamp"),
            )
        )
    ).write.text(path)
    return files.read_landed_json(spark, path, files.BLOCK_PAYLOAD).drop("_corrupt_record")


@query(
    "s03_write_partitioned",
    """SELECT CAST(ts AS DATE) AS p_day, count(*) AS "rows", min(event_id) AS lo, max(event_id) AS hi FROM events GROUP BY 1""",
)
def written_days(spark, sf):
    path = files.write_partitioned(load_table(spark, sf, "events"), scratch_path(spark, "events"), "ts")
    return spark.read.parquet(path).groupBy("p_day").agg(
        F.count(F.lit(1)).alias("rows"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi")
    )


@query(
    "s03_write_partitioned_wide",
    """SELECT make_timestamp(epoch_us(inserted_at) - epoch_us(inserted_at) % (180 * 86400000000)) AS lo,
       count(*) AS "rows", min(number) AS first_number FROM """ + view_sql("blocks") + " GROUP BY 1",
)
def written_half_years(spark, sf):
    blocks = load_table(spark, sf, "blocks")
    path = files.write_partitioned(blocks, scratch_path(spark, "blocks"), "inserted_at", "180 days")
    # the folder name is read back as a time; its cast keeps the type of the control column
    return spark.read.parquet(path).groupBy(F.col("p_day").cast("timestamp_ntz").alias("lo")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("number").alias("first_number")
    )


@query(
    "s04_append_where",
    "SELECT number, hash, inserted_at FROM " + view_sql("blocks") + " WHERE consensus UNION ALL "
    "SELECT number, hash, inserted_at FROM " + view_sql("blocks") + " WHERE NOT consensus AND number % 2 = 0",
)
def appended(spark, sf):
    path = scratch_path(spark, "append")
    blocks = load_table(spark, sf, "blocks").select("number", "hash", "inserted_at", "consensus")
    files.append_where(blocks, F.col("consensus"), path)
    files.append_where(blocks, ~F.col("consensus") & (F.col("number") % 2 == 0), path)
    return spark.read.parquet(path).drop("consensus")


@query(
    "s05_swap_tables",
    """SELECT 'swapped_live' AS step, count(*) AS "rows" FROM orders WHERE o_orderstatus <> 'P'
       UNION ALL SELECT 'swapped_backup', count(*) FROM orders
       UNION ALL SELECT 'restored_live', count(*) FROM orders""",
)
def swapped(spark, sf):
    tag = scratch_path(spark, "swap").rsplit("-", 1)[1]
    live, staged = f"live_{tag}", f"staged_{tag}"
    blocks = load_table(spark, sf, "blocks")
    for name, df in ((live, blocks), (staged, blocks.where("consensus"))):
        df.write.option("path", scratch_path(spark, name)).saveAsTable(name)
    swap_tables(spark, {live: staged})
    # counts are taken while the swap is in place, then it is undone
    seen = [("swapped_live", spark.table(live).count()), ("swapped_backup", spark.table(live + "_old").count())]
    rollback_swap(spark, {live: staged})
    seen.append(("restored_live", spark.table(live).count()))
    for name in (live, staged):
        spark.sql(f"DROP TABLE {name}")
    return spark.createDataFrame(seen, "step string, rows bigint")


@query(
    "s06_export_import",
    "SELECT number, hash, inserted_at FROM " + view_sql("blocks"),
)
def exported(spark, sf):
    blocks = load_table(spark, sf, "blocks").select("number", "hash", "inserted_at")
    target = scratch_path(spark, "import")
    old, new = blocks.where("number % 2 = 0"), blocks.where("number % 2 = 1")
    csv = files.export_rows(old, scratch_path(spark, "export"), "csv")
    parquet = files.export_rows(new, scratch_path(spark, "export"))
    files.import_rows(spark, csv, target, blocks.schema, "csv")
    files.import_rows(spark, parquet, target)
    return spark.read.parquet(target)


@query(
    "s07_tier_split",
    f"""SELECT CASE WHEN ts >= {now_sql('events')} - INTERVAL 7 DAY THEN 'hot' ELSE 'cold' END AS tier,
        CAST(ts AS DATE) AS p_day, count(*) AS "rows" FROM events GROUP BY 1, 2""",
)
def tiers(spark, sf):
    events = load_table(spark, sf, "events")
    hot, cold = scratch_path(spark, "hot"), scratch_path(spark, "cold")
    files.write_tiers(events, "ts", now_of(spark, sf, "events"), 7, hot, cold)
    both = spark.read.parquet(hot).unionByName(spark.read.parquet(cold))
    return both.groupBy("tier", "p_day").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "s08_synth_blocks",
    f"""SELECT md5(CAST(n AS VARCHAR)) AS hash, n AS number, made AS "timestamp", made AS inserted_at, true AS consensus,
        concat('test block ', n) AS data
        FROM (SELECT o_orderkey + 1 AS n, {now_sql('orders')} - to_days(CAST((o_orderkey + 1) % 7 AS INT)) AS made FROM orders) q""",
)
def synthetic(spark, sf):
    numbers = load_table(spark, sf, "orders").select((F.col("o_orderkey") + 1).alias("n"))
    return files.synth_blocks(numbers, "n", 7, now_of(spark, sf, "orders"))


@query(
    "s09_to_samples",
    f"""WITH q AS (
          SELECT 'blocks' AS t, {age_sql('min(o_orderdate)', now_sql('orders'))} AS a, count(*) AS n FROM orders
          UNION ALL
          SELECT 'transactions', {age_sql('min(l_shipdate)', now_sql('orders'))}, count(*) FROM lineitem)
        SELECT 'data_age_oldest_age_seconds' AS metric, t AS table_name, {now_sql('orders')} AS ts, a AS value FROM q
        UNION ALL SELECT 'data_age_row_count', t, {now_sql('orders')}, CAST(n AS DOUBLE) FROM q""",
)
def health_samples(spark, sf):
    now = now_of(spark, sf, "orders")
    tables = {n: (load_table(spark, sf, n), "inserted_at") for n in ("blocks", "transactions")}
    ages = health.data_ages(tables, now)
    samples = files.to_samples(ages, "data_age", ["table_name"], ["oldest_age_seconds", "row_count"], now)
    return samples.select("metric", F.col("labels")["table_name"].alias("table_name"), "ts", "value")


@query(
    "u01_labelled_counts",
    """SELECT 'blocks' AS table_name, count(*) AS row_count FROM orders
       UNION ALL SELECT 'blocks_canonical', count(*) FROM orders WHERE o_orderstatus <> 'P'
       UNION ALL SELECT 'transactions', count(*) FROM lineitem
       UNION ALL SELECT 'samples', count(*) FROM events""",
)
def counts(spark, sf):
    blocks = load_table(spark, sf, "blocks")
    return health.labelled_counts(
        {
            "blocks": blocks,
            "blocks_canonical": blocks.where("consensus"),
            "transactions": load_table(spark, sf, "transactions"),
            "samples": load_table(spark, sf, "samples"),
        }
    )


@query(
    "u02_union_sources",
    """SELECT event_id AS id, ts AS at, event_type, CAST(NULL AS VARCHAR) AS status, 'events' AS source, 'prod' AS cluster FROM events
       UNION ALL SELECT o_orderkey, o_orderdate, NULL, o_orderstatus, 'orders', 'prod' FROM orders""",
)
def united(spark, sf):
    events = load_table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), "event_type")
    orders = load_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), F.col("o_orderstatus").alias("status")
    )
    return files.union_sources({"events": events, "orders": orders}, {"cluster": "prod"})
