"""Streaming operators run over stored files until their input is done."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerops.operators import partitions as parts
from ledgerops.plans.inputs import now_of, now_sql
from ledgerops.plans.registry import query
from ledgerops.session import scratch_path
from ledgerops.sources.tables import base_table
from ledgerops.streaming import alerts, flows, sinks


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{sf}/events.parque[t]"  # a pattern, so that a single file works like a folder
    return flows.event_time(sinks.read_files(spark, path, base_table(spark, sf, "events").schema), "ts")


def finished(spark: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    """Result of a stream after all present input, read back with zone-free times."""
    path = scratch_path(spark, label)
    sinks.to_parquet(stream, path, scratch_path(spark, f"{label}-state")).awaitTermination()
    out = spark.read.parquet(path)
    times = {f.name: F.col(f.name).cast("timestamp_ntz") for f in out.schema if f.dataType.typeName() == "timestamp"}
    return out.withColumns(times)


def _window_sql(size_us: int, slide_us: int, by: str = "", delay: str = "1 HOUR") -> str:
    """Counts of the windows that are final: those that end before the watermark."""
    cols = f"{by}, " if by else ""
    n = size_us // slide_us
    return f"""(SELECT make_timestamp(s) AS start, make_timestamp(s + {size_us}) AS "end", {cols}count(*) AS events
      FROM (SELECT *, epoch_us(ts) - epoch_us(ts) % {slide_us} - unnest(range({n})) * {slide_us} AS s FROM events) x
      WHERE make_timestamp(s + {size_us}) <= (SELECT max(ts) FROM events) - INTERVAL {delay} GROUP BY ALL)"""


@query(
    "t01_ingest_stream",
    """SELECT CAST(ts AS DATE) AS p_day, count(*) AS "rows", min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY 1""",
)
def ingested(spark, sf):
    path = scratch_path(spark, "ingest")
    for attempt in ("a", "b"):  # the second pass reads the same input again and must add nothing
        state = scratch_path(spark, f"ingest-{attempt}")
        sinks.ingest_stream(event_stream(spark, sf), path, ["event_id"], "ts", state).awaitTermination()
    return spark.read.parquet(path).groupBy("p_day").agg(
        F.count(F.lit(1)).alias("rows"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")
    )


@query(
    "t01_catch_up",
    """SELECT o_orderkey AS number, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
)
def caught_up(spark, sf):
    from ledgerops.plans.chain import gaps

    source = base_table(spark, sf, "orders").select(F.col("o_orderkey").alias("number"), "o_custkey")
    return sinks.catch_up(source, "number", gaps(spark, sf))


@query(
    "t02_stream_rate",
    f"SELECT start, \"end\", event_type, events, events / 60.0::DOUBLE AS per_minute FROM {_window_sql(3_600_000_000, 3_600_000_000, 'event_type')} w",
)
def tumbling(spark, sf):
    return finished(spark, flows.stream_rate(event_stream(spark, sf), "1 hour", "1 hour", by=["event_type"]), "rate")


@query(
    "t03_stream_sliding_rate",
    f"SELECT start, \"end\", events, events / 7200.0::DOUBLE AS per_second FROM {_window_sql(7_200_000_000, 1_800_000_000)} w",
)
def sliding(spark, sf):
    return finished(spark, flows.stream_sliding_rate(event_stream(spark, sf), "2 hours", "30 minutes", "1 hour"), "sliding")


@query(
    "t04_stream_stalls",
    """WITH e AS (SELECT event_type, ts, lag(ts) OVER (PARTITION BY event_type ORDER BY ts) AS p FROM events),
       g AS (SELECT event_type, ts, count(*) FILTER (WHERE p IS NULL OR epoch_us(ts) - epoch_us(p) >= 3600000000) OVER (PARTITION BY event_type ORDER BY ts) AS g FROM e)
       SELECT event_type, min(ts) AS since, max(ts) AS last_seen, count(*) AS events FROM g GROUP BY event_type, g
       HAVING max(ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
)
def stalled(spark, sf):
    return finished(spark, flows.stream_stalls(event_stream(spark, sf), ["event_type"], "1 hour", "1 hour"), "stalls")


_EVALS = """(SELECT event_type AS series, date_trunc('hour', ts) AS t, max(value) > 50 AS "on" FROM events GROUP BY 1, 2)"""


@query(
    "t05_stream_alerts",
    f"""WITH h AS {_EVALS},
       i AS (SELECT *, epoch_us(t) // 3600000000 - row_number() OVER (PARTITION BY series, "on" ORDER BY t) AS g FROM h),
       s AS (SELECT series, t, CASE WHEN "on" THEN min(t) OVER (PARTITION BY series, "on", g) END AS since FROM i),
       st AS (SELECT series, t, CASE WHEN since IS NULL THEN 'inactive' WHEN epoch_us(t) - epoch_us(since) >= 7200000000 THEN 'firing' ELSE 'pending' END AS state, since FROM s),
       r AS (SELECT series, t + INTERVAL 3 HOUR AS t, 'resolved' AS state, since FROM (
         SELECT *, lead(t) OVER (PARTITION BY series ORDER BY t) AS nxt FROM st WHERE state = 'firing') f
         WHERE nxt IS NULL OR epoch_us(nxt) - epoch_us(t) > 10800000000)
       SELECT * FROM (SELECT * FROM st UNION ALL SELECT * FROM r) x WHERE t <= (SELECT max(t) FROM h) - INTERVAL 6 HOUR""",
)
def live_states(spark, sf):
    """Evaluations land in four files, each out of order by up to five hours; the watermark is six."""
    hourly = base_table(spark, sf, "events").groupBy(
        F.col("event_type").alias("series"), F.date_trunc("hour", "ts").cast("timestamp").alias("t")
    ).agg((F.max("value") > 50).alias("on"))
    ends = hourly.agg(F.min("t").alias("lo"), F.max("t").alias("hi")).first()
    jitter = F.unix_seconds("t") + F.pmod(F.xxhash64("series", "t"), F.lit(5)) * 3600
    landed, quarter = scratch_path(spark, "evals"), (ends["hi"] - ends["lo"]).total_seconds() / 4
    part = F.least(F.floor((jitter - F.unix_seconds(F.lit(ends["lo"]))) / F.lit(quarter)), F.lit(3))
    for i in range(4):
        hourly.where(part == i).orderBy(F.xxhash64("t", "series")).coalesce(1).write.mode("append").parquet(landed)
    evals = sinks.read_files(spark, landed, hourly.schema, max_files=1)
    before = alerts.use_rocksdb(spark)
    try:
        return finished(spark, alerts.stream_alerts(evals, "series", "on", "2 hours", "1 hour", "3 hours", "6 hours"), "alerts")
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


@query("t06_stream_dedup", "SELECT DISTINCT event_id, event_type, ts FROM events")
def deduplicated(spark, sf):
    events = event_stream(spark, sf).select("event_id", "event_type", "ts")
    twice = events.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return finished(spark, flows.stream_dedup(twice, ["event_id"], "1 hour"), "dedup")


@query(
    "t07_stream_partitioned_sink",
    f"""SELECT CASE WHEN ts >= {now_sql('events')} - INTERVAL 20 DAY THEN CAST(ts AS DATE) END AS p_day, count(*) AS "rows" FROM events GROUP BY 1""",
)
def routed(spark, sf):
    now, path = now_of(spark, sf, "events"), scratch_path(spark, "sink")
    cal = parts.partition_calendar("events", parts.cutoff(now, "20 days"), now)
    sinks.partitioned_sink(event_stream(spark, sf), "ts", cal, path, scratch_path(spark, "sink-state")).awaitTermination()
    return spark.read.parquet(path).groupBy("p_day").agg(F.count(F.lit(1)).alias("rows"))


_BREACHES = "SELECT start, \"end\", event_type, events, events > 4 + 2 AS burst_breach FROM {w} w WHERE events > 4"


@query("t08_rate_breaches", _BREACHES.format(w=_window_sql(3_600_000_000, 3_600_000_000, "event_type", "0 HOUR").replace("<= (SELECT max(ts) FROM events) - INTERVAL 0 HOUR", "IS NOT NULL")))
def breaches(spark, sf):
    events = flows.event_time(base_table(spark, sf, "events"), "ts")
    out = flows.rate_breaches(events, ["event_type"], 4, 2, "1 hour")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("t08_stream_rate_breaches", _BREACHES.format(w=_window_sql(3_600_000_000, 3_600_000_000, "event_type")))
def stream_breaches(spark, sf):
    return finished(spark, flows.rate_breaches(event_stream(spark, sf), ["event_type"], 4, 2, "1 hour", "1 hour"), "breaches")


@query(
    "t09_stream_match_pending",
    """SELECT p.event_id, p.ts, m.ts AS mined_ts FROM events p LEFT JOIN events m
       ON m.event_id = p.event_id + 3 AND m.event_type = 'purchase' AND epoch_us(m.ts) - epoch_us(p.ts) BETWEEN 0 AND 900000000
       WHERE p.event_type = 'view' AND (m.ts IS NOT NULL OR epoch_us(p.ts) + 900000000 < (SELECT least(max(ts) FILTER (WHERE event_type = 'view'),
         max(ts) FILTER (WHERE event_type = 'purchase')) FROM (SELECT event_type, epoch_us(ts) AS ts FROM events) q) - 3600000000)""",
)
def stream_matched(spark, sf):
    events = event_stream(spark, sf)
    pending = events.where("event_type = 'view'").select("event_id", "ts")
    mined = event_stream(spark, sf).where("event_type = 'purchase'").select((F.col("event_id") - 3).alias("event_id"), "ts")
    return finished(spark, flows.stream_match_pending(pending, mined, "event_id", "15 minutes", "1 hour"), "matched")


@query(
    "t10_refresh_stats",
    """SELECT CAST(ts AS DATE) AS p_day, event_type, count(*) AS "rows", round(sum(value), 4) AS total, max(value) AS highest FROM events GROUP BY 1, 2""",
)
def refreshed(spark, sf):
    path = scratch_path(spark, "stats")
    sinks.refresh_stats(event_stream(spark, sf), "ts", path, scratch_path(spark, "stats-state"), "value", ["event_type"]).awaitTermination()
    return sinks.read_stats(spark, path, ["event_type"]).withColumn("total", F.round("total", 4))
