"""Streams over several micro-batches give the batch result."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerops.operators import alerts as al
from ledgerops.operators import joins
from ledgerops.operators import partitions as parts
from ledgerops.session import scratch_path
from ledgerops.streaming import alerts, flows, sinks
from tests.conftest import rows

T0 = datetime(2024, 1, 1)
SCHEMA = "id bigint, k string, ts timestamp_ntz, v double"


def t(minutes):
    return T0 + timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def data():
    return [(i, "ab"[i % 3 == 0], t(i * 7 % 11 + i * 3), float(i % 13)) for i in range(120)]


@pytest.fixture(scope="module")
def landed(spark, data):
    """Four files that arrive one after the other."""
    path = scratch_path(spark, "t-land")
    for part in range(4):
        spark.createDataFrame(data[part * 30 : part * 30 + 30], SCHEMA).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # file times order the batches
    return path


@pytest.fixture
def stream(spark, landed):
    return lambda: flows.event_time(sinks.read_files(spark, landed, SCHEMA, 1), "ts")


def run(spark, df):
    path = scratch_path(spark, "t-out")
    query = sinks.to_parquet(df, path, scratch_path(spark, "t-state"))
    query.awaitTermination()
    return spark.read.parquet(path)


def final(batch, data, delay, column="end"):
    newest = max(r[2] for r in data)
    return batch.where(F.col(column) <= F.lit((newest - delay).isoformat(sep=" ")).cast("timestamp"))


def test_windows(spark, data, stream):
    batch = flows.event_time(spark.createDataFrame(data, SCHEMA), "ts")
    hour = timedelta(hours=1)
    got = run(spark, flows.stream_rate(stream(), "30 minutes", "1 hour", by=["k"]))
    assert rows(got) == rows(final(flows.stream_rate(batch, "30 minutes", None, by=["k"]), data, hour)) != []
    got = run(spark, flows.stream_sliding_rate(stream(), "30 minutes", "10 minutes", "1 hour"))
    assert rows(got) == rows(final(flows.stream_sliding_rate(batch, "30 minutes", "10 minutes", None), data, hour)) != []
    got = run(spark, flows.rate_breaches(stream(), ["k"], 4, 2, "30 minutes", "1 hour"))
    assert rows(got) == rows(final(flows.rate_breaches(batch, ["k"], 4, 2, "30 minutes"), data, hour)) != []


def test_breach_limits(spark):
    df = spark.createDataFrame([("x", t(0))] * 3 + [("y", t(0))] * 5 + [("z", t(0))] * 6, "k string, ts timestamp")
    got = flows.rate_breaches(df, ["k"], 3, 2)
    assert rows(got.select("k", "events", "burst_breach")) == [("y", 5, False), ("z", 6, True)]


def test_stalls(spark, stream, data):
    batch = flows.event_time(spark.createDataFrame(data, SCHEMA), "ts")
    got = run(spark, flows.stream_stalls(stream(), ["k"], "5 minutes", "1 hour"))
    want = flows.stream_stalls(batch, ["k"], "5 minutes", None).withColumn("end", F.col("last_seen") + F.expr("INTERVAL 5 MINUTES"))
    assert rows(got) == rows(final(want, data, timedelta(hours=1)).drop("end")) != []


def test_dedup_across_batches(spark, stream, data):
    thirds = stream().withColumn("id", F.expr("id div 40 * 40 + id % 20")).where("id is not null")
    got = run(spark, flows.stream_dedup(thirds, ["id"], "10 hours"))
    assert got.count() == got.select("id").distinct().count() == len({r[0] // 40 * 40 + r[0] % 20 for r in data})


def test_partitioned_sink_keeps_late_rows(spark, stream, data):
    cal = parts.partition_calendar("x", "2024-01-01", "2024-01-01", "1 day", 0)
    path = scratch_path(spark, "t-sink")
    moved = stream().withColumn("ts", F.when(F.col("id") % 10 == 0, F.col("ts") - F.expr("INTERVAL 40 DAYS")).otherwise(F.col("ts")))
    sinks.partitioned_sink(moved, "ts", cal, path, scratch_path(spark, "t-state")).awaitTermination()
    out = spark.read.parquet(path)
    assert out.count() == len(data) and out.where("p_day is null").count() == 12


def test_ingest_is_repeatable(spark, landed, stream, data):
    path = scratch_path(spark, "t-ingest")
    for _ in range(2):
        sinks.ingest_stream(stream(), path, ["id"], "ts", scratch_path(spark, "t-state")).awaitTermination()
    assert spark.read.parquet(path).count() == len(data)
    # the same micro-batch again after a crash, with a key the table already holds
    again = scratch_path(spark, "t-ingest")
    batch = spark.createDataFrame(data[:10], SCHEMA)
    for batch_id in (0, 0, 1):
        sinks.ingest_batch(batch, batch_id, again, ["id"], "ts")
    assert spark.read.parquet(again).count() == 10


def test_catch_up(spark, data):
    source = spark.createDataFrame(data, SCHEMA)
    ranges = spark.createDataFrame([(5, 7), (100, 300)], "lo bigint, hi bigint")
    assert sinks.catch_up(source, "id", ranges).count() == 3 + 20


def test_refresh_is_incremental(spark, stream, data):
    path, state = scratch_path(spark, "t-stats"), scratch_path(spark, "t-state")
    for _ in range(2):  # the second run finds nothing new
        sinks.refresh_stats(stream(), "ts", path, state, "v", ["k"]).awaitTermination()
    got = sinks.read_stats(spark, path, ["k"])
    want = spark.createDataFrame(data, SCHEMA).groupBy(F.to_date("ts").alias("p_day"), "k").agg(
        F.count("*").alias("rows"), F.sum("v").alias("total"), F.max("v").alias("highest")
    )
    assert rows(got) == rows(want)


def test_pending_join_matches_batch(spark, landed, data):
    def sides(df):
        return df.where("id % 2 = 0").select("id", "ts"), df.where("id % 3 = 0").select("id", (F.col("ts") + F.expr("INTERVAL 1 MINUTE") * (F.col("id") % 5)).alias("ts"))

    p, m = sides(flows.event_time(sinks.read_files(spark, landed, SCHEMA, 1), "ts"))
    got = run(spark, flows.stream_match_pending(p, m, "id", "2 minutes", "30 minutes"))
    got = {r["id"]: r["mined_ts"] for r in got.collect()}
    bp, bm = sides(spark.createDataFrame(data, SCHEMA))
    want = {r["id"]: r["mined_ts"] for r in joins.match_pending(bp.withColumn("n", F.lit(0)), bm.withColumn("n", F.lit(0)), "id", "ts", "n", "2 minutes").collect()}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
    assert set(got) <= set(want) and any(v is None for v in got.values())


def test_live_alerts_match_batch(spark):
    rng = random.Random(6)
    evals = [(name, t(i), rng.random() < share) for name, share in (("a", 0.8), ("b", 0.5), ("c", 0.97)) for i in range(80) if rng.random() < 0.93]
    evals += [("gone", t(i), True) for i in range(10)] + [("other", t(200), False)]
    late = sorted(evals, key=lambda e: (e[1] + timedelta(minutes=rng.randint(0, 8)), rng.random()))  # out of order, inside the watermark
    path, n = scratch_path(spark, "t-evals"), len(late) // 5
    for i in range(0, len(late), n):
        spark.createDataFrame(late[i : i + n], "series string, t timestamp, on boolean").coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    before = alerts.use_rocksdb(spark)
    try:
        live = sinks.read_files(spark, path, "series string, t timestamp, on boolean", 1)
        out = run(spark, alerts.stream_alerts(live, "series", "on", "2 minutes", "1 minute", "3 minutes", "10 minutes")).where("series <> 'other'").collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set(
            "spark.sql.streaming.stateStore.providerClass", before
        )
    batch = spark.createDataFrame(evals, "series string, t timestamp_ntz, on boolean").where("series <> 'other'")
    states = al.alert_state(batch, ["series"], "on", 120, "1 minute")
    want = [tuple(r) for r in states.select("series", "t", "state", "since").collect()]
    resolved = [(r["series"], r["resolved_at"]) for r in al.resolve(states, ["series"], "3 minutes").collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in out if r["state"] != "resolved"), key=key) == sorted(want, key=key)
    assert sorted((r["series"], r["t"]) for r in out if r["state"] == "resolved") == sorted(resolved)
    assert len(resolved) > 5


def test_runs_are_folded_and_repeats_change_nothing(spark):
    path, by = scratch_path(spark, "t-fold"), ["k"]

    def add(i):
        rows = [(datetime(2024, 1, 1 + i % 5).date(), "a", 2, float(i), float(i))]
        sinks.add_stats(spark.createDataFrame(rows, "p_day date, k string, rows bigint, total double, highest double").coalesce(1), i, path, by)

    want, before = lambda n: (2 * n, sum(map(float, range(n)))), sinks.FOLD
    try:
        sinks.FOLD = 3
        for i in range(20):
            add(i)
            if i in (2, 8, 10):
                add(i), add(max(0, i - 1))
            got = sinks.read_stats(spark, path, by).agg(F.sum("rows"), F.sum("total")).first()
            assert tuple(got) == want(i + 1)
        assert len(sinks._runs(spark, path)) <= 2 * 3 * 3
        assert sinks.read_stats(spark, path, by).count() == 5
    finally:
        sinks.FOLD = before
    with pytest.raises(ValueError, match="no statistics"):
        sinks.read_stats(spark, scratch_path(spark, "t-none"), by)


def test_sessions_merge_before_the_shuffle(spark):
    landed, out = scratch_path(spark, "t-hot"), scratch_path(spark, "t-hot-out")
    hot = spark.range(20_000, numPartitions=4).select(F.lit("hot").alias("k"), F.timestamp_seconds(F.col("id") % 100).alias("ts"))
    late = hot.limit(1).withColumn("ts", F.timestamp_seconds(F.lit(100_000)))
    hot.unionByName(late).write.parquet(landed)
    found = flows.stream_stalls(sinks.read_files(spark, landed, hot.schema), ["k"], "5 minutes", "1 hour")
    query = sinks.to_parquet(found, out, scratch_path(spark, "t-state"))
    query.awaitTermination()
    plan = query._jsq.explainInternal(False)
    assert "MergingSessions" in plan[plan.index("Exchange hashpartitioning"):]  # below the shuffle, and above it
    assert [tuple(r) for r in spark.read.parquet(out).select("events").collect()] == [(20_000,)]
