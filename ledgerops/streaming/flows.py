"""Stream operators: streaming DataFrame in, streaming DataFrame out.

Event time is TIMESTAMP here, because watermarks are not defined on TIMESTAMP_NTZ;
``event_time`` converts at the edge. The session time zone is UTC, as for all operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerops.functions.times import to_micros


#: Spark merges the sessions of a stream within each task, before the shuffle, where this is set.
LOCAL_SESSIONS = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def event_time(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def _interval(text: str) -> str:
    return f"{to_micros(text)} microseconds"


def _windowed(df: DataFrame, size: str, slide: str | None, ts: str, watermark: str | None, by: list[str]) -> DataFrame:
    if watermark is not None:
        df = df.withWatermark(ts, _interval(watermark))
    window = F.window(ts, _interval(size), _interval(slide) if slide else None)
    counts = df.groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("events"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "events")


def stream_rate(df: DataFrame, size: str, watermark: str | None, ts: str = "ts", by: list[str] | None = None) -> DataFrame:
    """Events per tumbling window, and per minute."""
    out = _windowed(df, size, None, ts, watermark, by or [])
    return out.withColumn("per_minute", F.col("events") / F.lit(to_micros(size) / 60e6))


def stream_sliding_rate(
    df: DataFrame, size: str, slide: str, watermark: str | None, ts: str = "ts", by: list[str] | None = None
) -> DataFrame:
    """Events per second over a trailing window, evaluated every ``slide``."""
    out = _windowed(df, size, slide, ts, watermark, by or [])
    return out.withColumn("per_second", F.col("events") / F.lit(to_micros(size) / 1e6))


def stream_stalls(df: DataFrame, keys: list[str], gap: str, watermark: str | None, ts: str = "ts") -> DataFrame:
    """Activity stretches that ended because nothing came for ``gap``: (keys.., since, last_seen, events).

    Sessions of a stream are merged in each task before they are shuffled, so a hot key sends a row per stretch and task, not one per event. The setting for
    this changes no result; it is switched on in the session of ``df``.
    """
    df.sparkSession.conf.set(LOCAL_SESSIONS, "true")
    if watermark is not None:
        df = df.withWatermark(ts, _interval(watermark))
    sessions = df.groupBy(F.session_window(ts, _interval(gap)).alias("w"), *keys).agg(F.count(F.lit(1)).alias("events"))
    last = F.timestamp_add("MICROSECOND", F.lit(-to_micros(gap)), F.col("w.end"))
    return sessions.select(*keys, F.col("w.start").alias("since"), last.alias("last_seen"), "events")


def stream_dedup(df: DataFrame, keys: list[str], watermark: str, ts: str = "ts") -> DataFrame:
    """First arrival per record key; state is dropped once the watermark has passed."""
    return df.withWatermark(ts, _interval(watermark)).dropDuplicatesWithinWatermark(keys)


def rate_breaches(
    df: DataFrame, keys: list[str], limit: int, burst: int, size: str = "1 second", watermark: str | None = None, ts: str = "ts"
) -> DataFrame:
    """Windows in which a key made more than ``limit`` requests; ``burst_breach`` above limit + burst.

    Serves batch and stream alike; counts combine map-side, so one hot key is cheap.
    """
    out = _windowed(df, size, None, ts, watermark, keys).where(F.col("events") > limit)
    return out.withColumn("burst_breach", F.col("events") > limit + burst)


def stream_match_pending(
    pending: DataFrame, mined: DataFrame, key: str, bound: str, watermark: str, ts: str = "ts"
) -> DataFrame:
    """Pending records with the mined record of their key within ``bound``.

    ``key`` identifies one record on each side. Pending records without a partner
    come out with nulls once the watermark rules a partner out.
    """
    p = pending.withWatermark(ts, _interval(watermark)).alias("p")
    m = mined.select(F.col(key).alias("_key"), F.col(ts).alias("mined_ts"))
    m = m.withWatermark("mined_ts", _interval(watermark)).alias("m")
    seconds = "%d.%06d" % divmod(to_micros(bound), 1_000_000)
    in_time = F.expr(f"mined_ts >= p.{ts} AND mined_ts <= p.{ts} + INTERVAL '{seconds}' SECOND")
    return p.join(m, (F.col(f"p.{key}") == F.col("_key")) & in_time, "leftOuter").drop("_key")
