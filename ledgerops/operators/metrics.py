"""Metric samples: instant vectors, rates, growth, histograms, label work.

Everything evaluated on a time grid is a merge of per-cell partial results: samples
first collapse into the cells between window edges, map-side, so a series holding a third
of all samples is reduced before it is shuffled. Windows are then differences of running
sums and carried first and last samples; nothing is copied to the points it reaches.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerops.functions.times import as_datetime, ceil_div, micros, ntz, to_micros, to_timedelta
from ledgerops.operators.ordered import OrderedRows
from ledgerops.session import cut

SECOND = 1_000_000


@dataclass(frozen=True)
class Grid:
    """Evaluation times ``start, start + step, ... <= end``."""

    start: datetime
    end: datetime
    step: timedelta

    @classmethod
    def at(cls, when) -> Grid:
        when = as_datetime(when)
        return cls(when, when, timedelta(seconds=1))

    @classmethod
    def over(cls, start, end, step) -> Grid:
        return cls(as_datetime(start), as_datetime(end), to_timedelta(step))

    @property
    def last(self) -> int:
        return (self.end - self.start) // self.step

    def time(self, i: Column) -> Column:
        return F.timestamp_add("MICROSECOND", i * F.lit(to_micros(self.step)), ntz(self.start))

    def reach(self, ts: str, span) -> tuple[Column, Column]:
        """First and last grid index t with ``t - span < ts <= t``; ``span`` may be a column of microseconds."""
        step = to_micros(self.step)
        offset = micros(ts) - micros(ntz(self.start))
        first = F.greatest(ceil_div(offset, step), F.lit(0))
        wide = span if isinstance(span, Column) else to_micros(span)
        last = F.least(ceil_div(offset + wide, step) - 1, F.lit(self.last).cast("bigint"))
        return first, last

    def touching(self, df: DataFrame, ts: str, span) -> DataFrame:
        """Rows some grid point can see; literal bounds, so the scan can prune."""
        lo, hi = ntz(self.start - to_timedelta(span)), ntz(self.end)
        return df.where((F.col(ts) > lo) & (F.col(ts) <= hi))


def flatten_labels(samples: DataFrame, names: list[str]) -> DataFrame:
    """Named labels as columns, the map dropped; the form most operators group by."""
    return samples.select(
        *[c for c in samples.columns if c != "labels"], *[F.col("labels")[n].alias(n) for n in names]
    )


def series_key(labels: Column | str = "labels") -> Column:
    """A label map as sorted entries, which unlike a map can be a grouping key."""
    return F.array_sort(F.map_entries(labels))


def trailing_windows(
    df: DataFrame, keys: list[str], grid: Grid, ts: str, span, total: str | None = None, longest=None
) -> DataFrame:
    """What the window ``(t - span, t]`` holds at each grid time t: (keys.., t, total, oldest, newest).

    Rows first collapse into the cells between the times where some window begins or ends, of which a series has at most
    two per grid point. In order of cells, a window is a stretch of consecutive ones: its total is a difference of two running sums of one sequence (so a window
    of zeros is exactly zero), its newest row that of the last cell entered, its oldest that of the first cell not yet left. Those change only where a cell
    enters or leaves; each stretch of points between two changes unfolds once, into result rows. Nothing is copied to the points it reaches.

    ``span`` may be a column of microseconds that depends on the keys; ``longest`` then bounds it.
    """
    first, last = grid.reach(ts, span)
    at = F.struct(ts, "value")
    cells = (
        grid.touching(df, ts, longest or span)
        .withColumns({"_first": first, "_last": last})
        .where("_first <= _last")
        .groupBy(*keys, "_first", "_last")
        .agg(F.sum(total or F.lit(0.0)).alias("_sum"), F.min(at).alias("_a"), F.max(at).alias("_b"))
    )
    # a window's group is a series' cells or changes, which the grid bounds
    order = W.partitionBy(*keys).orderBy("_first", "_last")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    cells = cells.withColumns({"_k": F.row_number().over(order), "_upto": F.sum("_sum").over(upto), "_next": F.lead("_a").over(order)})
    nothing = F.lit(None)
    enters = F.struct(
        F.col("_first").alias("_i"), F.struct("_k", "_upto", "_b").alias("_in"), nothing.cast("struct<_k:int,_upto:double>").alias("_out"),
        F.when(F.col("_k") == 1, F.col("_a")).alias("_old"),
    )
    leaves = F.struct(
        (F.col("_last") + 1).alias("_i"), F.when(F.lit(False), F.struct("_k", "_upto", "_b")).alias("_in"),
        F.struct("_k", F.col("_upto").cast("double").alias("_upto")).alias("_out"), F.col("_next").alias("_old"),
    )
    changes = cells.select(*keys, F.inline(F.array(enters, leaves))).where(F.col("_i") <= grid.last)
    # of changes at one point the last cell's stand; it leads the others in every field
    changes = changes.groupBy(*keys, "_i").agg(F.max("_in").alias("_in"), F.max("_out").alias("_out"), F.max("_old").alias("_old"))
    order = W.partitionBy(*keys).orderBy("_i")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    stretches = changes.select(
        *keys, "_i", F.coalesce(F.lead("_i").over(order) - 1, F.lit(grid.last).cast("bigint")).alias("_to"),
        *[F.last(c, ignorenulls=True).over(upto).alias(c) for c in ("_in", "_out", "_old")],
    ).where(F.col("_in._k") > F.coalesce(F.col("_out._k"), F.lit(0)))
    points = stretches.select(
        *keys, F.explode(F.sequence("_i", "_to")).alias("_at"), (F.col("_in._upto") - F.coalesce(F.col("_out._upto"), F.lit(0.0))).alias("total"),
        F.col("_old").alias("oldest"), F.col("_in._b").alias("newest"),
    )
    return points.withColumn("t", grid.time(F.col("_at"))).drop("_at")


def instant_vector(samples: DataFrame, keys: list[str], grid: Grid, lookback="5 minutes") -> DataFrame:
    """Value of each series at each grid time: its last sample within the look-back.

    Result (keys.., t, value). At equal times the higher value wins.
    """
    return trailing_windows(samples, keys, grid, "ts", lookback).select(*keys, "t", F.col("newest.value").alias("value"))


def counter_deltas(samples: DataFrame, keys: list[str], since=None, before=None) -> DataFrame:
    """Increase each sample adds to its counter; a drop means the counter restarted at 0.

    Copies of a sample collapse first; at equal times the higher value counts. With
    ``since``, older samples matter only through the last one per series: they collapse
    to one row each before anything is ordered. ``before`` says how far back that one is
    looked for; the scan then has a lower bound in time, else it reads all history.
    """
    rows = samples.select(*keys, "ts", "value")
    if since is not None:
        since = as_datetime(since)
        older = rows.where(F.col("ts") <= ntz(since))
        if before is not None:
            older = older.where(F.col("ts") > ntz(since - to_timedelta(before)))
        older = older.groupBy(*keys).agg(F.max(F.struct("ts", "value")).alias("_v"))
        older = older.select(*keys, F.col("_v.ts").alias("ts"), F.col("_v.value").alias("value"))
        rows = rows.where(F.col("ts") > ntz(since)).unionByName(older)
    rows = rows.groupBy(*keys, "ts").agg(F.max("value").alias("value"))
    ordered = OrderedRows.of(rows, keys, ["ts"]).previous(_before=F.col("value")).rows
    v, p = F.col("value"), F.col("_before")
    delta = F.when(p.isNull(), F.lit(0.0)).when(v >= p, v - p).otherwise(v)
    return ordered.withColumn("delta", delta).drop("_before")


def increase(samples: DataFrame, keys: list[str], grid: Grid, span="5 minutes", before=None) -> DataFrame:
    """Counter increase over the trailing ``span`` at each grid time: (keys.., t, value).

    ``before`` as in ``counter_deltas``.
    """
    known = samples.where(F.col("ts") <= ntz(grid.end))
    deltas = counter_deltas(known, keys, grid.start - to_timedelta(span), before)
    return trailing_windows(deltas, keys, grid, "ts", span, "delta").select(*keys, "t", F.col("total").alias("value"))


def rate(samples: DataFrame, keys: list[str], grid: Grid, span="5 minutes", before=None) -> DataFrame:
    """Increase per second."""
    seconds = to_micros(span) / SECOND
    return increase(samples, keys, grid, span, before).withColumn("value", F.col("value") / F.lit(seconds))


def growth_per_day(samples: DataFrame, keys: list[str], grid: Grid, span="24 hours") -> DataFrame:
    """Gauge change per day between the first and last sample in the trailing ``span``."""
    seen = trailing_windows(samples, keys, grid, "ts", span)
    seconds = (micros("newest.ts") - micros("oldest.ts")) / F.lit(1e6)
    value = F.when(seconds > 0, (F.col("newest.value") - F.col("oldest.value")) / seconds * 86400)
    return seen.select(*keys, "t", value.alias("value"))


_OPS = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: F.when(b != 0, a / b),
}


def vector_op(left: DataFrame, right: DataFrame, op: str, on: list[str], group_left: list[str] | None = None) -> DataFrame:
    """Combine two vectors label by label: (on.., [group_left..,] t, value).

    Plain form: both sides have one row per (on, t). With ``group_left`` the left side
    may have more rows, told apart by those columns. A zero divisor gives null. A missing
    label counts as empty text, so series without it meet each other.
    """
    left, right = (
        side.withColumns({c: F.coalesce(c, F.lit("")) for c in on if side.schema[c].dataType.simpleString() == "string"})
        for side in (left, right)
    )
    keep = [*on, *(group_left or []), "t"]
    r = right.select(*on, "t", F.col("value").alias("_right"))
    joined = left.select(*keep, "value").join(r, [*on, "t"])
    return joined.select(*keep, _OPS[op](F.col("value"), F.col("_right")).alias("value"))


def agg_vector(vector: DataFrame, op: str, by: list[str] | None = None) -> DataFrame:
    """``sum``, ``max``, ``min``, ``avg`` or ``count`` of a vector, optionally by labels."""
    fn = {"sum": F.sum, "max": F.max, "min": F.min, "avg": F.avg, "count": F.count}[op]
    by = [*(by or []), *(["t"] if "t" in vector.columns else [])]
    return vector.groupBy(*by).agg(fn("value").alias("value"))


def label_cardinality(samples: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` label names with most distinct values."""
    pairs = samples.select(F.explode("labels").alias("label", "label_value")).distinct()
    counts = pairs.groupBy("label").agg(F.count("label_value").alias("distinct_values"))
    return counts.orderBy(F.col("distinct_values").desc(), "label").limit(k)


# Default duration bucket bounds in seconds.
DURATION_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


def to_histogram(df: DataFrame, value: str, bounds: list[float] | None = None, by: list[str] | None = None) -> DataFrame:
    """Cumulative bucket counts: (by.., le, count, total, sum); the last bound is infinity.

    One pass counts all bounds side by side; only the counted row is unfolded.
    """
    by, bounds = by or [], sorted(bounds or DURATION_BOUNDS)
    v = F.col(value)
    counts = [F.count(F.when(v <= b, 1)).alias(f"_b{i}") for i, b in enumerate(bounds)]
    wide = df.groupBy(*by).agg(*counts, F.count(v).alias("total"), F.sum(v).alias("sum"))
    buckets = [F.struct(F.lit(b).alias("le"), F.col(f"_b{i}").alias("count")) for i, b in enumerate(bounds)]
    buckets.append(F.struct(F.lit(float("inf")).alias("le"), F.col("total").alias("count")))
    return wide.select(*by, "total", "sum", F.inline(F.array(*buckets))).select(*by, "le", "count", "total", "sum")


def histogram_quantile(q: float, buckets: DataFrame, by: list[str] | None = None, count: str = "count") -> DataFrame:
    """Quantile by linear interpolation in cumulative buckets: (by.., value).

    Rows of the same bound are summed first, so each group is as small as its bounds.
    """
    by = by or []
    summed = buckets.groupBy(*by, "le").agg(F.sum(count).cast("double").alias("_n"))
    w = W.partitionBy(*by).orderBy("le") if by else W.partitionBy(F.lit(0)).orderBy("le")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    finite = F.when(F.col("le") < float("inf"), F.col("le"))
    seen = summed.select(
        *by, "le", "_n",
        F.coalesce(F.lag("le").over(w), F.lit(0.0)).alias("_lower"),
        F.coalesce(F.lag("_n").over(w), F.lit(0.0)).alias("_below"),
        (F.last("_n").over(whole) * q).alias("_rank"),
        F.last("_n").over(whole).alias("_total"),
        F.max(finite).over(whole).alias("_top"),
    )
    inside = F.when(F.col("_n") > F.col("_below"), (F.col("_rank") - F.col("_below")) / (F.col("_n") - F.col("_below")))
    value = F.when(F.col("_total") <= 0, None).when(F.col("le") == float("inf"), F.col("_top")).otherwise(
        F.col("_lower") + (F.col("le") - F.col("_lower")) * F.coalesce(inside, F.lit(0.0))
    )
    hit = seen.where(F.col("_n") >= F.col("_rank")).withColumn("_value", value)
    return hit.groupBy(*by).agg(F.min_by("_value", "le").alias("value"))


def relabel(samples: DataFrame, source: str, regex: str, target: str, replacement: str = "") -> DataFrame:
    """Set label ``target`` where the whole ``source`` label matches; empty text removes it.

    ``__name__`` as source means the metric name; ``$1`` refers to a regex group.
    """
    value = F.col("metric") if source == "__name__" else F.coalesce(F.col("labels")[source], F.lit(""))
    whole = f"^(?:{regex})$"
    text = F.regexp_replace(value, whole, replacement) if replacement else F.lit("")
    others = F.map_filter("labels", lambda k, _: k != target)
    changed = F.map_filter(F.map_concat(others, F.create_map(F.lit(target), text)), lambda _, v: v != "")
    return samples.withColumn("labels", F.when(value.rlike(whole), changed).otherwise(F.col("labels")))


def sample_bytes() -> Column:
    """Stored size of a sample: time, value, metric name and labels."""
    text = F.aggregate(
        F.map_entries("labels"), F.lit(0), lambda acc, e: acc + F.length(e["key"]) + F.length(e["value"])
    )
    return (F.lit(16) + F.length("metric") + text).cast("bigint")


def retain_samples(samples: DataFrame, as_of, max_age, max_bytes: int) -> DataFrame:
    """Newest whole days within the age limit and the total size limit."""
    young = samples.where(F.col("ts") > ntz(as_datetime(as_of) - to_timedelta(max_age)))
    young = young.withColumn("_day", F.to_date("ts"))
    per_day = young.groupBy("_day").agg(F.sum(sample_bytes()).alias("_bytes"))
    newest_first = W.orderBy(F.col("_day").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    # one row per day inside max_age: bounded by the age limit, not by the data
    kept = per_day.withColumn("_total", F.sum("_bytes").over(newest_first)).where(F.col("_total") <= max_bytes)
    return young.join(F.broadcast(kept.select("_day")), "_day", "left_semi").drop("_day")


def down_targets(up: DataFrame, by: list[str], minimum: float = 1.0) -> DataFrame:
    """Targets reporting 0, with the availability of their group and whether it is too low.

    ``up`` is an instant vector of 0/1 values.
    """
    share = up.groupBy(*by, "t").agg(
        F.count(F.when(F.col("value") == 0, 1)).alias("down"), F.count("value").alias("targets"),
        F.avg("value").alias("availability"),
    )
    return share.where((F.col("down") > 0) | (F.col("availability") < minimum)).withColumn(
        "below_minimum", F.col("availability") < minimum
    )


@dataclass(frozen=True)
class Kpi:
    """A named number over the series of one or two metrics: ``instant``, ``rate``, ``ratio`` (a / b),
    ``rate_ratio`` (rate a / (rate a + rate b)), ``share`` (a / (a + b)) or ``quantile`` (``scale`` is the quantile).

    ``where`` are labels that the series of ``a`` must have; a missing label counts as empty text."""

    name: str
    kind: str
    a: str
    b: str | None = None
    span: str = "5 minutes"
    scale: float = 1.0
    where: dict[str, str] = field(default_factory=dict)


_GATEWAY = {"envoy_http_conn_manager_prefix": "gateway"}

# The report's key figures.
KPIS = [
    Kpi("blocks_per_second", "rate", "blockscout_indexed_blocks_total"),
    Kpi("blocks_per_minute", "rate", "blocks_indexed_total", scale=60.0),
    Kpi("indexing_lag", "instant", "blockscout_indexing_lag_blocks"),
    Kpi("indexing_lag_seconds", "instant", "indexing_lag_seconds"),
    Kpi("pool_usage", "ratio", "blockscout_db_connections_active", "blockscout_db_connections_total"),
    Kpi("connection_usage", "ratio", "pg_stat_activity_count", "pg_settings_max_connections"),
    Kpi("connection_count", "instant", "pg_stat_database_numbackends"),
    Kpi("response_p95", "quantile", "http_request_duration_seconds_bucket", scale=0.95),
    Kpi("request_rate", "rate", "http_requests_total"),
    Kpi("commit_rate", "rate", "pg_stat_database_xact_commit"),
    Kpi("transactions_per_second", "rate", "pg_stat_database_xact_commit", span="1 minute"),
    Kpi("db_cache_hit_ratio", "rate_ratio", "pg_stat_database_blks_hit", "pg_stat_database_blks_read"),
    Kpi("db_cache_hit_share", "share", "pg_stat_database_blks_hit", "pg_stat_database_blks_read"),
    Kpi("pg_replication_lag_seconds", "instant", "pg_replication_lag_seconds"),
    Kpi("cache_memory_use", "ratio", "redis_memory_used_bytes", "redis_memory_max_bytes"),
    Kpi("cache_commands_rate", "rate", "redis_commands_processed_total"),
    Kpi("cache_hit_ratio", "rate_ratio", "redis_keyspace_hits_total", "redis_keyspace_misses_total"),
    Kpi("connected_clients", "instant", "redis_connected_clients"),
    Kpi("packet_forward_rate", "rate", "cilium_forward_count_total"),
    Kpi("packet_drop_rate", "rate", "cilium_drop_count_total"),
    Kpi("policy_drop_rate", "rate", "cilium_drop_count_total", where={"reason": "Policy denied"}),
    Kpi("policy_deny_rate", "rate", "cilium_policy_endpoint_enforcement_outcome", where={"verdict": "denied"}),
    Kpi("datapath_error_rate", "rate", "cilium_datapath_errors_total"),
    Kpi("ready_endpoints", "instant", "cilium_endpoint_state", where={"state": "ready"}),
    Kpi("map_pressure", "instant", "cilium_bpf_map_pressure"),
    Kpi("gateway_request_rate", "rate", "envoy_http_downstream_rq_total", where=_GATEWAY),
    Kpi("gateway_error_rate", "rate", "envoy_http_downstream_rq_xx", where={**_GATEWAY, "envoy_response_code_class": "5"}),
    Kpi("gateway_p99", "quantile", "envoy_http_downstream_rq_time_bucket", scale=0.99),
    Kpi("gateway_p95", "quantile", "envoy_http_downstream_rq_time_bucket", scale=0.95),
    Kpi("gateway_connections", "instant", "envoy_http_downstream_cx_active"),
    Kpi("gateway_endpoints", "instant", "cilium_gateway_endpoint_state"),
    Kpi("gateway_config_updates_rate", "rate", "cilium_gateway_config_updates_total"),
    Kpi("gateway_listeners_ready", "instant", "cilium_gateway_listener_ready"),
]


def kpi_report(samples: DataFrame, at, kpis: list[Kpi] | None = None, lookback="5 minutes", span=None, before=None) -> DataFrame:
    """All key figures at one time: (kpi, value). Series of a metric are summed.

    Gauges take one pass, counters one pass per span; the figures are then expressions over one row of sums, each over the
    series that its labels select. ``before`` as in ``counter_deltas``.
    """
    kpis = kpis or KPIS
    grid = Grid.at(at)
    keyed = samples.withColumn("series", series_key())

    def picked(metric: str, where: dict[str, str]) -> Column:
        conds = [F.coalesce(F.map_from_entries("series")[n], F.lit("")) == v for n, v in where.items()]
        return reduce(lambda x, y: x & y, conds, F.col("metric") == metric)

    def sums(vector: DataFrame, of: list[Kpi], factor: float) -> DataFrame:
        """One row (kpi.a, kpi.b, ..) of the sums that the figures need."""
        parts = [(f"{k.name}.{side}", picked(metric, k.where if side == "a" else {})) for k in of for side, metric in (("a", k.a), ("b", k.b)) if metric]
        return vector.agg(*[(F.sum(F.when(cond, F.col("value"))) * factor).alias(name) for name, cond in parts])

    rows = []
    gauges = [k for k in kpis if k.kind in ("instant", "ratio", "share")]
    if gauges:
        names = sorted({x for k in gauges for x in (k.a, k.b) if x})
        now = instant_vector(keyed.where(F.col("metric").isin(*names)), ["metric", "series"], grid, lookback)
        rows.append(sums(now, gauges, 1.0))
    counted = [k for k in kpis if k.kind in ("rate", "rate_ratio", "quantile")]
    for s in sorted({span or k.span for k in counted}):
        here = [k for k in counted if (span or k.span) == s]
        names = sorted({x for k in here for x in (k.a, k.b) if x})
        # one ordered pass for all counters of a span; the result has a row per series
        grown = cut(increase(keyed.where(F.col("metric").isin(*names)), ["metric", "series"], grid, s, before))
        rates = [k for k in here if k.kind != "quantile"]
        if rates:
            rows.append(sums(grown, rates, SECOND / to_micros(s)))
        for k in here:
            if k.kind == "quantile":
                le = F.map_from_entries("series")["le"]
                bound = F.when(le == "+Inf", F.lit(float("inf"))).otherwise(le.try_cast("double"))
                buckets = grown.where(picked(k.a, k.where)).select(bound.alias("le"), F.col("value").alias("count"))
                rows.append(histogram_quantile(k.scale, buckets).agg(F.max("value").alias(f"{k.name}.a")))
    # each is one row
    together = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), rows)
    row = together.agg(*[F.max(f"`{c}`").alias(c) for c in together.columns])

    def figure(k: Kpi) -> Column:
        a = F.col(f"`{k.name}.a`")
        if k.kind == "quantile":
            return a
        if k.kind in ("instant", "rate"):
            return a * k.scale
        b = F.col(f"`{k.name}.b`")
        below = b if k.kind == "ratio" else a + b
        return F.when(below != 0, a / below)

    out = row.select(*[figure(k).cast("double").alias(k.name) for k in kpis])
    return out.unpivot([], [k.name for k in kpis], "kpi", "value")
