"""Metric operators over the samples table."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ledgerops.operators import metrics as m
from ledgerops.plans.inputs import now_of, now_sql, sql_frame
from ledgerops.plans.registry import query
from ledgerops.sources.tables import load_table

KEYS = ["metric", "instance", "job"]
_S = "(SELECT event_type AS metric, CAST(user_id % 5 AS VARCHAR) AS instance, concat('job-', user_id % 2) AS job, ts, value FROM events)"
_NOW = now_sql("events")
_GRID = f"(SELECT unnest(generate_series({_NOW} - INTERVAL 20 DAY, {_NOW}, INTERVAL 6 HOUR)) AS t)"


def samples(spark, sf):
    return m.flatten_labels(load_table(spark, sf, "samples"), ["instance", "job"])


def grid(spark, sf, days=20, step="6 hours"):
    now = now_of(spark, sf, "events")
    return m.Grid.over(now - timedelta(days=days), now, step)


def instant_sql(hours: int = 12) -> str:
    return f"""(SELECT k.metric, k.instance, k.job, g.t, s.value FROM (SELECT DISTINCT metric, instance, job FROM {_S} x) k CROSS JOIN {_GRID} g
      ASOF JOIN {_S} s ON s.metric = k.metric AND s.instance = k.instance AND s.job = k.job AND g.t >= s.ts
      WHERE epoch_us(g.t) - epoch_us(s.ts) < {hours} * 3600000000)"""


def instant(spark, sf):
    return m.instant_vector(samples(spark, sf), KEYS, grid(spark, sf), "12 hours")


@query("j09_instant_vector", f"SELECT * FROM {instant_sql()} q")
def instants(spark, sf):
    return instant(spark, sf)


@query("j09_instant_vector_at", f"SELECT * FROM {instant_sql()} q WHERE t = {_NOW}")
def instant_at(spark, sf):
    return m.instant_vector(samples(spark, sf), KEYS, m.Grid.at(now_of(spark, sf, "events")), "12 hours")


_DELTAS = f"""(SELECT metric, instance, job, ts, CASE WHEN p IS NULL THEN 0 WHEN value >= p THEN value - p ELSE value END AS d
  FROM (SELECT *, lag(value) OVER (PARTITION BY metric, instance, job ORDER BY ts) AS p FROM {_S} s) x)"""


def increase_sql(hours: int) -> str:
    return f"""(SELECT metric, instance, job, t, sum(d) AS value FROM {_GRID} g JOIN {_DELTAS} d
      ON d.ts <= g.t AND d.ts > g.t - INTERVAL {hours} HOUR GROUP BY 1, 2, 3, 4)"""


@query("w01_increase", f"SELECT metric, instance, job, t, round(value, 6) AS value FROM {increase_sql(24)} q")
def increases(spark, sf):
    return m.increase(samples(spark, sf), KEYS, grid(spark, sf), "24 hours").withColumn("value", F.round("value", 6))


@query("w01_rate", f"SELECT metric, instance, job, t, round(value / 36000, 9) AS value FROM {increase_sql(10)} q")
def rates(spark, sf):
    # a span that is no multiple of the step
    return m.rate(samples(spark, sf), KEYS, grid(spark, sf), "10 hours").withColumn("value", F.round("value", 9))


@query(
    "w02_growth_per_day",
    f"""SELECT metric, instance, job, t, round(CASE WHEN max(ts) > min(ts) THEN (arg_max(value, ts) - arg_min(value, ts))
          / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) * 86400 END, 4) AS value
        FROM {_GRID} g JOIN {_S} s ON s.ts <= g.t AND s.ts > g.t - INTERVAL 24 HOUR GROUP BY 1, 2, 3, 4""",
)
def growth(spark, sf):
    return m.growth_per_day(samples(spark, sf), KEYS, grid(spark, sf), "24 hours").withColumn("value", F.round("value", 4))


@query(
    "j06_vector_op",
    f"""SELECT l.instance, l.job, l.t, l.value / r.value AS value FROM {instant_sql()} l JOIN {instant_sql()} r
        ON l.metric = 'click' AND r.metric = 'view' AND l.instance = r.instance AND l.job = r.job AND l.t = r.t""",
)
def ratio(spark, sf):
    v = instant(spark, sf)
    return m.vector_op(v.where("metric = 'click'"), v.where("metric = 'view'"), "/", ["instance", "job"])


@query(
    "j08_vector_op_group_left",
    f"""SELECT l.job, l.instance, l.t, round(l.value / r.value, 6) AS value FROM {instant_sql()} l
        JOIN (SELECT job, t, sum(value) AS value FROM {instant_sql()} x WHERE metric = 'view' GROUP BY 1, 2) r
        ON l.metric = 'click' AND l.job = r.job AND l.t = r.t""",
)
def many_to_one(spark, sf):
    v = instant(spark, sf)
    views = m.agg_vector(v.where("metric = 'view'"), "sum", ["job"])
    out = m.vector_op(v.where("metric = 'click'"), views, "/", ["job"], group_left=["instance"])
    return out.withColumn("value", F.round("value", 6))


@query("a11_agg_vector_sum_by", f"SELECT instance, t, round(sum(value), 6) AS value FROM {instant_sql()} q GROUP BY 1, 2")
def summed(spark, sf):
    return m.agg_vector(instant(spark, sf), "sum", ["instance"]).withColumn("value", F.round("value", 6))


@query("a11_agg_vector_max", f"SELECT t, max(value) AS value FROM {instant_sql()} q GROUP BY 1")
def highest(spark, sf):
    return m.agg_vector(instant(spark, sf), "max")


@query(
    "a17_label_cardinality",
    """SELECT 'instance' AS label, count(DISTINCT user_id % 5) AS distinct_values FROM events
       UNION ALL SELECT 'job', count(DISTINCT user_id % 2) FROM events""",
)
def cardinality(spark, sf):
    return m.label_cardinality(load_table(spark, sf, "samples"), 10)


_BOUNDS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0]
_HISTOGRAM = "(" + " UNION ALL ".join(
    [f"SELECT event_type, {b}::DOUBLE AS le, count(*) FILTER (WHERE value <= {b}) AS \"count\", count(value) AS total, sum(value) AS \"sum\" FROM events GROUP BY 1" for b in _BOUNDS]
    + ["SELECT event_type, 'Infinity'::DOUBLE, count(value), count(value), sum(value) FROM events GROUP BY 1"]
) + ")"


def histogram(spark, sf):
    return m.to_histogram(load_table(spark, sf, "events"), "value", _BOUNDS, ["event_type"])


@query(
    "a18_to_histogram",
    f"""SELECT event_type, CASE WHEN le = 'Infinity' THEN '+Inf' ELSE CAST(le AS VARCHAR) END AS le, "count", total, round("sum", 4) AS "sum" FROM {_HISTOGRAM} h""",
)
def histograms(spark, sf):
    le = F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("string"))
    return histogram(spark, sf).withColumn("le", le).withColumn("sum", F.round("sum", 4))


def quantile_sql(q: float, source: str, by: str | None) -> str:
    part = f"PARTITION BY {by}" if by else ""
    cols, pre = (f"{by},", f"GROUP BY {by}, le") if by else ("", "GROUP BY le")
    return f"""(SELECT {cols} arg_min(v, le) AS value FROM (
        SELECT {cols} le, CASE WHEN le = 'Infinity' THEN top ELSE lo + (le - lo) * CASE WHEN n > below THEN (rank - below) / (n - below) ELSE 0 END END AS v
        FROM (SELECT {cols} le, n, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(n) OVER w, 0) AS below,
                {q} * last(n) OVER whole AS rank, max(CASE WHEN le < 'Infinity' THEN le END) OVER whole AS top
              FROM (SELECT {cols} le, CAST(sum("count") AS DOUBLE) AS n FROM {source} b {pre}) s
              WINDOW w AS ({part} ORDER BY le), whole AS ({part} ORDER BY le ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) y
        WHERE n >= rank) z {f'GROUP BY {by}' if by else ''})"""


@query("a19_histogram_quantile", f"SELECT event_type, round(value, 6) AS value FROM {quantile_sql(0.95, _HISTOGRAM, 'event_type')} q")
def quantiles(spark, sf):
    return m.histogram_quantile(0.95, histogram(spark, sf), ["event_type"]).withColumn("value", F.round("value", 6))


@query("a19_histogram_quantile_all", f"SELECT round(value, 6) AS value FROM {quantile_sql(0.5, _HISTOGRAM, None)} q")
def quantile_all(spark, sf):
    return m.histogram_quantile(0.5, histogram(spark, sf)).withColumn("value", F.round("value", 6))


@query(
    "l07_relabel",
    """SELECT event_type AS metric, CASE WHEN event_type LIKE 's%' THEN NULL ELSE CAST(user_id % 5 AS VARCHAR) END AS instance,
       concat('job-', user_id % 2) AS job, concat('n', user_id % 2) AS pool, ts, value FROM events""",
)
def relabelled(spark, sf):
    s = m.relabel(load_table(spark, sf, "samples"), "__name__", "s.*", "instance", "")
    s = m.relabel(s, "job", "job-(.*)", "pool", "n$1")
    label = lambda n: F.col("labels")[n].alias(n)
    return s.select("metric", label("instance"), label("job"), label("pool"), "ts", "value")


@query(
    "l08_retain_samples",
    f"""WITH s AS (SELECT event_type AS metric, ts, value, CAST(ts AS DATE) AS d,
          16 + length(event_type) + length('instance') + 1 + length('job') + length('job-0') AS b FROM events WHERE ts > {_NOW} - INTERVAL 20 DAY),
        days AS (SELECT d, sum(sum(b)) OVER (ORDER BY d DESC) AS total FROM s GROUP BY d)
        SELECT metric, ts, value FROM s WHERE d IN (SELECT d FROM days WHERE total <= (SELECT sum(b) * 0.6 FROM s))""",
)
def retained(spark, sf):
    s, now = load_table(spark, sf, "samples"), now_of(spark, sf, "events")
    young = s.where(F.col("ts") > F.lit((now - timedelta(days=20)).isoformat(sep=" ")).cast("timestamp_ntz"))
    budget = int(young.agg(F.sum(m.sample_bytes())).first()[0] * 0.6)
    return m.retain_samples(s, now, "20 days", budget).select("metric", "ts", "value")


@query(
    "l10_down_targets",
    f"""SELECT job, t, count(*) FILTER (WHERE up = 0) AS down, count(*) AS targets, round(avg(up), 6) AS availability, avg(up) < 0.5 AS below_minimum
        FROM (SELECT job, t, CASE WHEN value > 20 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS up FROM {instant_sql()} q WHERE metric = 'error') u
        GROUP BY 1, 2 HAVING count(*) FILTER (WHERE up = 0) > 0 OR avg(up) < 0.5""",
)
def down(spark, sf):
    up = instant(spark, sf).where("metric = 'error'").withColumn("value", F.when(F.col("value") > 20, 1.0).otherwise(0.0))
    return m.down_targets(up, ["job"], 0.5).withColumn("availability", F.round("availability", 6))


# Key-figure samples: each event is a sample of one of the metrics the report reads. Series of half the users have the labels
# that the figures select, some have others, and some lack them.
_KPI_METRICS = sorted({x for k in m.KPIS for x in (k.a, k.b) if x})
_KPI_LABELS = {n: v for k in m.KPIS for n, v in k.where.items()}
_KPI_SQL = (
    "SELECT CASE event_id % " + str(len(_KPI_METRICS))
    + "".join(f" WHEN {i} THEN '{n}'" for i, n in enumerate(_KPI_METRICS))
    + " END AS metric, CAST(user_id % 3 AS STRING) AS instance, "
    + "".join(f"CASE user_id % 4 WHEN 2 THEN 'other' WHEN 3 THEN NULL ELSE '{v}' END AS {n}, " for n, v in _KPI_LABELS.items())
    + "CASE user_id % 4 WHEN 0 THEN '0.5' WHEN 1 THEN '1.0' WHEN 2 THEN '5.0' ELSE '+Inf' END AS le, ts, value FROM {events}"
)
_K = "(" + _KPI_SQL.format(events="events") + ")"


def _kpi_sql() -> str:
    some = ", ".join(_KPI_LABELS)  # le tells the sets of labels apart
    inst = f"""(SELECT metric, {some}, arg_max(value, ts) AS v FROM {_K} k
      WHERE ts <= {_NOW} AND ts > {_NOW} - INTERVAL 24 HOUR GROUP BY metric, instance, le, {some})"""
    inc = f"""(SELECT metric, instance, le, {some}, sum(d) AS d FROM (SELECT metric, instance, le, {some}, ts,
        CASE WHEN p IS NULL THEN 0 WHEN value >= p THEN value - p ELSE value END AS d
        FROM (SELECT *, lag(value) OVER (PARTITION BY metric, instance, le ORDER BY ts) AS p FROM {_K} k) y) z
      WHERE ts > {_NOW} - INTERVAL 120 HOUR GROUP BY metric, instance, le, {some})"""
    def one(k):
        source, value = (inc, "sum(d) / 432000") if k.kind in ("rate", "rate_ratio") else (inst, "sum(v)")
        match = " AND ".join(["TRUE", *(f"{n} = '{v}'" for n, v in k.where.items())])
        a, b = f"(SELECT {value} FROM {source} t WHERE metric = '{k.a}' AND {match})", f"(SELECT {value} FROM {source} t WHERE metric = '{k.b}')"
        if k.kind == "quantile":
            buckets = f"""(SELECT CASE WHEN le = '+Inf' THEN 'Infinity'::DOUBLE ELSE CAST(le AS DOUBLE) END AS le, d AS "count" FROM {inc} i WHERE metric = '{k.a}')"""
            return f"(SELECT value FROM {quantile_sql(k.scale, buckets, None)} q)"
        if k.kind in ("rate", "instant"):
            return f"{a} * {k.scale}"
        return f"{a} / {b if k.kind == 'ratio' else f'({a} + {b})'}"
    return " UNION ALL ".join(f"SELECT '{k.name}' AS kpi, round({one(k)}, 9) AS value" for k in m.KPIS)


@query("l09_kpi_report", _kpi_sql())
def kpis(spark, sf):
    s = sql_frame(spark, sf, _KPI_SQL, "events")
    entries = [x for n in ("instance", "le", *_KPI_LABELS) for x in (F.lit(n), F.col(n))]
    labels = F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull())
    s = s.select("metric", labels.alias("labels"), "ts", "value")
    report = m.kpi_report(s, now_of(spark, sf, "events"), lookback="24 hours", span="120 hours")
    return report.withColumn("value", F.round("value", 9))


# As w01_rate, with the value before the span looked for in two days only, so that the scan has a lower bound in time.
_FROM = f"{_NOW} - INTERVAL 20 DAY - INTERVAL 10 HOUR"
_NEAR = f"""(SELECT metric, instance, job, ts, CASE WHEN p IS NULL THEN 0 WHEN value >= p THEN value - p ELSE value END AS d
  FROM (SELECT *, lag(value) OVER (PARTITION BY metric, instance, job ORDER BY ts) AS p FROM {_S} s WHERE ts > {_FROM} - INTERVAL 2 DAY) x)"""


@query(
    "w01_rate_recent",
    f"""SELECT metric, instance, job, t, round(sum(d) / 36000, 9) AS value FROM {_GRID} g JOIN {_NEAR} d
        ON d.ts <= g.t AND d.ts > g.t - INTERVAL 10 HOUR GROUP BY 1, 2, 3, 4""",
)
def recent_rates(spark, sf):
    return m.rate(samples(spark, sf), KEYS, grid(spark, sf), "10 hours", before="2 days").withColumn("value", F.round("value", 9))
