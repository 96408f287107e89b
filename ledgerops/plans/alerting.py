"""Alert rules, routing and notifications over stored tables."""

from __future__ import annotations

from dataclasses import replace
from datetime import timedelta

from pyspark.sql import functions as F

from ledgerops.operators import alerts as al
from ledgerops.operators import metrics as m
from ledgerops.plans.inputs import now_of, now_sql, sql_frame
from ledgerops.plans.metrics import grid, instant_sql
from ledgerops.plans.registry import query
from ledgerops.sources.tables import load_table

_NOW = now_sql("events")
_GRID = f"(SELECT unnest(generate_series({_NOW} - INTERVAL 20 DAY, {_NOW}, INTERVAL 6 HOUR)) AS t)"


def islands_sql(source: str, keys: str, for_s: str, step_us: int = 21_600_000_000) -> str:
    """States of true evaluations: stretches of consecutive grid times."""
    return f"""(SELECT *, min(t) OVER (PARTITION BY {keys}, island) AS since,
        CASE WHEN (epoch_us(t) - epoch_us(min(t) OVER (PARTITION BY {keys}, island))) / 1e6 >= {for_s} THEN 'firing' ELSE 'pending' END AS state
      FROM (SELECT *, epoch_us(t) // {step_us} - row_number() OVER (PARTITION BY {keys} ORDER BY t) AS island FROM {source} s) i)"""


_CLICKS = f"(SELECT instance, job, t, value FROM {instant_sql(24)} q WHERE metric = 'click')"


def clicks(spark, sf):
    v = m.instant_vector(
        m.flatten_labels(load_table(spark, sf, "samples").where("metric = 'click'"), ["instance", "job"]),
        ["instance", "job"], grid(spark, sf), "24 hours",
    )
    return v.withColumn("high", F.col("value") > 30)


@query(
    "w03_alert_state",
    f"""SELECT instance, job, t, value, state, since FROM {islands_sql(f'(SELECT * FROM {_CLICKS} c WHERE value > 30)', 'instance, job', '43200')} x
        UNION ALL SELECT instance, job, t, value, 'inactive', NULL FROM {_CLICKS} c WHERE NOT value > 30""",
)
def states(spark, sf):
    out = al.alert_state(clicks(spark, sf), ["instance", "job"], "high", 43200, "6 hours")
    return out.select("instance", "job", "t", "value", "state", "since")


# Rule samples: each event is a sample of one rule metric, scaled to straddle its threshold. Two instances have three
# sets of labels each: those the matchers look for, others (a second job, pod, database), and some that are missing.
_N = len(al.METRICS)
_RULE_VALUE = {
    "up": f"(event_id // {_N}) % 2", "redis_up": f"(event_id // {_N}) % 2", "cnpg_pg_cluster_last_backup_succeeded": f"(event_id // {_N}) % 2",
    "kube_deployment_status_replicas_available": f"(event_id // {_N}) % 3", "pg_database_size_bytes": "value * 1e10",
    "kubelet_volume_stats_capacity_bytes": "value * 1e10", "pg_stat_user_tables_last_autovacuum": "1704067200 + value * 20000",
    "cnpg_pg_cluster_last_backup_timestamp": "1704067200 + value * 20000", "pg_partman_maintenance_last_run_seconds_since_maintenance": "value * 100",
    "pg_partman_default_partition_rows_default_rows": "value * 200", "http_requests_per_second": "value * 20",
    "cpu_utilization": "value / 50", "response_seconds": "value / 50",
}
_LABELS = {
    "job": ("'indexer-postgresql'", "'node-exporter'", "NULL"),
    "pod": ("'indexer-backend-0'", "'indexer-backend-1'", "'indexer-frontend-0'"),
    "deployment": ("'indexer-backend'", "'indexer-frontend'", "NULL"),
    "datname": ("'blockscout'", "'postgres'", "'blockscout'"),
    "schemaname": ("'public'", "'public'", "NULL"),
    "relname": ("'blocks'", "'transactions'", "'my_logs'"),
    "persistentvolumeclaim": ("'indexer-postgresql-1'", "'other-0'", "'indexer-postgresql-2'"),
    "parent_table": ("'table_0'", "'table_1'", "NULL"),
}


def _rule_samples_sql(spark_side: bool) -> str:
    metric = "".join(f" WHEN {i} THEN '{name}'" for i, name in enumerate(al.METRICS))
    value = "".join(f" WHEN {al.METRICS.index(k)} THEN CAST({v} AS DOUBLE)" for k, v in _RULE_VALUE.items())
    labels = "".join(f" CASE user_id % 3 WHEN 0 THEN {a} WHEN 1 THEN {b} ELSE {c} END AS {n}," for n, (a, b, c) in _LABELS.items())
    text = f"""SELECT CASE event_id % {_N} {metric} END AS metric, CAST(user_id // 3 % 2 AS STRING) AS instance, {labels}
      user_id % 3 AS v, ts, CASE event_id % {_N} {value} ELSE value END AS value FROM {{events}}"""
    return text.replace("//", "div").replace("e10", "e10D") if spark_side else text


def rule_samples(spark, sf):
    s = sql_frame(spark, sf, _rule_samples_sql(True), "events")
    entries = [x for n in ("instance", *_LABELS) for x in (F.lit(n), F.col(n))]
    return s.select("metric", F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull()).alias("labels"), "ts", "value")


# The samples lie hours apart, so spans and durations are stretched alike.
STRETCH = 72


def stretched(rules):
    wide = lambda t: replace(t, span="5 days") if t.fn == "rate" else t
    return [replace(r, hold_for=r.hold_for * STRETCH, terms=tuple(wide(t) for t in r.terms)) for r in rules]


# A series is a metric with its labels, which the instance and v give.
_R = "(" + _rule_samples_sql(False).format(events="events") + ")"
_INST = f"""(SELECT k.metric, k.instance, k.v, g.t, s.value FROM (SELECT DISTINCT metric, instance, v FROM {_R} x) k CROSS JOIN {_GRID} g
  ASOF JOIN {_R} s ON s.metric = k.metric AND s.instance = k.instance AND s.v = k.v AND g.t >= s.ts
  WHERE epoch_us(g.t) - epoch_us(s.ts) < 86400000000)"""
_RATES = f"""(SELECT metric, instance, v, t, sum(d) / 432000 AS value FROM {_GRID} g JOIN (
    SELECT metric, instance, v, ts, CASE WHEN p IS NULL THEN 0 WHEN value >= p THEN value - p ELSE value END AS d
    FROM (SELECT *, lag(value) OVER (PARTITION BY metric, instance, v ORDER BY ts) AS p FROM {_R} s) x) d
  ON d.ts <= g.t AND d.ts > g.t - INTERVAL 120 HOUR GROUP BY 1, 2, 3, 4)"""
_GROWTH = f"""(SELECT metric, instance, v, t, CASE WHEN max(ts) > min(ts) THEN (arg_max(value, ts) - arg_min(value, ts))
    / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) * 86400 END AS value
  FROM {_GRID} g JOIN {_R} s ON s.ts <= g.t AND s.ts > g.t - INTERVAL 24 HOUR GROUP BY 1, 2, 3, 4)"""
_SETS = "(SELECT DISTINCT v, " + ", ".join(_LABELS) + f" FROM {_R} x)"


def _one(metric, cond, source="inst", value="value", match="TRUE"):
    return f"SELECT instance, v, t, {value} AS value, NULL AS claim FROM {source} JOIN sets USING (v) WHERE metric = '{metric}' AND {value} {cond} AND {match}"


def _two(a, op, b, cond, match="TRUE"):
    return f"""SELECT instance, v, t, a.value {op} b.value AS value, NULL AS claim FROM inst a JOIN inst b USING (instance, v, t) JOIN sets USING (v)
      WHERE a.metric = '{a}' AND b.metric = '{b}' AND a.value {op} b.value {cond} AND {match}"""


def _avg(metric, cond, fn="avg"):
    return f"SELECT NULL AS instance, NULL AS v, t, {fn}(value) AS value, NULL AS claim FROM inst WHERE metric = '{metric}' GROUP BY t HAVING {fn}(value) {cond}"


_AGE = "epoch_us(t) / 1e6 - value"
_POD = "regexp_full_match(coalesce(pod, ''), 'indexer-backend-.*')"
_SHARE = """SELECT instance, v, t, a.value / (a.value + b.value) AS value, NULL AS claim FROM rates a JOIN rates b USING (instance, v, t)
  WHERE a.metric = 'redis_keyspace_hits_total' AND b.metric = 'redis_keyspace_misses_total' AND a.value / (a.value + b.value) < 0.7"""
_STORAGE = """SELECT a.instance, a.v, a.t, a.value / b.value AS value, claim FROM inst a JOIN sets USING (v) JOIN (
    SELECT instance, t, max(value) AS value, arg_max(persistentvolumeclaim, value) AS claim FROM inst JOIN sets USING (v)
    WHERE metric = 'kubelet_volume_stats_capacity_bytes' AND regexp_full_match(coalesce(persistentvolumeclaim, ''), 'indexer-postgresql.*') GROUP BY 1, 2) b
  USING (instance, t) WHERE a.metric = 'pg_database_size_bytes' AND datname = 'blockscout' AND a.value / b.value > 0.8"""
_RULE_SQL = {
    "BlockchainIndexingLag": _two("latest_block_number", "-", "indexed_block_number", "> 100"),
    "BackendPodsDown": _one("kube_deployment_status_replicas_available", "< 1", match="deployment = 'indexer-backend'"),
    "BackendHighCPU": _one("container_cpu_usage_seconds_total", "> 0.8", "rates", match=_POD),
    "BackendHighMemory": _two("container_memory_usage_bytes", "/", "container_spec_memory_limit_bytes", "> 0.85", _POD),
    "PostgreSQLDown": _one("up", "= 0", match="job = 'indexer-postgresql'"),
    "PostgreSQLReplicationLag": _one("pg_replication_lag_seconds", "> 300"),
    "RedisDown": _one("redis_up", "= 0"),
    "DatabaseGrowthRateHigh": _one("pg_database_size_bytes", "> 107374182400", "growth", match="datname = 'blockscout'"),
    "DatabaseStorageHigh": _STORAGE,
    "DatabaseVacuumDelayed": _one(
        "pg_stat_user_tables_last_autovacuum", "> 86400", value=_AGE, match="datname = 'blockscout' AND schemaname = 'public' AND relname IN ('blocks', 'transactions', 'logs')"
    ),
    "PartmanMaintenanceNotRunning": _avg("pg_partman_maintenance_last_run_seconds_since_maintenance", "> 7200", "max"),
    "PartmanDefaultPartitionDataAccumulating": _one("pg_partman_default_partition_rows_default_rows", "> 10000"),
    "PartmanLowPartitionCount": _one("pg_partman_partition_count", "< 30"),
    "IndexerLagHigh": _one("blockscout_indexing_lag_blocks", "> 100"),
    "IndexerStalled": _one("blockscout_indexed_blocks_total", "= 0", "rates"),
    "DatabaseConnectionsHigh": _two("blockscout_db_connections_active", "/", "blockscout_db_connections_total", "> 0.8"),
    "RedisCacheHitRatioLow": _SHARE,
    "PostgreSQLNoRecentBackup": _one("cnpg_pg_cluster_last_backup_timestamp", "> 90000", value=_AGE),
    "PostgreSQLBackupFailed": _one("cnpg_pg_cluster_last_backup_succeeded", "= 0"),
    "ScaleOnLag": _one("blockscout_indexing_lag_blocks", "> 100"),
    "ScaleOnCPU": _one("cpu_utilization", "> 0.8"),
    "ScaleOnMemory": _two("container_memory_usage_bytes", "/", "container_spec_memory_limit_bytes", "> 0.85", _POD),
    "ScaleOnResponseTime": _one("response_seconds", "> 1"),
    "ScaleOnPodLag": _avg("indexing_lag_seconds", "> 30"),
    "ScaleOnPodRequests": _avg("http_requests_per_second", "> 1000"),
}
_FOR = {r.name: (r.hold_for * STRETCH).total_seconds() for r in al.RULES}
_WITH = f"WITH inst AS {_INST}, rates AS {_RATES}, growth AS {_GROWTH}, sets AS {_SETS}"


def _rules_sql(names) -> str:
    """A volume that grows past another changes the alert's labels, so the claim is part of the series."""
    active = " UNION ALL ".join(f"SELECT '{n}' AS alertname, {_FOR[n]} AS f, * FROM ({_RULE_SQL[n]}) q" for n in names)
    return f"""{_WITH}, active AS ({active})
      SELECT alertname, instance, job, pod, coalesce(claim, persistentvolumeclaim) AS persistentvolumeclaim, t, round(value, 4) AS value, state, since
      FROM {islands_sql('active', 'alertname, instance, v, claim', 'f')} x LEFT JOIN sets USING (v)"""


def _labels(*names):
    return [F.col("labels")[n].alias(n) for n in names]


@query("l03_run_rules", _rules_sql(_RULE_SQL))
def all_rules(spark, sf):
    states = al.run_rules(rule_samples(spark, sf), stretched(al.RULES), grid(spark, sf), "24 hours")
    return states.select("alertname", *_labels("instance", "job", "pod", "persistentvolumeclaim"), "t", F.round("value", 4).alias("value"), "state", "since")


@query(
    "l01_evaluate_rule",
    f"{_WITH} SELECT instance, job, pod, t, round(value, 6) AS value FROM ({_RULE_SQL['RedisCacheHitRatioLow']}) q JOIN sets USING (v)",
)
def one_rule(spark, sf):
    rule = next(r for r in stretched(al.RULES) if r.name == "RedisCacheHitRatioLow")
    signals = al.Signals(rule_samples(spark, sf), grid(spark, sf), "24 hours", [rule])
    return al.evaluate_rule(signals, rule).select(*_labels("instance", "job", "pod"), "t", F.round("value", 6).alias("value"))


@query(
    "l02_firing_alerts",
    f"""{_WITH}, active AS (SELECT * FROM ({_RULE_SQL['BackendHighMemory']}) q)
        SELECT instance, pod, t, state, since, 'warning' AS severity, 'backend' AS component, 'Backend high memory usage' AS summary,
               concat('Backend memory usage is ', CASE WHEN value * 100 < 10000 THEN format('{{:.4g}}', value * 100) ELSE format('{{:.4g}}', value * 100) END, '%') AS description
        FROM {islands_sql('active', 'instance, v', str(_FOR['BackendHighMemory']))} x JOIN sets USING (v) WHERE state = 'firing'""",
)
def firing(spark, sf):
    rule = next(r for r in stretched(al.RULES) if r.name == "BackendHighMemory")
    found = al.firing_alerts(al.Signals(rule_samples(spark, sf), grid(spark, sf), "24 hours", [rule])).where("state = 'firing'")
    return found.select(*_labels("instance", "pod"), "t", "state", "since", "severity", "component", "summary", "description")


_ROUTES = al.Route(
    "chat",
    routes=(
        al.Route("null", match={"alertname": "click"}),
        al.Route("pager", match={"severity": "critical"}, go_on=True),
        al.Route(
            "team", match_re={"alertname": "s.*|view"}, routes=(al.Route("team-night", match={"cluster": "2"}),)
        ),
        al.Route("archive", match_re={"cluster": "[01]"}),
    ),
)
_ALERTS = """SELECT event_id, event_type AS alertname, CASE WHEN value > 100 THEN 'critical' ELSE 'warning' END AS severity,
  CAST(user_id % 3 AS STRING) AS cluster FROM {events}"""


@query(
    "l04_route_alerts",
    f"""WITH a AS ({_ALERTS.format(events='events')}),
        hits AS (SELECT event_id, 1 AS o, 'null' AS receiver FROM a WHERE alertname = 'click'
          UNION ALL SELECT event_id, 2, 'pager' FROM a WHERE alertname <> 'click' AND severity = 'critical'
          UNION ALL SELECT event_id, 3, CASE WHEN cluster = '2' THEN 'team-night' ELSE 'team' END FROM a WHERE alertname = 'signup' OR alertname = 'view'
          UNION ALL SELECT event_id, 4, 'archive' FROM a WHERE alertname NOT IN ('click', 'signup', 'view') AND cluster IN ('0', '1'))
        SELECT a.event_id, coalesce(receiver, 'chat') AS receiver, CAST(row_number() OVER (PARTITION BY a.event_id ORDER BY o) AS INT) AS route_ord
        FROM a LEFT JOIN hits ON a.event_id = hits.event_id""",
)
def routed(spark, sf):
    found = sql_frame(spark, sf, _ALERTS, "events")
    return al.route_alerts(found, _ROUTES, lambda n: F.col(n)).select("event_id", "receiver", "route_ord")


@query(
    "l05_notifications",
    """WITH iv AS (SELECT event_type AS alertname, user_id % 3 AS cluster, ts AS s, ts + to_microseconds(CAST(round(value * 60) AS BIGINT) * 1000000) AS e FROM events),
       ch AS (SELECT alertname, cluster, c, sum(d) AS d FROM (SELECT alertname, cluster, s AS c, 1 AS d FROM iv UNION ALL SELECT alertname, cluster, e, -1 FROM iv) x GROUP BY 1, 2, 3),
       act AS (SELECT *, sum(d) OVER (PARTITION BY alertname, cluster ORDER BY c) AS active FROM ch),
       ep AS (SELECT *, max(CASE WHEN active > 0 AND active - d <= 0 THEN c END) OVER (PARTITION BY alertname, cluster ORDER BY c) AS episode,
                min(CASE WHEN active <= 0 THEN c END) OVER (PARTITION BY alertname, cluster ORDER BY c ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS closes FROM act),
       tk AS (SELECT *, epoch_us(episode) + 600000000 AS first,
                epoch_us(episode) + 600000000 + CAST(ceil(greatest(epoch_us(c) - epoch_us(episode) - 600000000, 0) / 1800000000) AS BIGINT) * 1800000000 AS tick FROM ep
              WHERE epoch_us(closes) > epoch_us(episode) + 600000000),
       g AS (SELECT alertname, cluster, episode, tick, arg_max(active, c) AS active, min(first) AS first, max(closes) AS closes FROM tk GROUP BY 1, 2, 3, 4),
       n AS (SELECT *, coalesce(lead(tick) OVER (PARTITION BY alertname, cluster, episode ORDER BY tick), epoch_us(closes)) AS until FROM g),
       sent AS (SELECT alertname, cluster, episode, tick AS c, CASE WHEN tick = first THEN 'first' WHEN active <= 0 THEN 'resolved' ELSE 'change' END AS kind, active FROM n
         UNION ALL SELECT alertname, cluster, episode, unnest(generate_series(tick + 7200000000, until - 1, 7200000000)), 'repeat', active FROM n WHERE active > 0)
       SELECT alertname, cluster, episode, make_timestamp(c) AS sent_at, kind, CAST(active AS BIGINT) AS active FROM sent""",
)
def notified(spark, sf):
    length = F.round(F.col("value") * 60).cast("bigint")
    intervals = load_table(spark, sf, "events").select(
        F.col("event_type").alias("alertname"), (F.col("user_id") % 3).alias("cluster"), F.col("ts").alias("start"),
        F.timestamp_add("SECOND", length, F.col("ts")).alias("end"),
    )
    return al.notifications(intervals, ["alertname", "cluster"], "10m", "30m", "2h")


@query(
    "l06_resolve",
    """SELECT event_type, t AS last_seen, t + INTERVAL 30 MINUTE AS resolved_at
       FROM (SELECT event_type, ts AS t, lead(ts) OVER (PARTITION BY event_type ORDER BY ts) AS nxt FROM events WHERE value > 50) x
       WHERE nxt IS NULL OR epoch_us(nxt) - epoch_us(t) > 1800000000""",
)
def resolved(spark, sf):
    states = load_table(spark, sf, "events").where("value > 50").select(
        "event_type", F.col("ts").alias("t"), F.lit("firing").alias("state")
    )
    return al.resolve(states, ["event_type"], "30m")


@query(
    "l06_firing_intervals",
    f"""SELECT instance, job, min(t) AS start, max(t) + INTERVAL 6 HOUR AS "end"
        FROM {islands_sql(f'(SELECT * FROM {_CLICKS} c WHERE value > 30)', 'instance, job', '43200')} x WHERE state = 'firing' GROUP BY instance, job, since""",
)
def intervals(spark, sf):
    states = al.alert_state(clicks(spark, sf), ["instance", "job"], "high", 43200, "6 hours")
    return al.firing_intervals(states, ["instance", "job"], timedelta(hours=6))


