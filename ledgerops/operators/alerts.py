"""Alert rules: evaluation, pending and firing states, routing, notifications."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import timedelta
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerops.functions.scalars import render, value_formats
from ledgerops.functions.times import ceil_div, from_micros, micros, ntz, to_micros
from ledgerops.operators.filters import label
from ledgerops.operators.metrics import Grid, counter_deltas, series_key, trailing_windows
from ledgerops.operators.ordered import OrderedRows
from ledgerops.session import cut


@dataclass(frozen=True)
class Term:
    """A vector a rule reads: the series of a metric that match, at each evaluation.

    ``fn`` is ``instant`` (last sample), ``rate`` (increase per second over ``span``), ``growth``
    (gauge change per day over ``span``) or ``age`` (seconds since the epoch time that the gauge holds). A missing label matches
    as empty text; a regex must match the whole value.
    """

    metric: str
    eq: dict[str, str] = field(default_factory=dict)
    regex: dict[str, str] = field(default_factory=dict)
    fn: str = "instant"
    span: str = "5 minutes"

    @property
    def vector(self) -> str:
        """The windows it is read from: ``age`` is an instant value too."""
        return f"{self.fn} {to_micros(self.span)}" if self.fn in ("rate", "growth") else "instant"

    def matches(self) -> Column | None:
        """The condition on the labels, if there is one."""
        conds = [label(name) == value for name, value in self.eq.items()]
        conds += [label(name).rlike(f"^(?:{pattern})$") for name, pattern in self.regex.items()]
        return reduce(lambda a, b: a & b, conds) if conds else None


@dataclass(frozen=True)
class Rule:
    """A condition on one or two vectors, and the alert it raises.

    ``op`` combines the terms a and b: ``-``, ``/`` or ``share`` (a / (a + b)). Series meet if all their labels are equal, or those
    in ``on``; then the a side may have several series, the largest of the b side counts, and its labels in ``bring`` go to the result.
    ``agg`` (``max`` or ``avg``) makes one value of all series, without labels. Other alerts keep all labels of their series.
    """

    name: str
    terms: tuple[Term, ...]
    holds: Callable[[Column], Column]
    hold_for: timedelta
    severity: str
    component: str = ""
    summary: str = ""
    description: str = ""
    op: str = ""
    agg: str = ""
    on: tuple[str, ...] | None = None
    bring: tuple[str, ...] = ()


_SERIES = "array<struct<key:string,value:string>>"


class Signals:
    """The vectors of a set of rules over one samples table and one grid.

    All rules share one pass: the samples that some term matches go through one ordered pass for counters
    and one pass of trailing windows, whatever the number of rules. The result is written to the shared folder.
    """

    def __init__(self, samples: DataFrame, grid: Grid, lookback="5 minutes", rules: list[Rule] | None = None, before=None):
        self.grid, self.rules, self._before = grid, rules or RULES, before
        self._samples, self._lookback = samples, lookback
        self.terms = [t for r in self.rules for t in r.terms]

    def _spans(self) -> dict[str, int]:
        return {t.vector: to_micros(t.span) if t.fn in ("rate", "growth") else to_micros(self._lookback) for t in self.terms}

    @cached_property
    def vectors(self) -> DataFrame:
        """(metric, series, vector, t, value) of every series that some term reads."""
        spans = self._spans()
        longest = timedelta(microseconds=max(spans.values()))
        metrics = list(dict.fromkeys(t.metric for t in self.terms))
        # labels are looked at for those metrics only of which no term takes all series
        conds = {m: [t.matches() for t in self.terms if t.metric == m] for m in metrics}
        looked = F.when(F.lit(False), F.lit(True))
        for metric, found in conds.items():
            if all(c is not None for c in found):
                looked = looked.when(F.col("metric") == metric, reduce(lambda a, b: a | b, {str(c): c for c in found}.values()))
        found = self._samples.where((F.col("ts") <= ntz(self.grid.end)) & F.col("metric").isin(*metrics)).where(looked.otherwise(True))
        found = found.withColumn("series", series_key())
        keys = ["metric", "series", "vector"]

        def of(rows: DataFrame, names: list[str]) -> DataFrame:
            uses = [F.when(F.col("metric").isin(*sorted({t.metric for t in self.terms if t.vector == n})), F.lit(n)) for n in names]
            rows = rows.withColumn("vector", F.explode(F.array_compact(F.array(*uses))))
            return rows.select(*keys, "ts", "value", "delta")

        plain = [n for n in spans if not n.startswith("rate")]
        parts = [of(found.withColumn("delta", F.lit(0.0)), plain)] if plain else []
        counted = [n for n in spans if n.startswith("rate")]
        if counted:
            names = sorted({t.metric for t in self.terms if t.fn == "rate"})
            wide = timedelta(microseconds=max(spans[n] for n in counted))
            parts.append(of(counter_deltas(found.where(F.col("metric").isin(*names)), ["metric", "series"], self.grid.start - wide, self._before), counted))
        span = F.create_map(*[F.lit(x) for n, us in spans.items() for x in (n, us)])[F.col("vector")].cast("bigint")
        seen = trailing_windows(reduce(DataFrame.unionByName, parts), keys, self.grid, "ts", span, "delta", longest)
        apart = (micros("newest.ts") - micros("oldest.ts")) / F.lit(1e6)
        grown = F.when(apart > 0, (F.col("newest.value") - F.col("oldest.value")) / apart * 86400)
        value = (
            F.when(F.col("vector") == "instant", F.col("newest.value"))
            .when(F.col("vector").startswith("rate"), F.col("total") / (span / F.lit(1e6)))
            .otherwise(grown)
        )
        return cut(seen.select(*keys, "t", value.alias("value")))


def evaluate(signals: Signals, rules: list[Rule] | None = None) -> DataFrame:
    """Evaluations at which rules hold: (rule, series, t, value), ``rule`` by its place in the list.

    The rules are one conditional list per value, which says what terms it serves; matching, operations and conditions are
    expressions of the rule's number. Values of a rule meet by their series (or the ``on`` labels) and time, so no plan is made per rule.
    """
    rules = rules or signals.rules

    def by_rule(value: Callable[[Rule], Column | None], default: Column | None = None) -> Column:
        """A value by the rule's number; rules that have none, or the same text of it, share a branch."""
        cases: dict[str, tuple[Column, list[int]]] = {}
        for i, r in enumerate(rules):
            found = value(r)
            if found is not None:
                cases.setdefault(str(found), (found, []))[1].append(i)
        chain = F.when(F.lit(False), F.lit(None))
        for found, places in cases.values():
            chain = chain.when(F.col("rule").isin(*places), found)
        return chain if default is None else chain.otherwise(default)

    serves: dict[tuple[str, str], list[Column]] = {}
    for i, r in enumerate(rules):
        for k, t in enumerate(r.terms):
            place, cond = F.struct(F.lit(i).alias("rule"), F.lit(k).alias("term")), t.matches()
            serves.setdefault((t.metric, t.vector), []).append(place if cond is None else F.when(cond, place))
    places = F.when(F.lit(False), F.array().cast("array<struct<rule:int,term:int>>"))
    for (metric, vector), found in serves.items():
        places = places.when((F.col("metric") == metric) & (F.col("vector") == vector), F.array_compact(F.array(*found)))
    values = signals.vectors.withColumn("labels", F.map_from_entries("series"))
    values = values.select("series", "t", "value", F.inline(places))
    age = by_rule(lambda r: F.lit(True) if r.terms[0].fn == "age" else None, F.lit(False))
    values = values.withColumn("value", F.when(age, micros("t") / F.lit(1e6) - F.col("value")).otherwise(F.col("value")))
    none = F.array().cast(_SERIES)
    whole = [i for i, r in enumerate(rules) if r.agg]
    one = values.where(F.col("rule").isin(*whole)).groupBy("rule", "t").agg(F.max("value").alias("max"), F.avg("value").alias("avg"))
    one = one.select("rule", none.alias("series"), "t", by_rule(lambda r: F.col(r.agg) if r.agg else None).cast("double").alias("value"))
    single = values.where(~F.col("rule").isin(*whole))
    # series that lack a label of ``on`` have it empty
    on = by_rule(lambda r: F.array(*[F.struct(F.lit(n).alias("key"), F.coalesce(F.map_from_entries("series")[n], F.lit("")).alias("value")) for n in r.on]) if r.on is not None else None, F.col("series"))
    pairs = W.partitionBy("rule", "_key", "t")
    right = F.max(F.when(F.col("term") == 1, F.struct("value", "series"))).over(pairs)
    met = single.withColumn("_key", on).withColumn("_b", right).where("term = 0")
    a, b = F.col("value"), F.col("_b.value")
    ops = {"": lambda: a, "-": lambda: a - b, "/": lambda: F.when(b != 0, a / b), "share": lambda: F.when(a + b != 0, a / (a + b))}
    brought = by_rule(lambda r: F.filter("_b.series", lambda e: e["key"].isin(*r.bring)) if r.bring else None, none)
    given = F.coalesce(brought, none)
    series = F.array_sort(F.concat(F.filter("series", lambda e: ~F.exists(given, lambda g: g["key"] == e["key"])), given))
    met = met.select("rule", series.alias("series"), "t", by_rule(lambda r: ops[r.op]()).alias("value"))
    return met.unionByName(one).where(by_rule(lambda r: r.holds(F.col("value"))))


def evaluate_rule(signals: Signals, rule: Rule) -> DataFrame:
    """Grid points where the condition of one rule holds: (labels, t, value)."""
    return evaluate(signals, [rule]).select(F.map_from_entries("series").alias("labels"), "t", "value")


def alert_state(evals: DataFrame, keys: list[str], cond: str, for_s: Column | float, step) -> DataFrame:
    """``inactive``, ``pending`` or ``firing`` per series and evaluation, with the start ``since``.

    The condition must hold at every evaluation for the whole duration; a false or a
    missing evaluation starts over.
    """
    rows = evals.withColumn("_on", F.coalesce(F.col(cond), F.lit(False)))
    ordered = OrderedRows.of(rows, keys, ["t"]).previous(_t=F.col("t"), _was=F.col("_on"))
    gap = micros("t") - micros("_t")
    begins = F.col("_on") & (F.col("_t").isNull() | ~F.col("_was") | (gap > to_micros(step)))
    out = ordered.latest(since=F.when(begins, F.col("t"))).rows
    need = for_s if isinstance(for_s, Column) else F.lit(float(for_s))
    lasted = (micros("t") - micros("since")) / F.lit(1e6)
    state = F.when(~F.col("_on"), "inactive").when(lasted >= need, "firing").otherwise("pending")
    out = out.withColumn("state", state).withColumn("since", F.when(F.col("_on"), F.col("since")))
    return out.drop("_on", "_t", "_was")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def firing_alerts(signals: Signals, rules: Rule | list[Rule] | None = None) -> DataFrame:
    """Pending and firing instances of one or more rules, with labels and rendered texts.

    (alertname, series, t, value, state, since, labels, severity, component, summary, description); at most one row per
    alertname, series and t. All rules share one ordered pass: the rule is part of the series key. Texts are added afterwards, so they are never shuffled.
    """
    rules = [rules] if isinstance(rules, Rule) else rules or signals.rules

    def told(value: Callable[[Rule], str]) -> Column:
        """A constant looked up by alert name; one text, as a plan for many rules is dear to build call by call."""
        return F.expr("CASE alertname " + " ".join(f"WHEN {_quoted(r.name)} THEN {value(r)}" for r in rules) + " END")

    names = F.array(*[F.lit(r.name) for r in rules])
    active = evaluate(signals, rules).withColumn("alertname", F.get(names, F.col("rule"))).select("alertname", "series", "t", "value")
    held = told(lambda r: f"{r.hold_for.total_seconds()}D")
    states = alert_state(
        active.withColumn("_true", F.lit(True)), ["alertname", "series"], "_true", held, signals.grid.step
    ).drop("_true")
    # a rule's own labels override those of its series
    label_of = lambda k, v: f"named_struct('key', '{k}', 'value', {_quoted(v)})"
    own = told(lambda r: f"array({', '.join(label_of(k, v) for k, v in (('severity', r.severity), ('component', r.component)) if v)})")
    states = states.withColumn("_own", own)
    entries = F.concat(F.filter("series", lambda e: ~F.exists("_own", lambda o: o["key"] == e["key"])), F.col("_own"))
    labelled = states.withColumn("series", F.array_sort(entries)).drop("_own").withColumn("labels", F.map_from_entries("series"))
    texts = {f"_text{i}": (name, text) for i, (name, text) in enumerate(value_formats("value").items())}
    columns = labelled.columns
    labelled = labelled.withColumns({c: text for c, (_, text) in texts.items()})
    formats = {name: F.col(c) for c, (name, _) in texts.items()}
    return labelled.select(
        *columns,
        F.col("labels")["severity"].alias("severity"),
        F.coalesce(F.col("labels")["component"], F.lit("")).alias("component"),
        told(lambda r: _quoted(r.summary)).alias("summary"),
        reduce(lambda rest, r: rest.when(F.col("alertname") == r.name, render(r.description, "value", "labels", formats)), rules, F.when(F.lit(False), "")).alias("description"),
    )


def run_rules(samples: DataFrame, rules: list[Rule], grid: Grid, lookback="5 minutes", before=None) -> DataFrame:
    """The rule catalogue over one samples table."""
    return firing_alerts(Signals(samples, grid, lookback, rules, before))


def firing_intervals(states: DataFrame, keys: list[str], step) -> DataFrame:
    """Stretches of firing evaluations: (keys.., start, end); the end is one step after the last."""
    fired = states.where("state = 'firing'").groupBy(*keys, "since").agg(
        F.min("t").alias("start"), F.max("t").alias("_last")
    )
    end = F.timestamp_add("MICROSECOND", F.lit(to_micros(step)), F.col("_last"))
    return fired.select(*keys, "start", end.alias("end"))


def resolve(states: DataFrame, keys: list[str], timeout="5 minutes", as_of=None) -> DataFrame:
    """Alerts not seen firing for longer than ``timeout``: (keys.., last_seen, resolved_at)."""
    fired = states.where("state = 'firing'").select(*keys, "t")
    seen = OrderedRows.of(fired, keys, ["t"]).following(_next=F.col("t")).rows
    wait = to_micros(timeout)
    ended = seen.where(F.col("_next").isNull() | (micros("_next") - micros("t") > wait))
    out = ended.select(
        *keys, F.col("t").alias("last_seen"), F.timestamp_add("MICROSECOND", F.lit(wait), F.col("t")).alias("resolved_at")
    )
    return out if as_of is None else out.where(F.col("resolved_at") <= ntz(as_of))


@dataclass(frozen=True)
class Route:
    """A routing node; all matchers must hold, regexes on the whole value."""

    receiver: str
    match: dict[str, str] = field(default_factory=dict)
    match_re: dict[str, str] = field(default_factory=dict)
    go_on: bool = False
    routes: tuple[Route, ...] = ()


def _receivers(route: Route, label: Callable[[str], Column]) -> Column:
    """Receivers of an alert that reached ``route``: its matching children's, else its own."""
    own = F.array(F.lit(route.receiver))
    if not route.routes:
        return own
    stopped, parts = F.lit(False), []
    for child in route.routes:
        conds = [label(k) == v for k, v in child.match.items()]
        conds += [label(k).rlike(f"^(?:{v})$") for k, v in child.match_re.items()]
        hit = reduce(lambda a, b: a & b, conds, F.lit(True)) & ~stopped
        parts.append(F.when(hit, _receivers(child, label)).otherwise(F.array().cast("array<string>")))
        if not child.go_on:
            stopped = stopped | hit
    found = F.concat(*parts)
    return F.when(F.size(found) > 0, found).otherwise(own)


def route_alerts(alerts: DataFrame, root: Route, label: Callable[[str], Column] | None = None) -> DataFrame:
    """One row per alert and receiver, in route order (``route_ord``).

    The routing tree is configuration: it becomes one conditional per row, no join.
    """
    label = label or (lambda n: F.coalesce(F.col("labels")[n], F.lit("")))
    out = alerts.select("*", F.posexplode(_receivers(root, label)).alias("route_ord", "receiver"))
    return out.withColumn("route_ord", F.col("route_ord") + 1)


def notifications(
    intervals: DataFrame, group_by: list[str], wait="10s", interval="10s", repeat="12h", as_of=None
) -> DataFrame:
    """Notification times per alert group: (group.., episode, sent_at, kind, active).

    ``intervals`` holds firing stretches (group.., start, end). An episode lasts while
    at least one alert of the group fires. It is announced ``wait`` after its start if
    it still lasts then; later changes at the next multiple of ``interval``; an
    unchanged group again every ``repeat``.
    """
    wait_us, step_us, repeat_us = to_micros(wait), to_micros(interval), to_micros(repeat)
    one = F.lit(1).cast("bigint")
    changes = intervals.select(*group_by, F.col("start").alias("at"), one.alias("d")).unionByName(
        intervals.where("end is not null").select(*group_by, F.col("end").alias("at"), (-one).alias("d"))
    )
    if as_of is not None:
        changes = changes.where(F.col("at") <= ntz(as_of))
    changes = changes.groupBy(*group_by, "at").agg(F.sum("d").alias("d"))
    ordered = OrderedRows.of(changes, group_by, ["at"]).running_sum(active=F.col("d"))
    opens = (F.col("active") > 0) & (F.col("active") - F.col("d") <= 0)
    ordered = ordered.latest(episode=F.when(opens, F.col("at")))
    ordered = ordered.upcoming(closes=F.when(F.col("active") <= 0, F.col("at")))
    first = micros("episode") + wait_us
    late = F.greatest(micros("at") - first, F.lit(0))
    tick = first + ceil_div(late, step_us) * step_us
    rows = ordered.rows.where(F.col("closes").isNull() | (micros("closes") > first))
    rows = rows.withColumn("tick", tick).withColumn("first", first)
    # several changes inside one interval make one notification with the latest state
    ticks = rows.groupBy(*group_by, "episode", "tick").agg(
        F.max_by("active", "at").alias("active"), F.min("first").alias("first"), F.max("closes").alias("closes")
    )
    ticks = OrderedRows.of(ticks, [*group_by, "episode"], ["tick"]).following(nxt=F.col("tick")).rows
    kind = F.when(F.col("tick") == F.col("first"), "first").when(F.col("active") <= 0, "resolved").otherwise("change")
    until = F.coalesce("nxt", micros("closes"), micros(ntz(as_of)) + 1 if as_of is not None else F.col("tick"))
    again = F.when(
        (F.col("active") > 0) & (F.col("tick") + repeat_us < until),
        F.transform(
            F.sequence(F.col("tick") + repeat_us, until - 1, F.lit(repeat_us)),
            lambda x: F.struct(x.alias("at"), F.lit("repeat").alias("kind")),
        ),
    ).otherwise(F.array().cast("array<struct<at:bigint,kind:string>>"))
    own = F.array(F.struct(F.col("tick").alias("at"), kind.alias("kind")))
    sent = ticks.select(*group_by, "episode", "active", F.inline(F.concat(own, again)))
    return sent.select(*group_by, "episode", from_micros(F.col("at")).alias("sent_at"), "kind", "active")


_M, _H = timedelta(minutes=1), timedelta(hours=1)
_GIB = 2.0**30


def rules(release: str = "indexer") -> list[Rule]:
    """The rule catalogue for one release; ``release`` is the full name its jobs, pods and volumes begin with."""
    pods = {"pod": f"{release}-backend-.*"}
    database = {"datname": "blockscout"}
    memory = (Term("container_memory_usage_bytes", regex=pods), Term("container_spec_memory_limit_bytes", regex=pods))
    # Rule names, metrics, matchers, thresholds, durations and texts.
    return [
        Rule("BlockchainIndexingLag", (Term("latest_block_number"), Term("indexed_block_number")), lambda v: v > 100,
             10 * _M, "warning", "backend", "Blockchain indexer is lagging", "Indexer is {{ $value }} blocks behind chain head", op="-"),
        Rule("BackendPodsDown", (Term("kube_deployment_status_replicas_available", {"deployment": f"{release}-backend"}),), lambda v: v < 1,
             5 * _M, "critical", "backend", "Backend pods are down", "Only {{ $value }} backend pods available"),
        Rule("BackendHighCPU", (Term("container_cpu_usage_seconds_total", regex=pods, fn="rate"),), lambda v: v > 0.8,
             10 * _M, "warning", "backend", "Backend high CPU usage", "Backend CPU usage is {{ $value | humanizePercentage }}"),
        Rule("BackendHighMemory", memory, lambda v: v > 0.85,
             5 * _M, "warning", "backend", "Backend high memory usage", "Backend memory usage is {{ $value | humanizePercentage }}", op="/"),
        Rule("PostgreSQLDown", (Term("up", {"job": f"{release}-postgresql"}),), lambda v: v == 0,
             1 * _M, "critical", "postgresql", "PostgreSQL instance down", "PostgreSQL instance {{ $labels.instance }} is down"),
        Rule("PostgreSQLReplicationLag", (Term("pg_replication_lag_seconds"),), lambda v: v > 300,
             5 * _M, "warning", "postgresql", "PostgreSQL replication lag high", "Replication lag is {{ $value }} seconds"),
        Rule("RedisDown", (Term("redis_up"),), lambda v: v == 0, 1 * _M, "critical", "redis",
             "Redis instance down", "Redis instance {{ $labels.instance }} is down"),
        Rule("DatabaseGrowthRateHigh", (Term("pg_database_size_bytes", database, fn="growth", span="24 hours"),), lambda v: v > 100 * _GIB,
             2 * _H, "info", "database", "Database growing faster than expected (>100GB/day)",
             "Database {{ $labels.datname }} grows by {{ $value | humanize }} bytes per day"),
        # the two metrics share no label but the instance, so the match is stated
        Rule("DatabaseStorageHigh",
             (Term("pg_database_size_bytes", database), Term("kubelet_volume_stats_capacity_bytes", regex={"persistentvolumeclaim": f"{release}-postgresql.*"})),
             lambda v: v > 0.8, 30 * _M, "warning", "database", "Database storage usage above 80%",
             "Current: {{ $value | humanizePercentage }} PVC: {{ $labels.persistentvolumeclaim }}", op="/", on=("instance",), bring=("persistentvolumeclaim",)),
        Rule("DatabaseVacuumDelayed",
             (Term("pg_stat_user_tables_last_autovacuum", {**database, "schemaname": "public"}, {"relname": "blocks|transactions|logs"}, fn="age"),),
             lambda v: v > 86400, 6 * _H, "info", "database", "Database vacuum hasn't run in 24 hours on critical table",
             "Table {{ $labels.relname }} was vacuumed {{ $value | humanizeDuration }} ago"),
        Rule("PartmanMaintenanceNotRunning", (Term("pg_partman_maintenance_last_run_seconds_since_maintenance"),), lambda v: v > 7200,
             30 * _M, "warning", "pg-partman", "pg_partman maintenance hasn't run in 2 hours", "Last run {{ $value | humanizeDuration }} ago", agg="max"),
        Rule("PartmanDefaultPartitionDataAccumulating", (Term("pg_partman_default_partition_rows_default_rows"),), lambda v: v > 10000,
             1 * _H, "warning", "pg-partman", "Default partition accumulating data",
             "Table {{ $labels.parent_table }} has {{ $value }} rows in default partition."),
        Rule("PartmanLowPartitionCount", (Term("pg_partman_partition_count"),), lambda v: v < 30,
             1 * _H, "warning", "pg-partman", "Unusually low partition count", "Table {{ $labels.parent_table }} has only {{ $value }} partitions."),
        Rule("IndexerLagHigh", (Term("blockscout_indexing_lag_blocks"),), lambda v: v > 100, 5 * _M, "warning", "",
             "Indexer is lagging behind", "Indexer is {{ $value }} blocks behind"),
        Rule("IndexerStalled", (Term("blockscout_indexed_blocks_total", fn="rate"),), lambda v: v == 0, 10 * _M, "critical", "",
             "Indexer has stalled", "No blocks indexed in the last 10 minutes"),
        Rule("DatabaseConnectionsHigh", (Term("blockscout_db_connections_active"), Term("blockscout_db_connections_total")), lambda v: v > 0.8,
             5 * _M, "warning", "", "Database connection pool nearly exhausted", "Connection pool usage: {{ $value | humanizePercentage }}", op="/"),
        Rule("RedisCacheHitRatioLow", (Term("redis_keyspace_hits_total", fn="rate"), Term("redis_keyspace_misses_total", fn="rate")), lambda v: v < 0.7,
             10 * _M, "warning", "", "Redis cache hit ratio is low", "Cache hit ratio: {{ $value | humanizePercentage }}", op="share"),
        Rule("PostgreSQLNoRecentBackup", (Term("cnpg_pg_cluster_last_backup_timestamp", fn="age"),), lambda v: v > 90000, 1 * _H, "warning", "",
             "No recent PostgreSQL backup", "Last backup was {{ $value | humanizeDuration }} ago"),
        Rule("PostgreSQLBackupFailed", (Term("cnpg_pg_cluster_last_backup_succeeded"),), lambda v: v == 0, 5 * _M, "critical", "",
             "PostgreSQL backup failed", ""),
        Rule("ScaleOnLag", (Term("blockscout_indexing_lag_blocks"),), lambda v: v > 100, 0 * _M, "info", "scaling"),
        Rule("ScaleOnCPU", (Term("cpu_utilization"),), lambda v: v > 0.8, 5 * _M, "info", "scaling"),
        Rule("ScaleOnMemory", memory, lambda v: v > 0.85, 0 * _M, "info", "scaling", op="/"),
        Rule("ScaleOnResponseTime", (Term("response_seconds"),), lambda v: v > 1, 0 * _M, "info", "scaling"),
        Rule("ScaleOnPodLag", (Term("indexing_lag_seconds"),), lambda v: v > 30, 0 * _M, "info", "scaling", agg="avg"),
        Rule("ScaleOnPodRequests", (Term("http_requests_per_second"),), lambda v: v > 1000, 0 * _M, "info", "scaling", agg="avg"),
    ]


RULES = rules()

# The stricter replication limit of the operations guide, as an alternative to the one above.
STRICT_REPLICATION = replace(
    next(r for r in RULES if r.name == "PostgreSQLReplicationLag"),
    holds=lambda v: v > 30, component="", description="Replication lag: {{ $value }}s",
)

#: Metrics that the rules read.
METRICS = list(dict.fromkeys(t.metric for r in RULES for t in r.terms))
