from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerops.operators import alerts as al
from ledgerops.operators import metrics as m
from tests.conftest import rows

T0 = datetime(2024, 1, 1)


def t(minutes, seconds=0):
    return T0 + timedelta(minutes=minutes, seconds=seconds)


def series(spark, points, key="a"):
    return spark.createDataFrame([(key, t(x), float(v)) for x, v in points], "k string, ts timestamp_ntz, value double")


def test_instant_lookback_edges(spark):
    s = series(spark, [(0, 1), (4, 2), (4, 3), (9, 5)])
    grid = m.Grid.over(t(0), t(14), "1 minute")
    got = {r["t"]: r["value"] for r in m.instant_vector(s, ["k"], grid, "5 minutes").collect()}
    assert got[t(0)] == 1 and got[t(3)] == 1  # a sample at exactly t counts
    assert got[t(4)] == 3 and got[t(8)] == 3  # equal times: the higher value
    assert got[t(9)] == 5 and got[t(13)] == 5 and t(14) not in got  # 5 minutes later it is gone


def test_instant_against_brute_force(spark):
    points = [(x * 7 % 61, x) for x in range(40)]
    s = series(spark, points)
    grid = m.Grid.over(t(0), t(60), "3 minutes")
    got = rows(m.instant_vector(s, ["k"], grid, "10 minutes").select("t", "value"))
    want = []
    for i in range(21):
        seen = [(x, v) for x, v in points if i * 3 - 10 < x <= i * 3]
        if seen:
            want.append((t(i * 3), float(max(seen)[1])))
    assert got == want


def test_increase_resets_and_first_sample(spark):
    s = series(spark, [(0, 10), (1, 15), (2, 3), (3, 4)])
    grid = m.Grid.over(t(0), t(9), "1 minute")
    got = {r["t"]: r["value"] for r in m.increase(s, ["k"], grid, "5 minutes").collect()}
    assert got[t(0)] == 0 and got[t(3)] == 5 + 3 + 1
    assert got[t(5)] == 5 + 3 + 1 and got[t(6)] == 3 + 1  # (t - 5, t]
    assert got[t(7)] == 1 and t(8) not in got
    assert m.increase(s, ["k"], m.Grid.at(t(6)), "5 minutes").first()["value"] == 4  # value before the span still counts
    assert m.rate(s, ["k"], m.Grid.at(t(3)), "5 minutes").first()["value"] == pytest.approx(9 / 300)


def test_growth(spark):
    s = series(spark, [(0, 100), (720, 40)])
    assert m.growth_per_day(s, ["k"], m.Grid.at(t(721)), "24 hours").first()["value"] == pytest.approx(-120)
    assert m.growth_per_day(s, ["k"], m.Grid.at(t(0)), "24 hours").first()["value"] is None


def test_vector_ops(spark):
    left = spark.createDataFrame([("a", "x", T0, 6.0), ("a", "y", T0, 3.0), ("b", "x", T0, 1.0)], "k string, l string, t timestamp_ntz, value double")
    right = spark.createDataFrame([("a", T0, 3.0), ("b", T0, 0.0)], "k string, t timestamp_ntz, value double")
    got = m.vector_op(left, right, "/", ["k"], group_left=["l"])
    assert rows(got.select("k", "l", "value")) == [("a", "x", 2.0), ("a", "y", 1.0), ("b", "x", None)]
    assert m.agg_vector(left, "sum", ["k"]).where("k = 'a'").first()["value"] == 9


@pytest.mark.parametrize("q,want", [(0.0, 0.0), (0.5, 0.075), (0.9, 0.5), (1.0, 0.5)])
def test_histogram_quantile(spark, q, want):
    df = spark.createDataFrame([(v,) for v in [0.02, 0.06, 0.07, 0.09, 0.3, 9.0, 9.0, 0.06]], "v double")
    buckets = m.to_histogram(df, "v", [0.05, 0.1, 0.5])
    assert [r["count"] for r in buckets.orderBy("le").collect()] == [1, 5, 6, 8]
    got = m.histogram_quantile(q, buckets).first()["value"]
    assert got == pytest.approx({0.0: 0.0, 0.5: 0.05 + 0.05 * 3 / 4, 0.9: 0.5, 1.0: 0.5}[q])


def test_histogram_empty(spark):
    empty = spark.createDataFrame([], "v double")
    assert m.histogram_quantile(0.5, m.to_histogram(empty, "v", [1.0])).first()["value"] is None


def test_relabel_and_cardinality(spark):
    s = spark.createDataFrame([("http_x", {"user": "1", "job": "a"}), ("up", {"user": "2"})], "metric string, labels map<string,string>")
    out = m.relabel(s, "__name__", "http.*", "user").collect()
    assert out[0]["labels"] == {"job": "a"} and out[1]["labels"] == {"user": "2"}
    assert rows(m.label_cardinality(s, 1)) == [("user", 2)]


def evals(spark, flags, step=1):
    data = [("a", t(i * step), f) for i, f in enumerate(flags) if f is not None]
    return spark.createDataFrame(data, "k string, t timestamp_ntz, on boolean")


def states(spark, flags, for_s):
    out = al.alert_state(evals(spark, flags), ["k"], "on", for_s, "1 minute")
    return [r["state"] for r in out.orderBy("t").collect()]


def test_alert_state(spark):
    assert states(spark, [True, True, True, False, True], 120) == ["pending", "pending", "firing", "inactive", "pending"]
    assert states(spark, [True, False, True], 0) == ["firing", "inactive", "firing"]
    assert states(spark, [True, True, None, True, True], 60) == ["pending", "firing", "pending", "firing"]


def test_resolve_gap_equal_to_timeout(spark):
    seen = evals(spark, [True, None, True, None, None, True]).withColumn("state", F.lit("firing"))
    got = rows(al.resolve(seen, ["k"], "2 minutes").select("last_seen", "resolved_at"))
    assert got == [(t(2), t(4)), (t(5), t(7))]
    assert al.resolve(seen, ["k"], "2 minutes", as_of=t(6)).count() == 1


def test_routes(spark):
    alerts = spark.createDataFrame([("A", "critical"), ("A", "criticality"), ("Watchdog", "none"), ("B", None)], "alertname string, severity string")
    root = al.Route("root", routes=(
        al.Route("null", match={"alertname": "Watchdog"}),
        al.Route("pager", match={"severity": "critical"}, go_on=True),
        al.Route("chat", match_re={"severity": "crit.*l"}),
    ))
    got = al.route_alerts(alerts, root, lambda n: F.coalesce(F.col(n), F.lit(""))).select("alertname", "severity", "receiver")
    assert rows(got) == [
        ("A", "critical", "chat"), ("A", "critical", "pager"), ("A", "criticality", "root"), ("B", None, "root"), ("Watchdog", "none", "null"),
    ]


def notified(spark, stretches, **kw):
    df = spark.createDataFrame([("g", t(a), t(b) if b is not None else None) for a, b in stretches], "g string, start timestamp_ntz, end timestamp_ntz")
    out = al.notifications(df, ["g"], "1m", "5m", "20m", **kw).orderBy("sent_at")
    return [((r["sent_at"] - T0).total_seconds() / 60, r["kind"], r["active"]) for r in out.collect()]


def test_notifications(spark):
    assert notified(spark, [(0, 10)]) == [(1, "first", 1), (11, "resolved", 0)]
    assert notified(spark, [(0, 0.5)]) == []  # over before the group wait
    assert notified(spark, [(0, 50)]) == [(1, "first", 1), (21, "repeat", 1), (41, "repeat", 1), (51, "resolved", 0)]
    assert notified(spark, [(0, 30), (3, 12)]) == [(1, "first", 1), (6, "change", 2), (16, "change", 1), (31, "resolved", 0)]
    assert notified(spark, [(0, None)], as_of=t(30)) == [(1, "first", 1), (21, "repeat", 1)]


def test_rules_end_to_end(spark):
    data = [("up", {"instance": "db-0", "job": "indexer-postgresql"}, t(i), 1.0 if i < 3 or i > 6 else 0.0) for i in range(10)]
    data += [("up", {"instance": "db-0", **job}, t(i), 0.0) for i in range(10) for job in ({"job": "node-exporter"}, {})]  # others raise nothing
    s = spark.createDataFrame(data, "metric string, labels map<string,string>, ts timestamp_ntz, value double")
    out = al.run_rules(s, al.RULES, m.Grid.over(t(0), t(9), "1 minute"), "2 minutes")
    got = [(r["t"], r["state"], r["severity"], r["description"]) for r in out.orderBy("t").collect()]
    assert [g[:2] for g in got] == [(t(3), "pending"), (t(4), "firing"), (t(5), "firing"), (t(6), "firing")]
    assert got[0][2:] == ("critical", "PostgreSQL instance db-0 is down")
    stretch = al.firing_intervals(out, ["alertname"], "1 minute").first()
    assert (stretch["start"], stretch["end"]) == (t(4), t(7))


def test_sample_retention_keeps_newest_days(spark):
    data = [("m", {"a": "b"}, T0 + timedelta(days=d, hours=h), 1.0) for d in range(5) for h in (1, 2)]
    s = spark.createDataFrame(data, "metric string, labels map<string,string>, ts timestamp_ntz, value double")
    day_bytes = 2 * (16 + 1 + 2)
    kept = m.retain_samples(s, T0 + timedelta(days=5), "4 days", 2 * day_bytes + 1)
    assert {r["ts"].day for r in kept.collect()} == {4, 5}


def test_kpi_kinds(spark):
    def sample(metric, minute, value, **labels):
        return (metric, {"i": "0", **labels}, t(minute), float(value))

    s = spark.createDataFrame(
        [sample("c", 1, 10), sample("c", 4, 70), sample("d", 1, 0), sample("d", 4, 20), sample("g", 4, 3), sample("h", 4, 4),
         sample("b", 1, 0, le="1"), sample("b", 4, 30, le="1"), sample("b", 1, 0, le="+Inf"), sample("b", 4, 60, le="+Inf")],
        "metric string, labels map<string,string>, ts timestamp_ntz, value double",
    )
    kpis = [
        m.Kpi("rate", "rate", "c", scale=60.0), m.Kpi("mix", "rate_ratio", "c", "d"), m.Kpi("now", "instant", "g"),
        m.Kpi("part", "ratio", "g", "h"), m.Kpi("share", "share", "g", "h"), m.Kpi("p25", "quantile", "b", scale=0.25),
        m.Kpi("none", "instant", "missing"),
    ]
    got = {r["kpi"]: r["value"] for r in m.kpi_report(s, t(5), kpis).collect()}
    assert got["rate"] == pytest.approx(12.0) and got["mix"] == pytest.approx(0.75) and got["now"] == 3
    assert got["part"] == 0.75 and got["share"] == pytest.approx(3 / 7) and got["p25"] == pytest.approx(0.5) and got["none"] is None


def test_down_targets(spark):
    up = spark.createDataFrame([("a", T0, 1.0), ("a", T0, 0.0), ("b", T0, 1.0)], "job string, t timestamp_ntz, value double")
    assert rows(m.down_targets(up, ["job"], 0.6)) == [("a", T0, 1, 2, 0.5, True)]


def test_series_without_the_label_meet(spark):
    side = lambda v: spark.createDataFrame([(None, 1, v), ("x", 1, v)], "job string, t int, value double")
    got = m.vector_op(side(6.0), side(2.0), "/", ["job"]).collect()
    assert sorted((r["job"], r["value"]) for r in got) == [("", 3.0), ("x", 3.0)]


SAMPLES = "metric string, labels map<string,string>, ts timestamp_ntz, value double"


def test_alerts_keep_all_labels(spark):
    pods = [{"instance": "n1", "pod": f"chain-backend-{i}"} for i in (0, 1)] + [{"instance": "n1", "pod": "chain-frontend-0"}, {"instance": "n1"}]
    data = [(metric, labels, t(i), v) for i in range(8) for labels in pods for metric, v in (("container_memory_usage_bytes", 95.0), ("container_spec_memory_limit_bytes", 100.0))]
    data += [("pg_database_size_bytes", {"instance": "n1", "datname": "blockscout"}, t(i), 90.0) for i in range(8)]
    data += [("kubelet_volume_stats_capacity_bytes", {"instance": "n1", "persistentvolumeclaim": c}, t(i), v) for i in range(8) for c, v in (("chain-postgresql-1", 100.0), ("chain-postgresql-2", 60.0), ("other", 1e9))]
    s = spark.createDataFrame(data, SAMPLES)
    out = al.run_rules(s, al.rules("chain"), m.Grid.over(t(0), t(7), "1 minute"), "2 minutes")
    got = out.where("t = timestamp_ntz'2024-01-01 00:07:00'").collect()
    assert out.groupBy("alertname", "series", "t").count().where("count > 1").count() == 0
    assert sorted((r["alertname"], r["labels"].get("pod"), r["state"]) for r in got) == [
        ("BackendHighMemory", "chain-backend-0", "firing"), ("BackendHighMemory", "chain-backend-1", "firing"), ("DatabaseStorageHigh", None, "pending"),
        ("ScaleOnMemory", "chain-backend-0", "firing"), ("ScaleOnMemory", "chain-backend-1", "firing"),
    ]
    storage = next(r for r in got if r["alertname"] == "DatabaseStorageHigh")
    assert storage["value"] == pytest.approx(0.9) and storage["description"] == "Current: 90% PVC: chain-postgresql-1"


def test_stalled_counter_is_exactly_zero(spark):
    # large and uneven increases before the stall must leave no rest in the differences
    data = [("blockscout_indexed_blocks_total", {"instance": "a"}, t(i), 1e15 + i * 0.1 if i < 20 else 1e15 + 2.0) for i in range(60)]
    out = al.run_rules(spark.createDataFrame(data, SAMPLES), al.RULES, m.Grid.over(t(0), t(59), "30 seconds"), "2 minutes")
    assert out.where("alertname = 'IndexerStalled' and state = 'firing'").agg(F.min("t")).first()[0] == t(35)


def test_trailing_windows_against_brute_force(spark):
    import random

    rng = random.Random(4)
    points = [(rng.choice("ab"), rng.randint(0, 400) / 4, float(rng.randint(0, 30))) for _ in range(150)] + [("hot", i / 8, float(i % 50)) for i in range(800)]
    s = spark.createDataFrame([(k, t(x), v) for k, x, v in points], "k string, ts timestamp_ntz, value double")
    grid, span = m.Grid.over(t(10), t(90), "3 minutes"), 10
    series_of = {}
    for k, x, v in points:
        at = series_of.setdefault(k, {})
        at[x] = max(v, at.get(x, v))
    inc, grow, now = {}, {}, {}
    for k, at in series_of.items():
        xs = sorted(at)
        delta = {x: 0.0 if i == 0 else at[x] - at[xs[i - 1]] if at[x] >= at[xs[i - 1]] else at[x] for i, x in enumerate(xs)}
        for g in range(10, 91, 3):
            seen = [x for x in xs if g - span < x <= g]
            if seen:
                inc[k, t(g)], now[k, t(g)] = sum(delta[x] for x in seen), at[seen[-1]]
                first = min(v for kk, x, v in points if kk == k and x == seen[0])
                grow[k, t(g)] = (at[seen[-1]] - first) / (seen[-1] - seen[0]) * 1440 if len(seen) > 1 else None
    for got, want in ((m.increase(s, ["k"], grid, "10 minutes"), inc), (m.growth_per_day(s, ["k"], grid, "10 minutes"), grow), (m.instant_vector(s, ["k"], grid, "10 minutes"), now)):
        found = {(r["k"], r["t"]): r["value"] for r in got.collect()}
        assert found.keys() == want.keys()
        assert all(found[x] == want[x] or found[x] == pytest.approx(want[x]) for x in want)
    bounded = m.increase(s, ["k"], grid, "10 minutes", before="5 minutes")
    assert bounded.count() == len(inc)


def test_bounded_look_back(spark, tmp_path):
    s = series(spark, [(i, i) for i in range(100)])
    s.write.parquet(str(tmp_path / "s"))
    read = spark.read.parquet(str(tmp_path / "s"))
    deltas = m.counter_deltas(read, ["k"], t(80), "5 minutes")
    # the samples after the start, and the newest one before it
    assert deltas.count() == 20 and deltas.agg(F.sum("delta")).first()[0] == 19
    gap = m.counter_deltas(read.where(~F.col("value").between(60, 80)), ["k"], t(80), "5 minutes")
    assert gap.count() == 19 and gap.agg(F.sum("delta")).first()[0] == 18  # the one 21 minutes before is not looked for


def test_kpi_labels(spark):
    data = [("cilium_endpoint_state", {"state": "ready", "node": n}, t(4), 3.0) for n in "ab"] + [("cilium_endpoint_state", {"state": "waiting"}, t(4), 9.0), ("cilium_endpoint_state", {"node": "c"}, t(4), 9.0)]
    data += [("cilium_drop_count_total", {"reason": r}, t(i), float(i * v)) for i in (1, 4) for r, v in (("Policy denied", 10), ("Stale", 20))]
    got = {r["kpi"]: r["value"] for r in m.kpi_report(spark.createDataFrame(data, SAMPLES), t(5)).collect()}
    assert got["ready_endpoints"] == 6 and got["policy_drop_rate"] == pytest.approx(0.1) and got["packet_drop_rate"] == pytest.approx(0.3)
    assert len(got) == len(m.KPIS) and got["gateway_p99"] is None
