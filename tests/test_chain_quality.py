import os
from datetime import date, datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerops.operators import chain, filters, health, joins, logs, quality
from ledgerops.operators.ordered import positions
from ledgerops.plans import ORACLES, QUERIES
from ledgerops.session import scratch_path, shared_dir
from tests.conftest import rows


def numbers(spark, ns):
    return spark.createDataFrame([(n,) for n in ns], "n bigint")


@pytest.mark.parametrize(
    "present,want",
    [([], [(0, 9)]), (range(10), []), ([0, 1, 5, 5, 9], [(2, 4), (6, 8)]), ([3], [(0, 2), (4, 9)]), ([-5, 20], [(0, 9)])],
)
def test_missing_ranges(spark, present, want):
    assert rows(chain.missing_ranges(numbers(spark, present), "n", 0, 9)) == want


def test_batches_tile_ranges(spark):
    ranges = spark.createDataFrame([(0, 6), (10, 10)], "lo bigint, hi bigint")
    assert rows(chain.fetch_batches(ranges, 3)) == [(0, 2), (3, 5), (6, 6), (10, 10)]


def test_balance_history(spark):
    d = lambda n: datetime(2024, 1, n, 12)
    flows = spark.createDataFrame([("a", d(1), 5), ("a", d(3), 2), ("a", d(3), -1), ("b", d(6), 7), ("c", d(9), 1)], "k string, at timestamp_ntz, v bigint")
    got = rows(chain.balance_history(flows, ["k"], "at", "v", 4, datetime(2024, 1, 6)))
    assert got == [("a", date(2024, 1, n), 6 if n >= 3 else 5) for n in (3, 4, 5, 6)] + [("b", date(2024, 1, 6), 7)]
    long = chain.balance_history(flows, ["k"], "at", "v", 30, datetime(2024, 1, 2))
    assert rows(long) == [("a", date(2024, 1, 1), 5), ("a", date(2024, 1, 2), 5)]  # nothing before the first change


def test_state_as_of(spark):
    c = spark.createDataFrame([("a", 1, "x", False), ("a", 3, "y", False), ("b", 2, "z", False), ("b", 4, "z", True)], "k string, v int, s string, gone boolean")
    state = lambda target: rows(chain.state_as_of(c, ["k"], "v", target, "gone").select("k", "s"))
    assert state(0) == [] and state(2) == [("a", "x"), ("b", "z")] and state(4) == [("a", "y")]
    points = spark.createDataFrame([("before", 2)], "name string, at int")
    assert chain.restore_point(points, "before", "at") == 2
    with pytest.raises(ValueError):
        chain.restore_point(points, "none", "at")


def test_latest_by_key_reduces_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    out = chain.latest_by_key(df, ["k"], ["v"])
    # one limit below the exchange, one above
    assert out._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2
    assert rows(out) == [(0, 99), (1, 97), (2, 98)]


def test_nonces(spark):
    txs = spark.createDataFrame([("s", n) for n in (0, 1, 1, 4)] + [("q", 7)], "s string, n bigint")
    assert rows(chain.nonce_gaps(txs, "s", "n")) == [("s", "duplicate", 1, 1, 2), ("s", "gap", 2, 3, 0)]


def test_token_balances_sum_to_zero(spark):
    t = spark.createDataFrame([("t", "a", "b", 5), ("t", "b", "a", 2), ("t", "c", "c", 9), ("u", "a", "b", 1), ("u", "b", "a", 1)], "tok string, f string, r string, v bigint")
    got = chain.token_balances(t, "tok", "f", "r", "v")
    assert rows(got) == [("t", "a", -3), ("t", "b", 3)]
    assert rows(chain.holders(got, "tok")) == [("t", 1)]


def test_decode(spark):
    word = lambda n: f"{n:064x}"
    df = spark.createDataFrame(
        [("0xe", "0xc", "0x" + word(42) + word(0xABC)), ("0xe", "0xc", "0x" + "f" * 64 + word(1)), ("0xother", "0xc", "0x")],
        "first_topic string, address_hash string, data string",
    )
    got = chain.decode_event(df, "0xe", [("value", "uint256"), ("who", "address")], contract="0xc").collect()
    assert int(got[0]["value"]) == 42 and got[0]["who"] == "0x" + f"{0xABC:040x}"
    assert got[1]["value"] is None and got[1]["value_hex"] == "f" * 64
    calls = spark.createDataFrame([("0x60FE47B1" + word(7),), ("0x6d4ce63c",)], "input string")
    names = spark.createDataFrame([("0x60fe47b1", "set(uint256)")], "selector string, signature string")
    out = {r["selector"]: r for r in chain.decode_calls(calls, [names]).collect()}
    assert out["0x60fe47b1"]["signature"] == "set(uint256)" and out["0x60fe47b1"]["args"] == [word(7)]
    assert out["0x6d4ce63c"]["signature"] is None and out["0x6d4ce63c"]["args"] == []


def test_signature_priority(spark):
    a = spark.createDataFrame([("x", "first")], "selector string, signature string")
    b = spark.createDataFrame([("x", "second"), ("y", "only")], "selector string, signature string")
    calls = spark.createDataFrame([("x",), ("y",), ("z",)], "selector string")
    got = joins.resolve_signature(calls, "selector", [a, b]).select("selector", "signature", "source")
    assert rows(got) == [("x", "first", 1), ("y", "only", 2), ("z", None, None)]


def test_not_in_forms(spark):
    src = spark.createDataFrame([(1,), (2,), (None,)], "v int")
    full, holed, empty = (spark.createDataFrame([(x,) for x in xs], "v int") for xs in ([1], [1, None], []))
    assert rows(joins.missing_rows(src, full, "v", True)) == [(2,)]
    assert rows(joins.missing_rows(src, holed, "v", True)) == []
    assert rows(joins.missing_rows(src, empty, "v", True)) == [(1,), (2,), (None,)]
    assert rows(joins.missing_rows(src, holed, "v")) == [(2,), (None,)]


def test_match_pending_bounds(spark, at):
    df = lambda xs: spark.createDataFrame([("k", at(c), i) for c, i in xs], "k string, ts timestamp_ntz, id int")
    got = joins.match_pending(df([("10:00", 1), ("12:00", 2)]), df([("10:00", 8), ("13:00:01", 9)]), "k", "ts", "id", "1 hour")
    assert rows(got.select("id", "mined_id")) == [(1, 8), (2, None)]


def test_routing_requests(spark):
    urls = ["https://a.x.com/api/v1?q=1", "https://a.x.com/apiary", "https://b.x.com", "http://y.org/api"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    df = df.select(joins.url_host(F.col("url")).alias("h"), joins.url_path(F.col("url")).alias("p"))
    got = joins.route_requests(df, "h", "p", [("*.x.com", "/", "web"), ("*.x.com", "/api", "api"), ("b.x.com", "/", "b")])
    assert [r["backend"] for r in got.collect()] == ["api", "web", "b", None]


def test_quality(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (None, "7")], "k int, v string")
    assert tuple(quality.duplicate_keys(df, ["k"]).first()) == (2, 1, 1, 1)
    checks = [quality.Check("k", "required"), quality.Check("k", "min", 2), quality.Check("v", "enum", ["a"]), quality.Check("v", "type", "int"), quality.Check("v", "pattern", "^[a-z]$")]
    assert [r["violations"] for r in quality.validate(df, checks).collect()] == [1, 2, 1, 2, 1]
    assert quality.violating_rows(df, checks[:2]).count() == 3
    assert rows(quality.fill_defaults(df, {"v": "?", "w": 1}).select("v", "w")) == [("7", 1), ("?", 1), ("a", 1), ("a", 1)]
    parent = spark.createDataFrame([(1,)], "id int")
    assert tuple(quality.fk_orphans([("r", df, "k", parent, "id")]).first()) == (1, 1, "r")


def test_health_edges(spark, at):
    empty = spark.createDataFrame([], "at timestamp_ntz, n bigint")
    assert tuple(health.data_age(empty, "at", "2024-01-01").first()) == (0.0, 0)
    assert health.data_age(empty, "at", "2024-01-01", null_as_zero=False).first()[0] is None
    assert tuple(health.indexing_progress(empty, "n", "at", "2024-01-01").first()) == (None, 0, 0.0)
    times = spark.createDataFrame([(at("10:00"),), (at("10:00"),), (at("10:05"),)], "at timestamp_ntz")
    gaps = health.stalls(times, "at", 60, at("10:20"))
    assert rows(gaps.select("gap_seconds", "open")) == [(300.0, False), (900.0, True)]
    assert health.stalls(times, "at", 300, at("10:10")).count() == 0  # exactly the limit is allowed


def test_profile_constant_column(spark):
    df = spark.range(200).select("id", F.lit(1).alias("c"), (-F.col("id")).alias("d"))
    got = {r["attname"]: r for r in health.column_profile(df, ["id", "c", "d"], ["id"]).collect()}
    assert got["id"]["correlation"] == pytest.approx(1) and got["d"]["correlation"] == pytest.approx(-1)
    assert got["c"]["correlation"] is None and not got["c"]["candidate"] and got["d"]["candidate"]


@pytest.mark.parametrize("rows_", [0, 1, 4000])
def test_profile_equals_sql_and_writes_wide_rows_once(spark, rows_):
    n = F.col("id")
    df = spark.range(0, rows_, 1, 5).select(
        (n % 7).alias("a"), (n * 37 % 50).alias("b"), F.when(n % 3 > 0, n % 11).alias("gaps"), F.concat(F.lit("k"), (n % 13).cast("string")).alias("text"),
        F.lit(5).alias("same"), F.lit("x" * 20).alias("wide"),
    ).where(n % 400 < 300)
    order, cols = ["a", "wide", "b"], ["b", "gaps", "text", "same", "a"]
    folder, before = shared_dir(spark), set(os.listdir(shared_dir(spark)))
    got = {r["attname"]: r for r in health.column_profile(df, cols, order).collect()}
    written = [spark.read.parquet(os.path.join(folder, f)) for f in set(os.listdir(folder)) - before]
    assert not [t.columns for t in written if "wide" in t.columns]  # columns of the order alone are not written
    assert sum(set(cols) <= set(t.columns) for t in written) == 1
    duck = duckdb.connect()
    duck.register("t", df.toArrow())
    for c in cols:
        keys = ", ".join(f"{k} NULLS FIRST" for k in dict.fromkeys([*order, *cols]))
        want = duck.sql(f"""SELECT count(DISTINCT v), corr(pos, rk) FROM (SELECT v, pos, CASE WHEN v IS NOT NULL THEN rank() OVER (ORDER BY v NULLS LAST) END AS rk
            FROM (SELECT {c} AS v, row_number() OVER (ORDER BY {keys}) AS pos FROM t) p) q""").fetchall()[0]
        flat = want[1] is None or want[1] != want[1]
        assert got[c]["n_distinct"] == want[0] and got[c]["correlation"] == (None if flat else pytest.approx(want[1], abs=1e-9)), c


def test_positions_deal_a_frequent_row_to_several_tasks(spark):
    df = spark.range(0, 40_000, 1, 8).select(F.when(F.col("id") % 10 > 0, 7).otherwise(F.col("id")).alias("v"), F.lit("p").alias("p"))
    folder, before = shared_dir(spark), set(os.listdir(shared_dir(spark)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = positions(df, ["v"], "at", ["v"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    written = [spark.read.parquet(os.path.join(folder, f)) for f in set(os.listdir(folder)) - before]
    files = [t.where("v = 7").select(F.input_file_name()).distinct().count() for t in written if "v" in t.columns]
    got = placed.orderBy("at").collect()
    assert placed.columns == ["v", "at"] and [r["at"] for r in got] == list(range(1, 40_001))
    assert [r["v"] for r in got] == sorted(r["v"] for r in got) and files[0] > 1


@pytest.mark.parametrize("text", ["", "a", "ab", "abcdef", "abcdefgh", "\u00e9", "\U0001f600x", "\x00", None])
def test_number_of_a_text_is_that_of_its_first_six_bytes(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    want = None if text is None else float(int.from_bytes(text.encode()[:6].ljust(6, b"\0"), "big"))
    assert df.select(health._ordered_number(df, "t")).first()[0] == want


def test_filters(spark):
    logs_ = spark.createDataFrame([("c", "t1", "x", None), ("c", "t2", "x", "y")], "address_hash string, transaction_hash string, first_topic string, second_topic string")
    assert filters.filter_logs(logs_, "c", None, ["x", "y"]).count() == 1 and filters.filter_logs(logs_).count() == 2
    names = spark.createDataFrame([("t_1",), ("tx1",)], "n string")
    assert filters.name_like(names, "n", "t_1").count() == 2 and filters.name_like(names, "n", "t_1", True).count() == 1
    s = spark.createDataFrame([("m", {"a": "pod-1"}), ("m", {"a": "xpod-1"}), ("m", {})], "metric string, labels map<string,string>")
    assert filters.select_series(s, "m", regex={"a": "pod-.*"}).count() == 1
    assert filters.select_series(s, "m", eq={"a": ""}).count() == 1
    both = spark.createDataFrame([("a", "a"), ("a", "b")], "f string, r string")
    assert filters.address_activity(both, "a", {"f": "from", "r": "to"}).count() == 3


def test_logs(spark):
    line = "2024-01-01 00:00:01.250 UTC [42]: [7-1] user=bob,db=chain,app=a,b,client=10.0.0.1 LOG:  duration: 1500.5 ms  statement: SELECT 'x', 12"
    df = spark.createDataFrame([(line,), ("free text",)], "l string")
    parsed = logs.parse_server_log(df, "l")
    r = parsed.where("pid = 42").first()
    assert (r["log_time"], r["line_no"], r["app"], r["client"]) == (datetime(2024, 1, 1, 0, 0, 1, 250000), 7, "a,b", "10.0.0.1")
    assert parsed.where("pid is null").first()["message"] == "free text"
    slow = logs.slow_statements(parsed, 1000).first()
    assert slow["duration_ms"] == 1500.5 and slow["statement"] == "SELECT 'x', 12"
    stats = logs.statement_stats(logs.slow_statements(parsed, 1000), "statement", "duration_ms").first()
    assert (stats["query"], stats["calls"]) == ("SELECT ?, ?", 1)


def test_paging_covers_everything(spark):
    df = spark.createDataFrame([(i // 3, i) for i in range(20)], "d int, k int")
    seen, after = [], None
    while True:
        page = logs.latest_page(df, ["d", "k"], 6, after).collect()
        if not page:
            break
        seen += [r["k"] for r in page]
        after = tuple(page[-1])
    assert seen == list(range(19, -1, -1))


def test_concurrency(spark, at):
    log = spark.createDataFrame([("c", at("10:00"), 1), ("c", at("10:01"), 1), ("c", at("10:01"), -1), ("d", at("10:02"), 1)], "c string, at timestamp_ntz, n int")
    assert [r["open"] for r in logs.session_concurrency(log, "at", "n").orderBy("at").collect()] == [1, 1, 2]
    assert tuple(logs.peak_concurrency(log, "at", "n").first()) == (2, at("10:02"))
    assert at("10:00") + timedelta(minutes=2) == at("10:02")


@pytest.mark.parametrize("copies", [1, 3])
def test_concurrency_equals_its_sql_with_equal_and_missing_times(spark, tmp_path, at, copies):
    times = [at("10:00"), at("10:01"), at("10:01"), at("10:02"), None, at("10:02"), None, at("10:03")]
    kinds = ["signup", "signup", "error", "signup", "signup", "view", "error", "error"]
    data = [(n, t, n % 2, k) for n, (t, k) in enumerate(zip(times, kinds, strict=True))] * copies
    spark.createDataFrame(data, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("a20_session_concurrency", "a20_peak_by_client"):
        want = duck.sql(ORACLES[name]).fetchall()
        assert sorted(map(str, (tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()))) == sorted(map(str, want)), name


def test_concurrency_of_one_frequent_time(spark, at):
    log = spark.range(25_000).select(F.lit(at("10:00")).alias("at"), F.lit(1).alias("n"))
    got = logs.session_concurrency(log, "at", "n", every=True)
    assert got.where("open = 25000").count() == got.count() == 25_000


def test_daily_stats_added_day_by_day(spark):
    import random
    rng = random.Random(9)
    start = datetime(2024, 3, 1)
    data = [(start + timedelta(days=d, minutes=rng.randint(0, 1439)), f"a{rng.randint(0, 30 + 5 * d)}", rng.choice([None, f"a{rng.randint(0, 60)}"]), 1.5) for d in range(8) if d != 3 for _ in range(20)]
    txs = spark.createDataFrame(data, "at timestamp_ntz, s string, r string, v double")
    path = scratch_path(spark, "t-daily")
    day = lambda d: date(2024, 3, 1 + d)
    add = lambda a, b: chain.update_daily_stats(txs, "at", "s", "r", "v", path, day(a), day(b))
    for a, b in ((0, 2), (3, 3), (4, 6), (4, 6), (7, 7)):
        add(a, b)
    want = chain.daily_stats(txs, "at", "s", "r", "v", 30, "2024-03-08 12:00:00")
    assert rows(chain.stored_daily_stats(spark, path, 30, "2024-03-08 12:00:00")) == rows(want)
    assert chain.stored_daily_stats(spark, path, 2, "2024-03-08 12:00:00").count() == 2
    with pytest.raises(ValueError):
        add(2, 4)


def test_fee_scan_is_bounded(spark, tmp_path):
    spark.range(1000).selectExpr("id AS block", "id * 2.0D AS price").write.parquet(str(tmp_path / "t"))
    txs = spark.read.parquet(str(tmp_path / "t"))
    for step in (1, 3):  # without and with numbers missing
        blocks = spark.range(0, 1000, step).withColumnRenamed("id", "number")
        got = chain.fee_percentiles(txs, "block", "price", blocks, "number", 100, {"low": 0.0, "high": 1.0}).collect()
        newest = sorted(range(0, 1000, step))[-100:]
        assert {r["speed"]: r["value"] for r in got} == {"low": newest[0] * 2.0, "high": newest[-1] * 2.0}
    assert chain.fee_percentiles(txs, "block", "price", blocks.limit(0), "number", 100, {"low": 0.0}).count() == 0


def test_table_sizes_against_the_file_system(spark):
    path = scratch_path(spark, "t-sizes")
    spark.range(1000, numPartitions=3).withColumn("p", F.col("id") % 2).write.partitionBy("p").parquet(path)
    spark.range(5).coalesce(1).write.parquet(f"{path}/_ledger")
    sizes = [os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet") and "_ledger" not in d]
    r = health.table_sizes(spark, {"t": path}).first()
    assert (r["data_bytes"], r["largest_bytes"], r["files"], r["rows"]) == (sum(sizes), max(sizes), len(sizes), 1000)
    assert r["rest_bytes"] == r["total_bytes"] - r["data_bytes"] > 0
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_sketched_profile(spark):
    df = spark.range(20_000).select(
        "id", (-F.col("id")).alias("down"), F.lit(7).alias("same"), F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("gaps"),
        F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("name"), F.lit(None).cast("double").alias("none"),
    )
    cols = ["id", "down", "same", "gaps", "name", "none"]
    near = {r["attname"]: r for r in health.column_profile(df, cols, ["id"], approx=True).collect()}
    exact = {r["attname"]: r for r in health.column_profile(df, cols, ["id"]).collect()}
    for c in cols:
        assert near[c]["n_distinct"] == pytest.approx(exact[c]["n_distinct"], rel=0.05)
        assert (near[c]["correlation"] is None) == (exact[c]["correlation"] is None), c
        if exact[c]["correlation"] is not None:
            assert near[c]["correlation"] == pytest.approx(exact[c]["correlation"], abs=0.02)
    assert health.column_profile(df, ["id"], [], approx=True).first()["correlation"] is None
    assert health.column_profile(df.limit(0), ["id"], ["id"], approx=True).first()["n_distinct"] == 0
