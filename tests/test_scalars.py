from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerops import functions as fn
from ledgerops.functions.register import register_functions
from ledgerops.plans import QUERIES


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make("v").alias("r")).first()["r"]


@pytest.mark.parametrize(
    "text,want",
    [("90 days", 7776000), ("1 day", 86400), ("30d", 2592000), ("300s", 300), ("5m", 300), ("720h", 2592000),
     ("1 day 12 hours", 129600), ("soon", None), ("5 parsecs", None), ("", None), (None, None)],
)
def test_duration(spark, text, want):
    assert one(spark, text, fn.duration_seconds) == want


@pytest.mark.parametrize(
    "size,want",
    [(0, "0 bytes"), (10239, "10239 bytes"), (10240, "10 kB"), (10485247, "10239 kB"), (10485760, "10 MB"), (5 * 2**40, "5120 GB"),
     (20 * 2**40, "20 TB"), (-20480, "-20 kB"), (None, None)],
)
def test_size_pretty(spark, size, want):
    assert one(spark, size, fn.size_pretty, "bigint") == want


@pytest.mark.parametrize(
    "size,want",
    [(2**63, "8192 PB"), (-(2**63) - 1, "-8192 PB"), (10**24, "888178420 PB"), (10**38 - 1, "88817841970012520000000 PB"), (10239, "10239 bytes"), (None, None)],
)
def test_size_pretty_beyond_longs(spark, size, want):
    register_functions(spark)
    df = spark.createDataFrame([(None if size is None else Decimal(size),)], "v decimal(38,0)")
    assert tuple(df.select(fn.size_pretty("v"), F.expr("size_pretty(v)")).first()) == (want, want)


def test_sizes_of_large_keys(spark, tmp_path):
    keys = [(0, 0), (1, 3), (149_999, 14_999), (8_999_999, 899_999), (53_999_999, 5_399_999), (None, 7)]
    spark.createDataFrame(keys, "o_orderkey bigint, o_custkey bigint").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r["k"]: r["size"] for r in QUERIES["x10_size_pretty"](spark, str(tmp_path)).collect()}
    assert got[0] == "0 bytes" and got[1] == "9000 bytes" and got[None] is None
    for order, customer in keys[2:5]:
        b = order * customer * customer * 1000
        assert got[order] == f"{(2 * b + 2**50) // 2**51} PB"


@pytest.mark.parametrize(
    "v,want",
    [(0.0, "0"), (1234.0, "1.234k"), (1.5e6, "1.5M"), (15.625, "15.62"), (0.012, "12m"), (999.96, "1000"), (-2500.0, "-2.5k"), (1e24, "1Y")],
)
def test_humanize(spark, v, want):
    assert one(spark, v, fn.humanize, "double") == want


@pytest.mark.parametrize(
    "v,want", [(0.0, "0s"), (0.0012, "1.2ms"), (59.5, "59.5s"), (61.0, "1m 1s"), (3661.0, "1h 1m 1s"), (90061.0, "1d 1h 1m 1s"), (-61.0, "-1m 1s")]
)
def test_humanize_duration(spark, v, want):
    assert one(spark, v, fn.humanize_duration, "double") == want


@pytest.mark.parametrize("v", [0.85, 0.12345, 1.0, 0.999951, 123.456, 0.00001234, 1.145, 211.65])
def test_percentage_matches_g_format(spark, v):
    text = f"{v * 100:.4g}%"
    assert one(spark, v, fn.humanize_percentage, "double") == text


def test_render(spark):
    df = spark.createDataFrame([(101.0, {"table": "logs"})], "v double, labels map<string,string>")
    text = "{{ $labels.table }}: {{ $value }} / {{ $value | humanizeDuration }}{{ $labels.none }}!"
    assert df.select(fn.render(text, "v", "labels")).first()[0] == "logs: 101 / 1m 41s!"


@pytest.mark.parametrize("digits", ["0x0", "0xff", "0x7fffffffffffffff", "0xffffffffffffffff", "0x0000" + "f" * 20, "0x" + "4" * 32, "0x" + "f" * 64, "zz", None])
def test_hex_to_number(spark, digits):
    r = one(spark, digits, fn.hex_to_number)
    n = int(digits, 16) if digits not in ("zz", None) else None
    assert r["as_long"] == (n if n is not None and n < 2**63 else None)
    assert r["as_decimal"] == (Decimal(n) if n is not None and n < 10**38 else None)
    assert r["hex"] == (f"{n:x}" if n is not None else None)


def test_positions_addresses_coins(spark):
    df = spark.createDataFrame([("1/0", "0/FFFFFFFF")], "a string, b string")
    assert df.select(fn.lsn_diff("a", "b")).first()[0] == 1
    assert one(spark, " 0xAB" + "c" * 38, fn.normalize_address) == "0xab" + "c" * 38
    assert one(spark, "0xABC", fn.normalize_address) is None
    coins = lambda v: one(spark, v, fn.to_coin, "decimal(38,0)")
    assert coins(Decimal(1)) == Decimal("1e-18")
    assert coins(Decimal("-12345678901234567890123")) == Decimal("-12345.678901234567890123")


@pytest.mark.parametrize("text,want", [("2000m", 2.0), ("4Gi", 4 * 2.0**30), ("8GB", 8 * 2.0**30), ("16kB", 16384.0), ("500M", 5e8), ("7", 7.0), ("1.5k", 1500.0), ("x", None), ("3zz", None)])
def test_quantity(spark, text, want):
    got = one(spark, text, fn.parse_quantity)
    assert got == (pytest.approx(want) if want is not None else None)


def test_times(spark):
    assert one(spark, "2024-01-02T03:04:05.250Z", fn.parse_iso) == datetime(2024, 1, 2, 3, 4, 5, 250000)
    assert one(spark, "not a time", fn.parse_iso) is None
    t = datetime(2024, 1, 1)
    assert one(spark, t, lambda c: fn.age_seconds(c, "2024-01-01 00:00:01.5"), "timestamp_ntz") == 1.5
    assert one(spark, None, lambda c: fn.age_seconds(c, "2024-01-01"), "timestamp_ntz") == 0.0
    assert one(spark, None, lambda c: fn.age_seconds(c, "2024-01-01", null_as_zero=False), "timestamp_ntz") is None
    assert one(spark, t, lambda c: fn.from_micros(fn.micros(c)), "timestamp_ntz") == t
    with pytest.raises(ValueError):
        fn.to_timedelta("5 parsecs")


def test_ratio_and_flag(spark):
    df = spark.createDataFrame([(1, 4), (1, 0), (None, 4), (1, None)], "a int, b int")
    assert [r[0] for r in df.select(fn.safe_ratio("a", "b")).collect()] == [0.25, 0.0, 0.0, 0.0]
    assert one(spark, "on", lambda c: fn.flag(c, "on")) == 1 and one(spark, None, lambda c: fn.flag(c, "on")) == 0


def test_sql_functions(spark):
    register_functions(spark)
    r = spark.sql("SELECT safe_ratio(1D, 0D) a, on_flag('on') b, lsn_bytes('1/0') c, uint256_text(repeat('f', 64)) d").first()
    assert (r["a"], r["b"], int(r["c"]), int(r["d"])) == (0.0, 1, 2**32, 2**256 - 1)
    assert spark.range(1).select(F.expr("normal_address('0x12')")).first()[0] is None


def test_sql_names_equal_columns(spark):
    register_functions(spark)
    df = spark.createDataFrame(
        [("1 day 12 hours", "4Gi", 123456789, "2001-01-01T00:00:01Z", "16/B374D848", "16/0"), ("30d", "2000m", 10239, "x", "0/10", "0/1"), ("soon", "8 XY", -7 * 10**16, None, None, "0/1")],
        "d string, q string, n bigint, iso string, a string, b string",
    )
    by_column = df.select(fn.duration_seconds("d"), fn.parse_quantity("q"), fn.size_pretty("n"), fn.parse_iso("iso"), fn.lsn_diff("a", "b"), fn.md5_hash("d"), fn.qualified("d", "q"))
    by_name = df.selectExpr("duration_seconds(d)", "parse_quantity(q)", "size_pretty(n)", "parse_iso(iso)", "lsn_diff(a, b)", "md5_hash(d)", "qualified_name(d, q)")
    assert [tuple(r) for r in by_name.collect()] == [tuple(r) for r in by_column.collect()]


def test_words_equal_hex_of_any_width(spark):
    words = ["0" * 64, "0" * 63 + "1", "0" * 49 + "f" * 15, "0" * 48 + "f" * 16, "0" * 32 + "4b3b4ca85a86c47a098a223fffffffff", "0" * 32 + "f" * 32, "f" * 64, "1" + "0" * 63, "g" * 64, "12", None]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [tuple(r) for r in df.select(fn.word_to_decimal(F.col("w")), F.when(F.length("w") == 64, fn.hex_to_decimal("w"))).collect()]
    assert all(a == b for a, b in got) and int(got[4][0]) == 10**38 - 1


def test_sql_names_of_texts_and_quantities(spark):
    register_functions(spark)
    values = [0.0, 1.0, -1.0, 999.95, 1234567.0, 1.145, 0.00012345, 1e-5, 12345.0, 59.999, 60.0, 3661.0, 90061.5, -90061.5, 0.5, 0.0005, 3e-7, 4e-10, 2.5e15, 1e27, 7.0e-23, 99999.5, 0.1 + 0.2, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for name, make in [("significant", lambda c: fn.significant(F.col(c))), ("humanize", fn.humanize), ("humanize_percentage", fn.humanize_percentage), ("humanize_duration", fn.humanize_duration)]:
        pairs = df.select("v", F.expr(f"{name}(v)").alias("a"), make("v").alias("b")).collect()
        assert [r for r in pairs if r["a"] != r["b"]] == [], name
    hexes = ["0x0", "0xFF", "ff", "0x", "zz", "0x" + "f" * 16, "7fffffffffffffff", "0x" + "f" * 31, "f" * 64, None]
    df = spark.createDataFrame([(h,) for h in hexes], "h string")
    pairs = df.select("h", F.expr("hex_to_decimal(h)").alias("a"), fn.hex_to_decimal("h").alias("b"), F.expr("hex_to_long(h)").alias("c"), fn.hex_to_number("h")["as_long"].alias("d")).collect()
    assert [r for r in pairs if (r["a"], r["c"]) != (r["b"], r["d"])] == []
    df = spark.sql("SELECT CAST(v AS DECIMAL(38,0)) v FROM VALUES ('0'), ('1'), ('-1'), ('1000000000000000000'), ('-12345678901234567890123'), (NULL) t(v)")
    assert [r for r in df.select("v", F.expr("to_coin(v)").alias("a"), fn.to_coin("v").alias("b")).collect() if r["a"] != r["b"]] == []
