from datetime import date, datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerops.operators import partitions as p
from ledgerops.session import scratch_path
from ledgerops.sources import files
from tests.conftest import rows

EVENING = datetime(2025, 3, 12, 19, 46)
MIDNIGHT = datetime(2025, 3, 13)


@pytest.fixture(scope="module")
def blocks(spark):
    """The scratch table: 7000 rows, 1000 on each of the last 7 days."""
    return files.synth_blocks(files.counters(spark, 7000), "n", 7, EVENING).cache()


@pytest.fixture(scope="module")
def calendar(blocks):
    return p.calendar_of(blocks, "blocks_test", "inserted_at", EVENING, "1 day", 3)


def test_synthetic_table(blocks):
    assert blocks.count() == 7000 and blocks.select("hash").distinct().count() == 7000
    assert blocks.where("number = 8").first()["inserted_at"] == EVENING - timedelta(days=1)


def test_calendar(spark, calendar):
    frame = calendar.frame(spark).orderBy("lo").collect()
    assert len(frame) == len(calendar) == 10  # 7 days of data and 3 made ahead
    assert frame[0]["partition_name"] == "blocks_test_p20250306" and frame[0]["lo"] == datetime(2025, 3, 6)
    assert all(a["hi"] == b["lo"] for a, b in zip(frame, frame[1:]))
    hours = p.partition_calendar("x", "2025-01-01 05:00:00", "2025-01-01 07:00:00", "6 hours", 1)
    assert (hours.first, hours.stop, len(hours)) == (datetime(2025, 1, 1), datetime(2025, 1, 1, 18), 3)
    assert len(p.partition_calendar("x", "2025-02-01", "2025-01-01", "1 day", 2)) == 0


def test_assignment_covers_every_row_once(blocks, calendar):
    counts = p.assign_partition(blocks, "inserted_at", calendar).groupBy("partition_name").count().collect()
    assert sum(r["count"] for r in counts) == 7000 and len(counts) == 7


def test_assignment_bounds_and_nulls(spark):
    cal = p.partition_calendar("t", "2025-01-01", "2025-01-02", "1 day", 0)
    times = [(datetime(2024, 12, 31, 23, 59, 59),), (datetime(2025, 1, 1),), (datetime(2025, 1, 3),), (None,)]
    df = spark.createDataFrame(times, "at timestamp_ntz")
    names = [r["partition_name"] for r in p.assign_partition(df, "at", cal, on_null="reject").collect()]
    assert names == ["default", "t_p20250101", "default", "rejected"]
    with pytest.raises(PySparkException):
        p.assign_partition(df, "at", cal).collect()


def test_migration_plan(spark, blocks):
    plan = p.migration_plan([("blocks", blocks, "inserted_at")], "1 day", 300).orderBy("batch_no").collect()
    assert len(plan) == 7 * 4 and [r["rows_moved"] for r in plan[:4]] == [300, 300, 300, 100]
    assert plan[-1]["total_moved"] == 7000 == sum(r["rows_moved"] for r in plan)
    assert [r["batch_no"] for r in plan if r["log_line"]] == [10, 20]
    assert p.migration_plan([("none", blocks.limit(0), "inserted_at")]).count() == 0


def test_batches_follow_the_plan(blocks):
    got = p.assign_batches(blocks, "inserted_at", ["number"], 300).groupBy("lo", "batch").count()
    assert sorted(r["count"] for r in got.collect()) == [100] * 7 + [300] * 21


def test_migrate_reconcile_and_prune(spark, blocks, calendar):
    path = scratch_path(spark, "t-migrate")
    p.migrate(blocks, path, "inserted_at", calendar)
    moved = spark.read.parquet(path)
    verdict = p.reconcile(blocks, moved, ["hash"]).first()
    assert verdict["passed"] and verdict["source_rows"] == verdict["target_rows"] == 7000
    lost = p.reconcile(blocks, moved.where("number > 10").unionByName(moved.where("number = 11")), ["hash"]).first()
    assert (lost["missing_rows"], lost["surplus_rows"], lost["difference"], lost["passed"]) == (10, 1, 9, False)
    recent = files.read_range(spark, path, "inserted_at", EVENING - timedelta(days=2), EVENING + timedelta(seconds=1))
    assert recent.count() == 3000
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(isnull(p_day" in plan and "PushedFilters: [IsNotNull(inserted_at)" in plan
    assert len(files.read_range(spark, path, "inserted_at", EVENING - timedelta(days=2)).inputFiles()) > 0
    sizes = p.partition_sizes(moved, 3).collect()
    assert [r["rows"] for r in sizes] == [1000] * 3 and all(r["bytes"] > 0 for r in sizes)


@pytest.mark.parametrize("now,dropped,left", [(EVENING, 5, 2000), (MIDNIGHT, 6, 1000)])
def test_retention_boundary(spark, blocks, calendar, now, dropped, left):
    gone = p.retention_candidates(calendar.frame(spark), now, "1 day")
    assert gone.count() == dropped
    kept = p.apply_retention(blocks, "inserted_at", now, "1 day")
    assert kept.count() == left
    check = p.retention_check(blocks, kept, "inserted_at", ["hash"], now, "1 day").first()
    assert check["passed"] and check["young_lost"] == 0
    too_much = p.retention_check(blocks, kept.limit(500), "inserted_at", ["hash"], now, "3 days").first()
    assert not too_much["passed"] and too_much["young_lost"] > 0


def test_physical_maintenance(spark, blocks):
    path, name = scratch_path(spark, "t-daily"), "t_daily_blocks"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    outside = blocks.limit(3).withColumn("p_day", F.lit(None).cast("date"))
    files.with_partition(blocks, "inserted_at").unionByName(outside).write.option("path", path).partitionBy("p_day").saveAsTable(name)
    config = spark.createDataFrame([("blocks", "1 day", 3, "1 day")], "parent_table string, partition_interval string, premake int, retention string")
    report = p.run_maintenance(spark, config, {"blocks": name}, EVENING).first()
    assert (report["created"], report["dropped"], report["partition_count"], report["default_rows"]) == (3, 5, 5, 3)
    assert spark.table(name).count() == 2003  # the default partition stays
    again = p.run_maintenance(spark, config, {"blocks": name}, EVENING).first()
    assert (again["created"], again["dropped"], again["partition_count"]) == (0, 0, 5)
    off = config.withColumns({"automatic_maintenance": F.lit("off"), "premake": F.lit(9)})
    idle = p.run_maintenance(spark, off, {"blocks": name}, EVENING).first()
    assert (idle["created"], idle["dropped"], idle["partition_count"]) == (0, 0, 5)
    with pytest.raises(ValueError, match="whole days"):
        p.run_maintenance(spark, config.withColumn("partition_interval", F.lit("12 hours")), {"blocks": name}, EVENING)
    assert p.drop_partitions(spark, name, MIDNIGHT, "1 day") == ["2025-03-11"]
    spark.sql(f"DROP TABLE {name}")


def test_half_day_partitions_have_own_names(spark):
    config = spark.createDataFrame([("b", "12 hours", 3, "1 day")], "parent_table string, partition_interval string, premake int, retention string")
    none = spark.createDataFrame([], "parent_table string, partition_name string, lo timestamp_ntz, hi timestamp_ntz")
    names = [r["partition_name"] for r in p.maintained_partitions(config, none, EVENING).collect()]
    assert len(names) == len(set(names)) == 4


def test_register_config_twice(spark):
    one = spark.createDataFrame([("a", "90 days")], "parent_table string, retention string")
    two = spark.createDataFrame([("a", "1 day"), ("b", "2 days")], "parent_table string, retention string")
    first = p.register_config(one, two.where("parent_table = 'b'"), {"retention": F.lit("30 days")})
    assert rows(first) == [("a", "90 days"), ("b", "30 days")]
    assert rows(p.register_config(first, two, {"retention": F.lit("30 days")})) == [("a", "30 days"), ("b", "30 days")]


def test_counts_and_default(spark, blocks, calendar):
    config = spark.createDataFrame([("blocks_test",), ("empty",)], "parent_table string")
    frame = calendar.frame(spark)
    assert rows(p.partition_counts(config, frame, "left")) == [("blocks_test", 10), ("empty", 0)]
    assert rows(p.partition_counts(config, frame, "inner")) == [("blocks_test", 10)]
    short = p.partition_calendar("blocks", EVENING - timedelta(days=2), EVENING, "1 day", 0)
    assert rows(p.default_partition_rows([(blocks, "inserted_at", short)])) == [("blocks", 4000)]


def test_status_and_age(spark):
    config = spark.createDataFrame(
        [("a", "on", 7, "90 days", True, EVENING - timedelta(hours=3)), ("b", None, 3, None, False, None)],
        "parent_table string, automatic_maintenance string, premake int, retention string, infinite_time_partitions boolean, maintenance_last_run timestamp_ntz",
    )
    assert rows(p.config_status(config)) == [("a", 1, 7, 7776000, 1), ("b", 0, 3, None, 0)]
    assert rows(p.maintenance_age(config, EVENING)) == [("a", 10800.0, True), ("b", 0.0, False)]
    assert rows(p.maintenance_age(config, EVENING, null_as_zero=False))[1] == ("b", None, None)


def test_backups(spark):
    day = lambda n: datetime(2025, 1, n)
    b = spark.createDataFrame(
        [("b1", "completed", day(1), day(1)), ("b2", "completed", day(5), day(5)), ("b3", "failed", day(6), day(6)), ("b4", "completed", day(9), day(9))],
        "name string, phase string, started timestamp_ntz, completed timestamp_ntz",
    )
    assert p.latest_backup(b, day(8)).first()["name"] == "b2"
    assert [r["name"] for r in p.expired_backups(b, day(6), "5 days").collect()] == ["b1"]
    assert p.latest_backup(b, datetime(2024, 1, 1)).count() == 0


def test_day_type(spark, blocks):
    assert files.with_partition(blocks, "inserted_at").where("number = 7").first()["p_day"] == date(2025, 3, 12)


def test_migrate_rejects_null_control(spark, blocks, calendar):
    holed = blocks.withColumn("inserted_at", F.when(F.col("number") > 1, F.col("inserted_at")))
    with pytest.raises(PySparkException):
        p.migrate(holed, scratch_path(spark, "t-null"), "inserted_at", calendar)


def test_check_default_uses_each_config(spark, blocks):
    config = spark.createDataFrame(
        [("a", "1 day", 0, "2 days"), ("b", "1 day", 0, "30 days"), ("unused", "1 day", 0, "1 day")],
        "parent_table string, partition_interval string, premake int, retention string",
    )
    got = p.check_default({"a": (blocks, "inserted_at"), "b": (blocks, "inserted_at")}, config, EVENING)
    assert rows(got) == [("a", 4000), ("b", 0)]


def _events(spark, n=96, hours=1):
    return spark.sql(f"SELECT id, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, CAST(id * {hours} AS INT)) AS ts FROM range({n})")


@pytest.mark.parametrize("interval", ["1 day", "6 hours", "7 days"])
def test_range_reads_every_layout(spark, tmp_path, interval):
    path = files.write_partitioned(_events(spark, 400), str(tmp_path / "t"), "ts", interval)
    lo, hi = "2024-01-03 05:00:00", "2024-01-11 03:00:00"
    want = _events(spark, 400).where(f"ts >= '{lo}' and ts < '{hi}'").count()
    assert files.read_range(spark, path, "ts", lo, hi).count() == want
    assert files.read_range(spark, path, "ts", lo, hi, interval=interval).count() == want


def test_range_reads_default_rows_and_prunes(spark, tmp_path):
    df = _events(spark)
    cal = p.partition_calendar("t", "2024-01-02 00:00:00", "2024-01-02 12:00:00", premake=0)
    p.migrate(df, str(tmp_path / "t"), "ts", cal)
    found = files.read_range(spark, str(tmp_path / "t"), "ts", "2024-01-01 12:00:00", "2024-01-04 00:00:00")
    assert found.count() == 60
    assert "PartitionFilters: [" in found._jdf.queryExecution().executedPlan().toString()


def test_retention_keeps_default_rows_with_and_without_folders(spark, tmp_path):
    df = _events(spark)
    cal = p.partition_calendar("t", "2024-01-02 00:00:00", "2024-01-03 12:00:00", premake=0)
    p.migrate(df, str(tmp_path / "t"), "ts", cal)
    args = ("ts", "2024-01-04 00:00:00", "1 day")
    plain = p.apply_retention(df, *args, calendar=cal)
    stored = spark.read.parquet(str(tmp_path / "t"))
    with_folders = p.apply_retention(stored, *args)
    both = p.apply_retention(stored, *args, calendar=cal)
    ids = lambda x: sorted(r[0] for r in x.select("id").collect())
    assert ids(plain) == ids(with_folders) == ids(both)
    assert len(ids(plain)) == 72


def test_migration_in_batches_resumes(spark, blocks, calendar):
    path, whole = scratch_path(spark, "t-batches"), scratch_path(spark, "t-batches")
    late = blocks.withColumn("inserted_at", F.when(F.col("number") % 1000 < 5, F.lit("1970-01-01").cast("timestamp_ntz")).otherwise(F.col("inserted_at")))
    first = p.migrate_in_batches(late, path, "inserted_at", calendar, 2500, stop_after=2)
    assert first.count() == 2 and spark.read.parquet(path).count() == first.agg(F.max("total_moved")).first()[0] < 7000
    # a batch that wrote its rows but was lost before its commit: they are written again, not added
    with_day = files.with_partition(late, "inserted_at").where(F.col("p_day") == F.lit(str(late.agg(F.max(F.to_date("inserted_at"))).first()[0])).cast("date"))
    with_day.write.mode("append").partitionBy("p_day").parquet(path)
    log = p.migrate_in_batches(late, path, "inserted_at", calendar, 2500)
    want = p.migrate_in_batches(late, whole, "inserted_at", calendar, 2500)
    assert rows(log) == rows(want) and log.agg(F.max("total_moved")).first()[0] == 7000
    assert p.reconcile(late, spark.read.parquet(path), ["hash"]).first()["passed"]
    assert spark.read.parquet(path).where("p_day is null").count() == late.where("inserted_at < timestamp_ntz'1971-01-01 00:00:00'").count() > 0
    assert rows(p.migrate_in_batches(late, path, "inserted_at", calendar, 2500)) == rows(want)  # nothing is left
    # rows that came since make their partition move again
    more = late.unionByName(late.where("number = 4007").withColumn("hash", F.lit("new")).withColumn("number", F.lit(99_999).cast(dict(late.dtypes)["number"])))
    p.migrate_in_batches(more, path, "inserted_at", calendar, 2500)
    assert p.reconcile(more, spark.read.parquet(path), ["hash"]).first()["passed"]
    with pytest.raises(PySparkException):
        p.migrate_in_batches(blocks.withColumn("inserted_at", F.lit(None).cast("timestamp_ntz")), scratch_path(spark, "t-null"), "inserted_at", calendar)


CONFIG = "parent_table string, partition_interval string, premake int, retention string, automatic_maintenance string, retention_keep_table boolean, infinite_time_partitions boolean"


def halves(spark, blocks, name):
    path = scratch_path(spark, name)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    files.with_partition(blocks, "inserted_at", "12 hours").write.option("path", path).partitionBy("p_day").saveAsTable(name)
    return path


def test_half_day_folders_are_maintained_and_the_run_is_stored(spark, blocks):
    path, name, store = halves(spark, blocks, "t_halves"), "t_halves", scratch_path(spark, "t-config")
    kept = blocks.where(F.col("inserted_at") >= p.ntz(p.first_kept(EVENING, "1 day", "12 hours"))).count()
    p.write_config(spark.createDataFrame([("a", "12 hours", 3, "1 day", "on", False, True), ("off", "1 day", 1, "1 day", "off", False, True)], CONFIG), store)
    first = p.maintain_registered(spark, store, {"a": name}, EVENING).first()
    assert first["created"] > 0 and first["dropped"] > 0 and spark.table(name).count() == kept
    assert spark.read.parquet(path).count() == kept  # the folders are gone as well
    again = p.maintain_registered(spark, store, {"a": name}, EVENING).first()
    assert (again["created"], again["dropped"], again["partition_count"]) == (0, 0, first["partition_count"])
    ages = {r["parent_table"]: r for r in p.maintenance_age(p.read_config(spark, store), EVENING, null_as_zero=False).collect()}
    assert ages["a"]["seconds_since_maintenance"] == 0 and ages["off"]["seconds_since_maintenance"] is None
    assert "maintenance_last_run" not in p.read_config(spark, store, 1).columns  # older versions stay
    spark.sql(f"DROP TABLE {name}")


def test_kept_tables_leave_the_catalog_only(spark, blocks):
    path, name = halves(spark, blocks, "t_kept"), "t_kept"
    all_rows, config = spark.read.parquet(path).count(), spark.createDataFrame([("a", "12 hours", 0, "1 day", "on", True, True)], CONFIG)
    assert p.run_maintenance(spark, config, {"a": name}, EVENING).first()["dropped"] > 0
    assert spark.table(name).count() < all_rows == spark.read.parquet(path).count()
    spark.sql(f"DROP TABLE {name}")
    files.with_partition(blocks, "inserted_at", "12 hours").write.partitionBy("p_day").saveAsTable("t_managed")
    with pytest.raises(ValueError, match="not external"):
        p.run_maintenance(spark, config, {"a": "t_managed"}, EVENING)
    spark.sql("DROP TABLE t_managed")


def test_idle_parents_get_no_new_partitions(spark):
    none = spark.createDataFrame([], "parent_table string, partition_name string, lo timestamp_ntz, hi timestamp_ntz")
    config = spark.createDataFrame([("a", "1 day", 2, "90 days", False), ("b", "1 day", 2, "90 days", True)], "parent_table string, partition_interval string, premake int, retention string, infinite_time_partitions boolean")
    config = config.withColumn("newest", F.lit("2025-01-01 05:00:00").cast("timestamp_ntz"))
    last = {r["parent_table"]: r["hi"] for r in p.maintained_partitions(config, none, EVENING).groupBy("parent_table").agg(F.max("hi").alias("hi")).collect()}
    assert last["a"] == datetime(2025, 1, 4) and last["b"] > datetime(2025, 3, 1)
