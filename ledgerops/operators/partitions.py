"""Partition calendars, migration plans, retention and maintenance."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerops.functions.scalars import duration_seconds, flag
from ledgerops.functions.times import (
    age_seconds, as_datetime, from_micros, micros, ntz, to_micros, to_timedelta,
)
from ledgerops.operators.ordered import OrderedRows, unfold
from ledgerops.session import cut
from ledgerops.sources.files import DAY, committed, interval_start, remove_folder, with_partition, write_partitioned

_EPOCH = datetime(1970, 1, 1)
DEFAULT = "default"


def _floor(at: datetime, width: timedelta) -> datetime:
    return at - (at - _EPOCH) % width


#: Microseconds of a day.
DAY_US = 86_400_000_000


@dataclass(frozen=True)
class Calendar:
    """Half-open intervals ``[lo, hi)`` of one parent; arithmetic, so no join assigns a row."""

    parent: str
    first: datetime
    stop: datetime  # upper bound of the last interval
    interval: timedelta

    def __len__(self) -> int:
        return max(0, (self.stop - self.first) // self.interval)

    def name(self, lo: Column) -> Column:
        fmt = "yyyyMMdd" if self.interval % timedelta(days=1) == timedelta(0) else "yyyyMMdd_HHmmss"
        return F.concat(F.lit(f"{self.parent}_p"), F.date_format(lo, fmt))

    def lo(self, control: Column | str) -> Column:
        return interval_start(control, self.interval)

    def covers(self, control: Column | str) -> Column:
        c = F.col(control) if isinstance(control, str) else control
        return (c >= ntz(self.first)) & (c < ntz(self.stop))

    def frame(self, spark: SparkSession) -> DataFrame:
        width = to_micros(self.interval)
        lo = F.timestamp_add("MICROSECOND", F.col("id") * F.lit(width), ntz(self.first))
        return (
            spark.range(len(self))
            .select(lo.alias("lo"))
            .select(
                F.lit(self.parent).alias("parent_table"),
                self.name(F.col("lo")).alias("partition_name"),
                "lo",
                F.timestamp_add("MICROSECOND", F.lit(width), F.col("lo")).alias("hi"),
            )
        )


def partition_calendar(parent: str, start, as_of, interval="1 day", premake: int = 7) -> Calendar:
    """Intervals from the one holding ``start`` to ``premake`` after the one holding ``as_of``."""
    width = to_timedelta(interval)
    first = _floor(as_datetime(start), width)
    stop = _floor(as_datetime(as_of), width) + (premake + 1) * width
    return Calendar(parent, first, max(first, stop), width)


def calendar_of(df: DataFrame, parent: str, control: str, as_of, interval="1 day", premake: int = 7) -> Calendar:
    """Calendar that starts at the oldest row."""
    oldest = df.agg(F.min(control)).first()[0]
    return partition_calendar(parent, oldest or as_of, as_of, interval, premake)


def assign_partition(df: DataFrame, control: str, calendar: Calendar, on_null: str = "raise") -> DataFrame:
    """Add ``partition_name``: the interval holding the row, else ``default``.

    A null control is an error row: it fails the job, or with ``on_null='reject'``
    gets the name ``rejected``.
    """
    null = F.lit("rejected") if on_null == "reject" else F.raise_error(F.lit(f"{control} is null"))
    name = (
        F.when(F.col(control).isNull(), null)
        .when(calendar.covers(control), calendar.name(calendar.lo(control)))
        .otherwise(F.lit(DEFAULT))
    )
    return df.withColumn("partition_name", name)


def register_config(existing: DataFrame, desired: DataFrame, updates: dict[str, Column]) -> DataFrame:
    """Add the desired parents that are absent, then set the update fields on the desired ones."""
    added = desired.join(existing, "parent_table", "left_anti")
    merged = existing.unionByName(added, allowMissingColumns=True)
    wanted = desired.select("parent_table").distinct().withColumn("_wanted", F.lit(True))
    merged = merged.join(wanted, "parent_table", "left")
    for name, value in updates.items():
        old = F.col(name) if name in existing.columns or name in desired.columns else F.lit(None)
        merged = merged.withColumn(name, F.when(F.col("_wanted"), value).otherwise(old))
    return merged.drop("_wanted")


def migration_plan(
    tables: list[tuple[str, DataFrame, str]], interval="1 day", batch_rows: int = 50_000
) -> DataFrame:
    """One progress row per batch, tables in the given (dependency) order.

    Only the row count of each interval is needed: batch sizes and running totals
    follow from it, so no row is sorted. The window runs over intervals, not rows.
    """
    per_day = None
    for ord_, (name, df, control) in enumerate(tables, start=1):
        part = (
            df.select(F.col(control).alias("_c"))
            .groupBy(interval_start("_c", interval).alias("lo"))
            .agg(F.count(F.lit(1)).alias("rows"))
            .select(F.lit(ord_).alias("table_ord"), F.lit(name).alias("table_name"), "lo", "rows")
        )
        per_day = part if per_day is None else per_day.unionByName(part)
    before = W.partitionBy("table_ord").orderBy("lo").rowsBetween(W.unboundedPreceding, -1)
    batches = F.ceil(F.col("rows") / F.lit(float(batch_rows))).cast("bigint")
    days = per_day.withColumn("batches", batches).withColumns(
        {
            "rows_before": F.coalesce(F.sum("rows").over(before), F.lit(0)),
            "batches_before": F.coalesce(F.sum("batches").over(before), F.lit(0)),
        }
    )
    b = F.col("b")
    moved = F.least(b * batch_rows, F.col("rows"))
    return (
        unfold(days.withColumn("first", F.lit(1).cast("bigint")), "first", "batches", "b")
        .select(
            "table_ord",
            "table_name",
            "lo",
            (F.col("batches_before") + b).alias("batch_no"),
            (moved - (b - 1) * batch_rows).alias("rows_moved"),
            (F.col("rows_before") + moved).alias("total_moved"),
        )
        .withColumn("log_line", F.col("batch_no") % 10 == 0)
    )


def assign_batches(df: DataFrame, control: str, keys: list[str], batch_rows: int, interval="1 day") -> DataFrame:
    """Add the interval start ``lo`` and ``batch``: rows of one interval cut in (control, keys) order."""
    rows = df.withColumn("lo", interval_start(control, interval))
    ranked = OrderedRows.of(rows, ["lo"], [control, *keys]).running_sum(_n=F.lit(1).cast("bigint"))
    return ranked.with_column("batch", F.ceil(F.col("_n") / F.lit(float(batch_rows))).cast("bigint")).rows.drop("_n")


def migrate(df: DataFrame, path: str, control: str, calendar: Calendar, batch_rows: int = 50_000) -> DataFrame:
    """Write all rows into their partitions, and return the progress rows.

    Rows outside the calendar go to the null partition folder, the default partition.
    A null control fails the job.
    """
    inside = with_partition(df, control, calendar.interval)
    null = F.raise_error(F.lit(f"{control} is null"))
    place = F.when(F.col(control).isNull(), null).when(calendar.covers(control), F.col(DAY))
    inside = inside.withColumn(DAY, place)
    rows = inside.hint("rebalance", F.col(DAY)).sortWithinPartitions(DAY, control)
    rows.write.mode("overwrite").partitionBy(DAY).parquet(path)
    return migration_plan([(calendar.parent, df, control)], calendar.interval, batch_rows)


LEDGER = "_ledger"
_LEDGER_SCHEMA = "seq bigint, batch bigint, p_day string, rows_moved bigint"


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    """The newest ledger row of each partition that has been moved."""
    rows = spark.read.schema(_LEDGER_SCHEMA).option("ignoreMissingFiles", "true").parquet(path)
    return rows.groupBy("p_day").agg(F.max_by(F.struct(*rows.columns), "seq").alias("r")).select("r.*")


def migrate_in_batches(
    df: DataFrame, path: str, control: str, calendar: Calendar, batch_rows: int = 50_000_000, stop_after: int | None = None
) -> DataFrame:
    """Move rows into their partitions one batch at a time until none is left, and return the progress log.

    A batch is a run of whole partitions of about ``batch_rows`` rows; rows outside the calendar are the last one and go to the default partition.
    Each batch replaces its partitions and then commits a ledger row per partition beside the data (``_ledger``, which table reads skip), with
    the rows counted from what was written. A run that was stopped (``stop_after`` batches, or anyhow) goes on with the first partition the
    ledger lacks; a batch whose commit is missing is written again. A partition whose source has gained rows since is moved again. A null control fails the job.
    """
    spark, width = df.sparkSession, to_micros(calendar.interval)
    null = F.raise_error(F.lit(f"{control} is null"))
    inside = with_partition(df, control, calendar.interval)
    inside = inside.withColumn(DAY, F.when(F.col(control).isNull(), null).when(calendar.covers(control), F.col(DAY)))
    # one count per partition: as many rows as the calendar has partitions
    counts = inside.groupBy(DAY).agg(F.count(F.lit(1)).alias("n")).collect()
    counts.sort(key=lambda r: (r[DAY] is None, str(r[DAY])))
    ledger = f"{path}/{LEDGER}"
    spark.createDataFrame([], _LEDGER_SCHEMA).write.mode("append").parquet(ledger)
    moved = {r["p_day"]: r for r in _ledger(spark, ledger).collect()}
    batches: dict[int, list] = {}
    before = 0
    for r in counts:
        key = None if r[DAY] is None else str(r[DAY])
        batch = before // batch_rows if r[DAY] is not None else -1
        if key not in moved or moved[key]["rows_moved"] != r["n"]:
            batches.setdefault(batch, []).append(r[DAY])
        before += r["n"]
    outside = batches.pop(-1, None)
    # rows outside the calendar come last, whatever number that is by now
    order = [*sorted(batches.items()), *([(max(1, -(-before // batch_rows)), outside)] if outside is not None else [])]
    seq = max([r["seq"] for r in moved.values()], default=0)
    for batch, places in order if stop_after is None else order[:stop_after]:
        if places == [None]:
            rows = inside.where(F.col(DAY).isNull())
        else:
            lo, hi = as_datetime(str(min(places))), as_datetime(str(max(places))) + timedelta(microseconds=width)
            rows = inside.where((F.col(control) >= ntz(lo)) & (F.col(control) < ntz(hi)) & F.col(DAY).isin(places))
        rows = rows.hint("rebalance", F.col(DAY)).sortWithinPartitions(DAY, control)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)
        stored = spark.read.schema(rows.schema).parquet(path)
        here = stored.where(F.col(DAY).isNull() if places == [None] else F.col(DAY).isin(places))
        written = here.groupBy(DAY).agg(F.count(F.lit(1)).alias("rows_moved"))
        seq += 1
        entry = written.select(F.lit(seq).cast("bigint").alias("seq"), F.lit(batch).cast("bigint").alias("batch"), F.col(DAY).cast("string").alias("p_day"), "rows_moved")
        entry.coalesce(1).write.mode("append").parquet(ledger)
    return migration_log(spark, path)


def migration_log(spark: SparkSession, path: str) -> DataFrame:
    """(batch_no, first_day, last_day, rows_moved, total_moved, log_line) of a table that ``migrate_in_batches`` writes, from its ledger."""
    per_batch = _ledger(spark, f"{path}/{LEDGER}").groupBy("batch").agg(
        F.min("p_day").alias("first_day"), F.max("p_day").alias("last_day"), F.sum("rows_moved").alias("rows_moved")
    )
    # one row per batch; the window runs over those
    order = W.orderBy("batch")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    log = per_batch.select(
        F.row_number().over(order).cast("bigint").alias("batch_no"), "first_day", "last_day", "rows_moved", F.sum("rows_moved").over(upto).alias("total_moved")
    )
    return log.withColumn("log_line", F.col("batch_no") % 10 == 0)


def reconcile(src: DataFrame, dst: DataFrame, keys: list[str]) -> DataFrame:
    """One row: counts of both sides, difference, keyed difference, verdict.

    Both sides are counted per key before they meet, so repeated keys cost one row.
    """
    tagged = src.select(*keys, F.lit(1).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("d")).unionByName(
        dst.select(*keys, F.lit(0).cast("bigint").alias("s"), F.lit(1).cast("bigint").alias("d"))
    )
    per_key = tagged.groupBy(*keys).agg(F.sum("s").alias("s"), F.sum("d").alias("d"))
    zero = F.lit(0).cast("bigint")
    sums = per_key.agg(
        F.coalesce(F.sum("s"), zero).alias("source_rows"),
        F.coalesce(F.sum("d"), zero).alias("target_rows"),
        F.coalesce(F.sum(F.greatest(F.col("s") - F.col("d"), zero)), zero).alias("missing_rows"),
        F.coalesce(F.sum(F.greatest(F.col("d") - F.col("s"), zero)), zero).alias("surplus_rows"),
    )
    return sums.withColumn("difference", F.col("source_rows") - F.col("target_rows")).withColumn(
        "passed", (F.col("missing_rows") == 0) & (F.col("surplus_rows") == 0)
    )


def default_partition_rows(parents: list[tuple[DataFrame, str, Calendar]]) -> DataFrame:
    """Rows outside the calendar, per parent."""
    out = None
    for df, control, calendar in parents:
        outside = F.count(F.when(~calendar.covers(control), 1))
        part = df.agg(outside.alias("default_rows")).select(
            F.lit(calendar.parent).alias("parent_table"), "default_rows"
        )
        out = part if out is None else out.unionByName(part)
    return out


def check_default(tables: dict[str, tuple[DataFrame, str]], config: DataFrame, as_of) -> DataFrame:
    """Default-partition rows of every registered parent.

    The calendar of each parent follows from its config row: kept back to
    ``retention`` and made ahead by ``premake`` intervals.
    """
    rows = config.select(
        "parent_table",
        duration_seconds("partition_interval").alias("width"),
        "premake",
        duration_seconds("retention").alias("keep"),
    ).where(F.col("parent_table").isin(*tables))
    parents = []
    for r in rows.collect():  # one row per registered parent table named by the caller
        df, control = tables[r["parent_table"]]
        width = timedelta(seconds=r["width"])
        start = as_datetime(as_of) - timedelta(seconds=r["keep"])
        parents.append((df, control, partition_calendar(r["parent_table"], start, as_of, width, r["premake"])))
    return default_partition_rows(parents)


def partition_counts(config: DataFrame, partitions: DataFrame, how: str = "left") -> DataFrame:
    """Partitions per parent: ``left`` keeps childless parents with 0, ``inner`` drops them."""
    children = partitions.groupBy("parent_table").agg(F.count("partition_name").alias("partition_count"))
    joined = config.select("parent_table").join(children, "parent_table", how)
    return joined.select(
        "parent_table", F.coalesce("partition_count", F.lit(0).cast("bigint")).alias("partition_count")
    )


def cutoff(as_of, retention) -> datetime:
    return as_datetime(as_of) - to_timedelta(retention)


def retention_candidates(partitions: DataFrame, as_of, retention) -> DataFrame:
    """Dry run: partitions whose upper bound is not after the cutoff."""
    return partitions.where(F.col("hi") <= ntz(cutoff(as_of, retention))).withColumn(
        "status", F.lit("would be dropped")
    )


def first_kept(as_of, retention, interval="1 day") -> datetime:
    """Lower bound of the oldest interval that ends after the cutoff."""
    return _floor(cutoff(as_of, retention), to_timedelta(interval))


def apply_retention(
    df: DataFrame, control: str, as_of, retention, interval="1 day", calendar: Calendar | None = None
) -> DataFrame:
    """Rows of the intervals that stay; one range predicate, pushed to the scan.

    Rows outside ``calendar`` are the default partition, which retention never drops; without a
    calendar every row counts as inside one. In a table read with its folder column, the null
    folder is the default partition too, and whole folders are pruned. A null control stays with a
    calendar, as it lies in no interval.
    """
    edge = first_kept(as_of, retention, interval)
    keep = F.col(control) >= ntz(edge)
    if calendar is not None:
        keep = keep | ~F.coalesce(calendar.covers(control), F.lit(False))
    if DAY in df.columns:
        edge_day = ntz(edge).cast(df.schema[DAY].dataType)
        keep = F.col(DAY).isNull() | ((F.col(DAY) >= edge_day) & keep) if calendar is None else F.col(DAY).isNull() | keep
    return df.where(keep)


def _folder_times(spark: SparkSession, table: str) -> dict[datetime, str]:
    """Start and folder value of each partition of a catalog table, the default one left out."""
    values = [unquote(r[0].split("=", 1)[1]) for r in spark.sql(f"SHOW PARTITIONS {table}").collect()]
    return {datetime.fromisoformat(v): v for v in values if v[:4].isdigit()}


def _partition_spec(at: datetime, kind: T.DataType) -> str:
    if isinstance(kind, T.DateType):
        return f"PARTITION ({DAY} = DATE '{at.date().isoformat()}')"
    return f"PARTITION ({DAY} = TIMESTAMP_NTZ '{at.isoformat(sep=' ')}')"


def _alter(spark: SparkSession, table: str, verb: str, times: list[datetime]) -> None:
    """One statement that adds or drops all the given partitions."""
    if times:
        kind = spark.table(table).schema[DAY].dataType
        between = " " if verb.startswith("ADD") else ", "
        spark.sql(f"ALTER TABLE {table} {verb} {between.join(_partition_spec(at, kind) for at in sorted(times))}")


def _forget(spark: SparkSession, table: str, times: list[datetime], keep_files: bool) -> None:
    """Take partitions off a catalog table; their folders stay where ``keep_files`` is set, else they go too."""
    if not times:
        return
    facts = {r[0]: r[1] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect() if r[0] in ("Type", "Location")}
    if keep_files and facts["Type"] != "EXTERNAL":
        raise ValueError(f"{table} is not external: dropping its partitions would delete the files that are to be kept")
    folders = [f"{facts['Location']}/{DAY}={v}" for v in _stored_names(spark, table, times)]
    _alter(spark, table, "DROP IF EXISTS", times)
    if not keep_files and facts["Type"] == "EXTERNAL":
        # the catalog forgets an external partition, but leaves its folder
        for folder in folders:
            remove_folder(spark, folder)


def _stored_names(spark: SparkSession, table: str, times: list[datetime]) -> list[str]:
    """Folder values as they are spelt on disk, where colons are escaped."""
    values = [r[0].split("=", 1)[1] for r in spark.sql(f"SHOW PARTITIONS {table}").collect()]
    return [v for v in values if v[:4].isdigit() and datetime.fromisoformat(unquote(v)) in set(times)]


def drop_partitions(spark: SparkSession, table: str, as_of, retention, interval="1 day", keep_files: bool = False) -> list[str]:
    """Drop the expired partitions of a catalog table in one statement, and return their folder values: metadata and folders, no rewrite.

    With ``keep_files`` an external table forgets the partitions, and their folders stay.
    """
    edge = first_kept(as_of, retention, interval)
    gone = {at: v for at, v in _folder_times(spark, table).items() if at < edge}
    _forget(spark, table, list(gone), keep_files)
    return [gone[at] for at in sorted(gone)]


def retention_check(before: DataFrame, after: DataFrame, control: str, keys: list[str], as_of, retention) -> DataFrame:
    """Nothing younger than the cutoff may be lost; compared with the state before."""
    young = F.when(F.col(control) > ntz(cutoff(as_of, retention)), 1).otherwise(0).cast("bigint")
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    tagged = before.select(*keys, young.alias("y"), zero.alias("a")).unionByName(
        after.select(*keys, zero.alias("y"), one.alias("a"))
    )
    per_key = tagged.groupBy(*keys).agg(F.sum("y").alias("y"), F.sum("a").alias("a"))
    sums = per_key.agg(
        F.coalesce(F.sum("a"), zero).alias("rows_kept"),
        F.coalesce(F.sum("y"), zero).alias("rows_expected"),
        F.coalesce(F.sum(F.greatest(F.col("y") - F.col("a"), zero)), zero).alias("young_lost"),
    )
    return sums.withColumn(
        "passed", (F.col("rows_kept") >= F.col("rows_expected")) & (F.col("young_lost") == 0)
    )


def config_status(config: DataFrame) -> DataFrame:
    """Configuration as numbers: flags as 0/1, retention in seconds."""
    return config.select(
        "parent_table",
        flag("automatic_maintenance", "on").alias("automatic_maintenance"),
        "premake",
        duration_seconds("retention").alias("retention_seconds"),
        flag("infinite_time_partitions").alias("infinite_time_partitions"),
    )


def maintenance_age(config: DataFrame, as_of, limit_s: float = 7200, null_as_zero: bool = True) -> DataFrame:
    """Seconds since the last maintenance and whether that is too long ago."""
    age = age_seconds("maintenance_last_run", as_of, null_as_zero)
    return config.select("parent_table", age.alias("seconds_since_maintenance")).withColumn(
        "overdue", F.col("seconds_since_maintenance") > limit_s
    )


def maintained_partitions(config: DataFrame, partitions: DataFrame, as_of) -> DataFrame:
    """Every partition with what maintenance does to it: ``kept``, ``created`` or ``dropped``.

    Where the configuration has ``automatic_maintenance``, parents without ``on`` keep their partitions as they are. Where it has
    ``infinite_time_partitions`` and ``newest`` (time of the newest row), a parent whose flag is not set gets partitions ahead of its newest row, not of
    ``as_of``, so that a table without new rows gets no new partitions; without a newest row it counts from ``as_of``.
    """
    now = ntz(as_of)
    if "automatic_maintenance" in config.columns:
        config = config.where("automatic_maintenance = 'on'")
    at = micros(now)
    ahead = at
    if {"infinite_time_partitions", "newest"} <= set(config.columns):
        idle = ~F.coalesce(F.col("infinite_time_partitions"), F.lit(False))
        ahead = F.when(idle, F.least(at, F.coalesce(micros("newest"), at))).otherwise(at)
    cfg = config.select(
        "parent_table",
        (duration_seconds("partition_interval") * 1_000_000).alias("width"),
        "premake",
        (duration_seconds("retention") * 1_000_000).alias("keep"),
        ahead.alias("ahead"),
    )
    first = F.col("ahead") - F.pmod(F.col("ahead"), F.col("width"))
    wanted = cfg.select(
        "parent_table",
        "width",
        F.explode(F.sequence(first, first + F.col("premake") * F.col("width"), F.col("width"))).alias("lo_us"),
    ).select(
        "parent_table",
        F.concat("parent_table", F.lit("_p"), F.date_format(from_micros(F.col("lo_us")), "yyyyMMdd"), F.when(
            F.col("width") % DAY_US != 0, F.date_format(from_micros(F.col("lo_us")), "_HHmmss")).otherwise("")).alias("partition_name"),
        from_micros(F.col("lo_us")).alias("lo"),
        from_micros(F.col("lo_us") + F.col("width")).alias("hi"),
    )
    created = wanted.join(partitions, ["parent_table", "lo"], "left_anti").withColumn("action", F.lit("created"))
    edge = from_micros(at - F.col("keep"))
    present = partitions.join(cfg, "parent_table", "left").select(
        *wanted.columns, F.when(F.col("hi") <= edge, "dropped").otherwise("kept").alias("action")
    )
    return present.unionByName(created)


def maintenance_report(config: DataFrame, partitions: DataFrame, default_rows: DataFrame, as_of) -> DataFrame:
    """One row per parent: partitions created, dropped and left, and rows in the default one."""
    done = maintained_partitions(config, partitions, as_of).groupBy("parent_table").agg(
        F.count(F.when(F.col("action") == "created", 1)).alias("created"),
        F.count(F.when(F.col("action") == "dropped", 1)).alias("dropped"),
        F.count(F.when(F.col("action") != "dropped", 1)).alias("partition_count"),
    )
    zero = F.lit(0).cast("bigint")
    return (
        config.select("parent_table")
        .join(done, "parent_table", "left")
        .join(default_rows, "parent_table", "left")
        .select(
            "parent_table",
            *[F.coalesce(c, zero).alias(c) for c in ("created", "dropped", "partition_count", "default_rows")],
        )
    )


def run_maintenance(spark: SparkSession, config: DataFrame, tables: dict[str, str], as_of) -> DataFrame:
    """Maintain catalog tables: premake and drop partitions, then report what changed.

    ``tables`` maps the parent name to its catalog table, whose folders start at multiples of the parent's interval (dates for whole days, else times). One
    statement adds and one drops the folders of a parent; they are listed again afterwards, so running it twice reports nothing more.
    Columns of the configuration that are read where they are there: ``automatic_maintenance`` (parents without ``on`` are left alone),
    ``retention_keep_table`` (expired partitions leave an external table, their files stay) and ``infinite_time_partitions`` (see ``maintained_partitions``).
    """
    config = config.where(F.col("parent_table").isin(*tables))
    width = duration_seconds("partition_interval") * 1_000_000
    # one row per registered parent
    cfg = {r["parent_table"]: r.asDict() for r in config.withColumn("width", width).collect()}
    for parent, r in cfg.items():
        daily = isinstance(spark.table(tables[parent]).schema[DAY].dataType, T.DateType)
        if not r["width"] or (daily and r["width"] % DAY_US):
            raise ValueError(f"{parent}: folders are days, so the interval must be whole days")

    before = {p: _folder_times(spark, tables[p]) for p in cfg}
    present = spark.createDataFrame([(p, at) for p, times in before.items() for at in times], "parent_table string, lo timestamp_ntz")
    present = present.join(config.select("parent_table", width.alias("width")), "parent_table").select(
        "parent_table",
        F.concat("parent_table", F.lit("_p"), F.date_format("lo", "yyyyMMdd_HHmmss")).alias("partition_name"),
        "lo",
        from_micros(micros("lo") + F.col("width")).alias("hi"),
    )
    if "infinite_time_partitions" in config.columns:
        # the newest folder with rows: a scan of the partition column alone
        newest = [(p, spark.table(tables[p]).agg(F.max(F.col(DAY)).cast("timestamp_ntz")).first()[0]) for p in cfg]
        config = config.join(spark.createDataFrame(newest, "parent_table string, newest timestamp_ntz"), "parent_table")
    todo: dict[tuple[str, str], list[datetime]] = {}
    for r in maintained_partitions(config, present, as_of).where("action <> 'kept'").select("parent_table", "lo", "action").collect():
        todo.setdefault((r["parent_table"], r["action"]), []).append(r["lo"])
    for (parent, action), times in todo.items():
        if action == "created":
            _alter(spark, tables[parent], "ADD IF NOT EXISTS", times)
        else:
            _forget(spark, tables[parent], times, bool(cfg[parent].get("retention_keep_table")))
    after = {p: _folder_times(spark, tables[p]) for p in cfg}
    defaults = None
    for parent in cfg:
        part = spark.table(tables[parent]).where(F.col(DAY).isNull()).agg(F.count(F.lit(1)).alias("default_rows"))
        part = part.select(F.lit(parent).alias("parent_table"), "default_rows")
        defaults = part if defaults is None else defaults.unionByName(part)
    done = spark.createDataFrame(
        [(p, len(after[p].keys() - before[p].keys()), len(before[p].keys() - after[p].keys()), len(after[p])) for p in cfg],
        "parent_table string, created bigint, dropped bigint, partition_count bigint",
    )
    if defaults is None:
        return done.withColumn("default_rows", F.lit(0).cast("bigint"))
    return done.join(defaults, "parent_table")


def write_config(config: DataFrame, path: str) -> int:
    """Store the configuration (a row per parent) as a new version at ``path``, and return its number; older versions stay."""
    spark = config.sparkSession
    version = 1 + max([int(n.split("-")[1]) for n in committed(spark, path) if n.startswith("version-")], default=0)
    config.coalesce(1).write.mode("overwrite").parquet(f"{path}/version-{version:09d}")
    return version


def read_config(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest committed version of a stored configuration, or the given one."""
    found = [n for n in committed(spark, path) if n.startswith("version-")]
    if not found:
        raise ValueError(f"no configuration is stored at {path}")
    return spark.read.parquet(f"{path}/{found[-1] if version is None else f'version-{version:09d}'}")


def maintain_registered(spark: SparkSession, path: str, tables: dict[str, str], as_of) -> DataFrame:
    """``run_maintenance`` with the stored configuration, which then gets a version whose maintained parents have ``as_of`` as ``maintenance_last_run``.

    A run that stops before that version is committed shows as overdue (``maintenance_age``); the next one changes no partition twice.
    """
    config = read_config(spark, path)
    report = cut(run_maintenance(spark, config, tables, as_of))
    ran = F.col("parent_table").isin(*tables)
    if "automatic_maintenance" in config.columns:
        ran = ran & (F.col("automatic_maintenance") == "on")
    before = F.col("maintenance_last_run") if "maintenance_last_run" in config.columns else F.lit(None).cast("timestamp_ntz")
    write_config(config.withColumn("maintenance_last_run", F.when(ran, ntz(as_of)).otherwise(before)), path)
    return report


def partition_sizes(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows, files and bytes per partition of a stored table, newest first."""
    per_file = df.groupBy(DAY, F.col("_metadata.file_path").alias("file")).agg(
        F.count(F.lit(1)).alias("rows"), F.max("_metadata.file_size").alias("bytes")
    )
    out = per_file.groupBy(DAY).agg(
        F.sum("rows").alias("rows"), F.count("file").alias("files"), F.sum("bytes").alias("bytes")
    ).orderBy(F.col(DAY).desc_nulls_last())
    return out.limit(limit) if limit else out


def latest_backup(backups: DataFrame, as_of) -> DataFrame:
    """The newest completed backup not after ``as_of``."""
    done = backups.where((F.col("phase") == "completed") & (F.col("completed") <= ntz(as_of)))
    return done.orderBy(F.col("completed").desc(), F.col("name").desc()).limit(1)


def expired_backups(backups: DataFrame, as_of, keep) -> DataFrame:
    """Completed backups that ended at or before ``as_of - keep``."""
    return backups.where((F.col("phase") == "completed") & (F.col("completed") <= ntz(cutoff(as_of, keep))))
