"""Starting streams and writing their results, safely repeatable per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerops.operators.ordered import unfold
from ledgerops.operators.partitions import Calendar
from ledgerops.sources.files import DAY, committed, remove_folder, with_partition

BATCH = "batch_id"


def read_files(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """A stream of landed Parquet files."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def to_parquet(df: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None) -> StreamingQuery:
    """Append a stream to Parquet files, each row once, until the present input is done."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.trigger(availableNow=True).start(path)


def _overwrite_batch(rows: DataFrame, batch_id: int, path: str) -> None:
    """Write one micro-batch into its own folders; writing it again replaces them."""
    rows.withColumn(BATCH, F.lit(batch_id)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(DAY, BATCH).parquet(path)


def _table_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(target) and len(fs.listStatus(target)) > 0


def ingest_batch(rows: DataFrame, batch_id: int, path: str, keys: list[str], control: str) -> None:
    """Add the rows of one batch whose key the table does not hold yet.

    Only the days the batch touches are read back. Rows an earlier attempt of the same
    batch wrote do not count as present, so a repeated batch gives the same table.
    """
    spark = rows.sparkSession
    null = F.raise_error(F.lit(f"{control} is null"))
    rows = rows.withColumn(control, F.when(F.col(control).isNull(), null).otherwise(F.col(control)))
    # of copies, the one with the least values stays, whatever order they come in
    rest = [f.name for f in rows.schema if f.name != control and "map" not in f.dataType.simpleString()]
    copies = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min_by(F.struct(*rows.columns), F.struct(control, *rest)).alias("row"))
    fresh = with_partition(copies.select("row.*"), control)
    if _table_exists(spark, path):
        days = [r[0] for r in fresh.select(DAY).distinct().collect()]  # days of one micro-batch
        # files of the pinned folders only: the schema is known, nothing is inferred
        present = spark.read.schema(fresh.withColumn(BATCH, F.lit(0)).schema).parquet(path)
        present = present.where(F.col(DAY).isin(days) & (F.col(BATCH) != batch_id)).select(*keys)
        fresh = fresh.join(present, keys, "left_anti")
    _overwrite_batch(fresh.hint("rebalance", F.col(DAY)), batch_id, path)


def ingest_stream(df: DataFrame, path: str, keys: list[str], control: str, checkpoint: str) -> StreamingQuery:
    """Realtime ingest into a daily partitioned table, once per record key and day."""
    return (
        df.writeStream.foreachBatch(lambda rows, batch_id: ingest_batch(rows, batch_id, path, keys, control))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def catch_up(source: DataFrame, number: str, ranges: DataFrame) -> DataFrame:
    """Source rows whose number lies in a missing range: the rows a catch-up job adds.

    Ranges unfold to the missing numbers, spread over the cluster, and meet the source
    in an equi semi join.
    """
    return source.join(unfold(ranges, "lo", "hi", number).select(number), number, "left_semi")


def partitioned_sink(df: DataFrame, control: str, calendar: Calendar, path: str, checkpoint: str) -> StreamingQuery:
    """Rows inside the calendar to daily folders, all others to the default (null) folder.

    The split is a plain column, made before any stateful operator could drop a late row.
    """
    at = F.col(control).cast("timestamp_ntz")
    routed = df.withColumn(DAY, F.when(calendar.covers(at), F.to_date(at)))
    return to_parquet(routed, path, checkpoint, [DAY])


#: So many committed runs of partial sums are folded into one of the next level.
FOLD = 8


def _run(level: int, n: int) -> str:
    """Folder of run ``n`` of a level: the sums of the batches from n * FOLD ** level on, FOLD ** level of them."""
    return f"run-{level:02d}-{n:012d}"


def _runs(spark: SparkSession, path: str) -> set[tuple[int, int]]:
    names = [name.split("-") for name in committed(spark, path) if name.startswith("run-")]
    return {(int(level), int(n)) for _, level, n in names}


def _covered(run: tuple[int, int], runs: set[tuple[int, int]]) -> bool:
    """Whether a run of a higher level holds the sums of this one."""
    level, n = run
    return any(up > level and n // FOLD ** (up - level) == m for up, m in runs)


def _folded(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(DAY, *by).agg(F.sum("rows").alias("rows"), F.sum("total").alias("total"), F.max("highest").alias("highest"))


def add_stats(partial: DataFrame, batch_id: int, path: str, by: list[str]) -> None:
    """Add the partial sums of one micro-batch to the store at ``path``, and fold runs that are due.

    The store is a log of runs, each written once and committed as a whole. When the last of ``FOLD`` runs of a level is there, they become one run of the
    next level, so that n batches leave at most about 2 * FOLD runs a level and log(n) levels; the runs a fold replaced are deleted one fold later, when readers
    have moved on. A repeated batch finds its run committed, or a run that holds it, and changes nothing; it only ends a fold that was stopped. Batch ids
    count from 0 without gaps, as streams number them: a stream with a new checkpoint needs a new store.
    """
    spark = partial.sparkSession
    runs = _runs(spark, path)
    if (0, batch_id) not in runs and not _covered((0, batch_id), runs):
        partial.sortWithinPartitions(DAY).write.mode("overwrite").parquet(f"{path}/{_run(0, batch_id)}")
        runs.add((0, batch_id))
    level, n = 0, batch_id
    while n % FOLD == FOLD - 1:
        parts = [(level, n - i) for i in range(FOLD)]
        level, n = level + 1, n // FOLD
        if (level, n) not in runs and not _covered((level, n), runs):
            if not runs.issuperset(parts):
                raise ValueError(f"{path} lacks batches of run {n} at level {level}: the store belongs to another stream")
            stored = spark.read.schema(partial.schema).parquet(*[f"{path}/{_run(*r)}" for r in parts])
            _folded(stored, by).select(*partial.columns).sortWithinPartitions(DAY).write.mode("overwrite").parquet(f"{path}/{_run(level, n)}")
            runs.add((level, n))
        for old in [r for r in runs if r[0] == level - 1 and r[1] // FOLD < n and _covered(r, runs)]:
            remove_folder(spark, f"{path}/{_run(*old)}")
            runs.remove(old)


def refresh_stats(df: DataFrame, control: str, path: str, checkpoint: str, value: str, by: list[str]) -> StreamingQuery:
    """Incremental daily statistics in their own store: partial sums per batch, folded as ``add_stats`` says."""

    def add(rows: DataFrame, batch_id: int) -> None:
        partial = with_partition(rows, control).groupBy(DAY, *by).agg(
            F.count(F.lit(1)).alias("rows"), F.sum(value).alias("total"), F.max(value).alias("highest")
        )
        add_stats(partial, batch_id, path, by)

    return (
        df.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_stats(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """Statistics per day from the runs that no other run holds; an error where no batch has been stored."""
    runs = _runs(spark, path)
    live = sorted(r for r in runs if not _covered(r, runs))
    if not live:
        raise ValueError(f"no statistics are stored at {path}")
    return _folded(spark.read.parquet(*[f"{path}/{_run(*r)}" for r in live]), by)
