"""Partitioned writes, appends, exports and landed JSON."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerops.functions.scalars import hex_to_decimal
from ledgerops.functions.times import as_datetime, from_micros, micros, ntz, to_micros

DAY = "p_day"


def committed(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below ``path`` whose write has been committed (they hold ``_SUCCESS``), sorted; none where nothing is stored."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return []
    done = [f.getPath() for f in fs.listStatus(target) if f.isDirectory()]
    return sorted(d.getName() for d in done if fs.exists(jvm.org.apache.hadoop.fs.Path(d, "_SUCCESS")))


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of a stored table, if it is there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of everything below ``path``, hidden files included."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(target).getLength()


def interval_start(control: Column | str, interval: str | timedelta = "1 day") -> Column:
    """Start of the interval a time falls in, counted from 1970-01-01."""
    width = to_micros(interval)
    at = micros(control)
    return from_micros(at - F.pmod(at, F.lit(width)))


def with_partition(df: DataFrame, control: str, interval: str | timedelta = "1 day") -> DataFrame:
    """Add ``p_day``: the date for daily intervals, else the interval's start time."""
    if to_micros(interval) == 86_400_000_000:
        return df.withColumn(DAY, F.to_date(control))
    return df.withColumn(DAY, interval_start(control, interval))


def write_partitioned(
    df: DataFrame,
    path: str,
    control: str,
    interval: str | timedelta = "1 day",
    mode: str = "overwrite",
    sort_by: list[str] | None = None,
) -> str:
    """Write into one folder per interval.

    Rebalancing on the partition column gathers each day into few files, while a
    day that is far larger than the others is split over several tasks. Rows are
    sorted by the control column inside a file, so row-group statistics prune too.
    """
    rows = with_partition(df, control, interval).hint("rebalance", F.col(DAY))
    rows = rows.sortWithinPartitions(DAY, control, *(sort_by or []))
    rows.write.mode(mode).partitionBy(DAY).parquet(path)
    return path


def append_where(src: DataFrame, cond: Column, path: str, partition_by: list[str] | None = None) -> str:
    """Append the rows of ``src`` that satisfy ``cond`` to another table."""
    writer = src.where(cond).write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def export_rows(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Data-only export; CSV carries a header and ISO times."""
    options = {"header": "true", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    df.write.mode("overwrite").options(**(options if fmt == "csv" else {})).format(fmt).save(path)
    return path


def import_rows(spark: SparkSession, path: str, target: str, schema=None, fmt: str = "parquet") -> str:
    """Append exported rows to the table at ``target``."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.options(header="true", timestampNTZFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if schema is not None:
        reader = reader.schema(schema)
    reader.load(path).write.mode("append").parquet(target)
    return target


def tier_split(df: DataFrame, control: str, as_of, hot_days: int = 30) -> DataFrame:
    """Mark rows ``hot`` or ``cold`` by age."""
    edge = ntz(as_datetime(as_of) - timedelta(days=hot_days))
    return df.withColumn("tier", F.when(F.col(control) >= edge, "hot").otherwise("cold"))


def write_tiers(df: DataFrame, control: str, as_of, hot_days: int, hot_path: str, cold_path: str) -> None:
    """Write the two tiers to their own locations, each in daily partitions.

    Two filters over the source instead of one tier column: each write reads only
    the files its time range needs.
    """
    marked = tier_split(df, control, as_of, hot_days)
    for tier, path in (("hot", hot_path), ("cold", cold_path)):
        write_partitioned(marked.where(F.col("tier") == tier), path, control)


def day_bound(df: DataFrame, at) -> Column:
    """A time as a value of the partition column: a date in daily tables, else a time."""
    return ntz(at).cast(df.schema[DAY].dataType)


def read_range(spark: SparkSession, path: str, control: str, lo=None, hi=None, interval=None) -> DataFrame:
    """Rows with ``lo <= control < hi`` of a partitioned table, whatever its interval.

    The bounds on ``p_day`` are implied by the time bounds; stating them lets the scan skip
    whole folders before it opens a file. The folder that holds ``lo`` starts at or before it: its start follows
    from ``interval``, or is looked up among the folders. The null folder is the default
    partition, whose rows lie anywhere, so it is always read.
    """
    df = spark.read.parquet(path)
    day, default = F.col(DAY), F.col(DAY).isNull()
    if lo is not None:
        if isinstance(df.schema[DAY].dataType, T.DateType):
            first = day_bound(df, lo)
        elif interval is not None:
            first = interval_start(ntz(lo), interval).cast(df.schema[DAY].dataType)
        else:
            first = df.where(day <= day_bound(df, lo)).agg(F.max(day).cast("string")).first()[0]
            first = F.lit(first).cast(df.schema[DAY].dataType) if first else None
        if first is not None:
            df = df.where(default | (day >= first))
        df = df.where(F.col(control) >= ntz(lo))
    if hi is not None:
        df = df.where(default | (day <= day_bound(df, hi))).where(F.col(control) < ntz(hi))
    return df


# Landed payload schemas: quantities and hashes arrive as 0x texts.
BLOCK_PAYLOAD = T.StructType(
    [
        T.StructField("number", T.StringType()),
        T.StructField("hash", T.StringType()),
        T.StructField("miner", T.StringType()),
        T.StructField("timestamp", T.StringType()),
    ]
)
LOG_PAYLOAD = T.StructType(
    [
        T.StructField("transactionHash", T.StringType()),
        T.StructField("blockHash", T.StringType()),
        T.StructField("logIndex", T.StringType()),
        T.StructField("address", T.StringType()),
        T.StructField("topics", T.ArrayType(T.StringType())),
        T.StructField("data", T.StringType()),
    ]
)
RECEIPT_PAYLOAD = T.StructType(
    [
        T.StructField("transactionHash", T.StringType()),
        T.StructField("blockHash", T.StringType()),
        T.StructField("blockNumber", T.StringType()),
        T.StructField("from", T.StringType()),
        T.StructField("to", T.StringType()),
        T.StructField("gasUsed", T.StringType()),
        T.StructField("effectiveGasPrice", T.StringType()),
        T.StructField("status", T.StringType()),
    ]
)
_QUANTITIES = {"number", "timestamp", "logIndex", "blockNumber", "gasUsed", "effectiveGasPrice", "status"}
_ADDRESSES = {"miner", "address", "from", "to"}
_CORRUPT = "_corrupt_record"


def read_landed_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Typed rows of landed payloads, one document per line.

    Hex quantities become DECIMAL(38,0), addresses lower case. A line that does not
    parse stays as one row with the text in ``_corrupt_record``.
    """
    with_corrupt = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    raw = (
        spark.read.schema(with_corrupt)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _CORRUPT)
        .json(path)
    )
    columns = []
    for field in schema.fields:
        c = F.col(field.name)
        if field.name in _QUANTITIES:
            c = hex_to_decimal(c)
        elif field.name in _ADDRESSES:
            c = F.lower(c)
        columns.append(c.alias(field.name))
    return raw.select(*columns, _CORRUPT)


def synth_blocks(numbers: DataFrame, n: str, days: int, as_of) -> DataFrame:
    """Deterministic blocks from a column of counters: hash, times and text follow from n."""
    number = F.col(n).cast("bigint")
    at = (ntz(as_of) - F.make_dt_interval((number % days).cast("int"))).cast("timestamp_ntz")
    return numbers.select(
        F.md5(number.cast("string")).alias("hash"),
        number.alias("number"),
        at.alias("timestamp"),
        at.alias("inserted_at"),
        F.lit(True).alias("consensus"),
        F.concat(F.lit("test block "), number.cast("string")).alias("data"),
    )


def counters(spark: SparkSession, n: int) -> DataFrame:
    """1..n, the input of ``synth_blocks`` for a scratch table."""
    return spark.range(1, n + 1).withColumnRenamed("id", "n")


def to_samples(df: DataFrame, query_name: str, labels: list[str], gauges: list[str], as_of) -> DataFrame:
    """Health-query rows as metric samples named ``<query>_<column>``.

    Label columns become the label map, each gauge column one sample row.
    """
    label_map = (
        F.map_from_arrays(
            F.array(*[F.lit(c) for c in labels]),
            F.array(*[F.col(c).cast("string") for c in labels]),
        )
        if labels
        else F.expr("cast(map() as map<string,string>)")
    )
    return (
        df.select(label_map.alias("labels"), *[F.col(g).cast("double").alias(g) for g in gauges])
        .unpivot("labels", gauges, "gauge", "value")
        .select(
            F.concat(F.lit(f"{query_name}_"), "gauge").alias("metric"),
            "labels",
            ntz(as_of).alias("ts"),
            "value",
        )
    )


def union_sources(sources: dict[str, DataFrame], external_labels: dict[str, str]) -> DataFrame:
    """Union of differently shaped sources, each row carrying its source and the fixed labels."""
    out = None
    for name, df in sources.items():
        part = df.withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    for label, value in external_labels.items():
        out = out.withColumn(label, F.lit(value))
    return out


def with_external_labels(samples: DataFrame, external_labels: dict[str, str]) -> DataFrame:
    """Add fixed labels to the label map; a sample's own label of that name wins."""
    fixed = F.map_from_arrays(
        F.array(*[F.lit(k) for k in external_labels]), F.array(*[F.lit(v) for v in external_labels.values()])
    )
    kept = F.map_filter(fixed, lambda k, _: ~F.map_contains_key("labels", k))
    return samples.withColumn("labels", F.map_concat("labels", kept))
