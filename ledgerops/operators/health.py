"""Table-health reports."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerops.functions.scalars import safe_ratio
from ledgerops.functions.times import age_seconds, micros, ntz
from ledgerops.operators.ordered import OrderedRows, positions
from ledgerops.sources.files import stored_bytes


def _stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def data_age(df: DataFrame, control: str, as_of, null_as_zero: bool = True) -> DataFrame:
    """Age of the oldest row in seconds, and the row count."""
    found = df.agg(F.min(control).alias("oldest"), F.count(F.lit(1)).alias("row_count"))
    return found.select(age_seconds("oldest", as_of, null_as_zero).alias("oldest_age_seconds"), "row_count")


def data_ages(tables: dict[str, tuple[DataFrame, str]], as_of) -> DataFrame:
    return _stack([data_age(df, c, as_of).withColumn("table_name", F.lit(n)) for n, (df, c) in tables.items()])


def indexing_progress(df: DataFrame, number: str, control: str, as_of, null_as_zero: bool = True) -> DataFrame:
    """Highest number, row count, and seconds since the newest row."""
    found = df.agg(
        F.max(number).alias("latest_number"), F.count(F.lit(1)).alias("total_rows"), F.max(control).alias("newest")
    )
    return found.select(
        "latest_number", "total_rows", age_seconds("newest", as_of, null_as_zero).alias("seconds_since_latest")
    )


#: Settings under which a plain count of a Parquet table reads file footers only.
_FOOTERS_ONLY = {"spark.sql.sources.useV1SourceList": "csv,json,text", "spark.sql.parquet.aggregatePushdown": "true"}


def footer_rows(spark: SparkSession, path: str) -> int:
    """Rows of a stored Parquet table, added up from the footers of its files; no record is read."""
    before = {k: spark.conf.get(k, None) for k in _FOOTERS_ONLY}
    try:
        for k, v in _FOOTERS_ONLY.items():
            spark.conf.set(k, v)
        return spark.read.parquet(path).agg(F.count(F.lit(1))).first()[0]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def table_sizes(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Per stored Parquet table: (total_bytes, data_bytes, rest_bytes, largest_bytes, files, rows, table_name).

    The data part is the files that a read of the table opens; the total is everything below its path, hidden files such as ledgers, markers and checksums
    included; the rest is what lies between. Sizes come from the file listing, one row per file, and row counts from footers, one number per table.
    """
    frames = []
    for name, path in paths.items():
        rows = footer_rows(spark, path)
        # without its content column this source only lists files
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length")
        sizes = files.agg(
            F.coalesce(F.sum("length"), F.lit(0)).alias("data_bytes"),
            F.coalesce(F.max("length"), F.lit(0)).alias("largest_bytes"),
            F.count(F.lit(1)).alias("files"),
        )
        total = F.greatest(F.lit(stored_bytes(spark, path)).cast("bigint"), F.col("data_bytes"))
        frames.append(
            sizes.select(
                total.alias("total_bytes"), "data_bytes", (total - F.col("data_bytes")).alias("rest_bytes"), "largest_bytes", "files",
                F.lit(rows).cast("bigint").alias("rows"), F.lit(name).alias("table_name"),
            )
        )
    return _stack(frames)


def churn_ratio(stats: DataFrame) -> DataFrame:
    """Dead over live rows from a statistics frame; 0 when nothing is live."""
    return stats.select(
        "schemaname",
        F.col("relname").alias("tablename"),
        F.col("n_dead_tup").alias("dead_rows"),
        F.col("n_live_tup").alias("live_rows"),
        safe_ratio("n_dead_tup", "n_live_tup").alias("dead_ratio"),
    )


def superseded_ratio(df: DataFrame, keys: list[str]) -> DataFrame:
    """The same ratio over versioned rows: all but the newest version of a key are dead."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    sums = per_key.agg(F.count(F.lit(1)).alias("live_rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("all_rows"))
    return sums.select(
        (F.col("all_rows") - F.col("live_rows")).alias("dead_rows"),
        "live_rows",
        safe_ratio(F.col("all_rows") - F.col("live_rows"), "live_rows").alias("dead_ratio"),
    )


def seconds_since(df: DataFrame, keep: list[str], cols: list[str], as_of, null_as_zero: bool = True) -> DataFrame:
    """Seconds since each of several event times."""
    return df.select(*keep, *[age_seconds(c, as_of, null_as_zero).alias(f"seconds_since_{c}") for c in cols])


def count_by(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("count"))


def sum_ratio(df: DataFrame, a: str, b: str) -> DataFrame:
    """sum(a) / (sum(a) + sum(b)); null when both are 0."""
    sums = df.agg(F.sum(F.col(a).cast("double")).alias("a"), F.sum(F.col(b).cast("double")).alias("b"))
    total = F.col("a") + F.col("b")
    return sums.select(F.col("a").alias("sum_a"), F.col("b").alias("sum_b"), F.when(total != 0, F.col("a") / total).alias("ratio"))


def control_range(df: DataFrame, control: str) -> DataFrame:
    return df.agg(F.min(control).alias("oldest"), F.max(control).alias("newest"))


def labelled_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table, one labelled row each."""
    return _stack(
        [df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("table_name", F.lit(n)) for n, df in tables.items()]
    )


def restore_summary(tables: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """Count and highest number per table, to compare a restored copy with the original."""
    return _stack(
        [
            df.agg(
                F.count(F.lit(1)).alias("row_count"),
                (F.max(n).cast("bigint") if n else F.lit(None).cast("bigint")).alias("max_number"),
            ).withColumn("table_name", F.lit(name))
            for name, (df, n) in tables.items()
        ]
    )


def totals(blocks: DataFrame, txs: DataFrame, frm: str, to: str) -> DataFrame:
    """Blocks, transactions and distinct addresses in one row."""
    zero = F.lit(0).cast("bigint")
    addresses = txs.select(F.explode(F.array(frm, to)).alias("a")).distinct()
    parts = _stack(
        [
            blocks.agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("b")),
            txs.agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("t")),
            addresses.agg(F.count("a").alias("n")).withColumn("what", F.lit("a")),
        ]
    )
    pick = lambda w: F.coalesce(F.max(F.when(F.col("what") == w, F.col("n"))), zero)
    return parts.agg(
        pick("b").alias("total_blocks"), pick("t").alias("total_transactions"), pick("a").alias("total_addresses")
    )


def _ordered_number(df: DataFrame, c: str) -> Column:
    """A double in the order of a column's values; texts count by their first six bytes."""
    kind = df.schema[c].dataType
    v = F.col(c)
    if isinstance(kind, T.StringType):
        head = F.substring(v.cast("binary"), 1, 6)
        return F.conv(F.concat(F.lit("0"), F.hex(head)), 16, 10).cast("bigint") * F.pow(F.lit(256.0), F.lit(6) - F.length(head))
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return micros(v.cast("timestamp_ntz")).cast("double")
    return v.cast("double")


def _edges(cuts: list[float]) -> tuple[list[float], list[float], list[float]]:
    """Edges between the distinct values of equally spaced quantiles; per piece the share of rows below it, and in its middle.

    A value that several quantiles share is frequent and gets a piece of its own.
    """
    last = len(cuts) - 1
    edges, first, middle = [float("-inf")], [0.0], [0.0]
    at = 0
    while at <= last:
        upto = at
        while upto < last and cuts[upto + 1] == cuts[at]:
            upto += 1
        if upto > at:
            edges.append(cuts[at])
            first.append(at / last)
            middle.append((at + upto) / 2 / last)
        edges.append(math.nextafter(cuts[at], math.inf))
        spread = (upto + min(upto + 1, last)) / 2 / last
        first.append(spread)
        middle.append(spread)
        at = upto + 1
    return [*edges, float("inf")], first, middle


def _correlation(x: Column, y: Column) -> Column:
    """Pearson's correlation over the rows that have both values; null where one of them never changes."""
    both = F.when(x.isNotNull() & y.isNotNull(), x), F.when(x.isNotNull() & y.isNotNull(), y)
    return F.try_divide(F.covar_pop(*both), F.stddev_pop(both[0]) * F.stddev_pop(both[1]))


def _approximate_profile(df: DataFrame, cols: list[str], order_by: list[str], pieces: int) -> DataFrame:
    """Counts and quantiles of all columns from mergeable sketches in one scan, then the correlation of their ranks in a second one.

    Quantiles become ``pieces`` intervals, a few hundred numbers per column; a row's rank is that of its interval. The position is that of the first
    column of ``order_by``; without one there is no correlation. Nothing is shuffled but sketches and sums.
    """
    names = list(dict.fromkeys([*cols, *order_by[:1]]))
    numbers = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(cols)], *[_ordered_number(df, c).alias(f"v{i}") for i, c in enumerate(names)])
    shares = [i / pieces for i in range(pieces + 1)]
    sketches = [F.percentile_approx(f"v{i}", shares, 20 * pieces).alias(f"q{i}") for i in range(len(names))]
    found = numbers.agg(*[F.approx_count_distinct(f"c{i}", 0.01).alias(f"n{i}") for i in range(len(cols))], *(sketches if order_by else [])).first()
    known = {}  # column number -> (edges, first, middle)
    if order_by:
        known = {i: _edges(found[f"q{i}"]) for i in range(len(names)) if found[f"q{i}"]}
    place = names.index(order_by[0]) if order_by else None
    out = {i: F.lit(None).cast("double") for i in range(len(cols))}
    if place in known:
        bins = Bucketizer(splitsArray=[e for e, _, _ in known.values()], inputCols=[f"v{i}" for i in known], outputCols=[f"b{i}" for i in known], handleInvalid="keep")
        binned = bins.transform(numbers.select(*[f"v{i}" for i in known]))
        # the bin of a null lies beyond the table and gives null, so its row does not count
        rank = lambda i, table: F.get(F.lit(table).cast("array<double>"), F.col(f"b{i}").cast("int"))
        pairs = {i: _correlation(rank(place, known[place][2]), rank(i, known[i][1])) for i in range(len(cols)) if i in known}
        got = binned.agg(*[c.alias(f"r{i}") for i, c in pairs.items()]).first()
        out |= {i: F.lit(None if r is None or math.isnan(r) else r).cast("double") for i, r in ((i, got[f"r{i}"]) for i in pairs)}
    # one row per profiled column
    rows = [F.struct(F.lit(c).alias("attname"), F.lit(found[f"n{i}"]).cast("bigint").alias("n_distinct"), out[i].alias("correlation")) for i, c in enumerate(cols)]
    return df.sparkSession.range(1).select(F.inline(F.array(*rows)))


def column_profile(df: DataFrame, cols: list[str], order_by: list[str], approx: bool = False, pieces: int = 256) -> DataFrame:
    """Distinct count and row-order correlation per column, with the index-candidate flag.

    Correlation is Pearson's between a row's position in ``order_by`` order and the
    rank of its value; rows equal in ``order_by`` are placed by the profiled columns.
    Copies of a row are placed in any order, which changes no sum. Both ranks are running counts;
    the sums of products need only per-value totals, so rows never meet their ranks again.
    With ``approx`` counts and ranks are those of sketches, within about 1 and 100 / ``pieces`` per cent.
    """
    frames = []
    if approx:
        frames.append(_approximate_profile(df, cols, order_by, pieces))
    else:
        # positions are written once; every column then reads only itself and its position
        placed = positions(df, list(dict.fromkeys([*order_by, *cols])), "_pos", list(dict.fromkeys(cols)))
        total = float(placed.count() or 1)
        middle = (total + 1) / 2  # ranks are centred and scaled, so sums of squares keep their digits
        place = (F.col("_pos") - middle) / total
        # squares of places matter as a total only, so they take no part in the shuffles by value
        squares = placed.agg(*[F.sum(F.when(F.col(c).isNotNull(), place * place)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
        for i, c in enumerate(cols):
            per_value = placed.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n"), F.sum(place).alias("x"))
            ranked = OrderedRows.of(per_value, [], ["v"]).running_sum(_upto=F.col("n")).rows
            rank = (F.col("_upto") - F.col("n") + 1 - middle) / total
            s = ranked.agg(
                F.count(F.lit(1)).alias("n_distinct"),
                F.sum("n").cast("double").alias("n"),
                F.sum("x").alias("x"),
                F.sum(rank * F.col("n")).alias("y"),
                F.sum(rank * rank * F.col("n")).alias("yy"),
                F.sum(rank * F.col("x")).alias("xy"),
            )
            rows, x, y = F.col("n"), F.col("x"), F.col("y")
            var = (F.lit(squares[f"s{i}"]).cast("double") - x * x / rows) * (F.col("yy") - y * y / rows)
            corr = F.when((F.col("n_distinct") > 1) & (var > 0), (F.col("xy") - x * y / rows) / F.sqrt(var))
            frames.append(s.select(F.lit(c).alias("attname"), "n_distinct", corr.alias("correlation")))
    return _stack(frames).withColumn(
        "candidate", F.coalesce((F.col("n_distinct") > 100) & (F.col("correlation") < 0.1), F.lit(False))
    )


def stalls(df: DataFrame, control: str, max_gap_s: float, as_of) -> DataFrame:
    """Gaps between successive rows above the allowed period, and the open gap to ``as_of``.

    Only distinct times matter, so rows of one time collapse before they are ordered.
    """
    times = df.where(F.col(control) <= ntz(as_of)).select(control).distinct().withColumn("_open", F.lit(False))
    closing = times.agg(F.max(control).alias("c")).where("c is not null").select(
        ntz(as_of).alias(control), F.lit(True).alias("_open")
    )
    found = OrderedRows.of(times.unionByName(closing), [], [control, "_open"]).previous(gap_start=F.col(control)).rows
    gap = (micros(control) - micros("gap_start")) / F.lit(1e6)
    return found.select(
        "gap_start", F.col(control).alias("gap_end"), gap.alias("gap_seconds"), F.col("_open").alias("open")
    ).where(F.col("gap_seconds") > max_gap_s)
