"""Server logs, statement statistics, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerops.operators.ordered import OrderedRows

# The server's line prefix  %t [%p]: [%l-1] user=%u,db=%d,app=%a,client=%h
LINE = (
    r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d+)?) (\S+) \[(\d+)\]: \[(\d+)-\d+\] "
    r"user=([^,]*),db=([^,]*),app=(.*?),client=(\S*) (.*)$"
)
_PARTS = ["log_time", "zone", "pid", "line_no", "user_name", "db_name", "app", "client", "message"]


_MARK = "\x01"


def _prefix_parts(line: Column) -> Column:
    """The nine parts of a line as an array, from one pass of the pattern.

    Lines that already hold the mark take the slower way, part by part.
    """
    groups = range(1, len(_PARTS) + 1)
    marked = F.regexp_replace(line, LINE, _MARK.join(f"${i}" for i in groups))
    apart = F.when(line.rlike(LINE), F.array(*[F.regexp_extract(line, LINE, i) for i in groups]))
    return F.when(line.contains(_MARK), apart).otherwise(F.split(marked, _MARK))


def parse_server_log(df: DataFrame, col: str) -> DataFrame:
    """Prefix fields and message of each line; a line without the prefix keeps only its message."""
    types = {"log_time": "timestamp_ntz", "pid": "int", "line_no": "bigint"}
    ok = F.size("_parts") == len(_PARTS)
    out = []
    for i, name in enumerate(_PARTS):
        value = F.when(ok, F.get("_parts", F.lit(i)))
        if name == "zone":
            continue
        if name == "message":
            value = F.coalesce(value, F.col(col))
        else:
            value = F.nullif(value, F.lit(""))
        if name in types:
            value = value.try_cast(types[name])
        out.append(value.alias(name))
    kept = [c for c in df.columns if c != col]
    return df.withColumn("_parts", _prefix_parts(F.col(col))).select(*kept, *out)


# Message shapes, tested in order.
MESSAGE_CLASSES = [
    ("duration", r"duration: [0-9.]+ ms"),
    ("disconnect", r"disconnection: session time"),
    ("connect", r"connection (received|authorized)"),
    ("checkpoint", r"checkpoint (starting|complete)"),
    ("lock_wait", r"still waiting for|acquired \S+ after|deadlock detected"),
    ("temp_file", r"temporary file: path"),
    ("autovacuum", r"automatic (vacuum|analyze) of table"),
]


def message_class(message: Column | str) -> Column:
    m = F.col(message) if isinstance(message, str) else message
    out = F.lit("other")
    for name, pattern in reversed(MESSAGE_CLASSES):
        out = F.when(m.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def classify_log(parsed: DataFrame) -> DataFrame:
    """Lines per message class."""
    return parsed.groupBy(message_class("message").alias("class")).agg(F.count(F.lit(1)).alias("lines"))


def slow_statements(parsed: DataFrame, min_ms: float = 1000.0) -> DataFrame:
    """Statements that ran at least ``min_ms``: adds ``duration_ms`` and ``statement``."""
    ms = F.regexp_extract("message", r"duration: ([0-9.]+) ms", 1)
    text = F.regexp_extract("message", r"duration: [0-9.]+ ms\s+(?:statement|execute [^:]*): (?s:(.*))$", 1)
    timed = parsed.where(F.col("message").contains("duration: "))
    return timed.withColumns({"duration_ms": ms.try_cast("double"), "statement": text}).where(
        F.col("duration_ms") >= min_ms
    )


def normalize_statement(text: Column | str) -> Column:
    """Statement text with literals replaced and blanks folded."""
    t = F.col(text) if isinstance(text, str) else text
    t = F.regexp_replace(t, r"'[^']*'", "?")
    t = F.regexp_replace(t, r"\b[0-9]+(\.[0-9]+)?\b", "?")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def statement_stats(df: DataFrame, text: str, ms: str) -> DataFrame:
    """Calls, total and mean time per normalised statement."""
    return df.groupBy(normalize_statement(text).alias("query")).agg(
        F.count(F.lit(1)).alias("calls"), F.sum(ms).alias("total_ms"), F.avg(ms).alias("mean_ms")
    )


def top_n(df: DataFrame, order: str, n: int, tie: list[str]) -> DataFrame:
    """Largest ``n`` rows by ``order``; each task keeps its own top before they meet."""
    return df.orderBy(F.col(order).desc(), *tie).limit(n)


def latest_page(df: DataFrame, keys: list[str], n: int, after: tuple | None = None) -> DataFrame:
    """Newest ``n`` rows, or the next ``n`` after the last row of the page before.

    The keyset condition is stated per column, so its first part can prune files.
    """
    if after is not None:
        cond, same = F.lit(False), F.lit(True)
        for k, v in zip(keys, after, strict=True):
            cond = cond | (same & (F.col(k) < F.lit(v)))
            same = same & (F.col(k) == F.lit(v))
        df = df.where((F.col(keys[0]) <= F.lit(after[0])) & cond)
    return df.orderBy(*[F.col(k).desc() for k in keys]).limit(n)


def sort_events(df: DataFrame, at: str, tie: list[str]) -> DataFrame:
    return df.orderBy(at, *tie)


def sessions_per_client(log: DataFrame, client: str, change: str) -> DataFrame:
    """Sessions opened and closed per client; ``change`` is +1, -1 or 0."""
    return log.groupBy(client).agg(
        F.count(F.when(F.col(change) > 0, 1)).alias("opened"), F.count(F.when(F.col(change) < 0, 1)).alias("closed")
    )


_BLOCK = 10_000


def _repeated(df: DataFrame, times: str) -> DataFrame:
    """Each row as often as its count says; a frequent row is dealt in blocks, so no task makes all of its copies."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = df.withColumn("_first", F.explode(F.sequence(F.lit(1).cast("bigint"), times, F.lit(_BLOCK).cast("bigint"))))
    # a stated number of partitions stays: by the few bytes of its rows the planner would merge them
    dealt = blocks.repartition(parts, *df.columns, "_first")
    last = F.least(F.col("_first") + (_BLOCK - 1), F.col(times))
    return dealt.withColumn("_copy", F.explode(F.sequence("_first", last))).select(*df.columns)


def session_concurrency(log: DataFrame, at: str, change: str, by: list[str] | None = None, every: bool = False) -> DataFrame:
    """Open sessions over time: (by.., at, open). Changes at one time collapse to one row; with ``every`` each keeps a row.

    Changes without a time count last.
    """
    by = by or []
    changes = log.where(F.col(change) != 0).groupBy(*by, F.col(at).isNull().alias("_untimed"), at)
    net = changes.agg(F.sum(change).cast("bigint").alias("net"), F.count(F.lit(1)).alias("_n"))
    found = OrderedRows.of(net, by, ["_untimed", at]).running_sum(open=F.col("net")).rows.select(*by, at, "open", "_n")
    return (_repeated(found, "_n") if every else found).select(*by, at, "open")


def peak_concurrency(log: DataFrame, at: str, change: str, by: list[str] | None = None) -> DataFrame:
    """Highest number of open sessions and the first of the known times with the most."""
    open_ = session_concurrency(log, at, change, by)
    grouped = open_.groupBy(*by) if by else open_.groupBy()
    first = F.max_by(at, F.when(F.col(at).isNotNull(), F.struct(F.col("open"), -_epoch(at))))
    return grouped.agg(F.max("open").alias("peak"), first.alias("peak_at"))


def _epoch(at: str) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(at))
