"""Selections and predicates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerops.functions.times import as_datetime, ntz, to_timedelta


def recent(df: DataFrame, control: str, as_of, interval) -> DataFrame:
    """Rows younger than ``interval``; the bound is a literal, so the scan can use it."""
    return df.where(F.col(control) > ntz(as_datetime(as_of) - to_timedelta(interval)))


def pick(df: DataFrame, **values) -> DataFrame:
    """Equality, or membership when a list is given, on each named column."""
    for name, wanted in values.items():
        df = df.where(F.col(name).isin(*wanted) if isinstance(wanted, (list, tuple, set)) else F.col(name) == wanted)
    return df


def name_like(df: DataFrame, col: str, pattern: str, literal_underscore: bool = False) -> DataFrame:
    """LIKE filter; ``_`` matches any character unless asked to be literal."""
    return df.where(F.col(col).like(pattern.replace("_", "\\_") if literal_underscore else pattern))


def label(name: str) -> Column:
    return F.coalesce(F.col("labels")[name], F.lit(""))


def select_series(
    samples: DataFrame, metric: str, eq: dict[str, str] | None = None, regex: dict[str, str] | None = None
) -> DataFrame:
    """Samples of one metric; a missing label counts as empty, a regex must match the whole value."""
    conds = [F.col("metric") == metric]
    conds += [label(name) == value for name, value in (eq or {}).items()]
    conds += [label(name).rlike(f"^(?:{pattern})$") for name, pattern in (regex or {}).items()]
    return samples.where(reduce(lambda a, b: a & b, conds))


def filter_logs(df: DataFrame, address: str | None = None, tx=None, topics: list | None = None) -> DataFrame:
    """Logs by emitter, transaction and up to four topics; ``None`` means any."""
    names = ["first_topic", "second_topic", "third_topic", "fourth_topic"]
    tx_col = "transaction_hash" if "transaction_hash" in df.columns else "transaction_key"
    wanted = {"address_hash": address, tx_col: tx, **dict(zip(names, topics or [], strict=False))}
    conds = [F.col(c) == v for c, v in wanted.items() if v is not None]
    return df.where(reduce(lambda a, b: a & b, conds)) if conds else df


def address_activity(df: DataFrame, address: str, roles: dict[str, str]) -> DataFrame:
    """Rows touching an address, one per role it plays; ``roles`` maps column to role name.

    The disjunction is stated before the roles are unfolded, so it reaches the scan.
    """
    touched = df.where(reduce(lambda a, b: a | b, [F.col(c) == address for c in roles]))
    played = F.filter(
        F.array(*[F.when(F.col(c) == address, F.lit(r)) for c, r in roles.items()]), lambda r: r.isNotNull()
    )
    return touched.withColumn("role", F.explode(played))


def canonical(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.col("consensus"))


def blocks_by(blocks: DataFrame, number: int | None = None, miner: str | None = None) -> DataFrame:
    if number is not None:
        blocks = blocks.where(F.col("number") == number)
    if miner is not None:
        blocks = blocks.where(F.col("miner_hash") == miner)
    return blocks


def first_where(array: Column, pred: Callable[[Column], Column]) -> Column:
    """First array element satisfying ``pred``, or null."""
    return F.get(F.filter(array, pred), F.lit(0))


def select_nested(
    df: DataFrame,
    json_col: str,
    schema: T.DataType | str,
    array_path: str,
    pred: Callable[[Column], Column],
    project: dict[str, str],
) -> DataFrame:
    """Documents with an array element satisfying ``pred``; nested paths as columns.

    ``array_path`` and the paths in ``project`` start at the document root.
    """
    doc = df.withColumn("_doc", F.from_json(json_col, schema))
    hit = doc.where(F.exists(F.col(f"_doc.{array_path}"), pred))
    return hit.select(*df.columns, *[F.col(f"_doc.{p}").alias(n) for n, p in project.items()])


def filter_flows(df: DataFrame, ns: str | None = None, pod: str | None = None, verdict: str | None = None) -> DataFrame:
    """Network flows by namespace, workload name prefix and verdict."""
    if ns is not None:
        df = df.where(F.col("namespace") == ns)
    if pod is not None:
        df = df.where(F.col("pod").startswith(pod))
    if verdict is not None:
        df = df.where(F.col("verdict") == verdict)
    return df


def flow_counts(flows: DataFrame, by: list[str]) -> DataFrame:
    return flows.groupBy(*by).agg(F.count(F.lit(1)).alias("flows"))


def grep_lines(df: DataFrame, col: str, pattern: str) -> DataFrame:
    """Case-insensitive regex search over whole lines."""
    return df.where(F.col(col).rlike(f"(?i){pattern}"))
