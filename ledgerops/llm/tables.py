"""Shared steps of the operators: written cut points, size checks, slices of Arrow batches."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerops.session import scratch_path

#: A side of a join is broadcast only if it has at most this many rows (ids and a few numbers each).
BROADCAST_ROWS = 300_000


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a table in the folder that all machines share, and read it from there.

    Void columns become text; the rows read later are the same whatever executors are lost.
    """
    df = df.withColumns({c: F.col(f"`{c}`").cast("string") for c, kind in df.dtypes if kind == "void"})
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast if ``rows`` (its counted rows) is within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def fresh(prefix: str, taken: list[str]) -> str:
    """A column name that ``taken`` does not hold."""
    name = prefix
    while name.lower() in {t.lower() for t in taken}:
        name = f"{prefix}_{uuid.uuid4().hex[:8]}"
    return name


def give_back() -> None:
    """Return freed memory to the machine: workers are kept for later tasks, and several share an executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], rows: int, size: int = 1 << 20, text: int = 1) -> Iterator[pa.RecordBatch]:
    """Cut record batches into pieces of at most ``rows`` rows and about ``size`` bytes in the string column ``text``."""
    for batch in batches:
        at, n = 0, batch.num_rows
        if not n:
            continue
        column = batch.column(text)
        lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0), dtype=np.int64)
        total = np.concatenate([[0], np.cumsum(lengths)])
        while at < n:
            to = int(np.searchsorted(total, total[at] + size, side="right")) - 1
            to = min(max(to, at + 1), at + rows, n)
            yield batch.slice(at, to - at)
            at = to
        del batch, column
        give_back()


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def least(spark: SparkSession, name: str, default: int) -> int:
    """An integer setting of the session, or ``default``."""
    return int(spark.conf.get(name, str(default)))


Mapper = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
