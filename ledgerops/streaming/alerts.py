"""Live alert states: one small state machine per series, driven by event time.

Evaluations wait in a map state keyed by their time until the watermark has passed them. An event-time timer per series
then releases them in order, so neither the order inside the watermark nor the cut into micro-batches shows in the result. State is dropped
once a series has been silent for a step and nothing is left to resolve.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from ledgerops.functions.times import to_micros

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _longs(*names: str) -> StructType:
    return StructType([StructField(n, LongType()) for n in names])


# Times in microseconds: the last evaluation, the start of its true stretch, the last firing one and its start; the next
# timer in milliseconds. Null where there is none.
_STATE = _longs("last", "since", "fired", "fired_since", "timer")
OUTPUT = StructType(
    [
        StructField("series", StringType()),
        StructField("t_us", LongType()),
        StructField("state", StringType()),
        StructField("since_us", LongType()),
    ]
)
_ROWS = 10_000


class AlertMachine(StatefulProcessor):
    """Evaluations (t_us, on) to states, and ``resolved`` for series that fire no longer."""

    def __init__(self, for_us: int, step_us: int, resolve_us: int):
        self.for_us, self.step_us, self.resolve_us = for_us, step_us, resolve_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("alert", _STATE)
        self.waiting = handle.getMapState("waiting", _longs("t_us"), StructType([StructField("on", BooleanType())]))

    def _held(self) -> list[int | None]:
        return list(self.state.get()) if self.state.exists() else [None] * len(_STATE)

    def _wake(self, held: list[int | None], at_us: int) -> None:
        """See that a timer fires when the watermark reaches ``at_us``."""
        at = -(-at_us // 1000)  # timers count milliseconds; none may fire early
        if held[4] is None or at < held[4]:
            held[4] = at
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, least = self._held(), None
        for part in rows:
            for t, on in zip(part["t_us"].tolist(), part["on"].tolist()):
                if held[0] is not None and t <= held[0]:
                    continue  # at or before the watermark that released the last one: too late
                before = self.waiting.getValue((t,)) if self.waiting.containsKey((t,)) else None
                self.waiting.updateValue((t,), (bool(on) or bool(before and before[0]),))  # of two at one time, true counts
                least = t if least is None else min(least, t)
        if least is not None:
            self._wake(held, least)
            self.state.update(tuple(held))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        last, since, fired, fired_since, _ = self._held()
        times = np.fromiter((k[0] for k in self.waiting.keys()), dtype=np.int64)
        due = np.sort(times[times <= upto])
        out = []
        for t in due.tolist():
            on = self.waiting.getValue((t,))[0]
            self.waiting.removeKey((t,))
            if fired is not None and t - fired > self.resolve_us:
                out.append((key[0], fired + self.resolve_us, "resolved", fired_since))
                fired = None
            if not on:
                since, state = None, "inactive"
            else:
                if since is None or t - last > self.step_us:
                    since = t
                state = "firing" if t - since >= self.for_us else "pending"
                if state == "firing":
                    fired, fired_since = t, since
            out.append((key[0], t, state, since))
            last = t
            if len(out) >= _ROWS:
                yield self._frame(out)
                out = []
        if fired is not None and fired + self.resolve_us <= upto:
            out.append((key[0], fired + self.resolve_us, "resolved", fired_since))
            fired = None
        held, later = [last, since, fired, fired_since, None], times[times > upto]
        wait = [int(later.min())] if len(later) else []
        if fired is not None:
            wait.append(fired + self.resolve_us)
        elif last is not None and last + self.step_us > upto:
            wait.append(last + self.step_us)  # until then the next evaluation may go on with this stretch
        if wait:
            self._wake(held, min(wait))
            self.state.update(tuple(held))
        else:
            self.state.clear()
        yield self._frame(out)

    @staticmethod
    def _frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[f.name for f in OUTPUT.fields]).astype({"t_us": "int64", "since_us": "Int64"})

    def close(self) -> None:
        pass


def stream_alerts(
    evals: DataFrame, series: str, cond: str, for_: str, step: str, resolve_timeout: str = "5 minutes",
    watermark: str = "1 minute", ts: str = "t",
) -> DataFrame:
    """States of every evaluation that the watermark has passed, plus ``resolved`` one timeout after the last firing one if none fired since.

    The same rows as ``alert_state`` and ``resolve`` give over the table of all evaluations, whatever their order inside the watermark. An evaluation that
    comes after the watermark is dropped, as in all streams. Needs the RocksDB state store (see ``use_rocksdb``).
    """
    rows = evals.withWatermark(ts, watermark).select(
        F.col(series).alias("series"), F.col(ts).alias("t"), F.unix_micros(ts).alias("t_us"), F.col(cond).alias("on")
    )
    machine = AlertMachine(to_micros(for_), to_micros(step), to_micros(resolve_timeout))
    out = rows.groupBy("series").transformWithStateInPandas(
        statefulProcessor=machine, outputStructType=OUTPUT, outputMode="Append", timeMode="eventTime"
    )
    return out.select(
        "series", F.timestamp_micros("t_us").alias("t"), "state", F.timestamp_micros("since_us").alias("since")
    )


def use_rocksdb(spark: SparkSession) -> str | None:
    """Choose the state store the alert machine needs; returns the setting before."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    return before
