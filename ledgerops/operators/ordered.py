"""Ordered computations that no single hot key can pin to one task.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task. Here the
rows are range-partitioned on (key, order) instead, so a heavy key is cut into many
balanced runs. Each run is computed on its own; what a run needs from the runs
before it (last value, running sum) is one small row per run, joined back.

The cut points come from sampling, so the runs are materialised in the shared folder
once; both the row pass and the edge pass then see the same runs, also after an
executor is lost.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerops.session import cut

RUN, KEY = "_run", "_key"


_BLOCK = 100_000


def unfold(df: DataFrame, lo: str, hi: str, name: str, step: int = 1) -> DataFrame:
    """One row per number of the inclusive range ``lo..hi``: adds ``name``.

    Long ranges first split into blocks that spread over the cluster, so neither an
    array nor a task ever holds a whole range.
    """
    width = F.lit(_BLOCK * step).cast("bigint")
    blocks = df.where(F.col(hi) >= F.col(lo)).withColumn("_block", F.explode(F.sequence(lo, hi, width)))
    blocks = blocks.hint("rebalance", F.col("_block"))
    last = F.least(F.col("_block") + (width - 1), F.col(hi))
    return blocks.withColumn(name, F.explode(F.sequence("_block", last, F.lit(step).cast("bigint")))).drop("_block")


class OrderedRows:
    """Rows in (keys, order) order. ``order`` must end in a tie-breaker."""

    def __init__(self, frame: DataFrame, keys: list[str], order: list[str], edges: DataFrame | None):
        self._frame, self._keys, self._order, self._edges = frame, keys, order, edges

    @classmethod
    def of(cls, df: DataFrame, keys: list[str], order: list[str], partitions: int | None = None) -> OrderedRows:
        spread = [F.col(c) for c in (*keys, *order)]
        ranged = df.repartitionByRange(partitions, *spread) if partitions else df.repartitionByRange(*spread)
        frame = cut(ranged.withColumn(RUN, F.spark_partition_id()))
        if len(frame.inputFiles()) <= 1:  # a task writes its run to a file; one run has no earlier run
            return cls(frame, keys, order, None)
        # Only keys on both sides of a cut need values from other runs: the least and
        # greatest key of each run, so at most two rows per run.
        key = F.struct(*keys) if keys else F.lit(0)
        ends = frame.groupBy(RUN).agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
        shared = (
            ends.select(RUN, F.explode(F.array_distinct(F.array("lo", "hi"))).alias(KEY))
            .groupBy(KEY)
            .agg(F.count(F.lit(1)).alias("n"))
            .where("n > 1")
            .select(KEY)
        )
        shared = cut(shared)  # tiny, and read by every later step
        edges = frame.withColumn(KEY, key).join(F.broadcast(shared), KEY, "left_semi")
        return cls(frame, keys, order, edges)

    @property
    def rows(self) -> DataFrame:
        return self._frame.drop(RUN)

    def select(self, *cols) -> OrderedRows:
        """Replace the value columns; keys, order and run stay."""
        keep = [RUN, *dict.fromkeys([*self._keys, *self._order])]
        edges = self._edges.select(KEY, *keep, *cols) if self._edges is not None else None
        return OrderedRows(self._frame.select(*keep, *cols), self._keys, self._order, edges)

    def with_column(self, name: str, col: Column) -> OrderedRows:
        edges = self._edges.withColumn(name, col) if self._edges is not None else None
        return OrderedRows(self._frame.withColumn(name, col), self._keys, self._order, edges)

    def _window(self):
        return W.partitionBy(RUN, *self._keys).orderBy(*self._order)

    def _combine(self, names, local, per_run, across, merge) -> OrderedRows:
        """Add columns: ``local`` inside the run, ``across`` over per-run values, merged."""

        def extend(frame: DataFrame, carry: DataFrame | None) -> DataFrame:
            own = list(frame.columns)
            frame = frame.withColumns({f"_l_{n}": local[n] for n in names})
            if carry is not None:
                if KEY in own:
                    frame = frame.join(carry, [RUN, KEY], "left")
                else:
                    key = F.struct(*self._keys) if self._keys else F.lit(0)
                    frame = frame.withColumn(KEY, key).join(carry, [RUN, KEY], "left")
            merged = [
                (merge(F.col(f"_l_{n}"), F.col(f"_c_{n}")) if carry is not None else F.col(f"_l_{n}")).alias(n)
                for n in names
            ]
            return frame.select(*own, *merged)

        if self._edges is None:
            return OrderedRows(extend(self._frame, None), self._keys, self._order, None)
        w = W.partitionBy(KEY).orderBy(RUN)  # at most one row per run
        totals = self._edges.groupBy(KEY, RUN).agg(*[per_run[n].alias(f"_t_{n}") for n in names])
        carry = totals.select(KEY, RUN, *[across(F.col(f"_t_{n}"), w).alias(f"_c_{n}") for n in names])
        # at most two rows per run, whatever the data size; written out, so that the plan
        # of a later step does not contain all earlier ones twice
        carry = F.broadcast(cut(carry))
        return OrderedRows(
            extend(self._frame, carry), self._keys, self._order, extend(self._edges, carry)
        )

    def previous(self, **cols: Column) -> OrderedRows:
        """Value of the row before, per key; null for the first."""
        # The run's first row takes the last value of the run before. A marker tells
        # "no row before inside the run" from "row before holds null".
        w, at = self._window(), F.struct(*self._order)
        local = {n: F.lag(F.struct(c.alias("v"))).over(w) for n, c in cols.items()}
        per_run = {n: F.max_by(F.struct(c.alias("v")), at) for n, c in cols.items()}
        out = self._combine(
            list(cols), local, per_run, lambda t, cw: F.lag(t).over(cw), lambda a, b: F.coalesce(a, b)
        )
        for n in cols:
            out = out.with_column(n, F.col(n)["v"])
        return out

    def following(self, **cols: Column) -> OrderedRows:
        """Value of the row after, per key; null for the last."""
        w, at = self._window(), F.struct(*self._order)
        local = {n: F.lead(F.struct(c.alias("v"))).over(w) for n, c in cols.items()}
        per_run = {n: F.min_by(F.struct(c.alias("v")), at) for n, c in cols.items()}
        out = self._combine(
            list(cols), local, per_run, lambda t, cw: F.lead(t).over(cw), lambda a, b: F.coalesce(a, b)
        )
        for n in cols:
            out = out.with_column(n, F.col(n)["v"])
        return out

    def running_sum(self, **cols: Column) -> OrderedRows:
        """Sum up to and including the row, per key."""
        w = self._window().rowsBetween(W.unboundedPreceding, W.currentRow)
        return self._combine(
            list(cols),
            {n: F.sum(c).over(w) for n, c in cols.items()},
            {n: F.sum(c) for n, c in cols.items()},
            lambda t, cw: F.sum(t).over(cw.rowsBetween(W.unboundedPreceding, -1)),
            lambda a, b: F.when(a.isNull() & b.isNull(), None).otherwise(
                F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
            ),
        )

    def latest(self, **cols: Column) -> OrderedRows:
        """Last non-null value up to and including the row, per key."""
        w, at = self._window().rowsBetween(W.unboundedPreceding, W.currentRow), F.struct(*self._order)
        return self._combine(
            list(cols),
            {n: F.last(c, ignorenulls=True).over(w) for n, c in cols.items()},
            {n: F.max_by(c, F.when(c.isNotNull(), at)) for n, c in cols.items()},
            lambda t, cw: F.last(t, ignorenulls=True).over(cw.rowsBetween(W.unboundedPreceding, -1)),
            lambda a, b: F.coalesce(a, b),
        )

    def upcoming(self, **cols: Column) -> OrderedRows:
        """First non-null value from the row onward, per key."""
        # read backwards: a frame that ends at the last row would be rescanned for every row
        back = W.partitionBy(RUN, *self._keys).orderBy(*[F.col(c).desc() for c in self._order])
        w, at = back.rowsBetween(W.unboundedPreceding, W.currentRow), F.struct(*self._order)
        later = W.partitionBy(KEY).orderBy(F.col(RUN).desc()).rowsBetween(W.unboundedPreceding, -1)
        return self._combine(
            list(cols),
            {n: F.last(c, ignorenulls=True).over(w) for n, c in cols.items()},
            {n: F.min_by(c, F.when(c.isNotNull(), at)) for n, c in cols.items()},
            lambda t, _: F.last(t, ignorenulls=True).over(later),
            lambda a, b: F.coalesce(a, b),
        )


def positions(df: DataFrame, order: list[str], name: str, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) and ``name``, each row's place in ``order`` from 1; equal rows are placed in any order.

    One shuffle: sorted runs number their rows as they are written, and the rows of earlier runs are added from one small row per run.
    Equal rows are told apart by the task that read them, so a frequent row needs no task of its own.
    """
    spread = [*order, "_tie"]
    tied = df.withColumn("_tie", F.spark_partition_id())
    runs = tied.repartitionByRange(*spread).sortWithinPartitions(*spread)
    # the number holds the task in its upper 31 bits and the row within the task in its lower 33
    numbered = cut(runs.select(*(keep or df.columns), F.monotonically_increasing_id().alias("_at")))
    run, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit(2**33 - 1))
    sizes = numbered.groupBy(run.alias(RUN)).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = W.partitionBy(F.lit(0)).orderBy(RUN).rowsBetween(W.unboundedPreceding, -1)  # one row per run
    starts = cut(sizes.select(RUN, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before")))
    placed = numbered.withColumn(RUN, run).join(F.broadcast(starts), RUN)
    return placed.select(*(keep or df.columns), (F.col("_before") + row + 1).alias(name))


def exact_quantiles(df: DataFrame, value: str, qs: list[float], by: list[str] | None = None) -> DataFrame:
    """Exact interpolated quantiles, one row per group and q: (by.., q, value).

    Values are counted first, so equal values collapse before the shuffle; the running
    count over distinct values then shows which value stands at each rank.
    """
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = OrderedRows.of(counts, by, [value]).running_sum(upto=F.col("n")).following(nxt=F.col(value)).rows
    if by:
        # the totals are one row per group; as a written table they are broadcast when
        # small, and otherwise leave the planner free to split a group of many values
        totals = cut(counts.groupBy(*by).agg(F.sum("n").alias("total")))
        names = {c: f"_of_{c}" for c in by}  # null is a group of its own
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
        ranked = ranked.join(totals.withColumnsRenamed(names), same).drop(*names.values())
    else:
        ranked = ranked.withColumn("total", F.lit(ranked.agg(F.sum("n")).first()[0]).cast("bigint"))
    first, upto = F.col("upto") - F.col("n"), F.col("upto")
    here = F.col(value).cast("double")

    def point(q: float) -> Column:
        pos = F.lit(float(q)) * (F.col("total") - 1)
        low = F.floor(pos)
        above = F.when(low + 1 < upto, here).otherwise(F.coalesce(F.col("nxt").cast("double"), here))
        found = F.struct(F.lit(float(q)).alias("q"), (here + (above - here) * (pos - low)).alias("value"))
        return F.when((low >= first) & (low < upto), found)

    hits = F.filter(F.array(*[point(q) for q in qs]), lambda x: x.isNotNull())
    return ranked.select(*by, hits.alias("_hits")).select(*by, F.inline("_hits"))
