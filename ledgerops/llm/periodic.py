"""Periodic runs: stretches of words that repeat with a period, found by splitting at rare words and scanning lags.

A run is a stretch of consecutive words with smallest period q whose length is at least max(6, 4 q) and that no neighbouring word extends. Each word of
a run occurs at least four times in it, so a word with fewer occurrences in a segment belongs to no run of that segment and splits it. Splitting is
repeated, counting anew in the segments that changed, until nothing changes; what is left is short in most texts, and is scanned for lags.

The lag scan takes all lags of [2^j, 2^(j+1)) in one pass: a run with such a period holds a multiple of 2^j whose block of 2^j words comes again one
period later, and each position has just one multiple of 2^j at such a distance. Blocks are compared by names (equal names, equal words), and
matches are extended by the names of longer blocks; a pass takes time in proportion to the words times the logarithm of the longest segment, also where one word fills a text.

All texts of a piece of an Arrow batch (about 1 MB) are worked on together. A longer text is a piece of its own: memory grows with the longest text
(some 40 bytes a word, and four more for each doubling of the longest segment left after splitting), never with the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerops.llm.tables import slices
from ledgerops.llm.words import text_bytes, word_hashes, word_spans

#: A run has at least this many words, and at least this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4


def _stretches(at: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each stretch of consecutive positions of one segment."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (np.diff(at) != 1) | (segment[1:] != segment[:-1])
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(at)))


def surviving(ids: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions that splitting leaves, and the number of the segment each belongs to; ``row`` tells texts apart."""
    at, segment = np.arange(len(ids)), row.astype(np.int64)
    done_at, done_segment, used = [], [], 0
    width = int(ids.max()) + 1 if len(ids) else 1
    while True:
        first, length = _stretches(at, segment)
        keep = np.repeat(length >= LEAST_WORDS, length)
        segment = np.repeat(np.arange(len(first)), length)[keep]
        at = at[keep]
        if not len(at):
            break
        _, which, n = np.unique(segment * width + ids[at], return_inverse=True, return_counts=True)
        rare = n[which] < LEAST_PERIODS
        split = np.zeros(int(segment[-1]) + 1, dtype=bool)
        split[segment[rare]] = True
        stable = ~split[segment]
        done_at.append(at[stable])
        done_segment.append(segment[stable] + used)
        used += len(split)
        left = ~stable & ~rare
        at, segment = at[left], segment[left]
    if not done_at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, segment = np.concatenate(done_at), np.concatenate(done_segment)
    order = np.argsort(at, kind="stable")
    return at[order], segment[order]


def _names(x: np.ndarray, longest: int) -> list[np.ndarray]:
    """Names of the blocks of 1, 2, 4, .. up to ``longest`` words that start at each position (-1 - position where the block leaves the array)."""
    names = [x.astype(np.int32)]
    size = 1
    while 2 * size <= longest:
        low, out = names[-1], -1 - np.arange(len(x), dtype=np.int32)
        if len(x) > 2 * size - 1:
            n = len(x) - 2 * size + 1
            pair = low[:n].astype(np.int64) * (len(x) + 1) + low[size : size + n]
            out[:n] = np.unique(pair, return_inverse=True)[1]
        names.append(out)
        size *= 2
    return names


def _same(names: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
    """How many words agree from positions a and b on, or before them."""
    n, total = len(names[0]), np.zeros(len(a), dtype=np.int64)
    for j in range(len(names) - 1, -1, -1):
        for _ in range(2):  # names end at half the longest stretch: its block may fit twice
            p, q = (a - total - (1 << j), b - total - (1 << j)) if back else (a + total, b + total)
            inside = (p >= 0) & (q + (1 << j) <= n)
            hit = inside & (names[j][np.where(inside, p, 0)] == names[j][np.where(inside, q, 0)])
            total += hit.astype(np.int64) << j
    return total


def find_runs(ids: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs in texts of word numbers laid end to end, by start and period."""
    none = np.zeros(0, np.int64)
    at, segment = surviving(ids, row)
    first, length = _stretches(at, segment)
    if not len(first):
        return none, none, none
    # segments end to end, each followed by a word of its own, so that no block reaches over
    n = len(at) + len(first)
    place = np.arange(len(at)) + np.repeat(np.arange(len(first)), length)
    x, origin = np.zeros(n, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    _, x[place] = np.unique(ids[at], return_inverse=True)
    origin[place] = at
    gap = origin < 0
    x[gap] = x.max() + 1 + np.arange(len(first))
    names = _names(x, int(length.max()))
    found = []
    for j in range(max(1, (int(length.max()) // LEAST_PERIODS).bit_length())):
        p = np.arange(1 << j, n)
        anchor = ((p >> j) - 1) << j
        hit = (anchor >= 0) & (names[j][p] == names[j][anchor])
        p, anchor = p[hit], anchor[hit]
        if len(p):
            lag = p - anchor
            before = _same(names, anchor, p, back=True)
            size = before + _same(names, anchor, p, back=False) + lag
            enough = size >= np.maximum(LEAST_WORDS, LEAST_PERIODS * lag)
            found.append(np.stack([anchor - before, size, lag])[:, enough])
    start, size, lag = np.concatenate(found, axis=1) if found else (none, none, none)
    order = np.lexsort((lag, size, start))
    start, size, lag = start[order], size[order], lag[order]
    # one stretch found with several lags has the least of them as its smallest period
    keep = np.ones(len(start), dtype=bool)
    keep[1:] = (start[1:] != start[:-1]) | (size[1:] != size[:-1])
    start, size, lag = origin[start[keep]], size[keep], lag[keep]
    order = np.lexsort((lag, start))
    return start[order], size[order], lag[order]


def _joined(raw: np.ndarray, start: np.ndarray, end: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Texts of words joined by one space; text i has the words bounds[i] to bounds[i + 1]."""
    size = end - start + 1
    upto = np.concatenate([[0], np.cumsum(size)])
    where = np.arange(upto[-1]) + np.repeat(start - upto[:-1], size)
    out = np.append(raw, np.uint8(0x20))[np.minimum(where, len(raw))]
    out[upto[1:] - 1] = 0x20
    # the space after the last word of each text goes
    some = bounds[1:] > bounds[:-1]
    keep = np.ones(len(out), dtype=bool)
    keep[upto[bounds[1:][some]] - 1] = False
    offsets = upto[bounds] - np.concatenate([[0], np.cumsum(some)])
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out[keep])).cast(pa.string())


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _scan(batches):
    for piece in slices(batches, 4096):
        raw, bounds = text_bytes(piece.column(1))
        start, end, first = word_spans(raw, bounds)
        ids = np.unique(word_hashes(raw, start, end, lower=False), return_inverse=True)[1]
        row = np.repeat(np.arange(piece.num_rows), np.diff(first))
        at, size, period = find_runs(ids, row)
        change = np.zeros(len(ids) + 1, dtype=np.int64)
        np.add.at(change, at + period, 1)
        np.add.at(change, at + size, -1)
        kept = np.cumsum(change)[:-1] == 0
        left = np.concatenate([[0], np.cumsum(kept)])[first]
        texts = _joined(raw, start[kept], end[kept], left)
        of = row[at] if len(at) else at
        flat = pa.StructArray.from_arrays([pa.array(at - first[of] if len(at) else at), pa.array(size), pa.array(period)], fields=list(_RUN))
        offsets = np.searchsorted(of, np.arange(piece.num_rows + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [piece.column(0), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(offsets), flat), texts], names=["id", "n_words", "runs", "collapsed"]
        )


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: (id, n_words, runs, collapsed).

    ``runs`` are (start, length, period) in words numbered from 0, by start and then period; ``collapsed`` is the text without the words that
    a run repeats after its first period, the kept ones joined by one space. Words are separated by ASCII white space and compared byte for byte.
    A null or empty text has no words, no runs and an empty ``collapsed``; rows that repeat an id give a row each; other columns are not looked at.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = rows.mapInArrow(_scan, f"id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return out.withColumnRenamed("id", id_col)


_GAP = r"[ \t-\r]+"


def repeat_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with the words of some texts replaced by repetitions, as the query's contract plants them.

    With h the CRC-32 of the decimal id and g = h div 10: where 10 divides h, word i >= a becomes word a + (i - a) mod p, for
    a = g mod n and p = 1 + (n - a) div (3 + g mod 8). Other rows, and those without words or id, keep their text.
    """
    h = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary"))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.floor(h / 10).cast("bigint").alias("g"), (F.pmod(h, F.lit(10)) == 0).alias("chosen"))
    rows = rows.withColumn("w", F.when(F.col("chosen"), F.filter(F.split("text", _GAP), lambda w: w != "")))
    rows = rows.withColumn("n", F.coalesce(F.size("w"), F.lit(0)).cast("bigint")).withColumn("a", F.when(F.col("n") > 0, F.pmod("g", "n")))
    rows = rows.withColumn("p", F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.pmod(F.col("g"), F.lit(8)))).cast("bigint"))
    moved = F.expr("array_join(transform(sequence(0L, n - 1), i -> element_at(w, cast(if(i < a, i, a + (i - a) % p) + 1 as int))), ' ')")
    return rows.select(F.col("id").alias(id_col), F.when(F.col("a").isNotNull(), moved).otherwise(F.col("text")).alias(text_col))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from ``periodic_runs``: counts, the run of greatest length / period, and digests of all runs and of the kept words."""
    best: Column = F.expr(
        "aggregate(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>), (b, r) -> "
        "if(b is null or r.length * b.period > b.length * r.period, r, b))"  # runs come by start and period, so the first of equals stays
    )
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    text = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    rows = found.withColumn("best", best)
    return rows.select(
        id_col, F.size("runs").cast("bigint").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
