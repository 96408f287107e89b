"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashes of its words, word pairs and pairs with one word between (``skip_pairs``), taken over the whole text.
FTRL-proximal keeps a rate per coordinate and zeroes what has seen too little evidence (L1), so the model is a short list
of slots and weights, small enough to go to every task by its very form: at most 2**bits slots.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerops.llm import words as W
from ledgerops.llm.tables import small, slices, written

#: Words are runs of letters, digits and bytes above ASCII; all other bytes separate.
_GAP = np.ones(256, dtype=bool)
_GAP[48:58] = _GAP[65:91] = _GAP[97:123] = _GAP[128:] = False
_PAIR, _SKIP = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


@dataclass(frozen=True)
class Settings:
    """``train_rows`` bounds the labelled rows that are learnt from (lowest hash of the id first).

    A slot takes part from ``least_rows`` learnt rows on; the rest are plain FTRL settings.
    """

    bits: int = 20
    train_rows: int = 16000
    least_rows: int = 3
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.01
    epochs: int = 5


def _features(batch: pa.RecordBatch, bits: int, column: int = 1) -> Iterator[np.ndarray]:
    """Distinct feature slots of each row."""
    raw, bounds = W.text_bytes(batch.column(column))
    start, end, first = W.word_spans(raw, bounds, _GAP)
    one = W.word_hashes(raw, start, end)
    two = W.mix(one[:-1] * _PAIR + one[1:]) if len(one) > 1 else one[:0]
    skip = W.mix(one[:-2] * _SKIP + one[2:]) if len(one) > 2 else one[:0]
    shift = np.uint64(64 - bits)
    one, two, skip = ((x >> shift).astype(np.int64) for x in (W.mix(one), two, skip))
    for a, b in zip(first[:-1], first[1:]):
        yield np.unique(np.concatenate([one[a:b], two[a : max(a, b - 1)], skip[a : max(a, b - 2)]])).astype(np.int32)


def _ftrl(rows: list[np.ndarray], labels: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, float]:
    """Slots with a weight, their weights, and the weight of the constant."""
    size = (1 << s.bits) + 1
    seen = np.bincount(np.concatenate(rows), minlength=size) if rows else np.zeros(size)
    rows = [r[seen[r] >= s.least_rows] for r in rows]
    z, n = np.zeros(size), np.zeros(size)
    bias = size - 1
    rng = np.random.default_rng(7)

    def weights(at):
        zi = z[at]
        w = -(zi - np.sign(zi) * s.l1) / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2)
        w[(np.abs(zi) <= s.l1)] = 0.0
        return w

    for _ in range(s.epochs):
        for i in rng.permutation(len(rows)):
            at = np.append(rows[i], bias)
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - labels[i]
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha
            z[at] += g - step * w
            n[at] += g * g
    w = weights(np.arange(size))
    keep = np.flatnonzero(w[:-1])
    return keep, w[keep], float(w[-1])


def _fit(s: Settings):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["order", "id", "label"])
        batch = pa.RecordBatch.from_pandas(group[["id", "text"]], preserve_index=False)
        rows = list(_features(batch, s.bits))
        slots, weights, bias = _ftrl(rows, group.label.to_numpy(dtype=float), s)
        return pd.DataFrame({"slots": [slots.tobytes()], "weights": [weights.tobytes()], "bias": [bias]})

    return run


def train(labelled: DataFrame, settings: Settings = Settings()) -> tuple[np.ndarray, np.ndarray, float]:
    """Model from (id, text, label): at most ``train_rows`` rows, the least in a fixed order of hashed ids.

    Rows without a label, and labels other than 0 and 1, are not used. Without any row, or with one label only, the model still is defined
    (the constant carries the share of label 1).
    """
    ranked = _bounded(labelled.where("label in (0, 1)"), settings.train_rows)
    # the bounded sample is learnt from in one task; only the slots with weights come back
    model = ranked.groupBy(F.lit(0).alias("all")).applyInPandas(_fit(settings), "slots binary, weights binary, bias double").first()
    if model is None:
        return np.zeros(0, np.int64), np.zeros(0), -2.0
    return np.frombuffer(model["slots"], dtype=np.int64), np.frombuffer(model["weights"]), model["bias"]


def _score(model: tuple[np.ndarray, np.ndarray, float], bits: int):
    slots, weights, bias = model

    def run(batches):
        table = np.zeros(1 << bits, dtype=np.float64)
        table[slots] = weights
        for piece in slices(batches, 2048):
            sums = np.array([bias + table[f].sum() for f in _features(piece, bits)])
            score = 1 / (1 + np.exp(-np.clip(sums, -35, 35)))
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(score)], names=["id", "score"])

    return run


def held_out(id_col: Column) -> Column:
    """Rows never learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7, settings: Settings = Settings()) -> DataFrame:
    """(id, held_out, score, predicted) for each row of ``docs``; predicted is 1 from ``threshold`` on.

    Only rows that are not held out are learnt from, and only their text and label. Null text counts as empty; a text without words gets the
    score of the constant. Repeated rows score alike; null ids are scored, not held out and not learnt from. If an id has several labels, each is a row.
    """
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    given = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("label in (0, 1)").where(~held_out(F.col("id")))
    # choose by id before any text moves
    chosen = written(_bounded(given, settings.train_rows), "labels")
    model = train(source.join(small(chosen.drop("order"), settings.train_rows), "id"), settings)
    scored = source.mapInArrow(_score(model, settings.bits), f"id {source.schema['id'].dataType.simpleString()}, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _bounded(given: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` rows, in a fixed order of hashed ids."""
    return given.where("id is not null").withColumn("order", F.xxhash64("id", F.lit(11))).orderBy("order", "id", "label").limit(rows)
