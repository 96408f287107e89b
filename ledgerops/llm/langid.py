"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed letter n-grams (1 to 3 code points, over words with one space around) are added up per language over all learnt rows, in map
tasks first; the table of log-probabilities has one row per language and a fixed number of slots, and goes to every task. Texts are scored in sparse
batches: the table's rows for the distinct slots of each text, weighed by their counts and added up. Very long texts are scored whole; a text has at most
as many distinct slots as the table has rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerops.llm import words as W
from ledgerops.llm.tables import slices

BITS = 13
UNKNOWN = "und"
_ORDERS = (1, 2, 3)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case letter of each code point of the first plane, 0x20 for what is no letter."""
    out = np.full(1 << 16, 0x20, dtype=np.uint32)
    for c in range(1 << 16):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def _codes(text: str) -> np.ndarray:
    """Lower-case letters of the text, runs of anything else as one space, with a space at both ends; empty without letters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    table = _letters()
    high = points >= 1 << 16
    if high.any():
        folded = np.where(high, 0x20, points)
        out = table[folded]
        at = np.flatnonzero(high)
        out[at] = [c if chr(c).isalpha() else 0x20 for c in points[at].tolist()]
    else:
        out = table[points]
    gap = out == 0x20
    if gap.all():
        return out[:0]
    out = np.concatenate([[np.uint32(0x20)], out, [np.uint32(0x20)]])
    gap = out == 0x20
    return out[~(gap & np.concatenate([[False], gap[:-1]]))]


def slots(text: str, bits: int) -> np.ndarray:
    """Slot of each n-gram of the text, orders one after the other."""
    codes = _codes(text)
    if not len(codes):
        return np.zeros(0, np.int64)
    c = (codes.astype(np.uint64) + np.uint64(1)) * W._BASE
    c ^= c >> np.uint64(29)
    shift, out = np.uint64(64 - bits), []
    state = np.zeros(len(c), dtype=np.uint64)
    for order in _ORDERS:
        if len(c) < order:
            break
        state = (state[: len(c) - order + 1] * W._M1 + c[order - 1 :]) * W._M2
        state ^= state >> np.uint64(31)
        out.append(((state * W._BASE) >> shift).astype(np.int64))
    return np.concatenate(out)


def _counts(bits: int):
    """Per task and language, the n-grams of all texts."""

    def run(batches):
        totals: dict[str, np.ndarray] = {}
        for piece in slices(batches, 2048):
            languages = piece.column(0).to_pylist()
            for lang, text in zip(languages, piece.column(1).to_pylist()):
                s = slots(text or "", bits)
                if lang not in totals:
                    totals[lang] = np.zeros(1 << bits, dtype=np.int64)
                if len(s):
                    totals[lang] += np.bincount(s, minlength=1 << bits)
            if len(totals) > 64:  # many labels: what is counted so far goes on
                yield _count_rows(totals)
                totals = {}
        if totals:
            yield _count_rows(totals)

    return run


def _count_rows(totals: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(totals)), pa.array([t.tobytes() for t in totals.values()])], names=["lang", "counts"])


def _add(group: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(len(group.counts.iloc[0]) // 8, dtype=np.int64)
    for c in group.counts:
        total += np.frombuffer(c, dtype=np.int64)
    return pd.DataFrame({"lang": [group.lang.iloc[0]], "counts": [total.tobytes()]})


def train(learnt: DataFrame, bits: int = BITS) -> tuple[list[str], np.ndarray]:
    """Languages, and their table of log-probabilities (slots x languages), from rows (lang, text).

    Priors are uniform; every slot counts half an occurrence more than seen. Without rows there is no language.
    """
    rows = learnt.mapInArrow(_counts(bits), "lang string, counts binary").groupBy("lang").applyInPandas(_add, "lang string, counts binary").orderBy("lang").collect()
    if not rows:
        return [], np.zeros((1 << bits, 0), np.float32)
    counts = np.stack([np.frombuffer(r["counts"], dtype=np.int64) for r in rows], axis=1) + 0.5
    return [r["lang"] for r in rows], np.log(counts / counts.sum(axis=0)).astype(np.float32)


#: Entries (text and distinct slot) that are scored at once: so many rows of the table are gathered.
ENTRIES = 1 << 16


def _likelihoods(texts: list[str | None], table: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of each text in each language, and which texts have a letter.

    A batch is sparse: distinct slots and their counts of one text after the other. Their rows of the table are gathered, weighed and added up per text.
    """
    likely, known = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts), dtype=bool)
    held: list[tuple[int, np.ndarray, np.ndarray]] = []

    def score() -> None:
        if held:
            starts = np.concatenate([[0], np.cumsum([len(s) for _, s, _ in held])[:-1]])
            weighed = table[np.concatenate([s for _, s, _ in held])] * np.concatenate([c for _, _, c in held])[:, None].astype(np.float64)
            likely[[i for i, _, _ in held]] = np.add.reduceat(weighed, starts, axis=0)
            held.clear()

    entries = 0
    for i, text in enumerate(texts):
        found = slots(text or "", bits)
        if len(found):
            known[i] = True
            held.append((i, *np.unique(found, return_counts=True)))
            entries += len(held[-1][1])
            if entries >= ENTRIES:
                score()
                entries = 0
    score()
    return likely, known


def _predict(languages: list[str], table: np.ndarray, bits: int):
    def run(batches):
        for piece in slices(batches, 256):
            texts = piece.column(1).to_pylist()
            likely, known = _likelihoods(texts, table, bits)
            if languages:
                best = likely.argmax(axis=1)
                score = 1 / np.exp(likely - likely.max(axis=1, keepdims=True)).sum(axis=1)
            else:
                best, score, known = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts), bool)
            names = [languages[b] if k else UNKNOWN for b, k in zip(best, known)]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(names, type=pa.string()), pa.array(np.where(known, score, 0.0))], names=["id", "lang_pred", "score"])

    return run


def held_out(id_col: Column) -> Column:
    """Rows never learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bits: int = BITS) -> DataFrame:
    """(id, held_out, lang_pred, score) for each row of ``docs``.

    Learns from text and label of all rows that are not held out and have a label and an id. Null texts and texts without a letter give ``und`` and score 0; so does
    everything if there is nothing to learn from. The score is the posterior of the language under equal priors; of equal ones the first by name wins.
    Repeated rows are learnt from and scored one by one.
    """
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    languages, table = train(source.where("lang is not null and id is not null and text is not null").where(~held_out(F.col("id"))).select("lang", "text"), bits)
    kind = docs.schema[id_col].dataType.simpleString()
    out = source.select("id", "text").mapInArrow(_predict(languages, table, bits), f"id {kind}, lang_pred string, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")


def with_known_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` in one of the learnt languages: those the model calls ``und``, or is less sure of than ``least``, go.

    Learns like ``identify``; rows are judged by their text alone, so repeated rows stay or go together.
    """
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    languages, table = train(source.where("lang is not null and id is not null and text is not null").where(~held_out(F.col("id"))).select("lang", "text"))
    predict, at = _predict(languages, table, BITS), docs.columns.index(text_col)

    def run(batches):
        for piece in slices(batches, 256, text=at):
            text = piece.column(at)
            for got in predict(iter([pa.RecordBatch.from_arrays([pa.array(range(piece.num_rows)), text], names=["id", "text"])])):
                sure = pa.compute.and_(pa.compute.not_equal(got.column(1), UNKNOWN), pa.compute.greater_equal(got.column(2), least))
                rows = got.column(0).filter(sure)
                yield piece.take(rows)

    return docs.mapInArrow(run, docs.schema)
