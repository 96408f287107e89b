"""Benchmark decontamination by winnowing, in built-in functions only.

Of every ``WINDOW`` - ``K`` + 1 consecutive hashes of ``K`` words the least is kept, in documents and benchmark items alike, so any ``WINDOW`` words that both have share a kept
hash at the same distance. Kept hashes are joined; each hit is extended to every window of the document that holds it, and those that are windows of an item
are the shared spans. Items with fewer words have no full window; the hash of the whole item is kept for them, and hashes of
as many words at every place of the documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerops.llm.tables import BROADCAST_ROWS, fresh, written

WINDOW, K = 10, 5
#: Low bits of a kept value are the place of its first word, from 1; the bits above are the hash.
_PLACE = (1 << 28) - 1
_GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text, ASCII letters in lower case; none for null."""
    return F.coalesce(F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), _GAP), ""), F.array().cast("array<string>"))


def _grams(array: str, k: int, tag: int) -> Column:
    """Hash of ``k`` words with its place, for each place of the array."""
    count = F.size(array) - (k - 1)
    value = lambda i: F.xxhash64(F.lit(tag), *[F.get(F.col(array), i + (j - 1)) for j in range(k)]).bitwiseAND(F.lit(~_PLACE)).bitwiseOR(i.cast("long"))
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), value)).otherwise(F.array().cast("array<bigint>"))


def _kept(grams: str) -> Column:
    """Least value of each run of hashes that a window covers."""
    covered = WINDOW - K + 1
    runs = F.size(grams) - (covered - 1)
    least = lambda j: F.least(*[F.get(F.col(grams), j + (i - 1)) for i in range(covered)])
    return F.when(runs > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), runs), least))).otherwise(F.array().cast("array<bigint>"))


def _fingerprints(df: DataFrame, array: str, lengths: list[int]) -> DataFrame:
    """Adds ``kept``: values of all full windows, and of each short length.

    To be unfolded by explode_outer: explode would filter on the array's size first, and make it twice.
    """
    df = df.withColumn("grams", _grams(array, K, 0))
    kept = [_kept("grams"), *[_grams(array, n, n) for n in lengths]]
    return df.withColumn("kept", F.concat(*kept)).drop("grams")


def _side(df: DataFrame, entries: Column | None = None) -> DataFrame:
    """``df``, to be broadcast if its rows, or the ``entries`` they list in all, are within the bound."""
    n = df.count() if entries is None else df.agg(F.sum(entries)).first()[0] or 0
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def _windows(df: DataFrame, array: str, places: str) -> DataFrame:
    """``df`` with a row for each window of the list ``places`` of (span, start): columns ``span``, ``start`` (from 0), and the window's name ``wa``, ``wb``.

    A window is named by two hashes of all its words, 128 bits in all.
    """
    name = lambda tag, p: F.xxhash64(F.lit(tag), p.span, *[F.when(p.span > t, F.get(F.col(array), p.start + t)) for t in range(WINDOW)])
    named = F.transform(places, lambda p: F.struct(p.span.alias("span"), p.start.alias("start"), name(-1, p).alias("wa"), name(-2, p).alias("wb")))
    return df.select(*[c for c in df.columns if c not in (array, places)], F.inline(named))


def spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All words of documents that lie in a window of an item, and the items met.

    First (id, text_hash, place): a row per word hit, places from 0; second (id, text_hash, item_id): a row per document and item. Rows that are equal in id and text
    count once here. A passage that many items share is one set of windows, whoever has it: between documents and items there is one row per place of a document, and documents
    meet classes of windows with the same items, not items, until the second result is made.
    """
    items = benchmark.select(F.col(f"`{item_col}`").alias("item_id"), words(F.col(f"`{item_text_col}`").cast("string")).alias("item")).where(F.size("item") > 0)
    items = written(items.groupBy("item").agg(F.collect_set("item_id").alias("item_ids")).withColumn("rep", F.xxhash64("item")).withColumn("len", F.size("item")), "items")
    lengths = [r[0] for r in items.where(F.col("len") < WINDOW).select("len").distinct().orderBy("len").collect()]  # at most 9 values
    value = F.explode_outer("kept").alias("v")
    parts = [_fingerprints(items.where(F.col("len") >= WINDOW), "item", []).select(F.lit(WINDOW).alias("span"), value)]
    for n in lengths:
        parts.append(items.where(F.col("len") == n).select(F.lit(n).alias("span"), F.explode_outer(_grams("item", n, n)).alias("v")))
    hash_of, place_of = F.col("v").bitwiseAND(F.lit(~_PLACE)), F.col("v").bitwiseAND(F.lit(_PLACE)).cast("int")
    marks = written(reduce(DataFrame.unionByName, parts).select(hash_of.alias("h"), "span").distinct(), "marks")

    # every window of the items, once
    span = F.least(F.col("len"), F.lit(WINDOW))
    all_places = F.transform(F.sequence(F.lit(0), F.col("len") - span), lambda p: F.struct(span.alias("span"), p.alias("start")))
    held = _windows(items.select("rep", "item", all_places.alias("places")), "item", "places").groupBy("wa", "wb").agg(F.sort_array(F.collect_set("rep")).alias("reps"))
    held = written(held.withColumn("class", F.xxhash64("reps")), "windows")

    text = F.col(f"`{text_col}`").cast("string")
    source = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")).where("text is not null")
    read = source.select("id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    found = _fingerprints(read, "w", lengths).select("id", "text_hash", value).select("id", "text_hash", hash_of.alias("h"), place_of.alias("p"))
    hits = found.join(_side(marks), "h").groupBy("id", "text_hash").agg(F.collect_set(F.struct("span", "p")).alias("hits"))
    hits = written(hits, "hits")

    # the documents with hits once more: each hit extends to all windows that hold it (rows that repeat a document repeat its windows, which add no words)
    again = source.withColumn("text_hash", F.xxhash64("text"))
    side = _side(hits.select(F.col("id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), "hits"), F.size("hits"))
    again = again.join(side, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash"))).select("id", "text_hash", words(F.col("text")).alias("w"), "hits")
    first = lambda h: F.greatest(F.lit(0), F.when(h.span < WINDOW, h.p - 1).otherwise(h.p - 1 - (WINDOW - K)))
    last = lambda h: F.least(F.size("w") - h.span, h.p - 1)
    around = lambda h: F.when(first(h) <= last(h), F.transform(F.sequence(first(h), last(h)), lambda p: F.struct(h.span.alias("span"), p.alias("start"))))
    near = F.array_distinct(F.flatten(F.array_compact(F.transform("hits", around))))
    near = _windows(again.select("id", "text_hash", "w", near.alias("places")), "w", "places")
    shared = written(near.join(_side(held.select("wa", "wb", "class")), ["wa", "wb"]).select("id", "text_hash", "span", "start", "class"), "shared")

    # windows of one document, in order: each adds the words that none before it has
    before = Window.partitionBy("id", "text_hash").orderBy("start", "span").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.coalesce(F.max(F.col("start") + F.col("span")).over(before), F.lit(0))
    fresh_words = shared.select("id", "text_hash", F.greatest(F.col("start"), upto).alias("lo"), (F.col("start") + F.col("span") - 1).alias("hi")).where("lo <= hi")
    places = fresh_words.select("id", "text_hash", F.explode(F.sequence("lo", "hi")).alias("place"))

    classes = held.groupBy("class").agg(F.first("reps").alias("reps")).select("class", F.explode("reps").alias("rep"))
    named = classes.join(items.select("rep", F.explode("item_ids").alias("item_id")), "rep").select("class", "item_id").distinct()
    met = shared.select("id", "text_hash", "class").distinct().join(named, "class").select("id", "text_hash", "item_id").distinct()
    return places, met


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of ``docs``.

    A word is hit if it lies in any occurrence of a window of ``WINDOW`` consecutive words of an item, or of all words of a shorter item. Null and empty texts and items
    have no words. Rows that repeat an id are judged each by its text. Items with equal words each count; an item that repeats an id counts once, and an item
    without an id hits words but is not counted.
    """
    places, met = spans(docs, benchmark, id_col, text_col, item_col, item_text_col)
    names = met.groupBy("id", "text_hash").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    per_doc = places.groupBy("id", "text_hash").agg(F.count("*").alias("n_hit"))
    key = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["text_hash"] == b["text_hash"])
    hit = per_doc.join(names, key(per_doc, names), "left").select(per_doc["id"].alias("hit_id"), per_doc["text_hash"].alias("hit_hash"), "n_hit", "items")
    joined = F.array_join(F.coalesce("items", F.array().cast("array<string>")), ",")
    hit = written(hit.select("hit_id", "hit_hash", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined.cast("binary"), 256).alias("items_sha256")), "hit")
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("text_hash"), F.size(words(text)).cast("long").alias("n_words"))
    out = rows.join(_side(hit), F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")), "left")
    return out.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.greatest(F.lit(0), "n_items").cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a hit word, all columns as they are. Null and empty texts stay."""
    places, _ = spans(docs, benchmark, id_col, text_col, item_col, item_text_col)
    mark = fresh("hit", docs.columns)
    hit = written(places.select(F.col("id").alias(f"{mark}_id"), F.col("text_hash").alias(f"{mark}_hash")).distinct(), "hit")
    own_hash = F.xxhash64(F.col(f"`{text_col}`").cast("string"))
    return docs.join(_side(hit), F.col(f"`{id_col}`").eqNullSafe(F.col(f"{mark}_id")) & (own_hash == F.col(f"{mark}_hash")), "left_anti")
