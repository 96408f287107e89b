"""Document fingerprints by one-permutation MinHash, in built-in functions only.

Every shingle is hashed once. The top bits of a hash are its bin, and each bin keeps its least hash. An empty bin takes the value of another bin, which it chooses by hashes of its own
number and the attempt alone, so two documents choose alike (optimal densification). The fingerprint is the low ``BITS`` bits of each bin, packed into longs; results show them in hexadecimal.
Likeness of two fingerprints is the share of equal bins, corrected for equality by chance.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerops.llm.tables import fresh

WIDTH, BIN_BITS, BITS = 5, 8, 8
BINS = 1 << BIN_BITS
_ATTEMPTS = 10
#: Bytes of text in one bucket of neighbouring ids.
_BUCKET = 8 << 20
_SHIFT = 64 - BIN_BITS
_FILL = (1 << _SHIFT) - 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bins in one long of a packed fingerprint, and the lowest bit of each.
_LANES = 64 // BITS
_LANE_ENDS = sum(1 << BITS * i for i in range(_LANES))


def with_packed(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """``df`` with a column ``out``: the fingerprint of the text as ``BINS`` / 8 longs, no longs for texts without words and for null.

    Shingles are ``WIDTH`` words of ASCII lower case; a shorter text is one shingle.
    """
    names = [fresh(n, df.columns) for n in ("words", "sorted", "least", "full", "dense")]
    w, s, d, full, dense = names
    text = F.translate(F.col(f"`{text_col}`"), _UPPER, _LOWER)
    df = df.withColumn(w, F.coalesce(F.array_remove(F.split(text, "[\\x20\\t\\n\\x0B\\f\\r]+"), ""), F.array().cast("array<string>")))
    shingle = lambda i: F.xxhash64(*[F.get(F.col(w), i + j) for j in range(WIDTH)])
    whole, none = F.array(F.xxhash64(F.array_join(w, " "))), F.slice(F.array(F.lit(0).cast("long")), 1, 0)
    hashes = F.when(F.size(w) >= WIDTH, F.transform(F.sequence(F.lit(0), F.size(w) - WIDTH), shingle)).when(F.size(w) > 0, whole).otherwise(none)
    # the greatest value of each bin stands for an empty bin, so that every bin is there; no array here may hold a null, so that plain longs are sorted
    fill = F.array(*[F.lit((b << _SHIFT | _FILL) - (1 << 64 if b >= BINS // 2 else 0)).cast("long") for b in range(BINS)])
    df = df.withColumn(s, F.sort_array(F.concat(hashes, fill)))
    first = F.filter(s, lambda x, i: F.coalesce(F.get(F.col(s), i - 1) < x.bitwiseAND(F.lit(~_FILL)), F.lit(True)))
    df = df.withColumn(d, F.transform(first, lambda x: F.when(x.bitwiseAND(F.lit(_FILL)) != _FILL, x)))
    places = F.array(*[F.lit(i) for i in range(BINS)])
    df = df.withColumn(full, F.filter(places, lambda i: F.get(F.col(d), i).isNotNull()))
    tries = lambda i: [F.get(F.col(d), F.pmod(F.xxhash64(i, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(_ATTEMPTS)]
    # after so many attempts, the full bin that comes first in an order of the empty bin's own
    nearest = lambda i: F.array_min(F.transform(full, lambda j: F.xxhash64(i, F.lit(-1), j).bitwiseAND(F.lit(~(BINS - 1))).bitwiseOR(j.cast("long")))).bitwiseAND(F.lit(BINS - 1)).cast("int")
    df = df.withColumn(dense, F.when(F.size(full) > 0, F.transform(d, lambda x, i: F.coalesce(x, *tries(i), F.get(F.col(d), nearest(i))))))
    low = lambda k, j: F.shiftleft(F.get(F.col(dense), k + j).bitwiseAND(F.lit((1 << BITS) - 1)), 64 - BITS * (j + 1))
    packed = F.transform(F.array(*[F.lit(k) for k in range(0, BINS, _LANES)]), lambda k: reduce(Column.bitwiseOR, [low(k, j) for j in range(_LANES)]))
    return df.withColumn(out, F.when(F.size(w) > 0, packed).otherwise(none)).drop(*names)


def as_text(packed: str) -> Column:
    """A packed fingerprint in hexadecimal, bin by bin; empty for one without longs."""
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def with_fingerprint(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """``df`` with a column ``out``: the fingerprint of the text as text, empty for texts without words and for null."""
    return with_packed(df, text_col, out).withColumn(out, as_text(out))


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity (0 to 1) from two packed fingerprints; two empty ones are alike, an empty one is unlike any other."""

    def unlike(x: Column) -> Column:
        """Lanes of a long that are not zero: the bits of a lane are folded into its lowest."""
        for by in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, by))
        return F.bit_count(x.bitwiseAND(F.lit(_LANE_ENDS)))

    chance = 1 / (1 << BITS)
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: unlike(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    estimate = F.greatest(F.lit(0.0), ((BINS - differ) / BINS - chance) / (1 - chance))
    return F.when(F.col(a) == F.col(b), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(estimate)


def _buckets(rows: DataFrame) -> list[int]:
    """First ids of all buckets but the lowest."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + size // _BUCKET
    if n < 2:
        return []
    cuts = rows.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 20 * n)).first()[0] or []
    least = rows.agg(F.min("id")).first()[0]
    return sorted(c for c in set(cuts) if c > least)


def with_next(df: DataFrame, id_col: str, keep: dict[str, str]) -> DataFrame:
    """``df`` (with a column ``text``) and the columns ``keep`` of the next row by id, equal ids by text, null ids last; the first row follows the last.

    Ids are cut into buckets, each bucket's first rows are copied to the bucket before, and each bucket is put in order by itself.
    """
    rows = df.withColumnRenamed(id_col, "id")
    cuts = _buckets(rows.select("id", "text"))
    outer = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + outer] for i in range(0, len(cuts), outer)]
    heads = F.from_json(F.lit(str([g[0] for g in groups])), "array<bigint>")
    tails = F.from_json(F.lit(str([g[1:] for g in groups] or [[]])), "array<array<bigint>>")
    passed = F.size(F.filter(heads, lambda c: c <= F.col("id")))
    inner = F.size(F.filter(F.get(tails, F.col("passed") - 1), lambda c: c <= F.col("id")))
    bucket = F.when(F.col("id").isNull(), F.lit(len(cuts))).when(F.col("passed") > 0, (F.col("passed") - 1) * outer + 1 + inner).otherwise(0)
    rows = rows.withColumn("passed", passed).withColumn("bucket", bucket.cast("int")).drop("passed")
    least = rows.agg(F.min("id")).first()[0]
    starts = F.from_json(F.lit(str(cuts)), "array<bigint>")
    is_cut = F.col("id") == F.get(starts, F.col("bucket") - 1)
    # (bucket, turn): own place, copy at the end of the bucket before, and the first rows of all once more at the very end
    first = F.col("id").eqNullSafe(F.lit(least))
    places = F.array_compact(F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("turn")), F.when(is_cut, F.struct((F.col("bucket") - 1).alias("b"), F.lit(1).alias("turn"))), F.when(first, F.struct(F.lit(len(cuts)).alias("b"), F.lit(2).alias("turn")))))
    rows = rows.withColumn("place", F.explode(places)).drop("bucket")
    order = Window.partitionBy("place.b").orderBy("place.turn", F.asc_nulls_last("id"), F.asc_nulls_first("text"))
    out = rows.withColumns({new: F.lead(old).over(order) for old, new in keep.items()}).where("place.turn = 0").drop("place")
    return out.withColumnRenamed("id", id_col)


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each row's text and of its edited text, and how alike they are to each other and to the next row's.

    The edited text has its last floor(n / 4) code points replaced by the first as many, or all, of the next document's text, by ascending integer id; after the last comes the
    first. Null texts are empty. Rows that repeat an id follow each other by text; null ids come last. A single row follows itself.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = with_packed(rows, "text", "fingerprint")
    rows = with_next(rows, "doc", {"text": "next_text", "fingerprint": "next_fingerprint"})
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))).drop("text", "next_text")
    rows = with_packed(rows, "edited", "edited_fingerprint")
    return rows.select(
        F.col("doc").alias(id_col), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text("fingerprint").alias("fingerprint"), as_text("edited_fingerprint").alias("edited_fingerprint"),
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )
