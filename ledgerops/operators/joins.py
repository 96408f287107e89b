"""Joins between tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerops.functions.times import micros, to_micros
from ledgerops.operators.ordered import OrderedRows
from ledgerops.session import cut


def with_child_count(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """Every parent with its number of children; children are counted before the join."""
    counts = children.groupBy(F.col(child_key).alias(parent_key)).agg(F.count(F.lit(1)).alias("child_count"))
    return parents.join(counts, parent_key, "left").withColumn(
        "child_count", F.coalesce("child_count", F.lit(0).cast("bigint"))
    )


def known_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys as a written table.

    Joined as a table, they are broadcast when their measured size is small; otherwise
    both join inputs are plain shuffles, which the adaptive planner may split where one
    key of the other side is hot. An aggregate right below the join would prevent that.
    """
    return cut(df.select(*keys).distinct())


def missing_rows(src: DataFrame, dst: DataFrame, col: str, null_aware: bool = False) -> DataFrame:
    """Source rows whose value is absent in the target.

    ``null_aware`` follows NOT IN: a null in the target leaves nothing, an empty
    target leaves everything. It is resolved with two one-row probes, so the join
    stays an equi anti join instead of one broadcast side.
    """
    seen = known_keys(dst, [col])
    if null_aware:
        if not seen.where(F.col(col).isNull()).isEmpty():
            return src.limit(0)
        if seen.isEmpty():
            return src
        src = src.where(F.col(col).isNotNull())
    return src.join(seen, col, "left_anti")


def deleted_rows(snapshot: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the snapshot whose key is gone from the live table."""
    return snapshot.join(known_keys(live, keys), keys, "left_anti")


def lag_blocks(head: DataFrame, head_col: str, indexed: DataFrame, indexed_col: str) -> DataFrame:
    """Chain head minus indexed head. Both maxima come from one aggregate over a union."""
    both = head.select(F.col(head_col).alias("h"), F.lit(None).cast("bigint").alias("i")).unionByName(
        indexed.select(F.lit(None).cast("bigint").alias("h"), F.col(indexed_col).alias("i"))
    )
    out = both.agg(F.max("h").alias("head"), F.max("i").alias("indexed"))
    return out.withColumn("lag", F.col("head") - F.col("indexed"))


def assign_shard(df: DataFrame, number: str, ranges: list[tuple[int, int, str]]) -> DataFrame:
    """Shard by block-number range ``[lo, hi)``; rows outside every range get null.

    Ranges are configuration, so they become a conditional inside the scan stage
    and rows never move.
    """
    n = F.col(number)
    branches = [F.when((n >= lo) & (n < hi), F.lit(name)) for lo, hi, name in ranges]
    return df.withColumn("shard", F.coalesce(*branches))


def resolve_signature(df: DataFrame, selector: str, sources: list[DataFrame]) -> DataFrame:
    """Signature of each selector from dictionaries in priority order.

    Each dictionary has ``selector`` and ``signature``. They are merged to one row per
    selector and written first, so the large side is joined once: by broadcast when the
    measured size allows, else with hot selectors split by the adaptive planner.
    """
    tagged = [
        s.select("selector", F.struct(F.lit(i).alias("priority"), F.col("signature")).alias("c"))
        for i, s in enumerate(sources, start=1)
    ]
    best = reduce(DataFrame.unionByName, tagged).groupBy("selector").agg(F.min("c").alias("c"))
    best = best.select(
        F.col("selector").alias(selector), F.col("c.signature").alias("signature"), F.col("c.priority").alias("source")
    )
    return df.join(cut(best), selector, "left")


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1))


def url_path(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def route_requests(df: DataFrame, host: str, path: str, routes: list[tuple[str, str, str]]) -> DataFrame:
    """Backend of each request: host must match, then the longest path prefix wins.

    ``routes`` holds (host, prefix, backend); host ``*.x`` matches any name below x and
    yields to an exact host. Prefixes match whole path segments. Routes are
    configuration: they turn into one conditional per row, most specific first.
    """
    def specific(route):
        return (not route[0].startswith("*"), len(route[0]), len(route[1].rstrip("/")))

    h, p = F.lower(F.col(host)), F.col(path)
    branches = []
    for route_host, prefix, backend in sorted(routes, key=specific, reverse=True):
        on_host = h.endswith(route_host[1:]) if route_host.startswith("*") else h == route_host.lower()
        stem = prefix.rstrip("/")
        on_path = (p == stem) | p.startswith(stem + "/") if stem else F.lit(True)
        branches.append(F.when(on_host & on_path, F.lit(backend)))
    return df.withColumn("backend", F.coalesce(*branches) if branches else F.lit(None).cast("string"))


def match_pending(
    pending: DataFrame, mined: DataFrame, key: str, ts: str, tie: str, bound
) -> DataFrame:
    """Each pending row with the first mined row of its key at or after it, within ``bound``.

    One ordered pass over both sides: no pairs are formed, so a key with very many
    rows on both sides stays linear.
    """
    def side(df, kind):
        return df.select(key, ts, F.lit(kind).alias("_kind"), tie)

    is_mined = F.col("_kind") == 1
    ordered = OrderedRows.of(side(pending, 0).unionByName(side(mined, 1)), [key], [ts, "_kind", tie])
    ordered = ordered.upcoming(_next=F.when(is_mined, F.struct(F.col(ts).alias("ts"), F.col(tie).alias("id"))))
    in_time = (micros("_next.ts") - micros(ts)) <= to_micros(bound)
    return ordered.rows.where("_kind = 0").select(
        key,
        ts,
        tie,
        F.when(in_time, F.col("_next.ts")).alias("mined_ts"),
        F.when(in_time, F.col("_next.id")).alias("mined_id"),
    )
