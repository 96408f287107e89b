"""Joins over stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerops.operators import joins
from ledgerops.plans.registry import query
from ledgerops.sources.tables import load_table


@query(
    "j03_with_child_count",
    "SELECT o_orderkey, o_orderstatus, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS child_count FROM orders",
)
def children(spark, sf):
    orders = load_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return joins.with_child_count(orders, load_table(spark, sf, "lineitem"), "o_orderkey", "l_orderkey")


@query(
    "j04_missing_rows_null_aware",
    """SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate NOT IN (SELECT o_orderdate FROM orders WHERE o_orderstatus = 'F')""",
)
def not_in(spark, sf):
    orders = load_table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    missing = joins.missing_rows(orders, orders.where("o_orderstatus = 'F'"), "o_orderdate", null_aware=True)
    return missing.select("o_orderkey", "o_orderdate")


@query(
    "j04_missing_rows",
    "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A')",
)
def not_exists(spark, sf):
    moved = load_table(spark, sf, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.missing_rows(load_table(spark, sf, "orders").select("o_orderkey"), moved, "o_orderkey")


@query(
    "j07_lag_blocks",
    """SELECT (SELECT max(o_orderkey) FROM orders) AS head, (SELECT max(l_orderkey) FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber = 7) AS indexed,
       (SELECT max(o_orderkey) FROM orders) - (SELECT max(l_orderkey) FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber = 7) AS lag""",
)
def lag(spark, sf):
    done = load_table(spark, sf, "lineitem").where("l_returnflag = 'A' AND l_linenumber = 7")
    return joins.lag_blocks(load_table(spark, sf, "blocks"), "number", done, "l_orderkey")


@query(
    "j10_assign_shard",
    """SELECT o_orderkey AS number, CASE WHEN o_orderkey < 5000 THEN 'shard-1' WHEN o_orderkey < 10000 THEN 'shard-2'
       WHEN o_orderkey >= 11000 AND o_orderkey < 14000 THEN 'shard-3' END AS shard FROM orders""",
)
def shards(spark, sf):
    ranges = [(0, 5000, "shard-1"), (5000, 10000, "shard-2"), (11000, 14000, "shard-3")]
    return joins.assign_shard(load_table(spark, sf, "blocks").select("number"), "number", ranges)


@query(
    "j11_resolve_signature",
    """SELECT l_orderkey, l_linenumber, l_partkey AS selector, CASE WHEN l_partkey % 4 = 0 THEN concat('a:', p_name)
         WHEN l_partkey % 3 = 0 THEN concat('b:', p_name) WHEN l_partkey % 2 = 0 THEN concat('c:', p_name) END AS signature,
       CASE WHEN l_partkey % 4 = 0 THEN 1 WHEN l_partkey % 3 = 0 THEN 2 WHEN l_partkey % 2 = 0 THEN 3 END AS source
       FROM lineitem JOIN part ON p_partkey = l_partkey""",
)
def signatures(spark, sf):
    part = load_table(spark, sf, "part")
    sources = [
        part.where(F.col("p_partkey") % m == 0).select(
            F.col("p_partkey").alias("selector"), F.concat(F.lit(f"{tag}:"), "p_name").alias("signature")
        )
        for tag, m in (("a", 4), ("b", 3), ("c", 2))
    ]
    calls = load_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("selector"))
    return joins.resolve_signature(calls, "selector", sources)


@query(
    "j12_deleted_rows",
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01')",
)
def deleted(spark, sf):
    snapshot = load_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    live = snapshot.where("o_orderdate < TIMESTAMP_NTZ '2000-01-01'")
    return joins.deleted_rows(snapshot, live, ["o_orderkey"]).drop("o_orderdate")


_ROUTES = [
    ("*.example.com", "/fr", "fr-com"), ("*.example.com", "/", "web-com"), ("*.example.org", "/en", "en-org"),
    ("*.example.org", "/", "web-org"), ("*.example.net", "/de", "de-net"),
]
_PATH = "'^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)'"


@query(
    "j13_route_requests",
    f"""SELECT page_id, h AS host, CASE WHEN p = '' THEN '/' ELSE p END AS path,
        CASE WHEN h LIKE '%.example.com' THEN CASE WHEN p = '/fr' OR p LIKE '/fr/%' THEN 'fr-com' ELSE 'web-com' END
             WHEN h LIKE '%.example.org' THEN CASE WHEN p = '/en' OR p LIKE '/en/%' THEN 'en-org' ELSE 'web-org' END
             WHEN h LIKE '%.example.net' AND (p = '/de' OR p LIKE '/de/%') THEN 'de-net' END AS backend
        FROM (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)) AS h,
                     regexp_extract(url, {_PATH}, 1) AS p FROM pages) q""",
)
def routed(spark, sf):
    requests = load_table(spark, sf, "pages").select(
        "page_id", joins.url_host(F.col("url")).alias("host"), joins.url_path(F.col("url")).alias("path")
    )
    return joins.route_requests(requests, "host", "path", _ROUTES)


@query(
    "j14_match_pending",
    """SELECT p.user_id, p.ts, p.event_id, CASE WHEN epoch_us(m.ts) - epoch_us(p.ts) <= 21600000000 THEN m.ts END AS mined_ts,
       CASE WHEN epoch_us(m.ts) - epoch_us(p.ts) <= 21600000000 THEN m.event_id END AS mined_id
       FROM (SELECT * FROM events WHERE event_type = 'view') p
       ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') m ON p.user_id = m.user_id AND p.ts <= m.ts""",
)
def matched(spark, sf):
    events = load_table(spark, sf, "events")
    return joins.match_pending(
        events.where("event_type = 'view'"), events.where("event_type = 'purchase'"), "user_id", "ts", "event_id", "6 hours"
    )
