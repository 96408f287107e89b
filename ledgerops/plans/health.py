"""Health, restore and quality reports over stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerops.operators import health, quality
from ledgerops.plans.inputs import age_sql, now_of, now_sql, view_sql
from ledgerops.plans.registry import query
from ledgerops.sources.tables import load_table

_TABLES = (("blocks", "orders", "o_orderdate"), ("transactions", "lineitem", "l_shipdate"), ("logs", "lineitem", "l_shipdate"))


@query(
    "a01_data_age",
    " UNION ALL ".join(
        f"SELECT {age_sql(f'min({c})', now_sql('lineitem'))} AS oldest_age_seconds, count(*) AS row_count, '{n}' AS table_name FROM {t}"
        for n, t, c in _TABLES
    ),
)
def data_age(spark, sf):
    tables = {n: (load_table(spark, sf, n), "inserted_at") for n, _, _ in _TABLES}
    return health.data_ages(tables, now_of(spark, sf, "lineitem"))


@query(
    "a02_indexing_progress",
    f"""SELECT max(o_orderkey) AS latest_number, count(*) AS total_rows,
        {age_sql('max(o_orderdate)', now_sql('orders'))} AS seconds_since_latest FROM orders""",
)
def progress(spark, sf):
    return health.indexing_progress(load_table(spark, sf, "blocks"), "number", "inserted_at", now_of(spark, sf, "orders"))


def _sizes(spark, sf):
    return health.table_sizes(spark, {t: f"{sf}/{t}.parquet" for t in ("orders", "lineitem", "events")})


@query(
    "a03_table_sizes",
    " UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, 1::BIGINT AS files, count(*) AS "rows", true AS has_data, true AS adds_up, true AS largest_is_data FROM {t}"""
        for t in ("orders", "lineitem", "events")
    ),
)
def table_sizes(spark, sf):
    """Bytes depend on the writer, so what must hold between them is compared; tests compare the bytes with the file system's."""
    return _sizes(spark, sf).select(
        "table_name", "files", "rows", (F.col("data_bytes") > 0).alias("has_data"),
        (F.col("data_bytes") + F.col("rest_bytes") == F.col("total_bytes")).alias("adds_up"),
        (F.col("largest_bytes") * F.col("files") >= F.col("data_bytes")).alias("largest_is_data"),
    )


@query(
    "a03_table_rows",
    """SELECT 'orders' AS table_name, 1::BIGINT AS files, count(*) AS "rows", true AS has_bytes FROM orders
       UNION ALL SELECT 'lineitem', 1, count(*), true FROM lineitem UNION ALL SELECT 'events', 1, count(*), true FROM events""",
)
def table_rows(spark, sf):
    return _sizes(spark, sf).select("table_name", "files", "rows", (F.col("total_bytes") > 0).alias("has_bytes"))


_STATS = """SELECT 'public' AS schemaname, concat('table_', CAST(l_suppkey AS STRING)) AS relname,
  count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS n_dead_tup,
  CASE WHEN l_suppkey % 10 = 0 THEN 0 ELSE count(CASE WHEN l_returnflag = 'N' THEN 1 END) END AS n_live_tup
  FROM {lineitem} GROUP BY l_suppkey"""


@query(
    "a04_churn_ratio",
    f"""SELECT schemaname, relname AS tablename, n_dead_tup AS dead_rows, n_live_tup AS live_rows,
        CASE WHEN n_live_tup > 0 THEN n_dead_tup / n_live_tup ELSE 0 END AS dead_ratio FROM ({_STATS.format(lineitem='lineitem')}) s""",
)
def churn(spark, sf):
    return health.churn_ratio(spark.sql(_STATS, lineitem=load_table(spark, sf, "lineitem")))


@query(
    "a04_superseded_ratio",
    """SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS dead_rows, count(DISTINCT (l_orderkey, l_linenumber)) AS live_rows,
       (count(*) - count(DISTINCT (l_orderkey, l_linenumber))) / count(DISTINCT (l_orderkey, l_linenumber)) AS dead_ratio FROM lineitem""",
)
def superseded(spark, sf):
    return health.superseded_ratio(load_table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


_EVENT_TIMES = """SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END) AS last_vacuum,
  max(CASE WHEN o_orderstatus = 'O' THEN o_orderdate END) AS last_autovacuum,
  max(CASE WHEN o_orderstatus = 'P' THEN o_orderdate END) AS last_analyze,
  max(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate END) AS last_autoanalyze FROM {orders} GROUP BY o_custkey"""
_FOUR = ("last_vacuum", "last_autovacuum", "last_analyze", "last_autoanalyze")


@query(
    "a05_seconds_since",
    "SELECT o_custkey, " + ", ".join(f"coalesce({age_sql(c, now_sql('orders'))}, 0) AS seconds_since_{c}" for c in _FOUR)
    + f" FROM ({_EVENT_TIMES.format(orders='orders')}) s",
)
def since(spark, sf):
    stats = spark.sql(_EVENT_TIMES, orders=load_table(spark, sf, "orders"))
    return health.seconds_since(stats, ["o_custkey"], list(_FOUR), now_of(spark, sf, "orders"))


@query("a06_count_by", 'SELECT o_orderstatus, count(*) AS "count" FROM orders GROUP BY 1')
def states(spark, sf):
    return health.count_by(load_table(spark, sf, "orders"), "o_orderstatus")


@query(
    "a07_sum_ratio",
    "SELECT sum(l_quantity) AS sum_a, sum(CAST(l_linenumber AS DOUBLE)) AS sum_b, sum(l_quantity) / (sum(l_quantity) + sum(l_linenumber)) AS ratio FROM lineitem",
)
def hit_ratio(spark, sf):
    return health.sum_ratio(load_table(spark, sf, "lineitem"), "l_quantity", "l_linenumber")


@query(
    "a08_duplicate_keys",
    """SELECT count(*) AS distinct_keys, count(*) FILTER (WHERE n > 1) AS duplicated_keys, CAST(sum(n - 1) AS BIGINT) AS surplus_rows, 0::BIGINT AS null_key_rows
       FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) q""",
)
def duplicates(spark, sf):
    return quality.duplicate_keys(load_table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


_ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@query(
    "a09_column_profile",
    "SELECT attname, n_distinct, round(correlation, 6) AS correlation, coalesce(n_distinct > 100 AND correlation < 0.1, false) AS candidate FROM ("
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS attname, count(DISTINCT v) AS n_distinct, corr(pos, rk) AS correlation FROM (SELECT {c} AS v,
            row_number() OVER (ORDER BY {_ORDER}) AS pos, rank() OVER (ORDER BY {c}) AS rk FROM lineitem) q"""
        for c in ("l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_shipdate")
    )
    + ") p",
)
def profile(spark, sf):
    lines = load_table(spark, sf, "lineitem")
    cols = ["l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_shipdate"]
    return health.column_profile(lines, cols, _ORDER.split(", ")).withColumn("correlation", F.round("correlation", 6))


_PROFILED = ("l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_shipdate")


@query(
    "a09_column_profile_approx",
    " UNION ALL ".join(f"SELECT '{c}' AS attname, true AS count_is_near, true AS correlation_is_near, true AS same_flag" for c in _PROFILED),
)
def profile_approx(spark, sf):
    """The sketched profile beside the exact one: counts within 5 per cent, correlations within 0.05."""
    lines = load_table(spark, sf, "lineitem")
    exact, near = (health.column_profile(lines, list(_PROFILED), _ORDER.split(", "), approx).alias(n) for n, approx in (("e", False), ("a", True)))
    return near.join(exact, "attname").select(
        "attname", (F.abs(F.col("a.n_distinct") / F.col("e.n_distinct") - 1) <= 0.05).alias("count_is_near"),
        (F.abs(F.col("a.correlation") - F.col("e.correlation")) <= 0.05).alias("correlation_is_near"),
        (F.col("a.candidate") == F.col("e.candidate")).alias("same_flag"),
    )


@query(
    "a10_restore_summary",
    """SELECT count(*) AS row_count, max(o_orderkey) AS max_number, 'blocks' AS table_name FROM orders
       UNION ALL SELECT count(*), max(l_orderkey), 'transactions' FROM lineitem
       UNION ALL SELECT count(*), NULL, 'samples' FROM events""",
)
def restored(spark, sf):
    return health.restore_summary(
        {
            "blocks": (load_table(spark, sf, "blocks"), "number"),
            "transactions": (load_table(spark, sf, "transactions"), "block_number"),
            "samples": (load_table(spark, sf, "samples"), None),
        }
    )


@query("a12_control_range", "SELECT min(o_orderdate) AS oldest, max(o_orderdate) AS newest FROM orders")
def control_range(spark, sf):
    return health.control_range(load_table(spark, sf, "blocks"), "inserted_at")


@query(
    "a14_totals",
    f"""SELECT (SELECT count(*) FROM orders) AS total_blocks, (SELECT count(*) FROM lineitem) AS total_transactions,
        (SELECT count(DISTINCT a) FROM (SELECT from_address_hash AS a FROM {view_sql('transactions')} UNION ALL
         SELECT to_address_hash FROM {view_sql('transactions')}) q) AS total_addresses""",
)
def totals(spark, sf):
    return health.totals(
        load_table(spark, sf, "blocks"), load_table(spark, sf, "transactions"), "from_address_hash", "to_address_hash"
    )


@query(
    "w09_stalls",
    f"""WITH r AS (SELECT ts, event_id, false AS open FROM events UNION ALL SELECT {now_sql('events')}, NULL, true),
        g AS (SELECT lag(ts) OVER (ORDER BY ts, open, event_id) AS gap_start, ts AS gap_end, open FROM r)
        SELECT gap_start, gap_end, (epoch_us(gap_end) - epoch_us(gap_start)) / 1e6 AS gap_seconds, open FROM g
        WHERE (epoch_us(gap_end) - epoch_us(gap_start)) / 1e6 > 600""",
)
def stalls(spark, sf):
    return health.stalls(load_table(spark, sf, "events"), "ts", 600, now_of(spark, sf, "events"))


_CHECKS = [
    quality.Check("o_orderkey", "required"),
    quality.Check("o_custkey", "min", 10),
    quality.Check("o_totalprice", "max", 400000.0),
    quality.Check("o_orderstatus", "enum", ["F", "O"]),
    quality.Check("o_orderpriority", "pattern", "^[1-4]-"),
    quality.Check("o_orderpriority", "type", "int"),
]
_BROKEN = {
    "o_orderkey:required": "o_orderkey IS NULL", "o_custkey:min": "o_custkey < 10", "o_totalprice:max": "o_totalprice > 400000",
    "o_orderstatus:enum": "o_orderstatus NOT IN ('F', 'O')", "o_orderpriority:pattern": "NOT regexp_matches(o_orderpriority, '^[1-4]-')",
    "o_orderpriority:type": "try_cast(o_orderpriority AS INT) IS NULL",
}


@query(
    "v01_validate",
    " UNION ALL ".join(
        f"""SELECT '{k.split(":")[0]}' AS column_name, '{k.split(":")[1]}' AS rule, count(*) FILTER (WHERE {c}) AS violations, count(*) AS "rows" FROM orders"""
        for k, c in _BROKEN.items()
    ),
)
def validated(spark, sf):
    return quality.validate(load_table(spark, sf, "orders"), _CHECKS)


@query(
    "v01_violating_rows",
    "SELECT o_orderkey, concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in list(_BROKEN.items())[:5])
    + ") AS failed FROM orders WHERE " + " OR ".join(list(_BROKEN.values())[:5]),
)
def violating(spark, sf):
    found = quality.violating_rows(load_table(spark, sf, "orders"), _CHECKS[:5])
    return found.select("o_orderkey", F.concat_ws(",", "failed").alias("failed"))


@query(
    "v02_fill_defaults",
    """SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic, 'human' AS rater
       FROM documents LEFT JOIN labels USING (doc_id)""",
)
def filled(spark, sf):
    rows = load_table(spark, sf, "documents").select("doc_id").join(load_table(spark, sf, "labels"), "doc_id", "left")
    return quality.fill_defaults(rows, {"quality": -1, "toxic": 0, "rater": "human"})


@query(
    "j05_fk_orphans",
    """SELECT 'lineitem_orders' AS relation, count(DISTINCT l_orderkey) AS orphan_keys, count(l_orderkey) AS orphan_rows FROM lineitem
         WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)
       UNION ALL SELECT 'orders_lineitem', count(DISTINCT o_orderkey), count(*) FROM orders
         WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE o_orderkey = l_orderkey)
       UNION ALL SELECT 'orders_customer', count(DISTINCT o_custkey), count(*) FROM orders
         WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_nationkey < 20)""",
)
def orphans(spark, sf):
    orders, lines = load_table(spark, sf, "orders"), load_table(spark, sf, "lineitem")
    customers = load_table(spark, sf, "customer").where("c_nationkey < 20")
    return quality.fk_orphans(
        [
            ("lineitem_orders", lines, "l_orderkey", orders, "o_orderkey"),
            ("orders_lineitem", orders, "o_orderkey", lines, "l_orderkey"),
            ("orders_customer", orders, "o_custkey", customers, "c_custkey"),
        ]
    )
