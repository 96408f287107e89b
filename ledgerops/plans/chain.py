"""Chain analytics over stored tables."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ledgerops.functions.times import ntz
from ledgerops.operators import chain
from ledgerops.operators.ordered import exact_quantiles
from ledgerops.plans.inputs import now_of, now_sql, sql_frame, view_sql
from ledgerops.plans.registry import query
from ledgerops.session import scratch_path
from ledgerops.sources.tables import load_table

_RANGES = """(SELECT p + 1 AS lo, n - 1 AS hi FROM (SELECT n, lag(n) OVER (ORDER BY n) AS p FROM (
    SELECT DISTINCT l_orderkey AS n FROM lineitem UNION SELECT -1 UNION SELECT (SELECT max(o_orderkey) + 1 FROM orders)) a) b WHERE n - p > 1)"""


def gaps(spark, sf):
    last = load_table(spark, sf, "blocks").agg(F.max("number")).first()[0]
    return chain.missing_ranges(load_table(spark, sf, "transactions"), "block_number", 0, last)


query("w05_missing_ranges", f"SELECT * FROM {_RANGES} r")(gaps)


@query(
    "w06_fetch_batches",
    """SELECT b AS batch_lo, least(b + 1, hi) AS batch_hi FROM (SELECT hi, unnest(generate_series(lo, hi, 2)) AS b FROM """ + _RANGES + " r) x",
)
def work_list(spark, sf):
    return chain.fetch_batches(gaps(spark, sf), 2)


_FLOWS = f"""(SELECT to_address_hash AS address, amount, inserted_at FROM {view_sql('token_transfers')}
  UNION ALL SELECT from_address_hash, -amount, inserted_at FROM {view_sql('token_transfers')})"""


@query(
    "w07_balance_history",
    f"""WITH days AS (SELECT CAST(unnest(generate_series({now_sql('lineitem')} - INTERVAL 29 DAY, {now_sql('lineitem')}, INTERVAL 1 DAY)) AS DATE) AS day),
        f AS {_FLOWS}
        SELECT address, day, CAST(sum(amount) AS BIGINT) AS balance FROM days JOIN f ON CAST(inserted_at AS DATE) <= day GROUP BY 1, 2""",
)
def balances(spark, sf):
    transfers = load_table(spark, sf, "token_transfers")
    flows = chain.signed_flows(transfers, "from_address_hash", "to_address_hash", "amount", ["inserted_at"])
    return chain.balance_history(flows, ["address"], "inserted_at", "amount", 30, now_of(spark, sf, "lineitem"))


_TIE = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query(
    "w08_state_as_of",
    f"""SELECT l_orderkey, l_shipdate, l_partkey, l_extendedprice FROM (
          SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn
          FROM lineitem WHERE l_shipdate <= {now_sql('lineitem')} - INTERVAL 1000 DAY) x WHERE rn = 1 AND l_returnflag <> 'R'""",
)
def recovered(spark, sf):
    changes = load_table(spark, sf, "lineitem").withColumn("deleted", F.col("l_returnflag") == "R")
    target = ntz(now_of(spark, sf, "lineitem") - timedelta(days=1000))
    found = chain.state_as_of(changes, ["l_orderkey"], "l_shipdate", target, "deleted", _TIE)
    return found.select("l_orderkey", "l_shipdate", "l_partkey", "l_extendedprice")


@query(
    "w08_state_at_restore_point",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders
       WHERE o_orderkey <= (SELECT max(o_orderkey) FROM orders WHERE o_custkey = 7)) x WHERE rn = 1""",
)
def recovered_point(spark, sf):
    orders = load_table(spark, sf, "orders")
    points = orders.groupBy(F.concat(F.lit("point-"), "o_custkey").alias("name")).agg(F.max("o_orderkey").alias("at"))
    target = chain.restore_point(points, "point-7", "at")
    return chain.state_as_of(orders, ["o_custkey"], "o_orderkey", target).select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "w10_nonce_gaps",
    """WITH u AS (SELECT o_custkey, o_orderkey % 50 AS nonce, count(*) AS n FROM orders GROUP BY 1, 2),
       g AS (SELECT *, lag(nonce) OVER (PARTITION BY o_custkey ORDER BY nonce) AS p FROM u)
       SELECT o_custkey, 'duplicate' AS kind, nonce AS lo, nonce AS hi, n AS "rows" FROM u WHERE n > 1
       UNION ALL SELECT o_custkey, 'gap', p + 1, nonce - 1, 0 FROM g WHERE nonce - p > 1""",
)
def nonces(spark, sf):
    txs = load_table(spark, sf, "orders").select("o_custkey", (F.col("o_orderkey") % 50).alias("nonce"))
    return chain.nonce_gaps(txs, "o_custkey", "nonce")


@query(
    "w11_latest_by_key",
    """SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
       ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM lineitem) x WHERE rn = 1""",
)
def newest(spark, sf):
    found = chain.latest_by_key(
        load_table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]
    )
    return found.select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey")


_DAILY = f"""WITH t AS (SELECT CAST(inserted_at AS DATE) AS day, * FROM {view_sql('transactions')}),
        seen AS (SELECT a, min(day) AS day FROM (SELECT from_address_hash AS a, day FROM t UNION ALL SELECT to_address_hash, day FROM t) x GROUP BY 1),
        fresh AS (SELECT day, count(*) AS n FROM seen GROUP BY 1)
        SELECT t.day, count(*) AS transactions, count(DISTINCT from_address_hash) AS senders, round(sum(value), 2) AS amount, coalesce(max(n), 0) AS new_addresses
        FROM t LEFT JOIN fresh ON fresh.day = t.day WHERE t.day > CAST({now_sql('lineitem')} AS DATE) - 2490 GROUP BY 1"""


@query("a15_daily_stats", _DAILY)
def per_day(spark, sf):
    txs = load_table(spark, sf, "transactions")
    stats = chain.daily_stats(
        txs, "inserted_at", "from_address_hash", "to_address_hash", "value", 2490, now_of(spark, sf, "lineitem")
    )
    return stats.withColumn("amount", F.round("amount", 2))


@query("a15_daily_stats_incremental", _DAILY)
def per_day_added(spark, sf):
    """All days but the last 30 in one run, then those in a second one that reads them alone."""
    txs, now, path = load_table(spark, sf, "transactions"), now_of(spark, sf, "lineitem"), scratch_path(spark, "daily")
    first = txs.agg(F.min("inserted_at")).first()[0].date()
    cut_day, last = now.date() - timedelta(days=30), now.date()
    columns = ("inserted_at", "from_address_hash", "to_address_hash", "value", path)
    chain.update_daily_stats(txs, *columns, first, cut_day)
    chain.update_daily_stats(txs, *columns, cut_day + timedelta(days=1), last)
    return chain.stored_daily_stats(spark, path, 2490, now).withColumn("amount", F.round("amount", 2))


@query(
    "a16_fee_percentiles",
    """WITH r AS (SELECT l_tax * 1000 AS p FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders ORDER BY 1 DESC LIMIT 200))
       SELECT 'slow' AS speed, round(quantile_cont(p, 0.35), 6) AS value FROM r UNION ALL SELECT 'average', round(quantile_cont(p, 0.6), 6) FROM r
       UNION ALL SELECT 'fast', round(quantile_cont(p, 0.9), 6) FROM r""",
)
def fees(spark, sf):
    txs = load_table(spark, sf, "transactions").withColumn("gas_price", F.col("gas_price") * 1000)
    found = chain.fee_percentiles(
        txs, "block_number", "gas_price", load_table(spark, sf, "blocks"), "number", 200,
        {"slow": 0.35, "average": 0.6, "fast": 0.9},
    )
    return found.withColumn("value", F.round("value", 6))


@query(
    "a16_quantiles_by_group",
    """SELECT event_type, q, round(v, 6) AS value FROM (SELECT event_type, unnest([0.1::DOUBLE, 0.5::DOUBLE, 0.99::DOUBLE]) AS q,
       unnest(quantile_cont(value, [0.1, 0.5, 0.99])) AS v FROM events GROUP BY event_type) x""",
)
def quantiles(spark, sf):
    return exact_quantiles(load_table(spark, sf, "events"), "value", [0.1, 0.5, 0.99], ["event_type"]).withColumn(
        "value", F.round("value", 6)
    )


# Logs and calls with payloads: two words, a number and an address, from stored keys.
_PAYLOAD = """SELECT l_orderkey, l_linenumber, l_shipdate, CAST(l_suppkey AS STRING) AS address_hash, concat('0xtopic', l_returnflag) AS first_topic,
  concat('0x', CASE WHEN l_linenumber = 7 THEN repeat('F', 64) ELSE lpad(hex(l_partkey), 64, '0') END,
         lpad(hex(l_suppkey), 64, '0')) AS data FROM {lineitem}"""


@query(
    "c01_decode_event",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 7 THEN CAST(l_partkey AS DECIMAL(38,0)) END AS new_value,
       CASE WHEN l_linenumber = 7 THEN repeat('f', 64) ELSE lower(lpad(hex(l_partkey), 64, '0')) END AS new_value_hex,
       concat('0x', lower(lpad(hex(l_suppkey), 40, '0'))) AS changed_by
       FROM lineitem WHERE l_returnflag = 'A'""",
)
def decoded(spark, sf):
    found = chain.decode_event(
        sql_frame(spark, sf, _PAYLOAD, "lineitem"), "0xtopicA", [("new_value", "uint256"), ("changed_by", "address")]
    )
    return found.select("l_orderkey", "l_linenumber", "new_value", "new_value_hex", "changed_by")


_CALLS = """SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN '0x60FE47B1' WHEN 2 THEN '0x6d4ce63c' WHEN 3 THEN '0xd09de08a' ELSE '0x00000000' END
    || CASE WHEN l_linenumber = 1 THEN lpad(hex(l_partkey), 64, '0') ELSE '' END AS input FROM {lineitem}"""


@query(
    "c02_decode_calls",
    """SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN '0x60fe47b1' WHEN 2 THEN '0x6d4ce63c' WHEN 3 THEN '0xd09de08a' ELSE '0x00000000' END AS selector,
       CASE l_linenumber WHEN 1 THEN 'set(uint256)' WHEN 2 THEN 'get()' WHEN 3 THEN 'increment()' END AS signature,
       CASE WHEN l_linenumber = 1 THEN lower(lpad(hex(l_partkey), 64, '0')) ELSE '' END AS args FROM lineitem""",
)
def calls(spark, sf):
    known = spark.createDataFrame(
        [("0x60fe47b1", "set(uint256)"), ("0x6d4ce63c", "get()")], "selector string, signature string"
    )
    fallback = spark.createDataFrame(
        [("0xd09de08a", "increment()"), ("0x6d4ce63c", "other()")], "selector string, signature string"
    )
    found = chain.decode_calls(sql_frame(spark, sf, _CALLS, "lineitem"), [known, fallback])
    return found.select("l_orderkey", "l_linenumber", "selector", "signature", F.concat_ws(",", "args").alias("args"))


@query(
    "c03_contract_state",
    """SELECT l_suppkey, arg_max(l_partkey, (l_shipdate, l_orderkey, l_linenumber, l_partkey)) AS current_value, count(*) AS changes FROM lineitem GROUP BY 1""",
)
def state(spark, sf):
    return chain.contract_state(
        load_table(spark, sf, "lineitem"), "l_suppkey", "l_partkey", ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]
    )


@query(
    "c03_contract_history",
    """SELECT user_id, event_id, ts, value, lag(value) OVER w AS previous_value, lead(ts) OVER w AS valid_to FROM events
       WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def history(spark, sf):
    return chain.contract_history(load_table(spark, sf, "events"), "user_id", "value", ["ts", "event_id"])




@query(
    "c04_token_balances",
    f"""SELECT token AS token_contract_address_hash, address, CAST(sum(amount) AS BIGINT) AS balance FROM (
        SELECT token_contract_address_hash AS token, to_address_hash AS address, amount FROM {view_sql('token_transfers')}
        UNION ALL SELECT token_contract_address_hash, from_address_hash, -amount FROM {view_sql('token_transfers')}) x GROUP BY 1, 2 HAVING sum(amount) <> 0""",
)
def token_balances(spark, sf):
    return chain.token_balances(
        load_table(spark, sf, "token_transfers"), "token_contract_address_hash", "from_address_hash", "to_address_hash", "amount"
    )


@query(
    "c04_token_holders",
    f"""SELECT token AS token_contract_address_hash, count(*) AS holders FROM (SELECT token, address FROM (
        SELECT token_contract_address_hash AS token, to_address_hash AS address, amount FROM {view_sql('token_transfers')}
        UNION ALL SELECT token_contract_address_hash, from_address_hash, -amount FROM {view_sql('token_transfers')}) x GROUP BY 1, 2 HAVING sum(amount) > 0) y GROUP BY 1""",
)
def token_holders(spark, sf):
    return chain.holders(token_balances(spark, sf), "token_contract_address_hash")


_CENTS_TX = "(SELECT from_address_hash AS f, to_address_hash AS t, CAST(round(value * 100) AS BIGINT) AS amount FROM " + view_sql("transactions") + ")"
_CENTS_IN = "(SELECT from_address_hash AS f, to_address_hash AS t, CAST(round(value * 100) AS BIGINT) AS amount FROM " + view_sql("internal_transactions") + ")"


@query(
    "c05_coin_balances",
    f"""SELECT address, CAST(sum(amount) AS BIGINT) AS balance FROM (
        SELECT t AS address, amount FROM {_CENTS_TX} a UNION ALL SELECT f, -amount FROM {_CENTS_TX} a
        UNION ALL SELECT t, amount FROM {_CENTS_IN} b UNION ALL SELECT f, -amount FROM {_CENTS_IN} b) x GROUP BY 1 HAVING sum(amount) <> 0""",
)
def coin_balances(spark, sf):
    cents = F.round(F.col("value") * 100).cast("bigint").alias("amount")
    sources = []
    for name in ("transactions", "internal_transactions"):
        t = load_table(spark, sf, name).select("from_address_hash", "to_address_hash", cents)
        sources.append((t, "from_address_hash", "to_address_hash", "amount"))
    return chain.coin_balances(sources)


@query(
    "c06_created_contracts",
    f"""SELECT created_contract_address_hash, arg_min(from_address_hash, (inserted_at, transaction_hash, "index", from_address_hash)) AS creator, min(inserted_at) AS first_seen
        FROM {view_sql('internal_transactions')} t WHERE created_contract_address_hash IS NOT NULL GROUP BY 1""",
)
def created(spark, sf):
    return chain.created_contracts(
        load_table(spark, sf, "internal_transactions"), "created_contract_address_hash", "from_address_hash", "inserted_at",
        ["transaction_hash", "index", "from_address_hash"],
    )


@query(
    "c07_dedup_logs",
    f"""SELECT transaction_key, "index", address_hash, inserted_at FROM (SELECT *, row_number() OVER (PARTITION BY transaction_key, "index"
        ORDER BY inserted_at DESC, address_hash DESC) AS rn FROM {view_sql('logs')} l) x WHERE rn = 1""",
)
def deduplicated(spark, sf):
    logs = load_table(spark, sf, "logs").select("transaction_key", "index", "address_hash", "inserted_at")
    return chain.dedup_logs(logs, ["transaction_key", "index"], ["inserted_at", "address_hash"])


@query("c07_dedup_keys", f"SELECT DISTINCT transaction_key, \"index\" FROM {view_sql('logs')} l")
def distinct_logs(spark, sf):
    logs = load_table(spark, sf, "logs").select("transaction_key", "index")
    return chain.dedup_logs(logs, ["transaction_key", "index"])
