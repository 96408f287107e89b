"""Scalar helpers over stored columns, and simple selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerops import functions as fn
from ledgerops.functions.register import register_functions
from ledgerops.operators import filters
from ledgerops.plans.inputs import age_sql, now_of, now_sql, view_sql
from ledgerops.plans.registry import query
from ledgerops.sources.tables import load_table


@query(
    "x01_age_seconds",
    f"SELECT event_id, {age_sql('ts', now_sql('events'))} AS age FROM events",
)
def ages(spark, sf):
    return load_table(spark, sf, "events").select("event_id", fn.age_seconds("ts", now_of(spark, sf, "events")).alias("age"))


_DURATION = """CASE l_linenumber % 5 WHEN 0 THEN concat(l_suppkey, ' days') WHEN 1 THEN concat(l_suppkey, 'd')
  WHEN 2 THEN concat(l_suppkey, 's') WHEN 3 THEN concat(l_suppkey, 'm') ELSE concat('1 day ', l_suppkey, ' hours') END"""


@query(
    "x02_duration_seconds",
    f"""SELECT {_DURATION} AS text, CAST(CASE l_linenumber % 5 WHEN 0 THEN l_suppkey * 86400 WHEN 1 THEN l_suppkey * 86400
        WHEN 2 THEN l_suppkey WHEN 3 THEN l_suppkey * 60 ELSE 86400 + l_suppkey * 3600 END AS BIGINT) AS seconds, count(*) AS n
        FROM lineitem GROUP BY 1, 2""",
)
def durations(spark, sf):
    texts = load_table(spark, sf, "lineitem").groupBy(F.expr(_DURATION).alias("text")).agg(F.count(F.lit(1)).alias("n"))
    return texts.select("text", fn.duration_seconds("text").alias("seconds"), "n")


@query("x03_day", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def days(spark, sf):
    return load_table(spark, sf, "events").groupBy(fn.day("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("x04_day_stamp", "SELECT strftime(o_orderdate, '%Y%m%d') AS stamp, count(*) AS n FROM orders GROUP BY 1")
def stamps(spark, sf):
    return load_table(spark, sf, "orders").groupBy(fn.day_stamp("o_orderdate").alias("stamp")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "x05_minus_days",
    f"SELECT o_orderkey, {now_sql('orders')} - to_days(CAST(o_orderkey % 7 AS INT)) AS at FROM orders",
)
def earlier(spark, sf):
    now = fn.ntz(now_of(spark, sf, "orders"))
    return load_table(spark, sf, "orders").select(
        "o_orderkey", fn.minus_days(now, (F.col("o_orderkey") % 7).cast("int")).alias("at")
    )


@query(
    "x06_safe_ratio",
    """SELECT l_suppkey, round(CASE WHEN sum(l_tax) > 0 THEN sum(l_discount) / sum(l_tax) ELSE 0 END, 6) AS ratio
       FROM lineitem GROUP BY l_suppkey""",
)
def ratios(spark, sf):
    sums = load_table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum("l_discount").alias("a"), F.sum("l_tax").alias("b"))
    return sums.select("l_suppkey", F.round(fn.safe_ratio("a", "b"), 6).alias("ratio"))


@query(
    "x07_flag",
    """SELECT l_returnflag, sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END)::BIGINT AS large,
       sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS open_lines FROM lineitem GROUP BY 1""",
)
def flags(spark, sf):
    return load_table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.sum(fn.flag(F.col("l_quantity") > 25)).alias("large"), F.sum(fn.flag("l_linestatus", "O")).alias("open_lines")
    )


@query("x08_qualified", "SELECT concat(c_mktsegment, '.', c_name) AS name FROM customer")
def names(spark, sf):
    return load_table(spark, sf, "customer").select(fn.qualified("c_mktsegment", "c_name").alias("name"))


@query(
    "x09_md5_hash",
    "SELECT o_orderkey, md5(CAST(o_orderkey AS VARCHAR)) AS hash, upper(md5(CAST(o_orderkey AS VARCHAR))) AS hex, 16 AS bytes FROM orders",
)
def hashes(spark, sf):
    return load_table(spark, sf, "orders").select(
        "o_orderkey", fn.md5_hash("o_orderkey").alias("hash"), F.hex(fn.md5_bytes("o_orderkey")).alias("hex"),
        F.octet_length(fn.md5_bytes("o_orderkey")).alias("bytes"),
    )


_PRETTY = """CASE WHEN b < 10240 THEN concat(b, ' bytes')
  WHEN floor(b / 1024.0 + 0.5) < 10240 THEN concat(CAST(floor(b / 1024.0 + 0.5) AS BIGINT), ' kB')
  WHEN floor(b / 1048576.0 + 0.5) < 10240 THEN concat(CAST(floor(b / 1048576.0 + 0.5) AS BIGINT), ' MB')
  WHEN floor(b / 1073741824.0 + 0.5) < 10240 THEN concat(CAST(floor(b / 1073741824.0 + 0.5) AS BIGINT), ' GB')
  WHEN floor(b / 1099511627776.0 + 0.5) < 10240 THEN concat(CAST(floor(b / 1099511627776.0 + 0.5) AS BIGINT), ' TB')
  ELSE concat(CAST(floor(b / 1125899906842624.0 + 0.5) AS BIGINT), ' PB') END"""


@query(
    "x10_size_pretty",
    f"SELECT k, {_PRETTY} AS size FROM (SELECT o_orderkey AS k, CAST(o_orderkey AS BIGINT) * o_custkey * o_custkey * 1000 AS b FROM orders) q",
)
def sizes(spark, sf):
    # four factors of large tables leave the range of a long
    order, customer = (F.col(c).cast("decimal(20,0)") for c in ("o_orderkey", "o_custkey"))
    b = order * customer * customer * 1000
    return load_table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), fn.size_pretty(b).alias("size"))


_SI = """CASE WHEN v = 0 THEN '0' WHEN abs(v) >= 1e9 THEN concat(format('{:.4g}', v / 1e9), 'G')
  WHEN abs(v) >= 1e6 THEN concat(format('{:.4g}', v / 1e6), 'M') WHEN abs(v) >= 1e3 THEN concat(format('{:.4g}', v / 1e3), 'k')
  WHEN abs(v) >= 1 THEN format('{:.4g}', v) WHEN abs(v) >= 1e-3 THEN concat(format('{:.4g}', v * 1e3), 'm')
  WHEN abs(v) >= 1e-6 THEN concat(format('{:.4g}', v * 1e6), 'u') ELSE concat(format('{:.4g}', v * 1e9), 'n') END"""
_HMS = """CASE WHEN s >= 86400 THEN concat(s // 86400, 'd ', (s // 3600) % 24, 'h ', (s // 60) % 60, 'm ', s % 60, 's')
  WHEN s >= 3600 THEN concat(s // 3600, 'h ', (s // 60) % 60, 'm ', s % 60, 's')
  WHEN s >= 60 THEN concat(s // 60, 'm ', s % 60, 's') WHEN s >= 1 THEN concat(format('{:.4g}', d), 's')
  WHEN d = 0 THEN '0s' ELSE concat(format('{:.4g}', d * 1e3), 'ms') END"""


@query(
    "x11_humanize",
    f"""SELECT event_id, {_SI} AS si, concat(format('{{:.4g}}', value / 500 * 100), '%') AS pct, {_HMS} AS duration
        FROM (SELECT event_id, value, CASE event_id % 4 WHEN 0 THEN value * 1e7 WHEN 1 THEN value * 1e3 WHEN 2 THEN value
              ELSE value / 1e5 END AS v, value * value * 10 AS d, CAST(floor(value * value * 10) AS BIGINT) AS s FROM events) q""",
)
def human(spark, sf):
    v = F.expr("CASE event_id % 4 WHEN 0 THEN value * 1e7D WHEN 1 THEN value * 1e3D WHEN 2 THEN value ELSE value / 1e5D END")
    value = F.col("value")
    return load_table(spark, sf, "events").select(
        "event_id", fn.humanize(v).alias("si"), fn.humanize_percentage(value / 500).alias("pct"),
        fn.humanize_duration(value * value * 10).alias("duration"),
    )


@query(
    "x12_render",
    """SELECT event_id, concat('Type ', event_type, ' at ', CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR)
       ELSE CAST(value AS VARCHAR) END, ' (', format('{:.4g}', value * 100), '%)') AS text FROM events""",
)
def rendered(spark, sf):
    text = "Type {{ $labels.kind }} at {{ $value }} ({{ $value | humanizePercentage }})"
    return load_table(spark, sf, "events").select(
        "event_id", fn.render(text, "value", {"kind": F.col("event_type")}).alias("text")
    )


_BIG_HEX = "concat('0x0', hex(o_orderkey + 1), CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN '0000000000000000' ELSE '00000000000000000000000000000000' END)"


@query(
    "x13_hex_to_number",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey + 1 END AS as_long,
       CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderkey + 1 AS DECIMAL(38,0))
         WHEN 1 THEN CAST(CAST(o_orderkey + 1 AS HUGEINT) * 18446744073709551616::HUGEINT AS DECIMAL(38,0)) END AS as_decimal,
       lower(concat(hex(o_orderkey + 1), CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN '0000000000000000'
         ELSE '00000000000000000000000000000000' END)) AS hex FROM orders""",
)
def hex_numbers(spark, sf):
    number = fn.hex_to_number(F.expr(_BIG_HEX))
    return load_table(spark, sf, "orders").select("o_orderkey", number.alias("n")).select("o_orderkey", "n.*")


@query(
    "x14_lsn_diff",
    """SELECT o_orderkey, CAST(CAST(o_custkey - o_orderkey AS DECIMAL(20,0)) * 4294967296 + (o_orderkey - o_custkey) AS DECIMAL(20,0)) AS bytes
       FROM orders""",
)
def positions(spark, sf):
    at = lambda a, b: F.concat(F.hex(a), F.lit("/"), F.hex(b))
    return load_table(spark, sf, "orders").select(
        "o_orderkey", fn.lsn_diff(at("o_custkey", "o_orderkey"), at("o_orderkey", "o_custkey")).alias("bytes")
    )


_ADDRESS = "concat('0X', lpad(hex(l_partkey), CASE WHEN l_linenumber = 3 THEN 39 ELSE 40 END, 'A'))"


@query(
    "x15_normalize_address",
    """SELECT l_partkey, CASE WHEN l_linenumber <> 3 THEN lower(concat('0x', lpad(hex(l_partkey), 40, 'A'))) END AS address, count(*) AS n
       FROM lineitem GROUP BY 1, 2""",
)
def addresses(spark, sf):
    return load_table(spark, sf, "lineitem").groupBy("l_partkey", fn.normalize_address(F.expr(_ADDRESS)).alias("address")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "x16_to_coin",
    """SELECT o_orderkey, CAST(concat((o_orderkey * 1234567 + 1) // 1000000000, '.',
       lpad(CAST((o_orderkey * 1234567 + 1) % 1000000000 AS VARCHAR), 9, '0')) AS DECIMAL(38,18)) AS gwei_coins FROM orders""",
)
def coins(spark, sf):
    return load_table(spark, sf, "orders").select(
        "o_orderkey", fn.to_coin(F.col("o_orderkey") * 1234567 + 1, 9).alias("gwei_coins")
    )


_QUANTITY = """concat(CAST(l_suppkey AS BIGINT), CASE l_linenumber WHEN 1 THEN 'm' WHEN 2 THEN 'Gi' WHEN 3 THEN 'GB' WHEN 4 THEN 'kB'
  WHEN 5 THEN '' WHEN 6 THEN 'k' ELSE 'zz' END)"""


@query(
    "x17_parse_quantity",
    f"""SELECT {_QUANTITY} AS text, CASE l_linenumber WHEN 1 THEN l_suppkey * 0.001::DOUBLE WHEN 2 THEN l_suppkey * 1073741824.0::DOUBLE
        WHEN 3 THEN l_suppkey * 1073741824.0::DOUBLE WHEN 4 THEN l_suppkey * 1024.0::DOUBLE WHEN 5 THEN l_suppkey::DOUBLE
        WHEN 6 THEN l_suppkey * 1000.0::DOUBLE END AS amount, count(*) AS n FROM lineitem GROUP BY 1, 2""",
)
def quantities(spark, sf):
    texts = load_table(spark, sf, "lineitem").groupBy(F.expr(_QUANTITY).alias("text")).agg(F.count(F.lit(1)).alias("n"))
    return texts.select("text", fn.parse_quantity("text").alias("amount"), "n")


@query("x18_parse_iso", "SELECT event_id, ts FROM events")
def iso(spark, sf):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return load_table(spark, sf, "events").select("event_id", fn.parse_iso(text).alias("ts"))


@query("x19_json_field", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_value(spark, sf):
    return load_table(spark, sf, "events").select("event_id", fn.json_field("props", "$.k").alias("k"))


@query(
    "y01_register_functions",
    """SELECT event_id, CASE WHEN user_id > 0 THEN value / user_id ELSE 0 END AS ratio,
       CASE WHEN event_type = 'on' THEN 1 ELSE 0 END AS flag, CAST(user_id + 1 AS VARCHAR) AS number,
       md5(CAST(event_id AS VARCHAR)) AS hash, user_id * 86400 AS seconds, CAST(user_id * 1024 AS DOUBLE) AS quantity, event_type || '.' || user_id AS name FROM events""",
)
def registered(spark, sf):
    register_functions(spark)
    return spark.sql(
        """SELECT event_id, safe_ratio(value, CAST(user_id AS DOUBLE)) AS ratio, on_flag(event_type) AS flag,
           uint256_text(hex(user_id + 1)) AS number, md5_hash(CAST(event_id AS STRING)) AS hash, duration_seconds(concat(user_id, ' days')) AS seconds,
           parse_quantity(concat(user_id, 'Ki')) AS quantity, qualified_name(event_type, CAST(user_id AS STRING)) AS name FROM {events}""",
        events=load_table(spark, sf, "events"),
    )


@query(
    "y01_register_texts",
    f"""SELECT event_id, {_SI} AS si, concat(format('{{:.4g}}', value / 500 * 100), '%') AS pct, {_HMS} AS duration,
        CAST(event_id + 1 AS DECIMAL(38,0)) AS whole, event_id + 1 AS as_long, CAST(concat((event_id + 1) // 8, '.', lpad(CAST((event_id + 1) % 8 * 125 AS VARCHAR), 3, '0')) AS DECIMAL(38,18)) AS coins
        FROM (SELECT event_id, value, CASE event_id % 4 WHEN 0 THEN value * 1e7 WHEN 1 THEN value * 1e3 WHEN 2 THEN value
              ELSE value / 1e5 END AS v, value * value * 10 AS d, CAST(floor(value * value * 10) AS BIGINT) AS s FROM events) q""",
)
def registered_texts(spark, sf):
    register_functions(spark)
    return spark.sql(
        """SELECT event_id, humanize(CASE event_id % 4 WHEN 0 THEN value * 1e7D WHEN 1 THEN value * 1e3D WHEN 2 THEN value ELSE value / 1e5D END) AS si,
           humanize_percentage(value / 500) AS pct, humanize_duration(value * value * 10) AS duration, hex_to_decimal(concat('0x', hex(event_id + 1))) AS whole,
           hex_to_long(hex(event_id + 1)) AS as_long, to_coin(CAST(CAST(event_id + 1 AS DECIMAL(18,0)) * CAST(125000000000000000 AS DECIMAL(18,0)) AS DECIMAL(38,0))) AS coins FROM {events}""",
        events=load_table(spark, sf, "events"),
    )


@query(
    "f01_recent",
    f"SELECT number, inserted_at FROM {view_sql('blocks')} WHERE inserted_at > {now_sql('orders')} - INTERVAL 90 DAY",
)
def recent(spark, sf):
    blocks = load_table(spark, sf, "blocks").select("number", "inserted_at")
    return filters.recent(blocks, "inserted_at", now_of(spark, sf, "orders"), "90 days")


@query(
    "f02_pick",
    """SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority = '5-LOW'""",
)
def picked(spark, sf):
    orders = load_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return filters.pick(orders, o_orderstatus=["F", "O"], o_orderpriority="5-LOW")


@query(
    "f03_name_like",
    "SELECT name, count(*) AS n FROM (SELECT concat('blocks_p', strftime(o_orderdate, '%Y%m%d')) AS name FROM orders) q WHERE name LIKE 'blocks_p1997%' GROUP BY 1",
)
def liked(spark, sf):
    names = load_table(spark, sf, "orders").select(F.concat(F.lit("blocks_p"), fn.day_stamp("o_orderdate")).alias("name"))
    return filters.name_like(names, "name", "blocks_p1997%").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f04_select_series",
    """SELECT CAST(user_id % 5 AS VARCHAR) AS instance, ts, value FROM events
       WHERE event_type = 'click' AND user_id % 2 = 1 AND regexp_full_match(CAST(user_id % 5 AS VARCHAR), '[0-2]')""",
)
def series(spark, sf):
    found = filters.select_series(load_table(spark, sf, "samples"), "click", {"job": "job-1"}, {"instance": "[0-2]"})
    return found.select(F.col("labels")["instance"].alias("instance"), "ts", "value")


@query(
    "f05_filter_logs",
    f"""SELECT transaction_key, "index", address_hash, third_topic FROM {view_sql('logs')}
        WHERE first_topic = 'A' AND third_topic = '2'""",
)
def some_logs(spark, sf):
    found = filters.filter_logs(load_table(spark, sf, "logs"), topics=["A", None, "2", None])
    return found.select("transaction_key", "index", "address_hash", "third_topic")


@query(
    "f06_address_activity",
    f"""SELECT transaction_key, log_index, amount, 'sender' AS role FROM {view_sql('token_transfers')} WHERE from_address_hash = '7'
        UNION ALL SELECT transaction_key, log_index, amount, 'receiver' FROM {view_sql('token_transfers')} WHERE to_address_hash = '7'""",
)
def activity(spark, sf):
    found = filters.address_activity(
        load_table(spark, sf, "token_transfers"), "7", {"from_address_hash": "sender", "to_address_hash": "receiver"}
    )
    return found.select("transaction_key", "log_index", "amount", "role")


@query(
    "f07_canonical",
    f"SELECT number, hash, miner_hash FROM {view_sql('blocks')} WHERE consensus AND miner_hash = '7'",
)
def canonical(spark, sf):
    found = filters.blocks_by(filters.canonical(load_table(spark, sf, "blocks")), miner="7")
    return found.select("number", "hash", "miner_hash")


@query(
    "f08_select_nested",
    "SELECT event_id, event_type AS name FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) = 69 OR user_id = 69",
)
def nested(spark, sf):
    doc = F.concat(
        F.lit('{"metadata":{"name":"'), "event_type", F.lit('"},"items":['), "props", F.lit(',{"k":'),
        F.col("user_id").cast("string"), F.lit("}]}"),
    )
    docs = load_table(spark, sf, "events").select("event_id", doc.alias("doc"))
    found = filters.select_nested(
        docs, "doc", "metadata struct<name:string>, items array<struct<k:int>>", "items",
        lambda x: x["k"] == 69, {"name": "metadata.name"},
    )
    return found.drop("doc")


_FLOWS = """SELECT event_type AS namespace, concat('pod-', CAST(user_id % 7 AS STRING)) AS pod, concat('svc-', CAST(user_id % 3 AS STRING)) AS peer,
  CASE WHEN value > 100 THEN 'DROPPED' ELSE 'FORWARDED' END AS verdict FROM {events}"""


@query(
    "f09_filter_flows",
    "SELECT pod, peer, count(*) AS flows FROM (" + _FLOWS.format(events="events")
    + ") q WHERE namespace = 'error' AND verdict = 'DROPPED' GROUP BY 1, 2",
)
def flows(spark, sf):
    all_flows = spark.sql(_FLOWS, events=load_table(spark, sf, "events"))
    return filters.flow_counts(filters.filter_flows(all_flows, ns="error", verdict="DROPPED"), ["pod", "peer"])


@query("f10_grep_lines", "SELECT doc_id, lang FROM documents WHERE regexp_matches(text, 'tion', 'i')")
def grep(spark, sf):
    return filters.grep_lines(load_table(spark, sf, "documents"), "text", "tion").select("doc_id", "lang")
