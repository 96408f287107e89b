"""Chain analytics: gaps, balances, recovery, fees, decoding."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerops.functions.scalars import word_to_decimal
from ledgerops.functions.times import as_datetime, ntz
from ledgerops.operators.joins import resolve_signature
from ledgerops.operators.ordered import OrderedRows, exact_quantiles, unfold
from ledgerops.session import cut


def missing_ranges(df: DataFrame, number: str, first: int, last: int) -> DataFrame:
    """Inclusive ranges of numbers in ``[first, last]`` that no row has: (lo, hi).

    Bounds join as two marker numbers just outside the interval, so an empty table
    yields the whole interval and no dense sequence is ever built.
    """
    n = F.col(number).cast("bigint")
    inside = df.select(n.alias("n")).where((F.col("n") >= first) & (F.col("n") <= last)).distinct()
    marks = df.sparkSession.range(2).select(
        F.when(F.col("id") == 0, F.lit(first - 1)).otherwise(F.lit(last + 1)).cast("bigint").alias("n")
    )
    ordered = OrderedRows.of(inside.unionByName(marks), [], ["n"]).previous(p=F.col("n")).rows
    return ordered.where(F.col("n") - F.col("p") > 1).select((F.col("p") + 1).alias("lo"), (F.col("n") - 1).alias("hi"))


def fetch_batches(ranges: DataFrame, batch_size: int) -> DataFrame:
    """Ranges cut into inclusive batches of at most ``batch_size`` numbers."""
    return unfold(ranges, "lo", "hi", "batch_lo", batch_size).select(
        "batch_lo", F.least(F.col("batch_lo") + (batch_size - 1), F.col("hi")).alias("batch_hi")
    )


def balance_history(deltas: DataFrame, by: list[str], at: str, amount: str, days: int, as_of) -> DataFrame:
    """End-of-day balance per key for the last ``days`` days, carried over quiet days.

    Rows collapse to one per key and day first, so the running sum per key is as long
    as its days. History before the window folds into one opening row per key.
    """
    last = as_datetime(as_of).date()
    first = last - timedelta(days=days - 1)
    lo, hi = F.lit(first.isoformat()).cast("date"), F.lit(last.isoformat()).cast("date")
    d = F.to_date(at)
    daily = (
        deltas.where(d <= hi)
        .select(*by, F.greatest(d, F.date_sub(lo, 1)).alias("d"), amount)
        .groupBy(*by, "d")
        .agg(F.sum(amount).alias("delta"))
    )
    w = W.partitionBy(*by).orderBy("d")  # at most days + 1 rows per key
    known = daily.select(
        *by,
        "d",
        F.sum("delta").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("balance"),
        F.coalesce(F.date_sub(F.lead("d").over(w), 1), hi).alias("until"),
    )
    start = F.greatest("d", lo)
    return known.where(F.col("until") >= start).select(
        *by, F.explode(F.sequence(start, "until")).alias("day"), "balance"
    )


def state_as_of(
    changes: DataFrame, keys: list[str], version: str, target, deleted: str | None = None, tie: list[str] | None = None
) -> DataFrame:
    """Table state at a version or time: newest change per key not after ``target``.

    ``deleted`` names a boolean marker column; a marked newest change removes the key.
    """
    upto = changes.where(F.col(version) <= target)
    out = latest_by_key(upto, keys, [version, *(tie or [])])
    return out.where(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else out


def restore_point(points: DataFrame, name: str, version: str):
    """Version of a named restore point."""
    found = points.where(F.col("name") == name).select(version).first()
    if found is None:
        raise ValueError(f"no restore point {name!r}")
    return found[0]


def latest_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key by ``order``, which must end in a tie-breaker.

    A rank limit of 1 lets the planner keep one row per key and task before the
    shuffle, so a key with very many versions arrives already reduced.
    """
    w = W.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def nonce_gaps(txs: DataFrame, sender: str, nonce: str) -> DataFrame:
    """Per sender: nonces used more than once, and ranges skipped between used ones.

    (sender, kind, lo, hi, rows); repeated nonces collapse before ordering.
    """
    used = txs.groupBy(sender, nonce).agg(F.count(F.lit(1)).alias("rows"))
    ordered = OrderedRows.of(used, [sender], [nonce]).previous(p=F.col(nonce)).rows
    n, p = F.col(nonce).cast("bigint"), F.col("p").cast("bigint")
    none = F.lit(None).cast("struct<kind:string,lo:bigint,hi:bigint,rows:bigint>")
    dup = F.when(
        F.col("rows") > 1, F.struct(F.lit("duplicate").alias("kind"), n.alias("lo"), n.alias("hi"), F.col("rows"))
    ).otherwise(none)
    gap = F.when(
        n - p > 1,
        F.struct(F.lit("gap").alias("kind"), (p + 1).alias("lo"), (n - 1).alias("hi"), F.lit(0).cast("bigint").alias("rows")),
    ).otherwise(none)
    return ordered.select(sender, F.inline(F.filter(F.array(dup, gap), lambda x: x.isNotNull())))


def daily_stats(
    txs: DataFrame, at: str, sender: str, receiver: str, value: str, days: int, as_of
) -> DataFrame:
    """Per day of the last ``days`` days: rows, senders, amount, and addresses seen for the first time."""
    last = as_datetime(as_of).date()
    lo = F.lit((last - timedelta(days=days - 1)).isoformat()).cast("date")
    hi = F.lit(last.isoformat()).cast("date")
    known = txs.where(F.to_date(at) <= hi).select(
        F.to_date(at).alias("day"), sender, F.array(sender, receiver).alias("_both"), value
    )
    counts = known.where(F.col("day") >= lo).groupBy("day").agg(
        F.count(F.lit(1)).alias("transactions"),
        F.count_distinct(sender).alias("senders"),
        F.sum(value).alias("amount"),
    )
    first_seen = known.select("day", F.explode("_both").alias("a")).where("a is not null").groupBy("a").agg(
        F.min("day").alias("day")
    )
    fresh = first_seen.where(F.col("day") >= lo).groupBy("day").agg(F.count(F.lit(1)).alias("new_addresses"))
    return counts.join(fresh, "day", "left").withColumn(
        "new_addresses", F.coalesce("new_addresses", F.lit(0).cast("bigint"))
    )


_FIRST_SEEN, _STATS = "first_seen", "stats"


def update_daily_stats(
    txs: DataFrame, at: str, sender: str, receiver: str, value: str, path: str, first: date, last: date
) -> None:
    """Add the days ``first`` to ``last`` to the stored statistics below ``path``; only those days of ``txs`` are read.

    Beside the statistics lies one row per address with the day it was first seen, in one folder per run. The addresses of the new days
    are reduced to one row each and matched with the folders of the runs before; those without a match are appended. A run
    that begins at the same day again replaces its folder, so a repeated run changes nothing. Days must be added in order: a run over days
    that other runs have stored, or before them, is an error, as their new addresses would be wrong.
    """
    spark, kind = txs.sparkSession, dict(txs.dtypes)
    lo = F.lit(first.isoformat()).cast("date")
    # the bounds in time are literals, so that they reach the scan
    new = txs.where((F.col(at) >= ntz(first.isoformat())) & (F.col(at) < ntz((last + timedelta(days=1)).isoformat())))
    new = new.select(F.to_date(at).alias("day"), F.col(sender).alias("_s"), F.col(receiver).alias("_r"), F.col(value).alias("_v"))
    seen_path, stats_path = f"{path}/{_FIRST_SEEN}", f"{path}/{_STATS}"
    schemas = {
        seen_path: f"address {kind[sender]}, day date, run date",
        stats_path: f"day date, transactions bigint, senders bigint, amount {new.agg(F.sum('_v')).dtypes[0][1]}, new_addresses bigint, run date",
    }
    for table, schema in schemas.items():
        spark.createDataFrame([], schema).write.mode("append").partitionBy("run").parquet(table)
    stored = spark.read.schema(schemas[stats_path]).parquet(stats_path)
    if not stored.where((F.col("day") >= lo) & (F.col("run") != lo)).isEmpty():
        raise ValueError(f"another run has stored days from {first} on")

    def replace(rows: DataFrame, table: str) -> None:
        rows = rows.withColumn("run", lo)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(table)

    met = new.select("day", F.explode(F.array("_s", "_r")).alias("address")).where("address is not null")
    met = met.groupBy("address").agg(F.min("day").alias("day"))
    seen = spark.read.schema(schemas[seen_path]).parquet(seen_path).where(F.col("run") < lo)
    # cut, as it is read twice
    fresh = cut(met.join(seen.select("address"), "address", "left_anti"))
    replace(fresh.select("address", "day"), seen_path)
    counts = new.groupBy("day").agg(
        F.count(F.lit(1)).alias("transactions"), F.count_distinct("_s").alias("senders"), F.sum("_v").alias("amount")
    )
    stats = counts.join(fresh.groupBy("day").agg(F.count(F.lit(1)).alias("new_addresses")), "day", "left")
    replace(stats.withColumn("new_addresses", F.coalesce("new_addresses", F.lit(0).cast("bigint"))), stats_path)


def stored_daily_stats(spark: SparkSession, path: str, days: int, as_of) -> DataFrame:
    """The stored statistics of the last ``days`` days, as ``daily_stats`` gives them."""
    last = as_datetime(as_of).date()
    stats = spark.read.parquet(f"{path}/{_STATS}")
    inside = F.col("day").between(F.lit((last - timedelta(days=days - 1)).isoformat()).cast("date"), F.lit(last.isoformat()).cast("date"))
    return stats.where(inside).select("day", "transactions", "senders", "amount", "new_addresses")


#: Block numbers are broadcast up to so many; beyond, the planner chooses.
BROADCAST_BLOCKS = 100_000


def fee_percentiles(
    txs: DataFrame, block: str, price: str, blocks: DataFrame, number: str, n: int, ps: dict[str, float]
) -> DataFrame:
    """Exact gas-price percentiles over the last ``n`` blocks: (speed, value).

    The least and greatest of the last ``n`` block numbers are found first (two numbers on the driver) and bound the scan of transactions. Only
    where numbers are missing between them the rows are also matched with the blocks. Prices are counted per value before they are ranked.
    """
    newest = blocks.select(F.col(number).alias(block)).distinct().orderBy(F.col(block).desc()).limit(n)
    ends = newest.agg(F.min(block).alias("lo"), F.max(block).alias("hi"), F.count(block).alias("n")).first()
    if ends["n"]:
        recent = txs.where(F.col(block).between(ends["lo"], ends["hi"]))
        if ends["hi"] - ends["lo"] + 1 != ends["n"]:
            recent = recent.join(F.broadcast(newest) if n <= BROADCAST_BLOCKS else newest, block, "left_semi")
    else:
        recent = txs.limit(0)
    found = exact_quantiles(recent, price, sorted(set(ps.values())))
    speeds = F.array(*[F.struct(F.lit(s).alias("speed"), F.lit(float(p)).alias("p")) for s, p in ps.items()])
    named = found.select("value", "q", F.inline(speeds))
    return named.where(F.col("p") == F.col("q")).select("speed", "value")


def _words(data: Column) -> Column:
    """Hex payload without 0x, for cutting into 32-byte words."""
    text = F.lower(data)
    return F.when(text.startswith("0x"), F.substr(text, F.lit(3))).otherwise(text)


def _typed_word(word: Column, kind: str) -> Column:
    if kind == "uint256":
        return word_to_decimal(word)
    if kind == "address":
        return F.concat(F.lit("0x"), F.substring(word, 25, 40))
    if kind == "bool":
        return word != "0" * 64
    return F.concat(F.lit("0x"), word)


def decode_event(
    logs: DataFrame, topic0: str, fields: list[tuple[str, str]], data: str = "data", contract: str | None = None
) -> DataFrame:
    """Logs of one event with its fixed-width words as typed columns.

    A number too wide for DECIMAL(38,0) is null in its column; ``<name>_hex`` keeps the word.
    """
    hits = logs.where(F.col("first_topic") == topic0)
    if contract is not None:
        hits = hits.where(F.col("address_hash") == contract)
    # payload, words and values are separate steps, so each is computed once per row
    cut_up = hits.withColumn("_payload", _words(F.col(data)))
    words = {f"_w{i}": F.substring("_payload", 1 + 64 * i, 64) for i in range(len(fields))}
    out = {}
    for i, (name, kind) in enumerate(fields):
        word = F.col(f"_w{i}")
        out[name] = _typed_word(F.when(F.length(word) == 64, word), kind)
        if kind == "uint256":
            out[f"{name}_hex"] = word
    return cut_up.withColumns(words).withColumns(out).drop("_payload", *words)


def decode_calls(txs: DataFrame, signatures: list[DataFrame], data: str = "input") -> DataFrame:
    """Transactions with selector, method signature and argument words."""
    body = _words(F.substring(F.col(data), 11, 1 << 30))
    count = F.floor(F.length(body) / 64).cast("int")
    words = F.when(
        count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(body, i * 64 + 1, F.lit(64)))
    ).otherwise(F.array().cast("array<string>"))
    called = txs.withColumns({"selector": F.lower(F.substring(F.col(data), 1, 10)), "args": words})
    return resolve_signature(called, "selector", signatures)


def contract_state(events: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Current value per contract: the value of its last event."""
    at = F.struct(*order)
    return events.groupBy(key).agg(
        F.max_by(value, at).alias("current_value"), F.count(F.lit(1)).alias("changes")
    )


def contract_history(events: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Every value with the order key from which, and until which, it held."""
    at = F.struct(*order)
    ordered = OrderedRows.of(events.select(key, value, *order), [key], order)
    ordered = ordered.previous(previous_value=F.col(value)).following(valid_to=F.col(order[0]))
    return ordered.with_column("_at", at).rows.drop("_at")


def signed_flows(df: DataFrame, frm: str, to: str, amount: str, keep: list[str] | None = None) -> DataFrame:
    """+amount for the receiver and -amount for the sender, as rows (keep.., address, amount)."""
    legs = F.array(
        F.struct(F.col(to).alias("address"), F.col(amount).alias("amount")),
        F.struct(F.col(frm).alias("address"), (-F.col(amount)).alias("amount")),
    )
    return df.select(*(keep or []), F.inline(legs)).where("address is not null")


def token_balances(transfers: DataFrame, token: str, frm: str, to: str, amount: str) -> DataFrame:
    """Non-zero balances by token and address."""
    flows = signed_flows(transfers, frm, to, amount, [token])
    return flows.groupBy(token, "address").agg(F.sum("amount").alias("balance")).where("balance <> 0")


def coin_balances(sources: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """Balances by address over several transfer tables (transactions, internal ones)."""
    flows = reduce(DataFrame.unionByName, [signed_flows(*s) for s in sources])
    return flows.groupBy("address").agg(F.sum("amount").alias("balance")).where("balance <> 0")


def holders(balances: DataFrame, by: str | None = None) -> DataFrame:
    held = balances.where("balance > 0")
    grouped = held.groupBy(by) if by else held.groupBy()
    return grouped.agg(F.count(F.lit(1)).alias("holders"))


def created_contracts(internal: DataFrame, contract: str, creator: str, at: str, tie: list[str]) -> DataFrame:
    """Creator and first time per created contract."""
    made = internal.where(F.col(contract).isNotNull())
    order = F.struct(at, *tie)
    return made.groupBy(contract).agg(F.min_by(creator, order).alias("creator"), F.min(at).alias("first_seen"))


def dedup_logs(logs: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row per log key; with ``order`` the newest receipt wins."""
    return latest_by_key(logs, keys, order) if order else logs.dropDuplicates(keys)


def recovery_target(as_of, points: DataFrame | None = None, name: str | None = None, version: str = "at") -> Column:
    """Target of a recovery: an explicit time, or the version of a named restore point."""
    return F.lit(restore_point(points, name, version)) if name is not None else ntz(as_of)
