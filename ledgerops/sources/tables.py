"""Tables by name: stored files, and the chain tables laid over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def base_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Chain tables as projections of stored ones. Every view is a plain select, so
# column pruning and filters still reach the file scan.
CHAIN_VIEWS = {
    "blocks": (
        "orders",
        {
            "hash": "md5(cast(o_orderkey as string))",
            "number": "o_orderkey",
            "timestamp": "o_orderdate",
            "miner_hash": "cast(o_custkey as string)",
            "consensus": "o_orderstatus <> 'P'",
            "inserted_at": "o_orderdate",
        },
    ),
    "transactions": (
        "lineitem",
        {
            "hash": "md5(concat(cast(l_orderkey as string), '-', cast(l_linenumber as string)))",
            "block_number": "l_orderkey",
            "block_hash": "md5(cast(l_orderkey as string))",
            "from_address_hash": "cast(l_suppkey as string)",
            "to_address_hash": "cast(l_partkey % 100 as string)",
            "nonce": "cast(l_linenumber as bigint)",
            "value": "l_extendedprice",
            "gas_price": "l_tax",
            "inserted_at": "l_shipdate",
        },
    ),
    "logs": (
        "lineitem",
        {
            "transaction_key": "l_orderkey",
            "index": "l_linenumber",
            "address_hash": "cast(l_suppkey as string)",
            "first_topic": "l_returnflag",
            "second_topic": "l_linestatus",
            "third_topic": "cast(l_linenumber as string)",
            "fourth_topic": "cast(null as string)",
            "inserted_at": "l_shipdate",
        },
    ),
    "token_transfers": (
        "lineitem",
        {
            "transaction_key": "l_orderkey",
            "log_index": "l_linenumber",
            "token_contract_address_hash": "cast(l_partkey % 50 as string)",
            "from_address_hash": "cast(l_suppkey as string)",
            "to_address_hash": "cast(l_partkey % 100 as string)",
            "amount": "cast(l_quantity as bigint)",
            "inserted_at": "l_shipdate",
        },
    ),
    "internal_transactions": (
        "lineitem",
        {
            "transaction_hash": "md5(cast(l_orderkey as string))",
            "index": "l_linenumber",
            "from_address_hash": "cast(l_suppkey as string)",
            "to_address_hash": "cast(l_partkey % 100 as string)",
            "created_contract_address_hash":
                "case when l_returnflag = 'A' then cast(l_partkey as string) end",
            "value": "l_discount",
            "inserted_at": "l_shipdate",
        },
    ),
    # metric samples: one gauge per event type, with a label map
    "samples": (
        "events",
        {
            "metric": "event_type",
            "labels": "map('instance', cast(user_id % 5 as string), 'job', concat('job-', cast(user_id % 2 as string)))",
            "ts": "ts",
            "value": "value",
        },
    ),
}

CONTROL = {
    "blocks": "inserted_at", "transactions": "inserted_at", "logs": "inserted_at",
    "token_transfers": "inserted_at", "internal_transactions": "inserted_at", "samples": "ts",
}


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table or a chain table, by name."""
    if name in BASE_TABLES:
        return base_table(spark, sf_dir, name)
    if name not in CHAIN_VIEWS:
        raise KeyError(f"no table {name!r}")
    source, columns = CHAIN_VIEWS[name]
    return base_table(spark, sf_dir, source).select(
        *[F.expr(body).alias(alias) for alias, body in columns.items()]
    )
