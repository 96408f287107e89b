"""Progress and partition state of every chain table in one frame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerops.operators.health import indexing_progress
from ledgerops.operators.partitions import partition_counts
from ledgerops.plans.inputs import now_of, partitions_frame
from ledgerops.sources.tables import load_table

_NUMBER = {"blocks": "number", "transactions": "block_number"}


def indexing_overview(spark: SparkSession, sf: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    now = now_of(spark, sf, "lineitem")
    parts = []
    for parent, number in _NUMBER.items():
        progress = indexing_progress(load_table(spark, sf, parent), number, "inserted_at", now)
        parts.append(progress.withColumn("parent_table", F.lit(parent)))
    progress = reduce(DataFrame.unionByName, parts)
    counts = partition_counts(progress, partitions_frame(spark, sf), "left")
    return progress.join(counts, "parent_table").select("parent_table", *progress.columns[:-1], "partition_count")

