"""Row checks, keys and references."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """``kind``: required, type, enum, pattern, min or max; ``arg`` is its parameter."""

    column: str
    kind: str
    arg: object = None

    def violated(self) -> Column:
        c = F.col(self.column)
        if self.kind == "required":
            return c.isNull()
        if self.kind == "type":
            return c.isNotNull() & c.cast("string").try_cast(str(self.arg)).isNull()
        if self.kind == "enum":
            return c.isNotNull() & ~c.isin(*self.arg)
        if self.kind == "pattern":
            return c.isNotNull() & ~c.cast("string").rlike(str(self.arg))
        if self.kind == "min":
            return c.isNotNull() & (c < F.lit(self.arg))
        if self.kind == "max":
            return c.isNotNull() & (c > F.lit(self.arg))
        raise ValueError(f"unknown check {self.kind!r}")

    @property
    def name(self) -> str:
        return f"{self.column}:{self.kind}"


def validate(df: DataFrame, checks: list[Check]) -> DataFrame:
    """Violations per check, all counted in one pass: (column_name, rule, violations, rows)."""
    counts = [F.count(F.when(c.violated(), 1)).alias(f"c{i}") for i, c in enumerate(checks)]
    row = df.agg(*counts, F.count(F.lit(1)).alias("rows"))
    out = [
        F.struct(F.lit(c.column).alias("column_name"), F.lit(c.kind).alias("rule"), F.col(f"c{i}").alias("violations"))
        for i, c in enumerate(checks)
    ]
    return row.select("rows", F.inline(F.array(*out))).select("column_name", "rule", "violations", "rows")


def violating_rows(df: DataFrame, checks: list[Check]) -> DataFrame:
    """Rows failing at least one check, with the names of the failed ones."""
    failed = F.filter(
        F.array(*[F.when(c.violated(), F.lit(c.name)) for c in checks]), lambda x: x.isNotNull()
    )
    return df.withColumn("failed", failed).where(F.size("failed") > 0)


def fill_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Declared defaults in place of nulls; a missing column is added whole."""
    filled = {
        name: F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value)
        for name, value in defaults.items()
    }
    return df.withColumns(filled)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: distinct keys, duplicated keys, surplus rows, rows with a null key part."""
    null_part = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("bigint")
    return per_key.agg(
        F.count(F.when(~null_part, 1)).alias("distinct_keys"),
        F.count(F.when(~null_part & (F.col("n") > 1), 1)).alias("duplicated_keys"),
        F.coalesce(F.sum(F.when(~null_part, F.col("n") - 1)), zero).alias("surplus_rows"),
        F.coalesce(F.sum(F.when(null_part, F.col("n"))), zero).alias("null_key_rows"),
    )


def fk_orphans(relations: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Child rows without parent per relation: (relation, orphan_keys, orphan_rows).

    Each relation is (name, child, child key, parent, parent key). Children are counted
    per key before the anti join, so a hot key costs one row.
    """
    out = []
    for name, child, child_key, parent, parent_key in relations:
        keys = child.where(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("k")).agg(
            F.count(F.lit(1)).alias("n")
        )
        lost = keys.join(parent.select(F.col(parent_key).alias("k")).distinct(), "k", "left_anti")
        out.append(
            lost.agg(
                F.count(F.lit(1)).alias("orphan_keys"),
                F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("orphan_rows"),
            ).withColumn("relation", F.lit(name))
        )
    return reduce(DataFrame.unionByName, out)
