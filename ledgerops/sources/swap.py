"""Swap staged tables for live ones in the session catalog, and back."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _rename_all(spark: SparkSession, renames: list[tuple[str, str]]) -> None:
    """Rename in order; on a failure undo what was done and raise."""
    for old, new in renames:
        if not spark.catalog.tableExists(old):
            raise ValueError(f"no table {old}")
    free_later = {old for old, _ in renames}
    for _, new in renames:
        if new not in free_later and spark.catalog.tableExists(new):
            raise ValueError(f"table {new} already exists")
    done = []
    try:
        for old, new in renames:
            spark.sql(f"ALTER TABLE {old} RENAME TO {new}")
            done.append((old, new))
    except Exception:
        for old, new in reversed(done):
            spark.sql(f"ALTER TABLE {new} RENAME TO {old}")
        raise


def swap_tables(spark: SparkSession, pairs: dict[str, str], backup_suffix: str = "_old") -> None:
    """Put each staged table in the place of its live one; the live one is kept as backup.

    ``pairs`` maps live name to staged name. All checks run before the first rename;
    renames touch metadata only.
    """
    renames = []
    for live, staged in pairs.items():
        renames += [(live, live + backup_suffix), (staged, live)]
    _rename_all(spark, renames)


def rollback_swap(spark: SparkSession, pairs: dict[str, str], backup_suffix: str = "_old") -> None:
    """Undo ``swap_tables``."""
    renames = []
    for live, staged in pairs.items():
        renames += [(live, staged), (live + backup_suffix, live)]
    _rename_all(spark, renames)
