"""Registered queries over the stored tables, each with its SQL counterpart."""

from ledgerops.plans import (  # noqa: F401
    alerting, chain, health, joins, logs, metrics, partitions, scalars, sources, streams,
)
from ledgerops.plans.registry import ORACLES, QUERIES  # noqa: F401
