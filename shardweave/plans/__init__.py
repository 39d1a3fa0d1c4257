"""The registered queries, grouped by operator family."""

from __future__ import annotations

from shardweave.plans import (  # noqa: F401
    alerting,
    autosplits,
    fleets,
    gathers,
    layouts,
    placement,
    recoveries,
    reshards,
    streams,
    topologies,
    workloads,
)
from shardweave.plans.registry import ORACLE, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
