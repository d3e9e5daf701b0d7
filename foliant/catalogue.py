"""All registered queries of the engine's own operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant import registry
from foliant.operators import benchmarks, classify, diffs, files, graph, integrity, inventory, lint, mirrors, overlap, records, screening, texts, windows  # noqa: F401
from foliant.sources import corpus  # noqa: F401
from foliant.streaming import changes, watching  # noqa: F401
from foliant.plans import reports, views  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries by name."""
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    return dict(registry.ORACLES)
