"""Registered queries of the engine."""

from palimpsest.plans import aggregates, clusters, governance, joins, lifecycle, multisource, networks, ranking, recall, records, retrieval, scalars, sources, windows  # noqa: F401
from palimpsest.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES
