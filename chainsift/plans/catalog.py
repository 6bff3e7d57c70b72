"""All queries of the ledger engine."""

from . import detector_queries, forensic_queries, ledger_queries, model_queries, source_queries  # noqa: F401
from .base import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
