"""All registered queries."""

from . import (  # noqa: F401  (imports register the queries)
    q_alerts,
    q_bundles,
    q_gold,
    q_payer,
    q_reports,
    q_streams,
    q_tables,
    q_telemetry,
)
from .registry import QUERIES, oracle

ORACLE = oracle()
