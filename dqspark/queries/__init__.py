"""Named queries over the given tables with their SQL twins."""

from dqspark.queries import change_q, contract_q, drift_q, lineage_q, ops_q, profile_q, rca_q, sources_q, stream_q
from dqspark.queries.base import ORACLES, QUERIES

__all__ = [
    "ORACLES",
    "QUERIES",
    "change_q",
    "contract_q",
    "drift_q",
    "lineage_q",
    "ops_q",
    "profile_q",
    "rca_q",
    "sources_q",
    "stream_q",
]
