"""All registered queries; importing the modules fills the registry."""

from rewardloom.plans import (  # noqa: F401
    queries_graph, queries_ingest, queries_metrics, queries_models, queries_reward, queries_stream, queries_tables,
    queries_text,
)
from rewardloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
