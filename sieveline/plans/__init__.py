"""Registered queries over the driver tables and their SQL oracles."""

from sieveline.plans import branch_queries, evaluate_queries, model_queries, prepare_queries  # noqa: F401
from sieveline.plans.registry import ORACLES, QUERIES  # noqa: F401
