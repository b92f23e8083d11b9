"""All queries of the engine proper."""

from textloom.plans import constant_plans, contract_plans, duplicate_plans, evaluation_plans, flow_plans, graph_plans, line_plans, linter_plans, markup_plans, metric_plans, planning_plans, record_plans, slice_plans, stream_plans, syntax_plans, walk_plans  # noqa: F401
from textloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
