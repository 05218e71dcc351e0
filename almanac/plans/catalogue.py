"""Imports every plan module so that all queries are registered."""

from almanac.plans import aggregate_plans, join_plans, model_plans, scalar_plans, source_plans, statistics_plans, text_plans  # noqa: F401
from almanac.plans.registry import ORACLES, QUERIES  # noqa: F401
