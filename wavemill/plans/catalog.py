"""All plans of the core library by inventory name."""

from __future__ import annotations

from . import beat_plans, evaluation, feature_plans, model_plans, relational_plans, safety_errors, signal_plans, source_plans, splitting, statistics  # noqa: F401
from .fixtures import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
