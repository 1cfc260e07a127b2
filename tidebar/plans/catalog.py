"""Importing this module fills the registry."""

from tidebar.plans import features_q, grids_q, models_q, paths_q, signals_q, sources_q, streams_q, trades_q  # noqa: F401
from tidebar.plans.registry import QUERIES

__all__ = ["QUERIES"]
