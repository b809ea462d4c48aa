"""All named queries of the engine, with their SQL."""

from . import curve_queries, graph_queries, overlay_queries, scalar_queries, spatial_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
