"""Registered queries; importing the package fills the registry."""

from spanforge.plans import broken, database, fields, findings, limits, logs, rendered, rollups, timeline, trees  # noqa: F401
from spanforge.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
