"""Queries over the given tables, each with the SQL it must agree with."""

from promptloom.plans import inference, ingest, logs, streams, telemetry, work  # noqa: F401
from promptloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
