"""Queries over the star-schema tables, each with the SQL it has to agree with."""

import importlib

from checks import views  # noqa: F401
from checks.registry import ORACLES, QUERIES

AREAS = ("topics", "kpi", "actors", "evidence", "text", "selection", "sinks")

for _area in AREAS:
    importlib.import_module(f"checks.{_area}")

__all__ = ["QUERIES", "ORACLES"]
