"""Every query of the engine, and the same in DuckDB's SQL."""

from __future__ import annotations

from .plans.oracles import ORACLES
from .plans.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
