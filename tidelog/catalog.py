"""Named queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

from tidelog.plans.oracles import ORACLES
from tidelog.plans.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
