"""All registered queries of the cell analytics operators."""

from __future__ import annotations

from lamella.plans import cells, graphs, keypoints, planes, sources, spatial, thresholds  # noqa: F401  they register
from lamella.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
