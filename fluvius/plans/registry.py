"""All registered queries of the library with their SQL twins."""

from __future__ import annotations

from fluvius.plans import maps, networks, rasters, resampled, vectors
from fluvius.plans.rasters import flagship

__all__ = ["ORACLE", "QUERIES", "flagship"]

QUERIES: dict = {**rasters.QUERIES, **vectors.QUERIES, **networks.QUERIES, **resampled.QUERIES, **maps.QUERIES}
ORACLE: dict[str, str] = {**rasters.ORACLE, **vectors.ORACLE, **networks.ORACLE, **resampled.ORACLE, **maps.ORACLE}
