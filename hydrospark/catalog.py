"""All queries of the library and the DuckDB SQL that they are held against."""

from __future__ import annotations

from hydrospark.operators import asof, evaluation, events, iterative, lines, outlines, polygons, projections, quadtree, rasters, scenes, scoring, selection, spatial, tiles  # noqa: F401  each registers its queries
from hydrospark.plans.registry import ORACLES, QUERIES  # noqa: F401
from hydrospark.sources import products, scans  # noqa: F401
