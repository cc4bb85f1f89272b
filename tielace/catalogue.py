"""All queries outside the llm subpackage, by name, with their SQL."""

from __future__ import annotations

from .plans import queries_eval, queries_geometry, queries_models, queries_points, queries_raster, queries_structure, queries_warp  # noqa: F401  register
from .plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
