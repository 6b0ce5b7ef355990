"""All queries by name, and the SQL of those that have a closed form."""

from __future__ import annotations

from . import extended, inference, points, registry

QUERIES = registry.QUERIES | extended.QUERIES | inference.QUERIES | points.QUERIES
ORACLES = registry.ORACLES | extended.ORACLES | inference.ORACLES | points.ORACLES
