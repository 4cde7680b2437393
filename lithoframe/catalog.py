"""Registry of the library's queries and of the DuckDB SQL they are checked against."""

from __future__ import annotations

from .plans import extras, geometry, lattices, surfaces, wells

QUERIES: dict = {**wells.QUERIES, **geometry.QUERIES, **extras.QUERIES, **lattices.QUERIES, **surfaces.QUERIES}
ORACLES: dict = {**wells.ORACLES, **geometry.ORACLES, **extras.ORACLES, **lattices.ORACLES, **surfaces.ORACLES}
