"""All registered queries of the library's own operators, with their SQL equivalents."""

from __future__ import annotations

from anisomap.plans import evaluation, fitting, generators, geometry, pairing, tables

QUERIES = {**geometry.QUERIES, **pairing.QUERIES, **evaluation.QUERIES, **tables.QUERIES, **fitting.QUERIES, **generators.QUERIES}
ORACLES = {**geometry.ORACLES, **pairing.ORACLES, **evaluation.ORACLES, **tables.ORACLES, **fitting.ORACLES, **generators.ORACLES}
