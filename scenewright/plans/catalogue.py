"""All queries of the core and their SQL."""

from __future__ import annotations

from . import data_quality, reconstruction, scene

QUERIES = {**data_quality.QUERIES, **scene.QUERIES, **reconstruction.QUERIES}
ORACLE = {**data_quality.ORACLE, **scene.ORACLE, **reconstruction.ORACLE}
FLAGSHIP = "covisibility_pairs"
