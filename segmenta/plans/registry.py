"""Registry of the named queries of the segmentation engine.

``QUERIES`` maps a name to ``(spark, sf_dir) -> DataFrame``; ``ORACLES`` maps
the same name to DuckDB SQL over the same tables.
"""

from __future__ import annotations

from segmenta.plans import semantic_queries, source_queries, structure_queries, text_queries, vector_queries

_MODULES = (vector_queries, text_queries, semantic_queries, structure_queries, source_queries)

QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
