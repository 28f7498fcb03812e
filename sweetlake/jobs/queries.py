"""All registered queries of the glycan operators and their SQL twins."""

from __future__ import annotations

from . import chromatogram_queries, hierarchy_queries, source_queries, spectra_queries, structure_queries, table_queries, text_queries  # noqa: F401  each registers its queries
from .registry import ORACLES, QUERIES  # noqa: F401
