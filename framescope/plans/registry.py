"""All registered queries; importing this fills the catalogue."""

from __future__ import annotations

from . import (  # noqa: F401
    clean_queries,
    compare_queries,
    distribution_queries,
    impute_queries,
    profile_queries,
    quality_queries,
    source_queries,
    temporal_queries,
    text_queries,
)
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
