"""All registered queries of the retrieval engine and the SQL that each is held against."""

from __future__ import annotations

from . import evaluation, reports, retrieval, texts  # noqa: F401  they register their queries
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
