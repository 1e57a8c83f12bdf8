"""All queries and their SQL; importing the catalogues registers them."""

from __future__ import annotations

from . import catalogue_embeddings, catalogue_extensions, catalogue_search, catalogue_store, catalogue_values  # noqa: F401
from .catalogue import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
