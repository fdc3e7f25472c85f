"""Registered queries over the input tables."""

from . import curation, graphs, molecules, more, similarity
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "curation", "graphs", "molecules", "more", "similarity"]
