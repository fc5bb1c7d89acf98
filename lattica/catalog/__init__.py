"""The queries of the engine's own operators, and the SQL that gives the same rows."""

from lattica.catalog import grids, kernels, learned, searches, trees
from lattica.catalog.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "grids", "kernels", "learned", "searches", "trees"]
