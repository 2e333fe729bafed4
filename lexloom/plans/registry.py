"""All queries by name, and their SQL."""

from __future__ import annotations

from lexloom.plans import corpus_queries, ranking_queries, search_queries
from lexloom.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "corpus_queries", "flagship", "ranking_queries"]


def flagship(spark, sf_dir):
    return search_queries.win1(spark, sf_dir)
