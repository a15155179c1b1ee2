"""Registered queries. Importing this package registers all of them."""

from wordlake.plans import (  # noqa: F401
    corpus_queries, coverage_queries, dataset_queries, feature_queries, language_queries, model_queries, relational_queries, sequence_queries,
    source_queries, text_queries, vector_queries)
from wordlake.plans.registry import QUERIES, Query, Tables, query

__all__ = ["QUERIES", "Query", "Tables", "query"]
