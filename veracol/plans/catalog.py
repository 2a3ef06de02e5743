"""Every registered query of the core engine with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veracol.plans import audit_queries, boundary_queries, model_queries, retrieval_queries, rule_queries, span_queries, store_queries, stream_queries, text_queries
from veracol.plans.common import Query

_CATALOGS = (text_queries.catalog, retrieval_queries.catalog, rule_queries.catalog, model_queries.catalog, audit_queries.catalog, span_queries.catalog, stream_queries.catalog, boundary_queries.catalog, store_queries.catalog)


def queries() -> dict[str, Query]:
    return {k: q for c in _CATALOGS for k, q in c.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for c in _CATALOGS for k, s in c.oracle.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risks of every document."""
    return text_queries.doc_risks(spark, sf_dir)
