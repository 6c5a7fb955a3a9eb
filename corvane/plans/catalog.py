"""All queries of the retrieval engine and their SQL counterparts."""

from __future__ import annotations

from corvane.plans import registry
from corvane.plans import context_plans, flow_plans, rag_plans, retrieval_plans, text_plans  # noqa: F401  register their queries


def flagship(spark, sf_dir):
    return registry.QUERIES["ret17_hybrid_search"](spark, sf_dir)


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.SQL)
