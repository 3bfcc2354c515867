"""All registered queries: ``queries()`` and ``oracle_sql()`` for the driver contract."""

from __future__ import annotations

import importlib

from retentia.plans.registry import REGISTRY

MODULES = ["q_core", "q_quality", "q_metrics", "q_retrieval", "q_recommend", "q_model", "q_stream"]


def load() -> dict:
    for m in MODULES:
        importlib.import_module(f"retentia.plans.{m}")
    return REGISTRY


def queries():
    return {k: v.build for k, v in load().items()}


def oracle_sql():
    return {k: v.sql for k, v in load().items() if v.sql}


def entry(spark):
    from retentia.plans.q_core import at_risk_context

    return at_risk_context(spark, "/root/testdata/sf0.001")
