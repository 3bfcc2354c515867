"""The queries of this package: name -> builder, and their SQL where there is one."""

from __future__ import annotations

import importlib

from retentia.llm.common import QUERIES

MODULES = ["langid", "quality", "lm", "topk", "mixing", "jaccard", "licenses", "chat", "decontaminate", "substring", "urlfilter", "lexical", "whitening"]


def load():
    for m in MODULES:
        importlib.import_module(f"retentia.llm.{m}")
    return QUERIES


def queries():
    return {k: e.build for k, e in load().items()}


def oracle_sql():
    return {k: e.sql for k, e in load().items() if e.sql}
