"""Query registry: name -> (Spark builder, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Entry:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    op_ids: str


REGISTRY: dict[str, Entry] = {}
#: whole operators that cannot end within a registered query's limits: run by name only
EXITS: dict[str, Entry] = {}


def query(name: str, ops: str, sql: str | None = None, into: dict[str, Entry] = REGISTRY):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its oracle SQL."""

    def deco(fn):
        if name in REGISTRY or name in EXITS:
            raise ValueError(f"duplicate query {name}")
        into[name] = Entry(name, fn, sql, ops)
        return fn

    return deco


def exit_query(name: str, ops: str):
    """``query`` for a member of EXITS."""
    return query(name, ops, into=EXITS)


def r6(c) -> F.Column:
    """Round a computed double to 6 decimals (float-noise guard for the oracle compare)."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)
