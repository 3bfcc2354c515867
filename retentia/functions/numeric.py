"""Numeric column expressions: right-closed binning, clip/round, scorecard, sigmoid, labels.

All of them are built-in Catalyst expressions, so they stay inside whole-stage
codegen.  None of them needs Python at run time.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from retentia import schemas as S


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def cut(x, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed binning ``(e0, e1], (e1, e2], ...``; values outside all edges give null.

    This is the semantics of a fixed-edge cut with right-closed intervals.  MLlib's
    ``Bucketizer`` is left-closed, so it is not used.
    """
    if len(edges) != len(labels) + 1:
        raise ValueError("need len(edges) == len(labels) + 1")
    x = _c(x)
    expr = None
    for hi, label in zip(edges[1:], labels):
        cond = x <= F.lit(hi) if not math.isinf(hi) else x.isNotNull()
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    # values at or below the first edge (and nulls) fall out of every bin
    return F.when(x > F.lit(edges[0]), expr.otherwise(F.lit(None)))


def cut_index(x, edges: Sequence[float]) -> Column:
    """0-based index of the right-closed bin of ``x`` (null outside), for ordering bins."""
    x = _c(x)
    expr = None
    for i, hi in enumerate(edges[1:]):
        cond = x <= F.lit(hi) if not math.isinf(hi) else x.isNotNull()
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return F.when(x > F.lit(edges[0]), expr)


def clip(x, lo=None, hi=None) -> Column:
    x = _c(x)
    if lo is not None:
        x = F.greatest(x, F.lit(lo))
    if hi is not None:
        x = F.least(x, F.lit(hi))
    return x


def round_half_even(x, scale: int = 2) -> Column:
    """Banker's rounding (the numpy rounding rule); ``F.round`` would be half-up."""
    return F.bround(_c(x), scale)


def indicator(x, value) -> Column:
    return (_c(x) == F.lit(value)).cast("int")


def scorecard(
    weights: Mapping[str, float] = S.SCORECARD_WEIGHTS,
    intercept: float = S.SCORECARD_INTERCEPT,
    month_to_month: str = "Month-to-month",
    electronic_check: str = "Electronic check",
) -> Column:
    """Linear churn score of a customers frame (noise term left out)."""
    terms = {
        "tenure_months": F.col("tenure_months"),
        "is_month_to_month": indicator("contract_type", month_to_month),
        "monthly_charges": F.col("monthly_charges"),
        "num_support_tickets": F.col("num_support_tickets"),
        "avg_satisfaction_score": F.col("avg_satisfaction_score"),
        "is_electronic_check": indicator("payment_method", electronic_check),
        "has_tech_support": indicator("tech_support", "Yes"),
        "has_online_security": indicator("online_security", "Yes"),
    }
    score = None
    for name, w in weights.items():
        t = F.lit(w) * terms[name]
        score = t if score is None else score + t
    return score + F.lit(intercept)


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def threshold_label(p, threshold: float) -> Column:
    return (_c(p) >= F.lit(threshold)).cast("int")


def months_to_days(months) -> Column:
    """``int(months * 30.4)`` days (truncation toward zero)."""
    return (_c(months) * F.lit(30.4)).cast("int")


def date_from_tenure(asof, months) -> Column:
    return F.date_sub(F.lit(asof).cast("date") if isinstance(asof, str) else asof, months_to_days(months))


def tenure_from_date(asof, date_col) -> Column:
    asof_c = F.to_date(F.lit(asof)) if isinstance(asof, str) else asof
    return F.floor(F.datediff(asof_c, _c(date_col)) / F.lit(30.4)).cast("int")


def created_at(at: str | None = None) -> Column:
    """the log timestamp, zone-less in UTC: the given literal (tests, replays) or the
    query's current time converted from the session zone to UTC."""
    if at is not None:
        return F.lit(at).cast("timestamp_ntz")
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.localtimestamp())
