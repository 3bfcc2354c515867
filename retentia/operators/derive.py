"""Row-wise derived columns over customer / interaction / request frames.

Every function is a narrow transformation (no shuffle): it adds or projects
columns with built-in expressions, so Catalyst fuses it into the scan's codegen
stage and prunes everything the caller does not use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia import schemas as S
from retentia.functions import numeric as N


def feature_projection(customers: DataFrame, with_id: bool = False) -> DataFrame:
    """The model's feature columns in their fixed order; identifiers and label dropped."""
    cols = (["customer_id"] if with_id else []) + S.FEATURE_COLUMNS
    return customers.select(*cols)


def add_bins(customers: DataFrame) -> DataFrame:
    """CLV segment, tenure bucket and ticket bucket (right-closed), with bucket order."""
    return customers.select(
        "*",
        N.cut(F.col("tenure_months") * F.col("monthly_charges"), S.CLV_EDGES, S.CLV_LABELS).alias("clv_bin"),
        N.cut("tenure_months", S.TENURE_EDGES, S.TENURE_LABELS).alias("tenure_bucket"),
        N.cut_index("tenure_months", S.TENURE_EDGES).alias("tenure_bucket_idx"),
        N.cut("num_support_tickets", S.TICKET_EDGES, S.TICKET_LABELS).alias("ticket_bucket"),
        N.cut_index("num_support_tickets", S.TICKET_EDGES).alias("ticket_bucket_idx"),
    )


def clip_round(customers: DataFrame) -> DataFrame:
    """Clip-then-round for charges and satisfaction, round-then-clip for totals."""
    raw_monthly = F.col("total_charges") / F.lit(1000.0)
    raw_satisfaction = F.lit(4.4) - F.lit(0.35) * F.col("num_support_tickets")
    raw_total = F.col("tenure_months") * F.col("monthly_charges") - F.lit(50.0)
    return customers.select(
        "customer_id",
        N.round_half_even(N.clip(raw_monthly, 18, 150), 2).alias("monthly_clipped"),
        N.round_half_even(N.clip(raw_satisfaction, 1, 5), 2).alias("satisfaction_clipped"),
        N.clip(N.round_half_even(raw_total, 2), 0, None).alias("total_clipped"),
    )


def score_with_scorecard(
    customers: DataFrame,
    threshold: float = S.DEFAULT_THRESHOLD,
    month_to_month: str = "Month-to-month",
    electronic_check: str = "Electronic check",
) -> DataFrame:
    """Linear score, sigmoid probability and the label at ``threshold``."""
    score = N.scorecard(month_to_month=month_to_month, electronic_check=electronic_check)
    return (
        customers.withColumn("churn_score", score)
        .withColumn("churn_probability", N.sigmoid("churn_score"))
        .withColumn("predicted_label", N.threshold_label("churn_probability", threshold))
        .withColumn("threshold_used", F.lit(float(threshold)))
    )


def high_risk(scored: DataFrame) -> DataFrame:
    """The customers flagged at-risk (``predicted_label = 1``)."""
    return scored.where(F.col("predicted_label") == 1)


def signup_date_from_tenure(customers: DataFrame, asof: str) -> DataFrame:
    """Signup date = asof - int(tenure * 30.4) days, and the inverse month count."""
    signup = N.date_from_tenure(F.to_date(F.lit(asof)), F.col("tenure_months"))
    return customers.select(
        "customer_id",
        "tenure_months",
        signup.alias("signup_date_derived"),
        N.tenure_from_date(F.to_date(F.lit(asof)), signup).alias("tenure_back"),
    )


def expand_tickets(customers: DataFrame) -> DataFrame:
    """One row per support ticket; customers with zero tickets produce none.

    ``sequence(1, 0)`` would count down, so zero-ticket rows are filtered first.
    """
    return customers.where(F.col("num_support_tickets") > 0).select(
        "customer_id",
        F.explode(F.sequence(F.lit(1), F.col("num_support_tickets"))).alias("ticket_no"),
    )


# A message template with named placeholders
BILLING_TEMPLATE = "I was charged ${amount} but my plan should only cost ${expected}. Can you explain this?"


def fill_template(template: str, values: dict) -> F.Column:
    """Fill ``{name}`` placeholders of ``template`` from column expressions."""
    out = F.lit(template)
    for name, col in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), col.cast("string"))
    return out


def text_template(events: DataFrame) -> DataFrame:
    """B13 over raw events: amount = floor(value), expected = floor(value / 2) + 20."""
    amount = F.floor("value").cast("bigint")
    expected = (F.floor(F.col("value") / F.lit(2.0)) + F.lit(20)).cast("bigint")
    return events.select(
        F.col("event_id").alias("interaction_id"),
        fill_template(BILLING_TEMPLATE, {"amount": amount, "expected": expected}).alias("text"),
    )


def validate_requests(requests: DataFrame, top_k: str = "top_k", query: str = "query") -> DataFrame:
    """Default ``top_k`` (5) and query text; status ``valid`` iff 1 <= top_k <= 20."""
    k = F.coalesce(F.col(top_k), F.lit(S.TOP_K_DEFAULT))
    return requests.withColumn(top_k, k.cast("int")).withColumn(
        query, F.coalesce(F.col(query), F.lit(S.DEFAULT_QUERY))
    ).withColumn(
        "status",
        F.when((F.col(top_k) >= S.TOP_K_MIN) & (F.col(top_k) <= S.TOP_K_MAX), F.lit("valid")).otherwise(F.lit("rejected")),
    )
