"""Declared table schemas, feature lists and the fixed values the engine must share
with the application it replaces.

Every constant under a "Fixed values" comment must stay equal to the original
application's value for results to agree; they are stated as plain text in
their natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Model feature lists (order matters: it is the feature order)
# ---------------------------------------------------------------------------
FEATURE_COLUMNS = [
    "tenure_months",
    "contract_type",
    "monthly_charges",
    "total_charges",
    "payment_method",
    "internet_service",
    "tech_support",
    "online_security",
    "paperless_billing",
    "num_support_tickets",
    "avg_satisfaction_score",
    "clv_segment",
]
CATEGORICAL_COLUMNS = [
    "contract_type",
    "payment_method",
    "internet_service",
    "tech_support",
    "online_security",
    "paperless_billing",
    "clv_segment",
]
NUMERIC_COLUMNS = [
    "tenure_months",
    "monthly_charges",
    "total_charges",
    "num_support_tickets",
    "avg_satisfaction_score",
]
IDENTIFIER_COLUMNS = ["customer_id", "signup_date"]
LABEL_COLUMN = "churned"

# ---------------------------------------------------------------------------
# Bins (right-closed edges, labels)
# ---------------------------------------------------------------------------
CLV_EDGES = [-1, 500, 2000, 5000, float("inf")]
CLV_LABELS = ["Low", "Medium", "High", "VIP"]
TENURE_EDGES = [-1, 6, 12, 24, 48, 72]
TENURE_LABELS = ["0-6mo", "7-12mo", "13-24mo", "25-48mo", "49-72mo"]
TICKET_EDGES = [-1, 0, 1, 3, 6, 100]
TICKET_LABELS = ["0", "1", "2-3", "4-6", "7+"]

# ---------------------------------------------------------------------------
# Churn scorecard weights (noise term left out) and thresholds
# ---------------------------------------------------------------------------
SCORECARD_WEIGHTS = {
    "tenure_months": -0.045,
    "is_month_to_month": 0.90,
    "monthly_charges": 0.020,
    "num_support_tickets": 0.35,
    "avg_satisfaction_score": -0.55,
    "is_electronic_check": 0.45,
    "has_tech_support": -0.30,
    "has_online_security": -0.25,
}
SCORECARD_INTERCEPT = -0.3
TARGET_PRECISION = 0.87
DEFAULT_THRESHOLD = 0.5
MODEL_VERSION = "xgboost-v1"

# ---------------------------------------------------------------------------
# Guardrails and requests
# ---------------------------------------------------------------------------
MIN_LENGTH = 20
MAX_LENGTH = 1000
DOLLAR_AMOUNT_PATTERN = r"\$\d+(?:\.\d{2})?"
MAX_ATTEMPTS = 2
TOP_K_DEFAULT = 5
TOP_K_MIN = 1
TOP_K_MAX = 20
DEFAULT_QUERY = "Why might this customer churn, and what should the support team do?"
EMPTY_CONTEXT_TEXT = "(No interaction history available for this customer.)"
STRUCTURAL_OK = "Structural checks passed."
EMPTY_REASON = "Recommendation is empty."
NO_AMOUNTS_REASON = "No dollar amounts claimed."
AMOUNTS_OK_REASON = "All claimed dollar amounts are grounded in context."
ALL_PASSED_REASON = "All guardrails passed."

# ---------------------------------------------------------------------------
# Declared domains of the customer and interaction tables
# ---------------------------------------------------------------------------
CONTRACT_TYPES = ["Month-to-month", "One year", "Two year"]
PAYMENT_METHODS = ["Electronic check", "Mailed check", "Bank transfer", "Credit card"]
INTERNET_SERVICES = ["DSL", "Fiber optic", "No internet service"]
YES_NO = ["Yes", "No"]
CHANNELS = ["chat", "email", "phone"]
INTERACTION_TYPES = [
    "billing_issue",
    "technical_problem",
    "complaint",
    "cancellation_request",
    "positive_feedback",
    "general_inquiry",
]
SENTIMENTS = ["negative", "neutral", "positive"]

# ---------------------------------------------------------------------------
# Table schemas (all declared columns are NOT NULL)
# ---------------------------------------------------------------------------
CUSTOMERS = T.StructType(
    [
        T.StructField("customer_id", T.LongType(), False),
        T.StructField("signup_date", T.DateType(), False),
        T.StructField("tenure_months", T.IntegerType(), False),
        T.StructField("contract_type", T.StringType(), False),
        T.StructField("monthly_charges", T.DoubleType(), False),
        T.StructField("total_charges", T.DoubleType(), False),
        T.StructField("payment_method", T.StringType(), False),
        T.StructField("internet_service", T.StringType(), False),
        T.StructField("tech_support", T.StringType(), False),
        T.StructField("online_security", T.StringType(), False),
        T.StructField("paperless_billing", T.StringType(), False),
        T.StructField("num_support_tickets", T.IntegerType(), False),
        T.StructField("avg_satisfaction_score", T.DoubleType(), False),
        T.StructField("clv_segment", T.StringType(), False),
        T.StructField("churned", T.IntegerType(), False),
    ]
)
INTERACTIONS = T.StructType(
    [
        T.StructField("interaction_id", T.LongType(), False),
        T.StructField("customer_id", T.LongType(), False),
        T.StructField("timestamp", T.TimestampNTZType(), False),
        T.StructField("channel", T.StringType(), False),
        T.StructField("interaction_type", T.StringType(), False),
        T.StructField("sentiment", T.StringType(), False),
        T.StructField("text", T.StringType(), False),
    ]
)
PREDICTIONS = T.StructType(
    [
        T.StructField("prediction_id", T.LongType(), False),
        T.StructField("customer_id", T.LongType(), False),
        T.StructField("churn_probability", T.DoubleType(), False),
        T.StructField("predicted_label", T.IntegerType(), False),
        T.StructField("threshold_used", T.DoubleType(), False),
        T.StructField("model_version", T.StringType(), False),
        T.StructField("created_at", T.TimestampNTZType(), False),
    ]
)
RECOMMENDATIONS = T.StructType(
    [
        T.StructField("recommendation_id", T.LongType(), False),
        T.StructField("prediction_id", T.LongType(), False),
        T.StructField("recommendation_text", T.StringType(), False),
        T.StructField("passed_guardrails", T.BooleanType(), False),
        T.StructField("guardrail_reason", T.StringType(), False),
        T.StructField("llm_provider", T.StringType(), False),
        T.StructField("created_at", T.TimestampNTZType(), False),
    ]
)

# varchar limits of the declared tables (column -> max length)
VARCHAR_LIMITS = {
    "customers": {
        "contract_type": 20,
        "payment_method": 30,
        "internet_service": 30,
        "tech_support": 5,
        "online_security": 5,
        "paperless_billing": 5,
        "clv_segment": 10,
    },
    "interactions": {"channel": 10, "interaction_type": 30, "sentiment": 10},
    "predictions": {"model_version": 50},
    "recommendations": {"llm_provider": 20},
}

TABLES = {
    "customers": CUSTOMERS,
    "interactions": INTERACTIONS,
    "predictions": PREDICTIONS,
    "recommendations": RECOMMENDATIONS,
}
PRIMARY_KEYS = {
    "customers": "customer_id",
    "interactions": "interaction_id",
    "predictions": "prediction_id",
    "recommendations": "recommendation_id",
}

# Declared mixes of the original's interactions.  Sentiment within each type,
# and types by whether the customer churned
SENTIMENT_BY_TYPE = {
    "billing_issue": {"negative": 0.7, "neutral": 0.25, "positive": 0.05},
    "technical_problem": {"negative": 0.65, "neutral": 0.3, "positive": 0.05},
    "complaint": {"negative": 0.85, "neutral": 0.13, "positive": 0.02},
    "cancellation_request": {"negative": 0.9, "neutral": 0.08, "positive": 0.02},
    "positive_feedback": {"negative": 0.02, "neutral": 0.08, "positive": 0.9},
    "general_inquiry": {"negative": 0.1, "neutral": 0.8, "positive": 0.1},
}
TYPE_WEIGHTS_BY_CHURN = {
    1: {"complaint": 0.25, "cancellation_request": 0.20, "billing_issue": 0.20, "technical_problem": 0.20, "general_inquiry": 0.10, "positive_feedback": 0.05},
    0: {"complaint": 0.10, "cancellation_request": 0.02, "billing_issue": 0.15, "technical_problem": 0.15, "general_inquiry": 0.35, "positive_feedback": 0.23},
}
