"""Registered queries: flagship, derived columns (B*) and profiling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from retentia import schemas as S
from retentia.operators import derive as D
from retentia.operators import profile as PR
from retentia.operators import retrieve as R
from retentia.operators.ranking import head_by, top_k_per_key
from retentia.plans.registry import query, r6
from retentia.plans.views_sql import q
from retentia.sources import proxies as P

NL = "chr(10)"
EMPTY_CTX_SQL = S.EMPTY_CONTEXT_TEXT.replace("'", "''")


def ctx_sql(rank: str = "rk") -> str:
    return f"CAST({rank} AS VARCHAR) || '. [' || interaction_type || ', ' || sentiment || '] ' || text"


# ---------------------------------------------------------------------------
# Flagship: who is at risk, and what did they last contact us about?
# ---------------------------------------------------------------------------
@query(
    "at_risk_context",
    "B7 B8 B9 B14 C5 E1 J5",
    q(
        f"""
SELECT hr.customer_id, round(hr.churn_probability, 6) AS churn_probability,
       CAST(coalesce(ctx.n, 0) AS INTEGER) AS n_context,
       coalesce(ctx.context_text, '{EMPTY_CTX_SQL}') AS context_text
FROM hr LEFT JOIN ctx ON hr.customer_id = ctx.customer_id""",
        ("hr", "SELECT customer_id, churn_probability FROM scored_v WHERE predicted_label = 1"),
        (
            "top5",
            """SELECT * FROM (SELECT i.*, row_number() OVER (PARTITION BY i.customer_id
                 ORDER BY i."timestamp" DESC, i.interaction_id DESC) AS rk
               FROM interactions_v i WHERE i.customer_id IN (SELECT customer_id FROM hr)) WHERE rk <= 5""",
        ),
        ("ctx", f"SELECT customer_id, count(*) AS n, string_agg({ctx_sql()}, {NL} ORDER BY rk) AS context_text FROM top5 GROUP BY customer_id"),
    ),
)
def at_risk_context(spark, sf_dir, k: int = 5):
    scored = P.scored_customers(spark, sf_dir)
    risky = D.high_risk(scored).select("customer_id", "churn_probability")
    inter = P.interactions_v(spark, sf_dir).join(risky.select("customer_id"), "customer_id", "left_semi")
    recent = top_k_per_key(inter, "customer_id", [F.col("timestamp").desc(), F.col("interaction_id").desc()], k)
    items = R.context_items(recent.withColumn("similarity", F.lit(None).cast("double")), "customer_id")
    out = R.with_context_text(risky.join(items, "customer_id", "left"))
    return out.select(
        "customer_id",
        r6("churn_probability").alias("churn_probability"),
        F.coalesce(F.size("context_items"), F.lit(0)).cast("int").alias("n_context"),
        "context_text",
    )


# ---------------------------------------------------------------------------
# B: projections and derived columns
# ---------------------------------------------------------------------------
@query("feature_projection", "B1 B2 B3", q("SELECT " + ", ".join(S.FEATURE_COLUMNS) + " FROM customers_v"))
def feature_projection(spark, sf_dir):
    return D.feature_projection(P.customers_v(spark, sf_dir))


def _bin_sql(x: str, edges, labels) -> str:
    parts = []
    for hi, lab in zip(edges[1:], labels):
        cond = f"{x} <= {hi}" if hi != float("inf") else f"{x} IS NOT NULL"
        parts.append(f"WHEN {cond} THEN '{lab}'")
    return f"CASE WHEN {x} > {edges[0]} THEN CASE {' '.join(parts)} END END"


def _bin_idx_sql(x: str, edges) -> str:
    parts = []
    for i, hi in enumerate(edges[1:]):
        cond = f"{x} <= {hi}" if hi != float("inf") else f"{x} IS NOT NULL"
        parts.append(f"WHEN {cond} THEN {i}")
    return f"CASE WHEN {x} > {edges[0]} THEN CASE {' '.join(parts)} END END"


@query(
    "clv_segment",
    "B4",
    q(
        "SELECT customer_id, round(tenure_months * monthly_charges, 6) AS clv_raw, "
        + _bin_sql("tenure_months * monthly_charges", S.CLV_EDGES, S.CLV_LABELS)
        + " AS clv_segment FROM customers_v"
    ),
)
def clv_segment(spark, sf_dir):
    c = D.add_bins(P.customers_v(spark, sf_dir))
    return c.select("customer_id", r6(F.col("tenure_months") * F.col("monthly_charges")).alias("clv_raw"), F.col("clv_bin").alias("clv_segment"))


@query(
    "tenure_bucket",
    "B4",
    q(
        "SELECT customer_id, tenure_months, "
        + _bin_sql("tenure_months", S.TENURE_EDGES, S.TENURE_LABELS)
        + " AS tenure_bucket FROM customers_v"
    ),
)
def tenure_bucket(spark, sf_dir):
    return D.add_bins(P.customers_v(spark, sf_dir)).select("customer_id", "tenure_months", "tenure_bucket")


@query(
    "ticket_bucket",
    "B4",
    q(
        "SELECT customer_id, num_support_tickets, "
        + _bin_sql("num_support_tickets", S.TICKET_EDGES, S.TICKET_LABELS)
        + " AS ticket_bucket FROM customers_v"
    ),
)
def ticket_bucket(spark, sf_dir):
    return D.add_bins(P.customers_v(spark, sf_dir)).select("customer_id", "num_support_tickets", "ticket_bucket")


@query(
    "clip_round",
    "B6",
    q(
        """
SELECT customer_id,
  round_even(least(greatest(total_charges / CAST(1000.0 AS DOUBLE), 18.0), 150.0), 2) AS monthly_clipped,
  round_even(least(greatest(CAST(4.4 AS DOUBLE) - CAST(0.35 AS DOUBLE) * num_support_tickets, 1.0), 5.0), 2) AS satisfaction_clipped,
  greatest(round_even(tenure_months * monthly_charges - CAST(50.0 AS DOUBLE), 2), 0.0) AS total_clipped
FROM customers_v"""
    ),
)
def clip_round(spark, sf_dir):
    return D.clip_round(P.customers_v(spark, sf_dir))


@query("churn_scorecard", "B5 B7", q("SELECT customer_id, round(churn_score, 6) AS churn_score FROM scored_v"))
def churn_scorecard(spark, sf_dir):
    return P.scored_customers(spark, sf_dir).select("customer_id", r6("churn_score").alias("churn_score"))


@query("churn_probability", "B8 F6", q("SELECT customer_id, round(churn_probability, 6) AS churn_probability FROM scored_v"))
def churn_probability(spark, sf_dir):
    return P.scored_customers(spark, sf_dir).select("customer_id", r6("churn_probability").alias("churn_probability"))


@query(
    "threshold_label",
    "B9 B10",
    q("SELECT customer_id, round(churn_probability, 6) AS churn_probability, predicted_label FROM scored_v"),
)
def threshold_label(spark, sf_dir):
    return P.scored_customers(spark, sf_dir).select(
        "customer_id", r6("churn_probability").alias("churn_probability"), "predicted_label"
    )


@query(
    "high_risk_customers",
    "B14",
    q(
        "SELECT customer_id, round(churn_probability, 6) AS churn_probability, contract_type, payment_method "
        "FROM scored_v WHERE predicted_label = 1"
    ),
)
def high_risk_customers(spark, sf_dir):
    return D.high_risk(P.scored_customers(spark, sf_dir)).select(
        "customer_id", r6("churn_probability").alias("churn_probability"), "contract_type", "payment_method"
    )


@query(
    "signup_date_from_tenure",
    "B11",
    q(
        f"""
SELECT customer_id, tenure_months, signup_date_derived,
  CAST(floor(date_diff('day', signup_date_derived, DATE '{P.ASOF}') / CAST(30.4 AS DOUBLE)) AS INTEGER) AS tenure_back
FROM (SELECT customer_id, tenure_months,
        CAST(DATE '{P.ASOF}' - CAST(trunc(tenure_months * CAST(30.4 AS DOUBLE)) AS INTEGER) AS DATE) AS signup_date_derived
      FROM customers_v)"""
    ),
)
def signup_date_from_tenure(spark, sf_dir):
    return D.signup_date_from_tenure(P.customers_v(spark, sf_dir), P.ASOF)


@query(
    "expand_tickets",
    "B12",
    q(
        "SELECT customer_id, CAST(t.ticket_no AS INTEGER) AS ticket_no FROM customers_v, "
        "generate_series(1, num_support_tickets) AS t(ticket_no) WHERE num_support_tickets > 0"
    ),
)
def expand_tickets(spark, sf_dir):
    return D.expand_tickets(P.customers_v(spark, sf_dir))


@query(
    "text_template",
    "B13",
    q(
        """
SELECT event_id AS interaction_id,
  'I was charged $' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || ' but my plan should only cost $'
  || CAST(CAST(floor(value / 2.0) + 20 AS BIGINT) AS VARCHAR) || '. Can you explain this?' AS text
FROM events"""
    ),
)
def text_template(spark, sf_dir):
    return D.text_template(P.table(spark, sf_dir, "events"))


@query(
    "valid_requests",
    "B15",
    q(
        f"""
SELECT event_id AS request_id, user_id AS customer_id, CAST(event_id % 25 AS INTEGER) AS top_k,
  '{S.DEFAULT_QUERY}' AS query,
  CASE WHEN event_id % 25 BETWEEN {S.TOP_K_MIN} AND {S.TOP_K_MAX} THEN 'valid' ELSE 'rejected' END AS status
FROM events"""
    ),
)
def valid_requests(spark, sf_dir):
    ev = P.table(spark, sf_dir, "events")
    req = ev.select(
        F.col("event_id").alias("request_id"),
        F.col("user_id").alias("customer_id"),
        F.pmod(F.col("event_id"), F.lit(25)).cast("int").alias("top_k"),
        F.lit(None).cast("string").alias("query"),
    )
    return D.validate_requests(req)


# ---------------------------------------------------------------------------
# D: profiling
# ---------------------------------------------------------------------------
@query("churn_rate", "D1", q("SELECT round(avg(churned), 6) AS churn_rate, count(*) AS n_customers FROM customers_v"))
def churn_rate(spark, sf_dir):
    return PR.rate(P.customers_v(spark, sf_dir)).select(r6("churn_rate").alias("churn_rate"), "n_customers")


@query("class_balance", "D2", q("SELECT churned, count(*) AS n FROM customers_v GROUP BY churned"))
def class_balance(spark, sf_dir):
    return PR.value_counts(P.customers_v(spark, sf_dir), "churned")


@query(
    "sentiment_share",
    "D3",
    q(
        "SELECT sentiment, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 3) AS share "
        "FROM interactions_v GROUP BY sentiment"
    ),
)
def sentiment_share(spark, sf_dir):
    vc = PR.value_counts(P.interactions_v(spark, sf_dir), "sentiment", normalize=True)
    return vc.select("sentiment", "n", F.round("share", 3).alias("share"))


def _rate_sql(col: str) -> str:
    return q(f"SELECT {col}, round(avg(churned), 6) AS churn_rate, count(*) AS n FROM customers_v WHERE {col} IS NOT NULL GROUP BY {col}")


@query("churn_by_contract", "D4", _rate_sql("contract_type"))
def churn_by_contract(spark, sf_dir):
    return PR.rate_by(P.customers_v(spark, sf_dir), "contract_type").select("contract_type", r6("churn_rate").alias("churn_rate"), "n")


@query("churn_by_payment", "D4", _rate_sql("payment_method"))
def churn_by_payment(spark, sf_dir):
    return PR.rate_by(P.customers_v(spark, sf_dir), "payment_method").select("payment_method", r6("churn_rate").alias("churn_rate"), "n")


def _bin_rate_sql(x: str, edges, labels, name: str) -> str:
    return q(
        f"""
SELECT {name}, {name}_idx, round(avg(churned), 6) AS churn_rate, count(*) AS n FROM (
  SELECT {_bin_sql(x, edges, labels)} AS {name}, {_bin_idx_sql(x, edges)} AS {name}_idx, churned FROM customers_v)
WHERE {name} IS NOT NULL GROUP BY {name}, {name}_idx"""
    )


@query("churn_by_tenure", "D5 B4", _bin_rate_sql("tenure_months", S.TENURE_EDGES, S.TENURE_LABELS, "tenure_bucket"))
def churn_by_tenure(spark, sf_dir):
    c = D.add_bins(P.customers_v(spark, sf_dir))
    r = PR.rate_by_bin(c, "tenure_bucket", "tenure_bucket_idx")
    return r.select("tenure_bucket", "tenure_bucket_idx", r6("churn_rate").alias("churn_rate"), "n")


@query("churn_by_tickets", "D5 B4", _bin_rate_sql("num_support_tickets", S.TICKET_EDGES, S.TICKET_LABELS, "ticket_bucket"))
def churn_by_tickets(spark, sf_dir):
    c = D.add_bins(P.customers_v(spark, sf_dir))
    r = PR.rate_by_bin(c, "ticket_bucket", "ticket_bucket_idx")
    return r.select("ticket_bucket", "ticket_bucket_idx", r6("churn_rate").alias("churn_rate"), "n")


@query(
    "churn_by_addons",
    "D6",
    q(
        """
SELECT 'tech_support' AS flag, tech_support AS value, round(avg(churned), 6) AS churn_rate, count(*) AS n FROM customers_v GROUP BY tech_support
UNION ALL
SELECT 'online_security' AS flag, online_security AS value, round(avg(churned), 6) AS churn_rate, count(*) AS n FROM customers_v GROUP BY online_security"""
    ),
)
def churn_by_addons(spark, sf_dir):
    r = PR.rate_by_flags(P.customers_v(spark, sf_dir), ["tech_support", "online_security"])
    return r.select("flag", "value", r6("churn_rate").alias("churn_rate"), "n")


DESCRIBE_NUMERIC = ["customer_id", "tenure_months", "monthly_charges", "total_charges", "num_support_tickets", "avg_satisfaction_score", "churned"]


def _describe_numeric_sql() -> str:
    parts = [
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
  round(CAST(min({c}) AS DOUBLE), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50,
  round(quantile_cont({c}, 0.75), 6) AS q75, round(CAST(max({c}) AS DOUBLE), 6) AS max FROM customers_v"""
        for c in DESCRIBE_NUMERIC
    ]
    return q("\nUNION ALL\n".join(parts))


@query("describe_numeric", "D7", _describe_numeric_sql())
def describe_numeric(spark, sf_dir):
    d = PR.describe_numeric(P.customers_v(spark, sf_dir), DESCRIBE_NUMERIC)
    return d.select("column", "count", *[r6(c).alias(c) for c in ["mean", "std", "min", "q25", "q50", "q75", "max"]])


@query(
    "describe_dates",
    "D7",
    q(
        """SELECT 'signup_date' AS "column", count(signup_date) AS count,
  round(avg(CAST(date_diff('day', DATE '1970-01-01', signup_date) AS DOUBLE)), 6) AS mean_days, min(signup_date) AS min,
  round(quantile_cont(CAST(date_diff('day', DATE '1970-01-01', signup_date) AS DOUBLE), 0.25), 6) AS q25_days,
  round(quantile_cont(CAST(date_diff('day', DATE '1970-01-01', signup_date) AS DOUBLE), 0.5), 6) AS q50_days,
  round(quantile_cont(CAST(date_diff('day', DATE '1970-01-01', signup_date) AS DOUBLE), 0.75), 6) AS q75_days,
  max(signup_date) AS max FROM customers_v"""
    ),
)
def describe_dates(spark, sf_dir):
    d = PR.describe_dates(P.customers_v(spark, sf_dir), ["signup_date"])
    return d.select("column", "count", r6("mean_days").alias("mean_days"), "min", *[r6(c).alias(c) for c in ["q25_days", "q50_days", "q75_days"]], "max")


def _describe_cat_sql() -> str:
    parts = [f"""SELECT '{c}' AS "column", {c} AS value, count(*) AS n FROM customers_v WHERE {c} IS NOT NULL GROUP BY {c}""" for c in S.CATEGORICAL_COLUMNS]
    return q(
        """
SELECT "column", CAST(sum(n) AS BIGINT) AS count, count(*) AS "unique",
  arg_min(value, (-n, value)) AS top, max(n) AS freq
FROM per_value GROUP BY "column" """,
        ("per_value", "\nUNION ALL\n".join(parts)),
    )


@query("describe_categorical", "D7", _describe_cat_sql())
def describe_categorical(spark, sf_dir):
    d = PR.describe_categorical(P.customers_v(spark, sf_dir), S.CATEGORICAL_COLUMNS)
    return d.select("column", F.col("count").cast("bigint").alias("count"), "unique", "top", "freq")


def _null_profile_sql() -> str:
    cols = [f.name for f in S.CUSTOMERS.fields]
    parts = [
        f"SELECT 'customers' AS table_name, '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count, count(*) AS row_count FROM customers_v"
        for c in cols
    ]
    cols_i = [f.name for f in S.INTERACTIONS.fields]
    parts += [
        f"SELECT 'interactions' AS table_name, '{c}' AS column_name, count(*) FILTER (WHERE \"{c}\" IS NULL) AS null_count, count(*) AS row_count FROM interactions_v"
        for c in cols_i
    ]
    return q("\nUNION ALL\n".join(parts))


@query("null_profile", "D8", _null_profile_sql())
def null_profile(spark, sf_dir):
    a = PR.null_profile(P.customers_v(spark, sf_dir), "customers")
    b = PR.null_profile(P.interactions_v(spark, sf_dir), "interactions")
    return a.unionByName(b)


CORR_COLS = ["tenure_months", "monthly_charges", "total_charges", "num_support_tickets", "avg_satisfaction_score", "churned"]


def _corr_sql() -> str:
    parts = [f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM customers_v" for a in CORR_COLS for b in CORR_COLS]
    return q("\nUNION ALL\n".join(parts))


@query("correlation_matrix", "D9", _corr_sql())
def correlation_matrix(spark, sf_dir):
    m = PR.correlation_matrix(P.customers_v(spark, sf_dir), CORR_COLS)
    return m.select("col_a", "col_b", r6("corr").alias("corr"))


@query(
    "correlation_with_churn",
    "D9 E5",
    q(
        "SELECT col_a AS feature, round(c, 6) AS corr_with_churn FROM ("
        + "\nUNION ALL\n".join(f"SELECT '{a}' AS col_a, corr({a}, churned) AS c FROM customers_v" for a in CORR_COLS)
        + ")"
    ),
)
def correlation_with_churn(spark, sf_dir):
    m = PR.correlation_matrix(P.customers_v(spark, sf_dir), CORR_COLS)
    return m.where(F.col("col_b") == "churned").select(F.col("col_a").alias("feature"), r6("corr").alias("corr_with_churn")).orderBy(
        F.col("corr_with_churn").desc()
    )


@query(
    "sentiment_by_churn",
    "C1 D10",
    q(
        """
SELECT churned,
  round(max(share) FILTER (WHERE sentiment = 'negative'), 6) AS negative,
  round(max(share) FILTER (WHERE sentiment = 'neutral'), 6) AS neutral,
  round(max(share) FILTER (WHERE sentiment = 'positive'), 6) AS positive
FROM (
  SELECT churned, sentiment, count(*) / sum(count(*)) OVER (PARTITION BY churned) AS share
  FROM interactions_v i LEFT JOIN (SELECT customer_id, churned FROM customers_v) c ON i.customer_id = c.customer_id
  WHERE churned IS NOT NULL GROUP BY churned, sentiment)
GROUP BY churned"""
    ),
)
def sentiment_by_churn(spark, sf_dir):
    # counted per customer before the join: a customer costs it a few rows, whatever its history
    inter = P.interactions_v(spark, sf_dir).groupBy("customer_id", "sentiment").agg(F.count(F.lit(1)).alias("_n"))
    cust = P.customers_v(spark, sf_dir).select("customer_id", "churned")
    merged = inter.join(cust, "customer_id", "left")
    wide = PR.share_pivot(merged, "churned", "sentiment", S.SENTIMENTS, weight="_n")
    return wide.select("churned", *[r6(s).alias(s) for s in S.SENTIMENTS])


@query(
    "satisfaction_boxstats",
    "D11",
    q(
        """
SELECT s.churned, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  round(min(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_low,
  round(max(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
  count(*) FILTER (WHERE NOT (v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1))) AS n_outliers,
  count(*) AS n
FROM (SELECT churned, avg_satisfaction_score AS v FROM customers_v) s
JOIN (SELECT churned, quantile_cont(avg_satisfaction_score, 0.25) AS q1, quantile_cont(avg_satisfaction_score, 0.5) AS median,
             quantile_cont(avg_satisfaction_score, 0.75) AS q3 FROM customers_v GROUP BY churned) qs ON s.churned = qs.churned
GROUP BY s.churned, q1, median, q3"""
    ),
)
def satisfaction_boxstats(spark, sf_dir):
    b = PR.box_stats(P.customers_v(spark, sf_dir), "churned", "avg_satisfaction_score")
    return b.select("churned", *[r6(c).alias(c) for c in ["q1", "median", "q3", "whisker_low", "whisker_high"]], "n_outliers", "n")


@query(
    "customer_interaction_ids",
    "D18",
    q(
        "SELECT customer_id, count(*) AS n_interactions, min(interaction_id) AS first_interaction_id, "
        "max(interaction_id) AS last_interaction_id FROM interactions_v GROUP BY customer_id"
    ),
)
def customer_interaction_ids(spark, sf_dir):
    return PR.per_key_ids(P.interactions_v(spark, sf_dir), "customer_id", "interaction_id")


def _design_audit_sql() -> str:
    m2m = P.SCORECARD_PROXY["month_to_month"]
    ech = P.SCORECARD_PROXY["electronic_check"]
    ten = _bin_idx_sql("tenure_months", S.TENURE_EDGES)
    tik = _bin_idx_sql("num_support_tickets", S.TICKET_EDGES)
    return q(
        f"""
SELECT check_name, round(observed, 6) AS observed, observed > 0 AS passed FROM (
  SELECT 'month_to_month_highest' AS check_name,
    (SELECT avg(churned) FROM customers_v WHERE contract_type = '{m2m}')
    - (SELECT max(r) FROM (SELECT avg(churned) AS r FROM customers_v WHERE contract_type <> '{m2m}' GROUP BY contract_type)) AS observed
  UNION ALL
  SELECT 'tenure_decreasing',
    (SELECT min(prev - r) FROM (SELECT r, lag(r) OVER (ORDER BY b) AS prev FROM
      (SELECT {ten} AS b, avg(churned) AS r FROM customers_v WHERE {ten} IS NOT NULL GROUP BY 1)))
  UNION ALL
  SELECT 'tickets_increasing',
    (SELECT min(r - prev) FROM (SELECT r, lag(r) OVER (ORDER BY b) AS prev FROM
      (SELECT {tik} AS b, avg(churned) AS r FROM customers_v WHERE {tik} IS NOT NULL GROUP BY 1)))
  UNION ALL
  SELECT 'electronic_check_highest',
    (SELECT avg(churned) FROM customers_v WHERE payment_method = '{ech}')
    - (SELECT max(r) FROM (SELECT avg(churned) AS r FROM customers_v WHERE payment_method <> '{ech}' GROUP BY payment_method))
  UNION ALL
  SELECT 'tech_support_reduces',
    (SELECT avg(churned) FROM customers_v WHERE tech_support = 'No') - (SELECT avg(churned) FROM customers_v WHERE tech_support = 'Yes')
  UNION ALL
  SELECT 'online_security_reduces',
    (SELECT avg(churned) FROM customers_v WHERE online_security = 'No') - (SELECT avg(churned) FROM customers_v WHERE online_security = 'Yes')
  UNION ALL
  SELECT 'satisfaction_inverse', -(SELECT corr(avg_satisfaction_score, churned) FROM customers_v)
)"""
    )


@query("design_audit", "D19", _design_audit_sql())
def design_audit(spark, sf_dir):
    """Per declared property of the data, the observed difference and whether it has the declared sign.
    Monotone checks give the smallest step between neighbouring bins."""
    c = D.add_bins(P.customers_v(spark, sf_dir))
    dims = {
        "month_to_month_highest": "contract_type",
        "tenure_decreasing": "tenure_bucket_idx",
        "tickets_increasing": "ticket_bucket_idx",
        "electronic_check_highest": "payment_method",
        "tech_support_reduces": "tech_support",
        "online_security_reduces": "online_security",
    }
    # one scan counts the cells of all dimensions; every rate comes from those few rows
    cells = c.groupBy(*dims.values()).agg(F.sum("churned").alias("s"), F.count("churned").alias("n"))
    pairs = F.array(*[F.struct(F.lit(k).alias("check_name"), F.col(v).cast("string").alias("value")) for k, v in dims.items()])
    long = cells.select(F.explode(pairs).alias("p"), "s", "n").select("p.*", "s", "n").where("value IS NOT NULL")
    rate = long.groupBy("check_name", "value").agg((F.sum("s") / F.sum("n")).alias("r"))
    step = F.col("r") - F.lag("r").over(Window.partitionBy("check_name").orderBy(F.expr("try_cast(value AS int)"), "value"))

    def highest(value):
        return F.max(F.when(F.col("value") == value, F.col("r"))) - F.max(F.when(F.col("value") != value, F.col("r")))

    no_yes = F.max(F.when(F.col("value") == "No", F.col("r"))) - F.max(F.when(F.col("value") == "Yes", F.col("r")))
    name = F.col("check_name")
    v = (
        F.when(name == "month_to_month_highest", highest(P.SCORECARD_PROXY["month_to_month"]))
        .when(name == "electronic_check_highest", highest(P.SCORECARD_PROXY["electronic_check"]))
        .when(name == "tenure_decreasing", -F.max("step"))
        .when(name == "tickets_increasing", F.min("step"))
        .otherwise(no_yes)
    )
    got = rate.withColumn("step", step).groupBy("check_name").agg(v.alias("v"))
    got = got.unionByName(c.agg((-F.corr("avg_satisfaction_score", "churned")).alias("v")).withColumn("check_name", F.lit("satisfaction_inverse")))
    checks = spark.createDataFrame([(k,) for k in [*dims, "satisfaction_inverse"]], "check_name string")
    return checks.join(got, "check_name", "left").select("check_name", r6("v").alias("observed"), (F.col("v") > 0).alias("passed"))


# Declared share of each event type in the proxy interaction table
EXPECTED_TYPE_SHARE = {"click": 0.2, "error": 0.2, "purchase": 0.2, "signup": 0.2, "view": 0.2}


@query(
    "mix_vs_expected",
    "D3 D20",
    q(
        """
SELECT coalesce(o.interaction_type, e.interaction_type) AS interaction_type, coalesce(o.n, 0) AS n,
  round(coalesce(o.share, 0), 6) AS share, e.expected_share,
  round(abs(coalesce(o.share, 0) - e.expected_share), 6) AS abs_deviation
FROM (SELECT interaction_type, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM interactions_v
      WHERE interaction_type IS NOT NULL GROUP BY interaction_type) o
FULL JOIN (VALUES """
        + ", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in EXPECTED_TYPE_SHARE.items())
        + """) e(interaction_type, expected_share) ON o.interaction_type = e.interaction_type"""
    ),
)
def mix_vs_expected(spark, sf_dir):
    obs = PR.value_counts(P.interactions_v(spark, sf_dir), "interaction_type", normalize=True)
    exp = spark.createDataFrame(list(EXPECTED_TYPE_SHARE.items()), "interaction_type string, expected_share double")
    d = PR.deviation_from_expected(obs, "interaction_type", exp)
    return d.select("interaction_type", "n", r6("share").alias("share"), "expected_share", r6("abs_deviation").alias("abs_deviation"))


# Fixed values of the proxy: which of the original's types an event stands for
TYPE_OF_EVENT = {"click": "complaint", "error": "technical_problem", "purchase": "billing_issue", "signup": "general_inquiry", "view": "positive_feedback"}
_TYPE_SQL = "CASE interaction_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPE_OF_EVENT.items()) + " END"


def _original_type():
    return F.element_at(F.create_map(*[F.lit(x) for kv in TYPE_OF_EVENT.items() for x in kv]), F.col("interaction_type"))


def _share_within_sql(group: str, key: str, observed: str, expected) -> str:
    cells = ", ".join(f"({g!r}, '{k}', CAST({x} AS DOUBLE))" for g, keys in expected.items() for k, x in keys.items())
    return f"""SELECT coalesce(o.g, e.g) AS {group}, coalesce(o.k, e.k) AS {key}, CAST(coalesce(o.n, 0) AS BIGINT) AS n, round(coalesce(o.share, 0), 6) AS share,
  e.x AS expected_share, round(abs(coalesce(o.share, 0) - e.x), 6) AS abs_deviation
FROM (SELECT g, k, n, n / sum(n) OVER (PARTITION BY g) AS share FROM ({observed})) o
FULL JOIN (VALUES {cells}) e(g, k, x) ON o.g = e.g AND o.k = e.k"""


def _rounded(d, group, key):
    return d.select(group, key, F.col("n").cast("bigint").alias("n"), r6("share").alias("share"), "expected_share", r6("abs_deviation").alias("abs_deviation"))


@query(
    "sentiment_vs_expected",
    "D3 D20",
    q(_share_within_sql("interaction_type", "sentiment", f"SELECT {_TYPE_SQL} AS g, sentiment AS k, count(*) AS n FROM interactions_v GROUP BY ALL", S.SENTIMENT_BY_TYPE)),
)
def sentiment_vs_expected(spark, sf_dir):
    """Sentiment within each type beside its declared share."""
    n = P.interactions_v(spark, sf_dir).groupBy(_original_type().alias("interaction_type"), "sentiment").agg(F.count(F.lit(1)).alias("n"))
    return _rounded(PR.share_within(n, "interaction_type", "sentiment", S.SENTIMENT_BY_TYPE), "interaction_type", "sentiment")


@query(
    "type_mix_by_churn",
    "C1 D20",
    q(
        _share_within_sql(
            "churned", "interaction_type",
            f"SELECT c.churned AS g, {_TYPE_SQL} AS k, count(*) AS n FROM interactions_v i JOIN customers_v c ON i.customer_id = c.customer_id GROUP BY ALL",
            S.TYPE_WEIGHTS_BY_CHURN,
        )
    ),
)
def type_mix_by_churn(spark, sf_dir):
    """Types of churned and of retained customers beside their declared shares."""
    # counted per customer before the join: a customer costs it a few rows, whatever its history
    per_customer = P.interactions_v(spark, sf_dir).groupBy("customer_id", _original_type().alias("interaction_type")).agg(F.count(F.lit(1)).alias("n"))
    n = per_customer.join(P.customers_v(spark, sf_dir).select("customer_id", "churned"), "customer_id")
    return _rounded(PR.share_within(n, "churned", "interaction_type", S.TYPE_WEIGHTS_BY_CHURN), "churned", "interaction_type")


@query(
    "top_contracts",
    "E5 D4",
    q(
        "SELECT contract_type, round(avg(churned), 6) AS churn_rate, count(*) AS n FROM customers_v "
        "GROUP BY contract_type ORDER BY avg(churned) DESC, contract_type LIMIT 3"
    ),
)
def top_contracts(spark, sf_dir):
    r = PR.rate_by(P.customers_v(spark, sf_dir), "contract_type")
    return head_by(r, [F.col("churn_rate").desc(), F.col("contract_type").asc()], 3).select(
        "contract_type", r6("churn_rate").alias("churn_rate"), "n"
    )
