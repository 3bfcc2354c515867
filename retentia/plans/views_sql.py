"""The proxy views of ``retentia.sources.proxies`` as DuckDB SQL CTEs, for the oracle.

``q(body, *ctes)`` builds one standalone statement: the base views, then any
extra ``(name, sql)`` CTEs, then the body.
"""

from __future__ import annotations

from retentia.sources import proxies as P

ASOF = f"DATE '{P.ASOF}'"

CUSTOMERS_V = f"""
_pp AS (
  SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderdate) AS first_order,
         max(o_orderdate) AS last_order, sum(CAST(o_totalprice AS DECIMAL(12,2))) AS spent
  FROM orders GROUP BY o_custkey, o_orderpriority),
_pc AS (
  SELECT o_custkey, min(first_order) AS first_order, max(last_order) AS last_order,
         CAST(sum(spent) AS DOUBLE) AS total_charges
  FROM _pp GROUP BY o_custkey),
_pm AS (
  SELECT o_custkey, o_orderpriority AS payment_method FROM (
    SELECT o_custkey, o_orderpriority,
           row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority DESC) AS rn
    FROM _pp) WHERE rn = 1),
_tk AS (
  SELECT user_id, CAST(count(*) AS INTEGER) AS n_tickets FROM events
  WHERE event_type = '{P.TICKET_EVENT}' AND value > {P.TICKET_MIN_VALUE} GROUP BY user_id),
_cb AS (
  SELECT c.c_custkey AS customer_id,
         CAST(pc.first_order AS DATE) AS signup_date,
         CAST(greatest(floor(date_diff('day', CAST(pc.first_order AS DATE), {ASOF}) / 30.4) - {P.TENURE_OFFSET_MONTHS}, 0) AS INTEGER) AS tenure_months,
         c.c_mktsegment AS contract_type,
         round_even(least(greatest(pc.total_charges / {P.CHARGES_DIVISOR}.0, 18.0), 150.0), 2) AS monthly_charges,
         pc.total_charges,
         pm.payment_method,
         r.r_name AS internet_service,
         CASE WHEN c.c_acctbal > 5000 THEN 'Yes' ELSE 'No' END AS tech_support,
         CASE WHEN c.c_custkey % 3 = 0 THEN 'Yes' ELSE 'No' END AS online_security,
         CASE WHEN c.c_custkey % 5 < 3 THEN 'Yes' ELSE 'No' END AS paperless_billing,
         CAST(coalesce(tk.n_tickets, 0) AS INTEGER) AS num_support_tickets,
         round_even(least(greatest(CAST(4.2 AS DOUBLE) - CAST(0.15 AS DOUBLE) * coalesce(tk.n_tickets, 0), 1.0), 5.0), 2) AS avg_satisfaction_score,
         CAST(pc.last_order < {ASOF} - INTERVAL {P.CHURN_GAP_DAYS} DAY AS INTEGER) AS churned
  FROM customer c
  JOIN _pc pc ON c.c_custkey = pc.o_custkey
  JOIN _pm pm ON c.c_custkey = pm.o_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN _tk tk ON c.c_custkey = tk.user_id),
customers_v AS (
  SELECT customer_id, signup_date, tenure_months, contract_type, monthly_charges, total_charges,
         payment_method, internet_service, tech_support, online_security, paperless_billing,
         num_support_tickets, avg_satisfaction_score,
         CASE WHEN tenure_months * monthly_charges > -1 THEN
           CASE WHEN tenure_months * monthly_charges <= 500 THEN 'Low'
                WHEN tenure_months * monthly_charges <= 2000 THEN 'Medium'
                WHEN tenure_months * monthly_charges <= 5000 THEN 'High'
                WHEN tenure_months * monthly_charges IS NOT NULL THEN 'VIP' END END AS clv_segment,
         churned
  FROM _cb)"""

INTERACTIONS_V = """
interactions_v AS (
  SELECT event_id AS interaction_id, user_id AS customer_id, ts AS "timestamp",
         CASE WHEN event_id % 10 < 5 THEN 'chat' WHEN event_id % 10 < 8 THEN 'email' ELSE 'phone' END AS channel,
         event_type AS interaction_type,
         CASE WHEN value < 20 THEN 'negative' WHEN value < 60 THEN 'neutral' ELSE 'positive' END AS sentiment,
         event_type || ' charge of $' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS text
  FROM events)"""

VECTORS_V = """
vectors_v AS (
  SELECT vec_id AS interaction_id, CAST(label AS BIGINT) AS customer_id, embedding FROM embeddings)"""

SCORES_V = """
scores_v AS (
  SELECT event_id AS row_id, value / 500.0 AS y_proba, CAST(event_type = 'purchase' AS INTEGER) AS y FROM events)"""

SCORED_V = f"""
scored_v AS (
  SELECT *, CAST(churn_probability >= {P.PROXY_THRESHOLD} AS INTEGER) AS predicted_label FROM (
    SELECT *, CAST(1.0 AS DOUBLE) / (CAST(1.0 AS DOUBLE) + exp(-churn_score)) AS churn_probability FROM (
      SELECT *, (CAST(-0.045 AS DOUBLE) * tenure_months
                 + CAST(0.90 AS DOUBLE) * CAST(contract_type = '{P.SCORECARD_PROXY["month_to_month"]}' AS INTEGER)
                 + CAST(0.020 AS DOUBLE) * monthly_charges
                 + CAST(0.35 AS DOUBLE) * num_support_tickets
                 + CAST(-0.55 AS DOUBLE) * avg_satisfaction_score
                 + CAST(0.45 AS DOUBLE) * CAST(payment_method = '{P.SCORECARD_PROXY["electronic_check"]}' AS INTEGER)
                 + CAST(-0.30 AS DOUBLE) * CAST(tech_support = 'Yes' AS INTEGER)
                 + CAST(-0.25 AS DOUBLE) * CAST(online_security = 'Yes' AS INTEGER)
                 + CAST(-0.3 AS DOUBLE)) AS churn_score
      FROM customers_v)))"""

RECS_V = """
recs_v AS (
  SELECT o_orderkey AS prediction_id, o_custkey AS customer_id,
         CASE WHEN o_orderkey % 3 = 0 THEN 'Review the last' ELSE 'Review the $' || CAST(CAST(trunc(o_totalprice) AS BIGINT) % 500 AS VARCHAR) END || ' charge with the customer'
         || CASE WHEN o_orderkey % 4 = 0 THEN ' and offer a 10% discount' ELSE '' END
         || ', then have a manager call them.'
         || CASE o_orderkey % 7 WHEN 3 THEN ' We already refunded them on 2001-03-05.'
                                WHEN 5 THEN ' The customer said "I will leave".' ELSE '' END AS recommendation_text
  FROM orders)"""

BASE = [CUSTOMERS_V, INTERACTIONS_V, VECTORS_V, SCORES_V, SCORED_V, RECS_V]


def q(body: str, *ctes: tuple[str, str]) -> str:
    parts = [c.strip() for c in BASE] + [f"{name} AS (\n{sql.strip()}\n)" for name, sql in ctes]
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()
