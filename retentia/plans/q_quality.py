"""Registered queries: sources and sinks (A1-A10), keys and references, joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from retentia import schemas as S
from retentia.functions import numeric as N
from retentia.operators import quality as Q
from retentia.operators.ranking import dense_ids
from retentia.plans.registry import query, r6
from retentia.plans.views_sql import q
from retentia.session import work_dir
from retentia.sources import io as IO
from retentia.sources import proxies as P

# Domains of the proxy customer table (segments, priorities, regions)
PROXY_CONTRACTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PROXY_PAYMENTS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
PROXY_SERVICES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
PROXY_MODEL_VERSION = "scorecard-proxy-v1"
ORPHAN_KEY_FACTOR = 11


def predictions_log(spark, sf_dir, start=1):
    """A10 rows (not yet written): dense prediction ids from ``start`` over the scored customers."""
    scored = P.scored_customers(spark, sf_dir).select("customer_id", "churn_probability", "predicted_label", "threshold_used")
    ids = dense_ids(scored, ["customer_id"], "prediction_id", start)
    return ids.select(
        "prediction_id",
        "customer_id",
        "churn_probability",
        "predicted_label",
        "threshold_used",
        F.lit(PROXY_MODEL_VERSION).alias("model_version"),
        N.created_at(P.FIXED_CREATED_AT).alias("created_at"),
    )


PREDICTIONS_SQL = (
    "predictions",
    f"""SELECT row_number() OVER (ORDER BY customer_id) AS prediction_id, customer_id, churn_probability, predicted_label,
       CAST({P.PROXY_THRESHOLD} AS DOUBLE) AS threshold_used, '{PROXY_MODEL_VERSION}' AS model_version,
       TIMESTAMP '{P.FIXED_CREATED_AT}' AS created_at FROM scored_v""",
)


@query("csv_roundtrip", "A1 A2", q("SELECT * FROM customers_v"))
def csv_roundtrip(spark, sf_dir):
    path = IO.write_csv(P.customers_v(spark, sf_dir), work_dir(spark, "customers-csv"))
    return IO.read_csv(spark, path, S.CUSTOMERS, na_tokens=IO.PANDAS_NA_TOKENS)


@query(
    "bulk_load_counts",
    "A3",
    q(
        """
SELECT 'customers' AS table_name, count(*) AS loaded_first, CAST(0 AS BIGINT) AS loaded_second, count(*) AS rows_in_table FROM customers_v
UNION ALL
SELECT 'interactions', count(*), CAST(0 AS BIGINT), count(*) FROM interactions_v"""
    ),
)
def bulk_load_counts(spark, sf_dir):
    out = []
    for name, df, schema, key in [
        ("customers", P.customers_v(spark, sf_dir), S.CUSTOMERS, "customer_id"),
        ("interactions", P.interactions_v(spark, sf_dir), S.INTERACTIONS, "interaction_id"),
    ]:
        csv = IO.write_csv(df, work_dir(spark, f"{name}-csv"))
        table = work_dir(spark, f"{name}-table")
        src = IO.read_csv(spark, csv, schema)
        first = IO.append_new(spark, src, table, key)
        second = IO.append_new(spark, src, table, key)  # re-run: nothing new
        n = spark.read.parquet(table).count()
        out.append((name, first, second, n))
    return spark.createDataFrame(out, "table_name string, loaded_first bigint, loaded_second bigint, rows_in_table bigint")


# Fixed values of the proxy batch: every so manieth row breaks a rule
BATCH_SQL = (
    "batch",
    f"""SELECT interaction_id AS source_id,
  CASE WHEN interaction_id % 13 = 0 THEN NULL WHEN interaction_id % 17 = 0 THEN interaction_id - 1 ELSE interaction_id END AS interaction_id,
  CASE WHEN interaction_id % 5 = 0 THEN customer_id * {ORPHAN_KEY_FACTOR} ELSE customer_id END AS customer_id, "timestamp",
  CASE WHEN interaction_id % 7 = 0 THEN channel || ' at the front desk' ELSE channel END AS channel, interaction_type,
  CASE WHEN interaction_id % 11 = 0 THEN 'angry' ELSE sentiment END AS sentiment,
  CASE WHEN interaction_id % 19 = 0 THEN NULL ELSE text END AS text FROM interactions_v""",
)


@query(
    "checked_append",
    "A3 A7 A8 A9",
    q(
        f"""SELECT source_id, interaction_id, array_to_string(list_sort(list_filter([
    CASE WHEN interaction_id IS NULL THEN 'key_null' END,
    CASE WHEN interaction_id IN (SELECT interaction_id FROM batch WHERE interaction_id IS NOT NULL GROUP BY interaction_id HAVING count(*) > 1) THEN 'key_repeated' END,
    CASE WHEN interaction_id % 3 = 0 AND interaction_id IN (SELECT interaction_id FROM interactions_v) THEN 'key_exists' END,
    CASE WHEN customer_id NOT IN (SELECT customer_id FROM customers_v) THEN 'reference:customer_id' END,
    CASE WHEN text IS NULL THEN 'not_null:text' END,
    CASE WHEN length(channel) > {S.VARCHAR_LIMITS["interactions"]["channel"]} THEN 'length:channel' END,
    CASE WHEN sentiment = 'angry' THEN 'domain:sentiment' END], lambda x: x IS NOT NULL)), ',') AS broken,
  CAST((SELECT count(*) FROM interactions_v WHERE interaction_id % 3 = 0) AS BIGINT) AS rows_before FROM batch""",
        BATCH_SQL,
    ),
)
def checked_append(spark, sf_dir):
    """A batch with broken rows goes to a table that holds every third interaction already: what
    breaks no rule is appended, the rest stays behind with the rules it breaks."""
    inter = P.interactions_v(spark, sf_dir)
    path = work_dir(spark, "checked-interactions")
    inter.where("interaction_id % 3 = 0").write.parquet(path)
    before = spark.read.parquet(path).count()
    every = lambda n: F.pmod(F.col("interaction_id"), F.lit(n)) == 0
    batch = inter.withColumns({
        "source_id": F.col("interaction_id"),
        "interaction_id": F.when(every(13), None).when(every(17), F.col("interaction_id") - 1).otherwise(F.col("interaction_id")),
        "customer_id": F.when(every(5), F.col("customer_id") * ORPHAN_KEY_FACTOR).otherwise(F.col("customer_id")),
        "channel": F.when(every(7), F.concat("channel", F.lit(" at the front desk"))).otherwise(F.col("channel")),
        "sentiment": F.when(every(11), "angry").otherwise(F.col("sentiment")),
        "text": F.when(~every(19), F.col("text")),
    })
    judged = IO.checked_append(
        spark, batch, path, "interaction_id", {"customer_id": (P.customers_v(spark, sf_dir), "customer_id")},
        not_null=["text"], max_lengths={"channel": S.VARCHAR_LIMITS["interactions"]["channel"]}, domains={"sentiment": S.SENTIMENTS}, table_columns=inter.columns,
    )
    return judged.select("source_id", "interaction_id", F.array_join("broken", ",").alias("broken"), F.lit(before).cast("bigint").alias("rows_before"))


@query(
    "interaction_metadata",
    "A4",
    q('SELECT interaction_id, customer_id, "timestamp", sentiment, interaction_type, text FROM interactions_v'),
)
def interaction_metadata(spark, sf_dir):
    cols = ["interaction_id", "customer_id", "timestamp", "sentiment", "interaction_type", "text"]
    path = IO.write_clustered(P.interactions_v(spark, sf_dir).select(*cols), work_dir(spark, "interaction-metadata"), "customer_id", tiebreak="interaction_id")
    return spark.read.parquet(path)


@query(
    "surrogate_keys",
    "A6",
    q("SELECT customer_id, row_number() OVER (ORDER BY customer_id) AS prediction_id FROM customers_v"),
)
def surrogate_keys(spark, sf_dir):
    c = P.customers_v(spark, sf_dir).select("customer_id")
    return dense_ids(c, ["customer_id"], "prediction_id").select("customer_id", "prediction_id")


@query(
    "pk_violations",
    "A7",
    q(
        """
SELECT table_name, CAST(sum(n) AS BIGINT) AS n_rows, CAST(coalesce(sum(n) FILTER (WHERE k IS NULL), 0) AS BIGINT) AS n_null_keys,
  count(*) FILTER (WHERE k IS NOT NULL) AS n_distinct_keys,
  count(*) FILTER (WHERE k IS NOT NULL AND n > 1) AS n_duplicate_keys,
  CAST(coalesce(sum(n) FILTER (WHERE k IS NOT NULL AND n > 1), 0) AS BIGINT) AS n_rows_with_duplicate_key
FROM (
  SELECT 'customers' AS table_name, customer_id AS k, count(*) AS n FROM customers_v GROUP BY customer_id
  UNION ALL SELECT 'interactions', interaction_id, count(*) FROM interactions_v GROUP BY interaction_id
  UNION ALL SELECT 'recommendations', prediction_id, count(*) FROM recs_v GROUP BY prediction_id)
GROUP BY table_name"""
    ),
)
def pk_violations(spark, sf_dir):
    a = Q.key_summary(P.customers_v(spark, sf_dir), "customer_id", "customers")
    b = Q.key_summary(P.interactions_v(spark, sf_dir), "interaction_id", "interactions")
    c = Q.key_summary(P.recs_v(spark, sf_dir), "prediction_id", "recommendations")
    return a.unionByName(b).unionByName(c).select(
        "table_name", "n_rows", F.col("n_null_keys").cast("bigint").alias("n_null_keys"), "n_distinct_keys", "n_duplicate_keys",
        F.col("n_rows_with_duplicate_key").cast("bigint").alias("n_rows_with_duplicate_key"),
    )


def _shifted_interactions(spark, sf_dir):
    i = P.interactions_v(spark, sf_dir)
    return i.withColumn("customer_id", F.col("customer_id") * ORPHAN_KEY_FACTOR).select("interaction_id", "customer_id")


@query(
    "fk_orphans",
    "A8",
    q(
        f"""SELECT interaction_id, customer_id * {ORPHAN_KEY_FACTOR} AS customer_id FROM interactions_v
WHERE customer_id * {ORPHAN_KEY_FACTOR} NOT IN (SELECT customer_id FROM customers_v)"""
    ),
)
def fk_orphans(spark, sf_dir):
    return Q.orphans(_shifted_interactions(spark, sf_dir), P.customers_v(spark, sf_dir), "customer_id", "customer_id")


@query(
    "fk_valid",
    "A8",
    q(
        f"""SELECT interaction_id, customer_id * {ORPHAN_KEY_FACTOR} AS customer_id FROM interactions_v
WHERE customer_id * {ORPHAN_KEY_FACTOR} IN (SELECT customer_id FROM customers_v)"""
    ),
)
def fk_valid(spark, sf_dir):
    return Q.valid_references(_shifted_interactions(spark, sf_dir), P.customers_v(spark, sf_dir), "customer_id", "customer_id")


CONSTRAINTS = {
    "not_null": [f.name for f in S.CUSTOMERS.fields],
    "max_lengths": S.VARCHAR_LIMITS["customers"],
    "domains": {
        "contract_type": PROXY_CONTRACTS,
        "payment_method": PROXY_PAYMENTS,
        "internet_service": PROXY_SERVICES,
        "tech_support": S.YES_NO,
        "online_security": S.YES_NO,
        "paperless_billing": S.YES_NO,
        "clv_segment": S.CLV_LABELS,
    },
    "ranges": {"tenure_months": (0, 72), "monthly_charges": (18, 150), "avg_satisfaction_score": (1, 5), "churned": (0, 1)},
}


def _constraint_sql() -> str:
    parts = []
    for c in CONSTRAINTS["not_null"]:
        parts.append(f"SELECT '{c}' AS column_name, 'not_null' AS check_name, count(*) FILTER (WHERE {c} IS NULL) AS violations FROM customers_v")
    for c, n in CONSTRAINTS["max_lengths"].items():
        parts.append(f"SELECT '{c}', 'max_length_{n}', count(*) FILTER (WHERE length({c}) > {n}) FROM customers_v")
    for c, vals in CONSTRAINTS["domains"].items():
        lst = ", ".join(f"'{v}'" for v in vals)
        parts.append(f"SELECT '{c}', 'domain', count(*) FILTER (WHERE {c} IS NOT NULL AND {c} NOT IN ({lst})) FROM customers_v")
    for c, (lo, hi) in CONSTRAINTS["ranges"].items():
        parts.append(f"SELECT '{c}', 'range', count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) FROM customers_v")
    return q("\nUNION ALL\n".join(parts))


@query("constraint_report", "A9 A5", _constraint_sql())
def constraint_report(spark, sf_dir):
    return Q.constraint_report(P.customers_v(spark, sf_dir), **CONSTRAINTS)


@query(
    "prediction_log",
    "A10 A6 F7",
    q(
        "SELECT prediction_id, customer_id, round(churn_probability, 6) AS churn_probability, predicted_label, threshold_used, "
        "model_version, created_at FROM predictions",
        PREDICTIONS_SQL,
    ),
)
def prediction_log(spark, sf_dir):
    path = work_dir(spark, "predictions")
    IO.append_table(predictions_log(spark, sf_dir, IO.next_id(spark, path, "prediction_id")), path)
    log = spark.read.parquet(path)
    return log.select(
        "prediction_id", "customer_id", r6("churn_probability").alias("churn_probability"), "predicted_label", "threshold_used",
        "model_version", "created_at",
    )


@query(
    "interactions_with_churn",
    "C1",
    q(
        "SELECT i.interaction_id, i.customer_id, i.sentiment, c.churned FROM interactions_v i "
        "LEFT JOIN customers_v c ON i.customer_id = c.customer_id"
    ),
)
def interactions_with_churn(spark, sf_dir):
    i = P.interactions_v(spark, sf_dir).select("interaction_id", "customer_id", "sentiment")
    c = P.customers_v(spark, sf_dir).select("customer_id", "churned")
    return i.join(c, "customer_id", "left").select("interaction_id", "customer_id", "sentiment", "churned")


@query(
    "lookup_customers",
    "C2",
    q(
        f"""SELECT e.event_id AS request_id, e.user_id * {ORPHAN_KEY_FACTOR} AS requested_id,
  CASE WHEN c.customer_id IS NULL THEN 'not_found' ELSE 'found' END AS status, c.tenure_months
FROM events e LEFT JOIN customers_v c ON e.user_id * {ORPHAN_KEY_FACTOR} = c.customer_id"""
    ),
)
def lookup_customers(spark, sf_dir):
    req = P.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), (F.col("user_id") * ORPHAN_KEY_FACTOR).alias("requested_id")
    )
    cust = P.customers_v(spark, sf_dir).select("customer_id", "tenure_months")
    return Q.lookup(req, cust, "requested_id", "customer_id").select("request_id", "requested_id", "status", "tenure_months")


@query(
    "prediction_history",
    "C3",
    q(
        """SELECT p.prediction_id, p.customer_id, i.interaction_id, i.interaction_type
FROM predictions p JOIN customers_v c ON p.customer_id = c.customer_id
JOIN interactions_v i ON c.customer_id = i.customer_id WHERE p.predicted_label = 1""",
        PREDICTIONS_SQL,
    ),
)
def prediction_history(spark, sf_dir):
    pred = predictions_log(spark, sf_dir).where("predicted_label = 1").select("prediction_id", "customer_id")
    cust = P.customers_v(spark, sf_dir).select("customer_id")
    inter = P.interactions_v(spark, sf_dir).select("customer_id", "interaction_id", "interaction_type")
    return pred.join(cust, "customer_id").join(inter, "customer_id").select("prediction_id", "customer_id", "interaction_id", "interaction_type")


@query(
    "customers_without_history",
    "C5",
    q("SELECT customer_id, tenure_months FROM customers_v WHERE customer_id NOT IN (SELECT customer_id FROM interactions_v)"),
)
def customers_without_history(spark, sf_dir):
    c = P.customers_v(spark, sf_dir).select("customer_id", "tenure_months")
    # distinct first: the anti-join cannot split a hot key on its build side
    return c.join(P.interactions_v(spark, sf_dir).select("customer_id").distinct(), "customer_id", "left_anti")
