"""Registered queries: streaming scoring, streaming recommendation and request
throughput (S1-S3), each drained with an availableNow trigger and read back from its sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from retentia.operators import recommend as RC
from retentia.plans.q_quality import PROXY_MODEL_VERSION, predictions_log
from retentia.plans.q_recommend import REQUEST_CTES, REQUEST_JOB_SQL, requests_v
from retentia.plans.q_retrieval import embedded_interactions
from retentia.plans.registry import query, r6
from retentia.plans.views_sql import q
from retentia.session import work_dir
from retentia.sources import proxies as P
from retentia.streaming import jobs as J


def _requests(spark, sf_dir):
    ev = J.file_stream(spark, f"{sf_dir.rstrip('/')}/events.parquet")
    return ev.select(F.col("event_id").alias("request_id"), F.col("user_id").alias("customer_id"), "ts", "event_type")


@query(
    "stream_score",
    "S1 I9 A10 C2",
    q(
        f"""SELECT CASE WHEN s.customer_id IS NOT NULL THEN row_number() OVER (PARTITION BY s.customer_id IS NULL ORDER BY e.event_id) END AS prediction_id,
  e.event_id AS request_id, e.user_id AS customer_id,
  CASE WHEN s.customer_id IS NULL THEN 'not_found' ELSE 'scored' END AS status,
  round(s.churn_probability, 6) AS churn_probability, s.predicted_label,
  CASE WHEN s.customer_id IS NULL THEN NULL ELSE CAST({P.PROXY_THRESHOLD} AS DOUBLE) END AS threshold_used,
  CASE WHEN s.customer_id IS NULL THEN NULL ELSE '{PROXY_MODEL_VERSION}' END AS model_version,
  CASE WHEN s.customer_id IS NOT NULL THEN TIMESTAMP '{P.FIXED_CREATED_AT}' END AS created_at
FROM events e LEFT JOIN scored_v s ON e.user_id = s.customer_id"""
    ),
)
def stream_score(spark, sf_dir):
    scored = J.materialize(
        spark,
        P.scored_customers(spark, sf_dir).select("customer_id", "churn_probability", "predicted_label", "threshold_used"),
        "scored-customers",
    )
    requests = _requests(spark, sf_dir).drop("ts", "event_type")
    sink, ledger = work_dir(spark, "stream-score"), work_dir(spark, "stream-score-ids")

    def score(df, batch_id):
        rows = J.score_requests(df, scored, PROXY_MODEL_VERSION)
        return J.with_batch_ids(rows, ledger, batch_id, "request_id", "prediction_id", F.col("status") == "scored", P.FIXED_CREATED_AT)

    J.run_available_now(requests, J.batch_sink(sink, score), work_dir(spark, "stream-score-ckpt"))
    log = J.read_sink(spark, sink)
    return log.select(
        "prediction_id", "request_id", "customer_id", "status", r6("churn_probability").alias("churn_probability"), "predicted_label",
        "threshold_used", "model_version", "created_at",
    )


@query("stream_recommend", "S2 J12 C2", q(REQUEST_JOB_SQL, *REQUEST_CTES))
def stream_recommend(spark, sf_dir):
    """Recommendation requests arrive as files (prediction, query, number of hits); each micro-batch
    runs the J12 path: rejected and unknown requests keep their status, the others are answered
    and logged with ids, provider and time."""
    predictions = J.materialize(spark, predictions_log(spark, sf_dir).select("prediction_id", "customer_id"), "predictions")
    candidates = J.materialize(spark, embedded_interactions(spark, sf_dir), "interaction-vectors")
    queue = work_dir(spark, "recommend-requests")
    requests_v(spark, sf_dir, predictions).write.parquet(queue)
    sink, ledger = work_dir(spark, "stream-recommend"), work_dir(spark, "stream-recommend-ids")

    def per_batch(df, batch_id):
        answers = RC.answer_requests(df.sparkSession, df, predictions, candidates).withColumn("llm_provider", F.when(F.col("status") == "answered", F.lit(RC.PROVIDER)))
        return J.with_batch_ids(answers, ledger, batch_id, "request_id", "recommendation_id", F.col("status") == "answered", P.FIXED_CREATED_AT)

    J.run_available_now(J.file_stream(spark, queue), J.batch_sink(sink, per_batch), work_dir(spark, "stream-recommend-ckpt"))
    return J.read_sink(spark, sink).drop("batch_id")


@query(
    "requests_per_minute",
    "S3",
    q(
        """SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS minute, count(*) AS requests,
  count(*) FILTER (WHERE event_type = 'error') AS failures,
  round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS failure_share
FROM events GROUP BY 1"""
    ),
)
def requests_per_minute(spark, sf_dir):
    sink = work_dir(spark, "stream-rpm")
    count = J.batch_sink(sink, lambda df, _: J.requests_per_minute(df, "ts", F.col("event_type") == "error"))
    J.run_available_now(_requests(spark, sf_dir), count, work_dir(spark, "stream-rpm-ckpt"))
    out = J.total_per_minute(J.read_sink(spark, sink))
    return out.select("minute", "requests", "failures", r6("failure_share").alias("failure_share"))
