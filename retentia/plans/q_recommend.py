"""Registered queries: prompts, generation, guardrails, retries, the end-to-end
recommendation job and the recommendation log (J6-J12, A11, C6).

The oracle SQL rebuilds the same deterministic template generator and guardrail rules,
so the whole job is checked by value."""

from __future__ import annotations

from pyspark.sql import functions as F

from retentia import schemas as S
from retentia.functions import numeric as N
from retentia.functions import text as X
from retentia.operators import quality as Q
from retentia.operators import recommend as RC
from retentia.operators.ranking import dense_ids
from retentia.plans.q_quality import PREDICTIONS_SQL, predictions_log
from retentia.plans.q_retrieval import EMB_SQL, EMPTY_CTX_SQL, HITS_SQL, cosine_sql, customer_contexts, embedded_interactions
from retentia.plans.registry import query
from retentia.plans.views_sql import q
from retentia.session import stored, work_dir
from retentia.sources import io as IO
from retentia.sources import proxies as P

# ---------------------------------------------------------------------------
# SQL renderings of the guardrail rules (DuckDB / RE2)
# ---------------------------------------------------------------------------
WS = r"[\t-\r\x{85}\p{Z}]"  # Unicode White_Space, as Java's (?U)\s
DOLLAR = S.DOLLAR_AMOUNT_PATTERN
PCT = r"\d+(?:\.\d+)?\s?%"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _blank(t: str) -> str:
    return f"({t} IS NULL OR regexp_replace({t}, '^{WS}+|{WS}+$', '', 'g') = '')"


def _missing(t: str, c: str) -> str:
    claimed = f"list_distinct(regexp_extract_all({t}, '{DOLLAR}'))"
    ctx = f"regexp_extract_all(coalesce({c}, ''), '{DOLLAR}')"
    return f"list_sort(list_filter({claimed}, lambda x: NOT list_contains({ctx}, x)))"


def _n_claimed(t: str) -> str:
    return f"len(regexp_extract_all({t}, '{DOLLAR}'))"


def _extra_pct(t: str, c: str) -> str:
    pt = f"list_sort(list_distinct(regexp_extract_all({t}, '{PCT}')))"
    pc = f"regexp_extract_all(coalesce({c}, ''), '{PCT}')"
    return f"list_filter({pt}, lambda x: NOT list_contains({pc}, x))"


def _pylist(arr: str) -> str:
    return f"'[' || array_to_string(list_transform({arr}, lambda x: '''' || x || ''''), ', ') || ']'"


def structural_sql(t: str) -> tuple[str, str]:
    n = f"length({t})"
    passed = f"CASE WHEN {_blank(t)} THEN false WHEN {n} < {S.MIN_LENGTH} THEN false WHEN {n} > {S.MAX_LENGTH} THEN false ELSE true END"
    reason = (
        f"CASE WHEN {_blank(t)} THEN {_lit(S.EMPTY_REASON)} "
        f"WHEN {n} < {S.MIN_LENGTH} THEN 'Recommendation too short (' || CAST({n} AS VARCHAR) || ' chars).' "
        f"WHEN {n} > {S.MAX_LENGTH} THEN 'Recommendation too long (' || CAST({n} AS VARCHAR) || ' chars).' "
        f"ELSE {_lit(S.STRUCTURAL_OK)} END"
    )
    return passed, reason


def numeric_sql(t: str, c: str) -> tuple[str, str]:
    miss = _missing(t, c)
    passed = f"CASE WHEN {_n_claimed(t)} = 0 THEN true WHEN len({miss}) > 0 THEN false ELSE true END"
    reason = (
        f"CASE WHEN {_n_claimed(t)} = 0 THEN {_lit(S.NO_AMOUNTS_REASON)} "
        f"WHEN len({miss}) > 0 THEN 'Recommendation mentions amount(s) not found in context: ' || {_pylist(miss)} "
        f"ELSE {_lit(S.AMOUNTS_OK_REASON)} END"
    )
    return passed, reason


def _new_facts(t: str, c: str) -> str:
    """Claims of rule (a) that the context does not hold."""
    ctx = f"coalesce({c}, '')"
    parts = []
    for pattern, text, context in ((X.DATE_RE, t, ctx), (DOLLAR, t, ctx), (X.PRIOR_ACTION_RE, f"lower({t})", f"lower({ctx})")):
        parts.append(f"list_filter(regexp_extract_all({text}, '{pattern}'), lambda x: NOT list_contains(regexp_extract_all({context}, '{pattern}'), x))")
    parts.append(f"list_filter(regexp_extract_all({t}, '{X.QUOTATION_RE}', 1), lambda x: NOT contains({ctx}, x))")
    return f"list_sort(list_distinct(flatten([{', '.join(parts)}])))"


def judge_sql(t: str, c: str) -> tuple[str, str]:
    facts, extra = _new_facts(t, c), _extra_pct(t, c)
    passed = f"(len({facts}) = 0 AND len({extra}) = 0)"
    reason = (
        f"CASE WHEN len({facts}) > 0 THEN 'UNGROUNDED' || chr(10) || 'States facts not in the context: ' || array_to_string({facts}, ', ') || '.' "
        f"WHEN len({extra}) > 0 THEN 'UNGROUNDED' || chr(10) || 'Proposes a concession not in the context: ' "
        f"|| array_to_string({extra}, ', ') || '.' ELSE 'GROUNDED' || chr(10) || 'Every stated fact and amount appears in the context.' END"
    )
    return passed, reason


def chain_sql(t: str, c: str) -> tuple[str, str]:
    sp, sr = structural_sql(t)
    np_, nr = numeric_sql(t, c)
    jp, jr = judge_sql(t, c)
    passed = f"(({sp}) AND ({np_}) AND {jp})"
    reason = f"CASE WHEN NOT ({sp}) THEN {sr} WHEN NOT ({np_}) THEN {nr} WHEN NOT {jp} THEN {jr} ELSE {_lit(S.ALL_PASSED_REASON)} END"
    return passed, reason


CTX_SQL = (
    "ctx",
    f"""SELECT c.customer_id, CAST(coalesce(x.n, 0) AS INTEGER) AS n_context,
  coalesce(x.context_text, '{EMPTY_CTX_SQL}') AS context_text, coalesce(x.first_type, 'general') AS first_type
FROM customers_v c LEFT JOIN (
  SELECT customer_id, count(*) AS n,
    string_agg(CAST(rank AS VARCHAR) || '. [' || interaction_type || ', ' || sentiment || '] ' || text, chr(10) ORDER BY rank) AS context_text,
    max(interaction_type) FILTER (WHERE rank = 1) AS first_type
  FROM hits GROUP BY customer_id) x ON c.customer_id = x.customer_id""",
)
BASE_SQL = (
    "base",
    """SELECT p.prediction_id, p.customer_id, ctx.n_context, ctx.context_text, ctx.first_type
FROM predictions p JOIN ctx ON p.customer_id = ctx.customer_id WHERE p.predicted_label = 1""",
)
TEXT1_SQL = (
    "'Customer ' || CAST(customer_id AS VARCHAR) || ' raised ' || CAST(n_context AS VARCHAR) || ' recent issue(s); offer a credit of $' "
    "|| CAST(prediction_id % 50 AS VARCHAR) || CASE WHEN prediction_id % 3 = 0 THEN ' or a 10% discount' ELSE '' END "
    "|| ' and have a manager call them.'"
)
TEXT2_SQL = (
    "'Have a specialist review the account of customer ' || CAST(customer_id AS VARCHAR) || ', starting with the ' "
    "|| first_type || ' history, and call them back.'"
)
_CP, _CR = chain_sql("t", "context_text")


def attempts_sql(base: str, key: str, prefix: str = "") -> list[tuple[str, str]]:
    """Both rounds over the rows of ``base`` and the chosen attempt, as CTEs g1, g2, final."""
    keys = "prediction_id" if key == "prediction_id" else f"{key}, prediction_id"
    return [
        (f"{prefix}g1", f"SELECT *, 1 AS attempt, {_CP} AS passed, {_CR} AS reason FROM (SELECT *, {TEXT1_SQL} AS t FROM {base})"),
        (
            f"{prefix}g2",
            f"""SELECT *, 2 AS attempt, {_CP} AS passed, {_CR} AS reason FROM (
  SELECT {keys}, customer_id, n_context, context_text, first_type, {TEXT2_SQL} AS t FROM {prefix}g1 WHERE NOT passed)""",
        ),
        (f"{prefix}final", f"SELECT * FROM (SELECT {keys}, customer_id, t, attempt, passed, reason FROM {prefix}g1 WHERE passed UNION ALL SELECT {keys}, customer_id, t, attempt, passed, reason FROM {prefix}g2)"),
    ]


ATTEMPTS_SQL = attempts_sql("base", "prediction_id")
JOB_CTES = [PREDICTIONS_SQL, EMB_SQL, HITS_SQL, CTX_SQL, BASE_SQL]
RECS_CTX_SQL = ("rc", "SELECT r.prediction_id, r.customer_id, r.recommendation_text AS t, ctx.context_text, ctx.n_context, ctx.first_type FROM recs_v r JOIN ctx ON r.customer_id = ctx.customer_id")
RECS_CTES = [EMB_SQL, HITS_SQL, CTX_SQL, RECS_CTX_SQL]


# ---------------------------------------------------------------------------
# Spark side
# ---------------------------------------------------------------------------
def job_base(spark, sf_dir):
    """At-risk predictions with the retrieved context of their customers (C2 -> C3 -> J4 -> J5)."""
    preds = stored(predictions_log(spark, sf_dir).where("predicted_label = 1").select("prediction_id", "customer_id"), "at-risk")
    ctx = customer_contexts(spark, sf_dir, preds.select("customer_id").distinct())
    return preds.join(RC.with_context_facts(ctx.select("customer_id", "context_items", "context_text")), "customer_id")


def recs_with_context(spark, sf_dir, items: bool = False):
    """Every recommendation with its customer's context (a customer who is not known: the fixed
    sentence); the context's facts are extracted once per customer, before the join repeats
    them.  The join keeps the recommendations' side, which AQE may split where a customer is hot."""
    cols = ["customer_id", "context_text"] + (["context_items"] if items else [])
    ctx = RC.with_context_facts(customer_contexts(spark, sf_dir).select(*cols))
    known = P.recs_v(spark, sf_dir).join(ctx, "customer_id", "left")
    facts = {c: F.coalesce(c, F.array().cast("array<string>")) for c in RC.FACTS}
    return known.withColumns({"context_text": F.coalesce("context_text", F.lit(S.EMPTY_CONTEXT_TEXT)), **facts})


@query(
    "build_prompts",
    "J6",
    q(
        f"""SELECT prediction_id, {_lit(RC.USER_PROMPT_HEAD)} || context_text || {_lit(RC.USER_PROMPT_TAIL)} AS user_prompt,
  CAST({len(RC.SYSTEM_PROMPT)} AS INTEGER) AS system_prompt_chars FROM base""",
        *JOB_CTES,
    ),
)
def build_prompts(spark, sf_dir):
    p = RC.build_prompts(job_base(spark, sf_dir))
    return p.select("prediction_id", "user_prompt", F.length("system_prompt").alias("system_prompt_chars"))


@query("generate_recommendations", "J6", q(f"SELECT prediction_id, {TEXT1_SQL} AS recommendation_text FROM base", *JOB_CTES))
def generate_recommendations(spark, sf_dir):
    g = RC.generate(job_base(spark, sf_dir), attempt=1)
    return g.select("prediction_id", "recommendation_text")


def _sp():
    return structural_sql("text")


@query(
    "guardrail_structural",
    "J7 F1 F2",
    q(f"SELECT doc_id, {_sp()[0]} AS passed, {_sp()[1]} AS reason FROM documents"),
)
def guardrail_structural(spark, sf_dir):
    d = P.table(spark, sf_dir, "documents").select("doc_id", RC.structural_check("text").alias("r"))
    return d.select("doc_id", F.col("r.passed").alias("passed"), F.col("r.reason").alias("reason"))


_NP, _NR = numeric_sql("t", "context_text")


@query("guardrail_numeric", "J8 F3 E6", q(f"SELECT prediction_id, {_NP} AS passed, {_NR} AS reason FROM rc", *RECS_CTES))
def guardrail_numeric(spark, sf_dir):
    rc = recs_with_context(spark, sf_dir)
    r = rc.select("prediction_id", RC.numeric_check("recommendation_text", "context_text", F.col(RC.CONTEXT_AMOUNTS)).alias("r"))
    return r.select("prediction_id", F.col("r.passed").alias("passed"), F.col("r.reason").alias("reason"))


_JP, _JR = judge_sql("t", "context_text")


@query("guardrail_judge", "J9 F4", q(f"SELECT prediction_id, {_JP} AS passed, {_JR} AS reason FROM rc", *RECS_CTES))
def guardrail_judge(spark, sf_dir):
    r = RC.apply_judge(recs_with_context(spark, sf_dir)).select("prediction_id", RC.judge_check("verdict").alias("r"))
    return r.select("prediction_id", F.col("r.passed").alias("passed"), F.col("r.reason").alias("reason"))


_RP, _RR = chain_sql("t", "context_text")


@query(
    "guardrail_chain",
    "J10 F5",
    q(f"SELECT prediction_id, {_RP} AS passed_guardrails, {_RR} AS guardrail_reason FROM rc", *RECS_CTES),
)
def guardrail_chain(spark, sf_dir):
    g = RC.guardrail_chain(recs_with_context(spark, sf_dir))
    return g.select("prediction_id", "passed_guardrails", "guardrail_reason")


def _attempts(spark, sf_dir):
    base = job_base(spark, sf_dir)
    return RC.run_attempts(spark, base)


@query(
    "recommend_with_retry",
    "J11 E4",
    q(
        "SELECT prediction_id, CAST(attempt AS INTEGER) AS attempt, t AS recommendation_text, passed AS passed_guardrails, "
        "reason AS guardrail_reason FROM g1 UNION ALL SELECT prediction_id, CAST(attempt AS INTEGER), t, passed, reason FROM g2",
        *JOB_CTES,
        *ATTEMPTS_SQL,
    ),
)
def recommend_with_retry(spark, sf_dir):
    a = _attempts(spark, sf_dir)
    return a.select("prediction_id", F.col("attempt").cast("int").alias("attempt"), "recommendation_text", "passed_guardrails", "guardrail_reason")


# ---------------------------------------------------------------------------
# J6, J9, J11 through the model hooks: a generator and a judge in Python, one call per Arrow batch
# ---------------------------------------------------------------------------
def model_generate(system, prompts, attempt):
    """Stands in for a hosted generator: it sees the prompts of a batch, nothing else."""
    first = prompts.str.removeprefix(RC.USER_PROMPT_HEAD).str.split("\n", n=1).str[0]
    if attempt == 1:
        return "Offer a credit of $" + (prompts.str.len() % 50).astype(str) + " and call them about: " + first
    return "Have a manager review this with them: " + first


def model_judge(rules, prompts):
    """Stands in for a hosted judge: a recommendation about a complaint has to be looked at again."""
    said = prompts.str.split(RC.JUDGE_USER_MID, n=1).str[1]
    return said.str.contains("call them about: 1. [complaint", regex=False).map({True: "UNGROUNDED\nA complaint needs a review first.", False: "GROUNDED\nFine."})


def _model_rounds_sql() -> list[tuple[str, str]]:
    first = "split_part(context_text, chr(10), 1)"
    prompt_chars = f"({len(RC.USER_PROMPT_HEAD) + len(RC.USER_PROMPT_TAIL)} + length(context_text))"
    sp, sr = structural_sql("t")
    np_, nr = numeric_sql("t", "context_text")
    bad = "contains(t, 'call them about: 1. [complaint')"
    passed = f"(({sp}) AND ({np_}) AND NOT {bad})"
    reason = f"CASE WHEN NOT ({sp}) THEN {sr} WHEN NOT ({np_}) THEN {nr} WHEN {bad} THEN 'UNGROUNDED' || chr(10) || 'A complaint needs a review first.' ELSE {_lit(S.ALL_PASSED_REASON)} END"
    text1 = f"'Offer a credit of $' || CAST({prompt_chars} % 50 AS VARCHAR) || ' and call them about: ' || {first}"
    text2 = f"'Have a manager review this with them: ' || {first}"
    return [
        ("m1", f"SELECT *, 1 AS attempt, {passed} AS passed, {reason} AS reason FROM (SELECT *, {text1} AS t FROM base)"),
        ("m2", f"SELECT *, 2 AS attempt, {passed} AS passed, {reason} AS reason FROM (SELECT prediction_id, customer_id, context_text, {text2} AS t FROM m1 WHERE NOT passed)"),
    ]


@query(
    "recommend_with_model",
    "J6 J9 J10 J11",
    q(
        "SELECT prediction_id, CAST(attempt AS INTEGER) AS attempt, t AS recommendation_text, passed AS passed_guardrails, "
        "reason AS guardrail_reason FROM m1 UNION ALL SELECT prediction_id, CAST(attempt AS INTEGER), t, passed, reason FROM m2",
        *JOB_CTES,
        *_model_rounds_sql(),
    ),
)
def recommend_with_model(spark, sf_dir):
    """The retry rounds with a generator and a judge plugged in as Python functions."""
    a = RC.run_attempts(spark, job_base(spark, sf_dir), generate_fn=model_generate, judge_fn=model_judge)
    return a.select("prediction_id", F.col("attempt").cast("int").alias("attempt"), "recommendation_text", "passed_guardrails", "guardrail_reason")


def at_risk_job(spark, sf_dir, start=1):
    """Every at-risk prediction -> context -> text -> guardrails (with retry) -> log rows, with
    ids from ``start``."""
    final = stored(RC.final_attempt(_attempts(spark, sf_dir)), "final-attempts")
    with_ids = dense_ids(final, ["prediction_id"], "recommendation_id", start)
    return with_ids.select(
        "recommendation_id",
        "prediction_id",
        "recommendation_text",
        "passed_guardrails",
        "guardrail_reason",
        F.lit(RC.PROVIDER).alias("llm_provider"),
        N.created_at(P.FIXED_CREATED_AT).alias("created_at"),
        F.col("attempt").cast("int").alias("attempt"),
    )


JOB_SQL = f"""SELECT row_number() OVER (ORDER BY prediction_id) AS recommendation_id, prediction_id, t AS recommendation_text,
  passed AS passed_guardrails, '(attempt ' || CAST(attempt AS VARCHAR) || '/{S.MAX_ATTEMPTS}) ' || reason AS guardrail_reason,
  '{RC.PROVIDER}' AS llm_provider, TIMESTAMP '{P.FIXED_CREATED_AT}' AS created_at, CAST(attempt AS INTEGER) AS attempt FROM final"""

# Fixed values of the proxy requests: one per prediction, with its own query (the first is left
# out: the default), number of hits (0, 21 and 22 are out of range, some are left out) and
# now and then an unknown prediction
REQUEST_QUERIES = [None, "An error with a charge of $42", "purchase or signup trouble", "clicks, views and a complaint about the charge"]
UNKNOWN_OFFSET = 1_000_000_000


def requests_v(spark, sf_dir, predictions):
    """request_id, prediction_id, query, top_k."""
    p = F.col("prediction_id")
    query_of = F.element_at(F.array(*[F.lit(x) for x in REQUEST_QUERIES]), (F.pmod(p, F.lit(len(REQUEST_QUERIES))) + 1).cast("int"))
    k = F.pmod(p, F.lit(23)).cast("int")
    return predictions.select(
        p.alias("request_id"),
        F.when(F.pmod(p, F.lit(7)) == 0, p + UNKNOWN_OFFSET).otherwise(p).alias("prediction_id"),
        query_of.alias("query"),
        F.when(k != 5, k).alias("top_k"),
    )


def _request_sims() -> str:
    cases = " ".join(f"WHEN {i} THEN {cosine_sql('tokens', text or S.DEFAULT_QUERY)}" for i, text in enumerate(REQUEST_QUERIES))
    return f"CASE request_id % {len(REQUEST_QUERIES)} {cases} END"


REQUEST_CTES = [
    PREDICTIONS_SQL,
    EMB_SQL,
    (
        "req",
        f"""SELECT r.*, p.customer_id, CASE WHEN top_k NOT BETWEEN {S.TOP_K_MIN} AND {S.TOP_K_MAX} THEN 'rejected'
  WHEN p.customer_id IS NULL THEN 'not_found' ELSE 'answered' END AS status FROM (
  SELECT prediction_id AS request_id, CASE WHEN prediction_id % 7 = 0 THEN prediction_id + {UNKNOWN_OFFSET} ELSE prediction_id END AS prediction_id,
         CAST(prediction_id % 23 AS INTEGER) AS top_k FROM predictions) r LEFT JOIN predictions p USING (prediction_id)""",
    ),
    (
        "rhits",
        f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY sim DESC, interaction_id) AS rank FROM (
  SELECT r.request_id, r.top_k, e.*, {_request_sims()} AS sim FROM req r JOIN emb e ON r.customer_id = e.customer_id WHERE r.status = 'answered'))
WHERE rank <= top_k""",
    ),
    (
        "rbase",
        f"""SELECT r.request_id, r.prediction_id, r.customer_id, CAST(coalesce(x.n, 0) AS INTEGER) AS n_context,
  coalesce(x.context_text, '{EMPTY_CTX_SQL}') AS context_text, coalesce(x.first_type, 'general') AS first_type
FROM req r LEFT JOIN (
  SELECT request_id, count(*) AS n,
    string_agg(CAST(rank AS VARCHAR) || '. [' || interaction_type || ', ' || sentiment || '] ' || text, chr(10) ORDER BY rank) AS context_text,
    max(interaction_type) FILTER (WHERE rank = 1) AS first_type
  FROM rhits GROUP BY request_id) x USING (request_id) WHERE r.status = 'answered'""",
    ),
    *attempts_sql("rbase", "request_id", "r"),
]
REQUEST_JOB_SQL = f"""SELECT f.recommendation_id, r.request_id, r.prediction_id, CASE WHEN r.status = 'answered' THEN r.customer_id END AS customer_id,
  r.top_k, r.status, f.t AS recommendation_text, f.passed AS passed_guardrails,
  '(attempt ' || CAST(f.attempt AS VARCHAR) || '/{S.MAX_ATTEMPTS}) ' || f.reason AS guardrail_reason, CAST(f.attempt AS INTEGER) AS attempt,
  CASE WHEN r.status = 'answered' THEN '{RC.PROVIDER}' END AS llm_provider,
  CASE WHEN r.status = 'answered' THEN TIMESTAMP '{P.FIXED_CREATED_AT}' END AS created_at
FROM req r LEFT JOIN (SELECT *, row_number() OVER (ORDER BY request_id) AS recommendation_id FROM rfinal) f USING (request_id)"""


def logged(answers, start: int, created_at):
    """Ids (dense from ``start``, by request), provider and time of the answered rows; the others
    keep nulls there, they are no recommendations."""
    done = dense_ids(answers.where("status = 'answered'"), ["request_id"], "recommendation_id", start)
    done = done.withColumns({"llm_provider": F.lit(RC.PROVIDER), "created_at": created_at})
    return done.unionByName(answers.where("status <> 'answered'"), allowMissingColumns=True)


@query("recommend_job", "J12 A11 B15 C2 C3", q(REQUEST_JOB_SQL, *REQUEST_CTES))
def recommend_job(spark, sf_dir):
    """J12 over requests with queries and numbers of hits of their own; the answered ones go on
    the recommendation log."""
    predictions = stored(predictions_log(spark, sf_dir).select("prediction_id", "customer_id"), "predictions")
    answers = stored(RC.answer_requests(spark, requests_v(spark, sf_dir, predictions), predictions, embedded_interactions(spark, sf_dir)), "answers")
    path = work_dir(spark, "recommendations")
    rows = stored(logged(answers, IO.next_id(spark, path, "recommendation_id"), N.created_at(P.FIXED_CREATED_AT)), "answered")
    IO.append_table(rows.where("status = 'answered'").select("recommendation_id", "prediction_id", "recommendation_text", "passed_guardrails", "guardrail_reason", "llm_provider", "created_at"), path)
    return rows


# ---------------------------------------------------------------------------
# The recommendation log, its cardinality and latest-wins navigation
# ---------------------------------------------------------------------------
def recommendation_log_table(spark, sf_dir):
    """An append-only log with re-requests: run 1 logs every recommendation (whether or
    not it passed), run 2 generates the next attempt for those whose latest row failed.  Each
    run's ids go on from the log's largest, in prediction order, and are stored with the
    row, so an append changes no id.  Written to the shared folder and read back."""
    base = stored(recs_with_context(spark, sf_dir, items=True), "recs-with-context")
    cols = ["prediction_id", "recommendation_text", "passed_guardrails", "guardrail_reason", "attempt"]
    path = work_dir(spark, "recommendation-log")
    first = RC.guardrail_chain(base).withColumn("attempt", F.lit(1))
    _append_run(spark, stored(first.select(*cols), "first-run"), path, 1)
    again = RC.regenerate(spark, spark.read.parquet(path), base.drop("recommendation_text"))
    _append_run(spark, again.select(*cols), path, 2)
    return spark.read.parquet(path)


def _append_run(spark, rows, path, run):
    start = IO.next_id(spark, path, "recommendation_id")
    IO.append_table(dense_ids(rows.withColumn("run", F.lit(run)), ["prediction_id"], "recommendation_id", start), path)


LOG_SQL = [
    ("run1", f"SELECT prediction_id, customer_id, t, context_text, n_context, first_type, {_RP} AS passed_guardrails, 1 AS run FROM rc"),
    ("run2", f"SELECT prediction_id, t, {_RP} AS passed_guardrails, 2 AS run FROM (SELECT prediction_id, context_text, {TEXT2_SQL} AS t FROM run1 WHERE NOT passed_guardrails)"),
    (
        "rlog",
        """SELECT row_number() OVER (ORDER BY run, prediction_id) AS recommendation_id, * FROM (
  SELECT prediction_id, t AS recommendation_text, passed_guardrails, run FROM run1 UNION ALL SELECT prediction_id, t, passed_guardrails, run FROM run2)""",
    ),
]


@query(
    "recommendation_log",
    "A11",
    q(
        "SELECT recommendation_id, prediction_id, recommendation_text, passed_guardrails, CAST(run AS INTEGER) AS run, CAST(run AS INTEGER) AS attempt FROM rlog",
        *RECS_CTES,
        *LOG_SQL,
    ),
)
def recommendation_log(spark, sf_dir):
    return recommendation_log_table(spark, sf_dir).select("recommendation_id", "prediction_id", "recommendation_text", "passed_guardrails", "run", "attempt")


@query(
    "recommendation_latest",
    "A11 C6",
    q(
        """SELECT prediction_id, count(*) AS n_rows, max(recommendation_id) AS recommendation_id,
  arg_max(passed_guardrails, recommendation_id) AS passed_guardrails FROM rlog GROUP BY prediction_id""",
        *RECS_CTES,
        *LOG_SQL,
    ),
)
def recommendation_latest(spark, sf_dir):
    """Latest row per prediction plus its row count (n_rows > 1 = the 1-to-1 rule broken);
    one aggregate with map-side combine, no window sort."""
    log = recommendation_log_table(spark, sf_dir).select("prediction_id", "recommendation_id", "passed_guardrails")
    return Q.latest_per_key(log, "prediction_id", "recommendation_id", count_col="n_rows")


@query(
    "prediction_with_recommendation",
    "C6",
    q(
        """SELECT p.prediction_id, p.customer_id, p.predicted_label, j.recommendation_id, j.passed_guardrails
FROM predictions p LEFT JOIN job j ON p.prediction_id = j.prediction_id""",
        *JOB_CTES,
        *ATTEMPTS_SQL,
        ("job", JOB_SQL),
    ),
)
def prediction_with_recommendation(spark, sf_dir):
    preds = predictions_log(spark, sf_dir).select("prediction_id", "customer_id", "predicted_label")
    path = work_dir(spark, "recommendations")
    IO.append_table(at_risk_job(spark, sf_dir, IO.next_id(spark, path, "recommendation_id")), path)
    log = spark.read.parquet(path).select("prediction_id", "recommendation_id", "passed_guardrails")
    latest = Q.latest_per_key(log, "prediction_id", "recommendation_id")
    return preds.join(latest, "prediction_id", "left").select(
        "prediction_id", "customer_id", "predicted_label", "recommendation_id", "passed_guardrails"
    )
