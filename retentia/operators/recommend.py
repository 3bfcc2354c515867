"""Prompts, generation, guardrails, retries and the end-to-end recommendation job.

Guardrails are column expressions evaluated cheapest first; the chain keeps the first
failure's reason.  External calls (a text generator or judge supplied as
``generate_fn`` / ``judge_fn``) run under ``mapInPandas`` on Arrow batches and their
output is written to the shared folder before anything reads it, so a retried task
or a recomputed lineage never calls the provider twice for the same row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentia import schemas as S
from retentia.functions import text as X
from retentia.functions import vectors as V
from retentia.operators.derive import validate_requests
from retentia.operators.quality import latest_per_key, lookup
from retentia.operators.ranking import first_pass_else_last
from retentia.operators.retrieve import context_items, scoped_search, with_context_text
from retentia.session import stored, work_dir

# The generation prompt and the user prompt frame
SYSTEM_PROMPT = (
    "You are a customer retention specialist. You will be given a customer's "
    "actual recent support interaction history. Write ONE short, specific, "
    "actionable retention recommendation for the support team. Base your "
    "recommendation ONLY on the facts given below - do not invent details, "
    "dates, amounts, or prior actions that are not present in the provided "
    "history. Do NOT propose specific discounts, refunds, compensation "
    "percentages, or promised timelines unless the customer's history "
    "already mentions one - offering unauthorized concessions is a bigger "
    "business risk than a vague recommendation. Prefer general next steps "
    "such as escalating to a specialist, reviewing the account manually, or "
    "having a manager call the customer to discuss their specific concerns. "
    "If the history is empty or too sparse to say anything specific, "
    "recommend a general check-in instead of inventing details."
)
USER_PROMPT_HEAD = "Customer's interaction history:\n"
USER_PROMPT_TAIL = "\n\nWrite the retention recommendation now."
# what a judge is told; the built-in one applies the same two rules
JUDGE_RULES = (
    "Check a RECOMMENDATION against the CONTEXT it was written from, a customer's own support history. New next steps "
    "(an escalation, a callback, a review of the account) are fine even if nobody asked for them. It is UNGROUNDED if "
    "(a) it states a fact that the context does not hold: a date, an amount, an action said to have been taken already, or "
    "words put into the customer's mouth; or (b) it proposes a concession, such as a percentage off, a refund or a "
    "compensation, that the context does not mention. First line: GROUNDED or UNGROUNDED. Second line: one sentence why."
)
JUDGE_USER_HEAD = "CONTEXT:\n"
JUDGE_USER_MID = "\n\nRECOMMENDATION:\n"

PROVIDER = "template"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def build_prompts(df: DataFrame, context_col: str = "context_text") -> DataFrame:
    """System and user prompt columns."""
    return df.withColumn("system_prompt", F.lit(SYSTEM_PROMPT)).withColumn(
        "user_prompt", F.concat(F.lit(USER_PROMPT_HEAD), F.col(context_col), F.lit(USER_PROMPT_TAIL))
    )


def template_text(attempt: int | Column) -> Column:
    """Deterministic offline generator (stands in for a hosted model).  Attempt 1 quotes a
    credit amount and sometimes a percentage (so the guardrails have work to do); later
    attempts fall back to a general next step with no numbers."""
    if isinstance(attempt, Column):
        return F.when(attempt == 1, template_text(1)).otherwise(template_text(2))
    first_type = F.coalesce(F.element_at(F.col("context_items"), 1)["interaction_type"], F.lit("general"))
    if attempt == 1:
        pct = F.when(F.pmod(F.col("prediction_id"), F.lit(3)) == 0, F.lit(" or a 10% discount")).otherwise(F.lit(""))
        return F.concat(
            F.lit("Customer "),
            F.col("customer_id").cast("string"),
            F.lit(" raised "),
            F.coalesce(F.size("context_items"), F.lit(0)).cast("string"),
            F.lit(" recent issue(s); offer a credit of $"),
            F.pmod(F.col("prediction_id"), F.lit(50)).cast("string"),
            pct,
            F.lit(" and have a manager call them."),
        )
    return F.concat(
        F.lit("Have a specialist review the account of customer "),
        F.col("customer_id").cast("string"),
        F.lit(", starting with the "),
        first_type,
        F.lit(" history, and call them back."),
    )


def generate(df: DataFrame, attempt: int | str, generate_fn: Callable | None = None, out_col: str = "recommendation_text") -> DataFrame:
    """One generated text per row, as the given attempt or as the one its column ``attempt``
    names.  ``generate_fn(system: str, user: pandas.Series, attempt: int) -> pandas.Series`` runs
    under ``mapInPandas``; default is the template."""
    if generate_fn is None:
        return df.withColumn(out_col, template_text(F.col(attempt) if isinstance(attempt, str) else attempt))
    if "user_prompt" not in df.columns:
        df = build_prompts(df)
    schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.StringType(), True)])

    def run(batches):
        for pdf in batches:
            if isinstance(attempt, str):
                pdf[out_col] = None
                for n, rows in pdf.groupby(attempt).groups.items():
                    pdf.loc[rows, out_col] = list(generate_fn(SYSTEM_PROMPT, pdf.loc[rows, "user_prompt"], int(n)))
            else:
                pdf[out_col] = list(generate_fn(SYSTEM_PROMPT, pdf["user_prompt"], attempt))
            yield pdf

    return df.mapInPandas(run, schema)


def _result(passed: Column, reason: Column) -> Column:
    return F.struct(passed.alias("passed"), reason.alias("reason"))


def structural_check(text) -> Column:
    """Blank, shorter than 20, longer than 1000 code points."""
    t = _c(text)
    n = X.n_chars(t)
    return (
        F.when(X.is_blank(t), _result(F.lit(False), F.lit(S.EMPTY_REASON)))
        .when(n < S.MIN_LENGTH, _result(F.lit(False), F.concat(F.lit("Recommendation too short ("), n.cast("string"), F.lit(" chars)."))))
        .when(n > S.MAX_LENGTH, _result(F.lit(False), F.concat(F.lit("Recommendation too long ("), n.cast("string"), F.lit(" chars)."))))
        .otherwise(_result(F.lit(True), F.lit(S.STRUCTURAL_OK)))
    )


def _py_list(arr: Column) -> Column:
    """Render a string array like a Python list repr: ['$5', '$7']."""
    return F.concat(F.lit("["), F.array_join(F.transform(arr, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))


# facts of a context, by the column that holds them when they are extracted beforehand
CONTEXT_AMOUNTS = "context_amounts"
CONTEXT_PERCENTAGES = "context_percentages"
CONTEXT_DATES = "context_dates"
CONTEXT_ACTIONS = "context_actions"
FACTS = {CONTEXT_AMOUNTS: X.dollar_amounts, CONTEXT_PERCENTAGES: X.percentages, CONTEXT_DATES: X.dates, CONTEXT_ACTIONS: X.prior_actions}


def with_context_facts(df: DataFrame, context_col: str = "context_text") -> DataFrame:
    """The amounts, percentages, dates and past actions of each context, extracted once per
    context row (e.g. once per customer before the join that repeats a context for every one
    of the customer's recommendations), for the numeric check and the built-in judge."""
    ctx = F.coalesce(F.col(context_col), F.lit(""))
    return df.withColumns({name: extract(ctx) for name, extract in FACTS.items()})


def _fact(df: DataFrame, name: str, context) -> Column:
    return F.col(name) if name in df.columns else FACTS[name](F.coalesce(_c(context), F.lit("")))


def numeric_check(text, context, context_amounts: Column | None = None) -> Column:
    """Every dollar amount claimed must occur in the context."""
    claimed = X.dollar_amounts(_c(text))
    ctx_amounts = context_amounts if context_amounts is not None else FACTS[CONTEXT_AMOUNTS](F.coalesce(_c(context), F.lit("")))
    missing = F.array_sort(F.array_except(claimed, ctx_amounts))
    return (
        F.when(F.size(claimed) == 0, _result(F.lit(True), F.lit(S.NO_AMOUNTS_REASON)))
        .when(
            F.size(missing) > 0,
            _result(F.lit(False), F.concat(F.lit("Recommendation mentions amount(s) not found in context: "), _py_list(missing))),
        )
        .otherwise(_result(F.lit(True), F.lit(S.AMOUNTS_OK_REASON)))
    )


def default_verdict(df: DataFrame, text_col: str = "recommendation_text", context_col: str = "context_text") -> Column:
    """J9 offline judge over the claims of a text, each held against the facts of its context:

    (a) dates, dollar amounts and past actions that the context does not state, and quoted words
    that it does not contain; (b) percentages that it does not mention.  UNGROUNDED with the first
    rule broken and all its claims, else GROUNDED."""
    text, context = F.col(text_col), F.coalesce(F.col(context_col), F.lit(""))
    new = lambda name: F.array_except(FACTS[name](text), _fact(df, name, context_col))
    unsaid = F.filter(X.quotations(text), lambda quote: ~F.contains(context, quote))
    facts = F.array_sort(F.array_distinct(F.concat(new(CONTEXT_DATES), new(CONTEXT_AMOUNTS), new(CONTEXT_ACTIONS), unsaid)))
    concessions = new(CONTEXT_PERCENTAGES)
    return (
        F.when(F.size(facts) > 0, F.concat(F.lit("UNGROUNDED\nStates facts not in the context: "), F.array_join(facts, ", "), F.lit(".")))
        .when(F.size(concessions) > 0, F.concat(F.lit("UNGROUNDED\nProposes a concession not in the context: "), F.array_join(concessions, ", "), F.lit(".")))
        .otherwise(F.lit("GROUNDED\nEvery stated fact and amount appears in the context."))
    )


def judge_check(verdict) -> Column:
    """Pass iff the verdict's first line starts with GROUNDED; reason = stripped verdict.
    An empty verdict is a failure (the original raised)."""
    v = _c(verdict)
    reason = F.when(X.is_blank(v), F.lit("Judge returned an empty verdict.")).otherwise(X.strip(v))
    return _result(X.verdict_passed(v), reason)


def apply_judge(df: DataFrame, judge_fn: Callable | None = None, text_col: str = "recommendation_text", context_col: str = "context_text") -> DataFrame:
    """Add ``verdict``: the default rules, or ``judge_fn(rules: str, user_prompts: pandas.Series) ->
    Series`` under ``mapInPandas``."""
    if judge_fn is None:
        return df.withColumn("verdict", default_verdict(df, text_col, context_col))
    with_prompt = df.withColumn(
        "_judge_prompt", F.concat(F.lit(JUDGE_USER_HEAD), F.col(context_col), F.lit(JUDGE_USER_MID), F.col(text_col))
    )
    schema = T.StructType(with_prompt.schema.fields + [T.StructField("verdict", T.StringType(), True)])

    def run(batches):
        for pdf in batches:
            pdf["verdict"] = list(judge_fn(JUDGE_RULES, pdf["_judge_prompt"]))
            yield pdf

    return with_prompt.mapInPandas(run, schema).drop("_judge_prompt")


def guardrail_chain(
    df: DataFrame, text_col: str = "recommendation_text", context_col: str = "context_text", judge_fn: Callable | None = None
) -> DataFrame:
    """Structural -> numeric -> judge, first failure wins.

    With the built-in judge rule everything is one projection (one pass, codegen).  With
    an external ``judge_fn`` the cheap checks are written to the shared folder first and
    the judge runs only on the rows still passing (an explicit ``where``), so a paid judge
    is never called for rows the cheap checks already rejected, and a retried task never
    re-runs the cheap part's upstream."""
    x = df.withColumn("_s", structural_check(text_col)).withColumn(
        "_n", numeric_check(text_col, context_col, _fact(df, CONTEXT_AMOUNTS, context_col))
    )
    cheap_ok = F.col("_s.passed") & F.col("_n.passed")
    if judge_fn is None:
        verdict = default_verdict(df, text_col, context_col)
        judged = x.withColumn("verdict", F.when(cheap_ok, verdict)).withColumn(
            "_j", judge_check("verdict")
        )
        out = judged.withColumn(
            "guardrail",
            F.when(~F.col("_s.passed"), F.col("_s"))
            .when(~F.col("_n.passed"), F.col("_n"))
            .when(~F.col("_j.passed"), F.col("_j"))
            .otherwise(_result(F.lit(True), F.lit(S.ALL_PASSED_REASON))),
        ).drop("_j")
    else:
        spark = df.sparkSession
        path = work_dir(spark, "guardrail-cheap")
        x.write.parquet(path)
        x = spark.read.parquet(path)
        failed = x.where(~cheap_ok).withColumn(
            "guardrail", F.when(~F.col("_s.passed"), F.col("_s")).otherwise(F.col("_n"))
        ).withColumn("verdict", F.lit(None).cast("string"))
        judged = apply_judge(x.where(cheap_ok), judge_fn, text_col, context_col).withColumn("_j", judge_check("verdict"))
        judged = judged.withColumn(
            "guardrail", F.when(F.col("_j.passed"), _result(F.lit(True), F.lit(S.ALL_PASSED_REASON))).otherwise(F.col("_j"))
        ).drop("_j")
        out = failed.unionByName(judged)
    return out.drop("_s", "_n").withColumn("passed_guardrails", F.col("guardrail.passed")).withColumn(
        "guardrail_reason", F.col("guardrail.reason")
    ).drop("guardrail")


def run_attempts(
    spark: SparkSession,
    base: DataFrame,
    key: str = "prediction_id",
    max_attempts: int = S.MAX_ATTEMPTS,
    generate_fn: Callable | None = None,
    judge_fn: Callable | None = None,
    materialize: bool = True,
) -> DataFrame:
    """Generate + guardrail for the rows not yet passed, up to ``max_attempts`` rounds
    (a short driver loop over whole frames, not over rows).  Each round is written to the
    shared folder before the next round reads it when ``materialize`` (always when an
    external function is involved).  Returns all attempts with ``attempt``."""
    must_write = materialize or generate_fn is not None or judge_fn is not None
    pending = base
    rounds = []
    for attempt in range(1, max_attempts + 1):
        gen = generate(pending, attempt, generate_fn)
        checked = guardrail_chain(gen, judge_fn=judge_fn).withColumn("attempt", F.lit(attempt))
        if must_write:
            path = work_dir(spark, f"attempt{attempt}")
            checked.write.mode("overwrite").parquet(path)
            checked = spark.read.parquet(path)
        rounds.append(checked)
        if attempt < max_attempts:
            pending = checked.where(~F.col("passed_guardrails")).select(*base.columns)
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out


def final_attempt(attempts: DataFrame, key: str = "prediction_id", max_attempts: int = S.MAX_ATTEMPTS) -> DataFrame:
    """E4 + reason prefix ``(attempt i/n)``: first passing attempt, else the last one."""
    picked = first_pass_else_last(attempts, key, "attempt", "passed_guardrails")
    return picked.withColumn(
        "guardrail_reason",
        F.concat(F.lit("(attempt "), F.col("attempt").cast("string"), F.lit(f"/{max_attempts}) "), F.col("guardrail_reason")),
    )


def retry_queue(log: DataFrame, key: str = "prediction_id", id_col: str = "recommendation_id") -> DataFrame:
    """The keys whose latest log row did not pass, with the number of their next attempt."""
    latest = latest_per_key(log.select(key, id_col, "passed_guardrails", "attempt"), key, id_col)
    return latest.where(~F.col("passed_guardrails")).select(key, (F.col("attempt") + 1).alias("attempt"))


def regenerate(spark: SparkSession, log: DataFrame, base: DataFrame, key: str = "prediction_id", generate_fn: Callable | None = None, judge_fn: Callable | None = None) -> DataFrame:
    """The next attempt of every queued key, generated and checked anew; ``base`` holds a
    context row per key.  Passed keys are not generated again.  The queue is stored first, so
    the result may be appended to the log it came from."""
    queue = stored(retry_queue(log, key), "retry-queue")
    pending = base.join(queue, key)
    checked = guardrail_chain(generate(pending, "attempt", generate_fn), judge_fn=judge_fn)
    return stored(checked, "regenerated")


def answer_requests(spark: SparkSession, requests: DataFrame, predictions: DataFrame, candidates: DataFrame, generate_fn: Callable | None = None, judge_fn: Callable | None = None) -> DataFrame:
    """One row per request (request_id, unique; prediction_id; query; top_k).

    A request is ``rejected`` (top_k outside 1..20), ``not_found`` (no such prediction) or
    ``answered``: its own query against the history of the prediction's customer alone
    (``candidates``: interactions with their ``vector``), its own number of hits, then context,
    generation and guardrails with retry.  Missing queries and numbers take the defaults."""
    checked = stored(validate_requests(requests.select("request_id", "prediction_id", "query", "top_k")), "requests")
    known = predictions.select("prediction_id", "customer_id")
    looked = lookup(checked.where("status = 'valid'"), known, "prediction_id", "prediction_id")
    found = stored(looked.where("status = 'found'").drop("status").withColumn("query_vector", V.term_vector(F.col("query"))), "asked")
    asked = found.select("request_id", "customer_id", "top_k", "query_vector")
    hits = scoped_search(candidates, asked, lambda: V.sparse_cosine("vector", "query_vector"), k_max=S.TOP_K_MAX)
    items = context_items(hits.drop("vector", "query_vector", "customer_id"), "request_id")
    base = with_context_facts(with_context_text(found.drop("query_vector").join(items, "request_id", "left")))
    final = final_attempt(run_attempts(spark, base, "request_id", generate_fn=generate_fn, judge_fn=judge_fn), "request_id")
    answered = final.select("request_id", "prediction_id", "customer_id", "top_k", F.lit("answered").alias("status"), "recommendation_text", "passed_guardrails", "guardrail_reason", F.col("attempt").cast("int").alias("attempt"))
    others = checked.where("status = 'rejected'").unionByName(looked.where("status = 'not_found'").drop("customer_id"))
    return answered.unionByName(others.select("request_id", "prediction_id", "top_k", "status"), allowMissingColumns=True)
