"""Guardrail rules, short-circuit order, retries and attempt choice."""

from pyspark.sql import functions as F

from retentia import schemas as S
from retentia.operators import recommend as RC
from retentia.operators.ranking import first_pass_else_last


def _check(spark, rows, fn):
    df = spark.createDataFrame(rows, "t string, c string")
    return [tuple(r[0]) for r in df.select(fn).collect()]


def test_structural_limits(spark):
    rows = [("", ""), ("\t\n", ""), ("x" * 19, ""), ("x" * 20, ""), ("x" * 1000, ""), ("x" * 1001, "")]
    got = _check(spark, rows, RC.structural_check("t"))
    assert got[0] == (False, "Recommendation is empty.")
    assert got[1] == (False, "Recommendation is empty.")
    assert got[2] == (False, "Recommendation too short (19 chars).")
    assert got[3][0] and got[4][0]
    assert got[5] == (False, "Recommendation too long (1001 chars).")


def test_numeric_grounding(spark):
    rows = [
        ("Offer $15 back", "charged $15.00"),
        ("Offer $15 back", "charged $15 twice"),
        ("Call them", "charged $15"),
        ("Refund $7 and $5", "x"),
    ]
    got = _check(spark, rows, RC.numeric_check("t", "c"))
    assert got[0] == (False, "Recommendation mentions amount(s) not found in context: ['$15']")
    assert got[1] == (True, S.AMOUNTS_OK_REASON)
    assert got[2] == (True, S.NO_AMOUNTS_REASON)
    assert got[3] == (False, "Recommendation mentions amount(s) not found in context: ['$5', '$7']")


def test_judge_parse_and_empty(spark):
    df = spark.createDataFrame([("GROUNDED\nfine",), ("  ungrounded\nno",), ("",)], "v string")
    got = [tuple(r[0]) for r in df.select(RC.judge_check("v")).collect()]
    assert got[0] == (True, "GROUNDED\nfine")
    assert got[1] == (False, "ungrounded\nno")
    assert got[2][0] is False


def test_chain_first_failure_wins_and_judge_only_on_survivors(spark):
    calls = []

    def judge(rules, prompts):
        import pandas as pd

        assert "(a)" in rules and "(b)" in rules
        return pd.Series(["GROUNDED\nok"] * len(prompts))

    rows = [(1, "short", "ctx"), (2, "Offer a credit of $99 to this customer now.", "ctx"), (3, "Have a manager call this customer back.", "ctx")]
    df = spark.createDataFrame(rows, "k int, recommendation_text string, context_text string")
    out = {r["k"]: r for r in RC.guardrail_chain(df, judge_fn=judge).collect()}
    assert out[1]["guardrail_reason"].startswith("Recommendation too short")
    assert out[2]["guardrail_reason"].startswith("Recommendation mentions amount")
    assert out[3]["passed_guardrails"] and out[3]["guardrail_reason"] == S.ALL_PASSED_REASON
    assert out[1]["verdict"] is None and out[2]["verdict"] is None  # judge never saw them
    del calls


def test_default_judge_rejects_new_percentages(spark):
    rows = [(1, "Offer a 10% discount and call them back.", "no numbers"), (2, "Offer a 10% discount and call them back.", "had 10% off")]
    df = spark.createDataFrame(rows, "k int, recommendation_text string, context_text string")
    out = {r["k"]: r["passed_guardrails"] for r in RC.guardrail_chain(df).collect()}
    assert out == {1: False, 2: True}


def test_first_pass_else_last(spark):
    rows = [(1, 1, True), (1, 2, True), (2, 1, False), (2, 2, True), (3, 1, False), (3, 2, False)]
    df = spark.createDataFrame(rows, "prediction_id int, attempt int, passed boolean")
    got = sorted(tuple(r) for r in first_pass_else_last(df, "prediction_id").select("prediction_id", "attempt", "passed").collect())
    assert got == [(1, 1, True), (2, 2, True), (3, 2, False)]


def test_retry_rounds_and_reason_prefix(spark):
    base = spark.createDataFrame(
        [(3, 10, "1. [error, negative] error charge of $3"), (4, 11, "(none)")],
        "prediction_id bigint, customer_id bigint, context_text string",
    ).withColumn("context_items", F.array(F.struct(F.lit("error").alias("interaction_type"))))
    attempts = RC.run_attempts(spark, base)
    final = {r["prediction_id"]: r for r in RC.final_attempt(attempts).collect()}
    # prediction 3: "$3" is grounded but "10%" is not -> attempt 2 passes
    assert final[3]["attempt"] == 2 and final[3]["passed_guardrails"]
    assert final[3]["guardrail_reason"] == f"(attempt 2/{S.MAX_ATTEMPTS}) {S.ALL_PASSED_REASON}"
    # prediction 4: "$4" is not in context -> attempt 2 passes
    assert final[4]["attempt"] == 2
    assert attempts.where("prediction_id = 3").count() == 2


def test_generate_fn_hook_runs_in_arrow_batches(spark):
    import pandas as pd

    def gen(system, prompts, attempt):
        return pd.Series([f"Attempt {attempt}: have a manager call the customer."] * len(prompts))

    df = RC.build_prompts(spark.createDataFrame([(1, "ctx")], "prediction_id int, context_text string"))
    out = RC.generate(df, 1, generate_fn=gen).first()
    assert out["recommendation_text"].startswith("Attempt 1")


def test_retry_with_external_generator_and_judge(spark):
    import pandas as pd

    def gen(system, prompts, attempt):
        text = "Offer a credit of $999 now." if attempt == 1 else "Have a manager call the customer back."
        return pd.Series([text] * len(prompts))

    def judge(rules, prompts):
        return pd.Series(["GROUNDED\nfine"] * len(prompts))

    base = spark.createDataFrame([(1, 5, "1. [error, negative] error charge of $3")], "prediction_id bigint, customer_id bigint, context_text string")
    attempts = RC.run_attempts(spark, base, generate_fn=gen, judge_fn=judge)
    rows = {r["attempt"]: r for r in attempts.collect()}
    assert not rows[1]["passed_guardrails"] and rows[1]["guardrail_reason"].startswith("Recommendation mentions amount")
    assert rows[2]["passed_guardrails"]
    final = RC.final_attempt(attempts).first()
    assert final["attempt"] == 2 and final["guardrail_reason"] == f"(attempt 2/{S.MAX_ATTEMPTS}) {S.ALL_PASSED_REASON}"


def test_judge_holds_every_kind_of_claim_against_the_context(spark):
    ctx = 'charged $15 on 2024-02-01, already refunded $15; the customer said "enough" and got 10% off'
    rows = [
        ("Call about the $15 of 2024-02-01, already refunded; \"enough\" is \"enough\", 10% off.", "GROUNDED"),
        ("Call about 2024-02-02.", "2024-02-02"),
        ("Call about $16.", "$16"),
        ("We Already Escalated it.", "already escalated"),
        ('They said "never again".', "never again"),
        ("Offer 20% off.", "20%"),
        ("Call on 2024-02-03, $3, \"x\", 30% off.", "$3, 2024-02-03, x"),
        ("", "GROUNDED"),
        (None, "GROUNDED"),
    ]
    df = spark.createDataFrame([(i, t, ctx) for i, (t, _) in enumerate(rows)], "k int, recommendation_text string, context_text string")
    for frame in (df, RC.with_context_facts(df)):
        got = {r["k"]: r["verdict"] for r in RC.apply_judge(frame).collect()}
        for i, (_, want) in enumerate(rows):
            assert got[i].startswith("GROUNDED") if want == "GROUNDED" else got[i].endswith(f": {want}."), (i, got[i])
    empty = spark.createDataFrame([("Offer 5% off since 2024-01-01.", None)], "recommendation_text string, context_text string")
    assert RC.apply_judge(empty).first()["verdict"] == "UNGROUNDED\nStates facts not in the context: 2024-01-01."


def test_regenerate_takes_only_the_latest_failures_and_counts_on(spark):
    import pandas as pd

    log = spark.createDataFrame(
        [(1, 1, False, 1), (2, 2, True, 1), (3, 3, False, 1), (4, 3, False, 2), (5, 4, False, 1), (6, 4, True, 2)],
        "recommendation_id bigint, prediction_id bigint, passed_guardrails boolean, attempt int",
    )
    base = spark.createDataFrame([(i, 7, "1. [error, negative] error charge of $3") for i in range(1, 6)], "prediction_id bigint, customer_id bigint, context_text string")
    base = base.withColumn("context_items", F.array(F.struct(F.lit("error").alias("interaction_type"))))
    assert {(r["prediction_id"], r["attempt"]) for r in RC.retry_queue(log).collect()} == {(1, 2), (3, 3)}
    asked = []

    def gen(system, prompts, attempt):
        return pd.Series([f"Attempt {attempt}: have a manager call them."] * len(prompts))

    for fn in (None, gen):
        got = {r["prediction_id"]: r for r in RC.regenerate(spark, log, base, generate_fn=fn).collect()}
        assert {k: r["attempt"] for k, r in got.items()} == {1: 2, 3: 3} and all(r["passed_guardrails"] for r in got.values())
        asked.append(got[3]["recommendation_text"])
    assert asked[1].startswith("Attempt 3") and "specialist" in asked[0]


def test_requests_get_their_own_query_number_and_status(spark):
    from retentia.operators import retrieve as R

    history = [(i, 1 + i % 2, f"{w} charge of ${i}", w) for i, w in enumerate(["error", "view", "outage", "click"] * 8)]
    cand = R.embed_text(spark.createDataFrame(history, "interaction_id bigint, customer_id bigint, text string, interaction_type string").withColumn("sentiment", F.lit("negative")), "text", "vector")
    preds = spark.createDataFrame([(10, 1), (11, 2), (12, 3)], "prediction_id bigint, customer_id bigint")
    reqs = [(1, 10, "an outage!", 1), (2, 10, "ERROR", 3), (3, 11, None, None), (4, 11, "click", 21), (5, 11, "click", 0), (6, 99, "view", 5), (7, None, "view", 5), (8, 12, "view", 20), (9, 10, "...", 20)]
    got = {r["request_id"]: r for r in RC.answer_requests(spark, spark.createDataFrame(reqs, "request_id bigint, prediction_id bigint, query string, top_k int"), preds, cand).collect()}
    assert {k: r["status"] for k, r in got.items()} == {1: "answered", 2: "answered", 3: "answered", 4: "rejected", 5: "rejected", 6: "not_found", 7: "not_found", 8: "answered", 9: "answered"}
    assert {k: r["customer_id"] for k, r in got.items()} == {1: 1, 2: 1, 3: 2, 4: None, 5: None, 6: None, 7: None, 8: 3, 9: 1}
    # attempt 2 names the type of the first hit, so the query decides the text
    assert "starting with the outage" in got[1]["recommendation_text"] and "starting with the error" in got[2]["recommendation_text"]
    assert "starting with the general" in got[8]["recommendation_text"]  # no history
    assert got[6]["recommendation_text"] is None and got[6]["passed_guardrails"] is None
    assert RC.answer_requests(spark, spark.createDataFrame([], "request_id bigint, prediction_id bigint, query string, top_k int"), preds, cand).count() == 0
