"""B4-B15 edge rows: right-closed bins, clip/round order, expansion, request defaults."""

from pyspark.sql import functions as F

from retentia import schemas as S
from retentia.functions import numeric as N
from retentia.operators import derive as D


def _cut(spark, values, edges, labels):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")
    return [r[0] for r in df.select(N.cut("x", edges, labels)).collect()]


def test_tenure_bins_right_closed(spark):
    got = _cut(spark, [-1, 0, 6, 7, 72, 73, None], S.TENURE_EDGES, S.TENURE_LABELS)
    assert got == [None, "0-6mo", "0-6mo", "7-12mo", "49-72mo", None, None]


def test_clv_bins(spark):
    got = _cut(spark, [0, 500, 500.01, 5000, 1e9], S.CLV_EDGES, S.CLV_LABELS)
    assert got == ["Low", "Low", "Medium", "High", "VIP"]


def test_ticket_bins_differ_from_left_closed(spark):
    got = _cut(spark, [0, 1, 3, 6, 7, 101], S.TICKET_EDGES, S.TICKET_LABELS)
    assert got == ["0", "1", "2-3", "4-6", "7+", None]


def test_bin_index_orders_bins(spark):
    df = spark.createDataFrame([(v,) for v in [0, 1, 2, 5, 50]], "x int")
    got = [r[0] for r in df.select(N.cut_index("x", S.TICKET_EDGES)).collect()]
    assert got == [0, 1, 2, 3, 4]


def test_round_half_even(spark):
    df = spark.createDataFrame([(0.125,), (0.135,), (2.5,)], "x double")
    got = [r[0] for r in df.select(N.round_half_even("x", 2)).collect()]
    assert got == [0.12, 0.14, 2.5]


def test_clip_then_round_vs_round_then_clip(spark):
    df = spark.createDataFrame([(1, 0.0, 10, 3.0, 50.0)], "customer_id bigint, total_charges double, num_support_tickets int, "
                               "tenure_months double, monthly_charges double")
    r = D.clip_round(df).first()
    assert r["monthly_clipped"] == 18.0
    assert r["satisfaction_clipped"] == 1.0
    assert r["total_clipped"] == 100.0


def test_expand_tickets_skips_zero(spark):
    df = spark.createDataFrame([(1, 0), (2, 3), (3, 1)], "customer_id bigint, num_support_tickets int")
    got = sorted(tuple(r) for r in D.expand_tickets(df).collect())
    assert got == [(2, 1), (2, 2), (2, 3), (3, 1)]


def test_scorecard_sigmoid_label(spark):
    df = spark.createDataFrame(
        [(0, "Month-to-month", 100.0, 3, 2.0, "Electronic check", "No", "No")],
        "tenure_months int, contract_type string, monthly_charges double, num_support_tickets int, "
        "avg_satisfaction_score double, payment_method string, tech_support string, online_security string",
    )
    r = D.score_with_scorecard(df, threshold=0.5).first()
    s = 0.90 + 0.020 * 100 + 0.35 * 3 - 0.55 * 2 + 0.45 - 0.3
    assert abs(r["churn_score"] - s) < 1e-12
    import math

    assert abs(r["churn_probability"] - 1 / (1 + math.exp(-s))) < 1e-12
    assert r["predicted_label"] == 1


def test_validate_requests_defaults(spark):
    df = spark.createDataFrame([(1, None, None), (2, 0, "q"), (3, 20, "q"), (4, 21, "q")], "request_id int, top_k int, query string")
    rows = {r["request_id"]: r for r in D.validate_requests(df).collect()}
    assert rows[1]["top_k"] == 5 and rows[1]["query"] == S.DEFAULT_QUERY and rows[1]["status"] == "valid"
    assert rows[2]["status"] == "rejected"
    assert rows[3]["status"] == "valid"
    assert rows[4]["status"] == "rejected"


def test_signup_date_roundtrip(spark):
    df = spark.createDataFrame([(1, t) for t in range(0, 73)], "customer_id bigint, tenure_months int")
    out = D.signup_date_from_tenure(df, "2001-08-01")
    # days = int(t * 30.4) truncates, so the inverse floor(days / 30.4) is t or t - 1,
    # and exactly t when t * 30.4 is whole (t divisible by 5)
    diff = F.col("tenure_months") - F.col("tenure_back")
    assert out.where(~diff.isin(0, 1)).count() == 0
    assert out.where((F.col("tenure_months") % 5 == 0) & (diff != 0)).count() == 0
