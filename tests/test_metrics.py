"""Metrics against brute force on small frames, including ties,
one-class data and an unreachable precision target."""

import random

import numpy as np
import pytest

from retentia.operators import metrics as M
from retentia.operators.ranking import dense_ids, running_totals


def _frame(spark, ys, ps):
    return spark.createDataFrame([(int(y), float(p)) for y, p in zip(ys, ps)], "y int, y_proba double")


def brute_curve(ys, ps):
    ys, ps = np.asarray(ys), np.asarray(ps)
    out = []
    for t in sorted(set(ps), reverse=True):
        pred = ps >= t
        tp = int((pred & (ys == 1)).sum())
        fp = int((pred & (ys == 0)).sum())
        out.append((t, tp, fp, tp / (tp + fp), tp / max(1, (ys == 1).sum()) if (ys == 1).sum() else 1.0))
    return out


def brute_ap(ys, ps):
    curve = brute_curve(ys, ps)
    ap, prev_r = 0.0, 0.0
    for _, _, _, p, r in curve:
        ap += (r - prev_r) * p
        prev_r = r
    return ap


def brute_auc(ys, ps):
    pos = [p for y, p in zip(ys, ps) if y == 1]
    neg = [p for y, p in zip(ys, ps) if y == 0]
    s = sum((1.0 if a > b else 0.5 if a == b else 0.0) for a in pos for b in neg)
    return s / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def data():
    rng = random.Random(7)
    ys = [rng.random() < 0.3 for _ in range(400)]
    ps = [round(rng.random() * 0.6 + (0.3 if y else 0.0), 2) for y in ys]  # many ties
    return [int(y) for y in ys], ps


def test_pr_curve_matches_brute_force(spark, data):
    ys, ps = data
    got = sorted((r["score"], r["tp"], r["fp"], r["precision"], r["recall"]) for r in M.pr_curve(_frame(spark, ys, ps), n_buckets=7).collect())
    want = sorted(brute_curve(ys, ps))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[0] == w[0] and g[1] == w[1] and g[2] == w[2]
        assert abs(g[3] - w[3]) < 1e-12 and abs(g[4] - w[4]) < 1e-12


def test_recall_non_increasing_with_threshold(spark, data):
    ys, ps = data
    rows = sorted((r["score"], r["recall"]) for r in M.pr_curve(_frame(spark, ys, ps)).collect())
    recalls = [r for _, r in rows]
    assert all(a >= b for a, b in zip(recalls, recalls[1:]))


def test_auc_and_ap(spark, data):
    ys, ps = data
    curve = M.pr_curve(_frame(spark, ys, ps))
    assert abs(M.roc_auc(curve).first()[0] - brute_auc(ys, ps)) < 1e-12
    assert abs(M.average_precision(curve).first()[0] - brute_ap(ys, ps)) < 1e-12


def test_all_scores_tied(spark):
    ys, ps = [1, 0, 1, 0], [0.5] * 4
    curve = M.pr_curve(_frame(spark, ys, ps))
    assert curve.count() == 1
    assert M.roc_auc(curve).first()[0] == 0.5


def test_one_class_only(spark):
    curve = M.pr_curve(_frame(spark, [0, 0, 0], [0.1, 0.2, 0.3]))
    assert M.roc_auc(curve).first()[0] is None
    prf = M.precision_recall_f1(_frame(spark, [0, 0, 0], [0.1, 0.2, 0.3]), 0.5).first()
    assert (prf["precision"], prf["recall"], prf["f1"]) == (0.0, 0.0, 0.0)


def test_tuned_threshold_tie_and_fallback(spark):
    # scores 0.9 (pos), 0.8 (neg), 0.7 (pos), 0.6 (neg)
    ys, ps = [1, 0, 1, 0], [0.9, 0.8, 0.7, 0.6]
    curve = M.pr_curve(_frame(spark, ys, ps))
    t = M.tuned_threshold(curve, 0.6).first()
    # precision >= 0.6 at 0.9 (1.0, r .5) and 0.7 (.667, r 1.0): max recall -> 0.7
    assert t["threshold"] == 0.7 and t["met_target"]
    f = M.tuned_threshold(curve, 1.01).first()
    assert f["threshold"] == 0.9 and not f["met_target"]
    # tie on recall: 0.7 and 0.6 both have recall 1 -> the lowest score wins
    t2 = M.tuned_threshold(curve, 0.5).first()
    assert t2["threshold"] == 0.6


def test_confusion_sums_to_n(spark, data):
    ys, ps = data
    cm = M.confusion(_frame(spark, ys, ps), 0.5).first()
    assert cm["tn"] + cm["fp"] + cm["fn"] + cm["tp"] == len(ys)


def test_class_ratio(spark):
    r = M.class_ratio(_frame(spark, [1, 0, 0, 0], [0.1] * 4)).first()
    assert r["scale_pos_weight"] == 3.0


def test_running_totals_grouped(spark):
    rng = random.Random(3)
    rows = [(g, i, rng.randint(0, 9)) for g in ("a", "b") for i in rng.sample(range(10_000), 300)]
    df = spark.createDataFrame(rows, "g string, k int, v int")
    got = {(r["g"], r["k"]): r["cum_v"] for r in running_totals(df, "k", ["v"], groups=["g"], n_buckets=5).collect()}
    for g in ("a", "b"):
        acc = 0
        for _, k, v in sorted(r for r in rows if r[0] == g):
            acc += v
            assert got[(g, k)] == acc


def test_dense_ids_are_dense_and_ordered(spark):
    keys = random.Random(1).sample(range(1, 10**9), 500)
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    got = sorted((r["k"], r["id"]) for r in dense_ids(df, ["k"], "id", start=101, n_buckets=9).collect())
    assert [i for _, i in got] == list(range(101, 601))


def test_pr_curve_plan_has_no_single_partition_exchange(spark, data):
    ys, ps = data
    plan = M.pr_curve(_frame(spark, ys, ps))._jdf.queryExecution().executedPlan().toString().splitlines()
    # the only single-partition exchange carries the per-bucket sums (n_buckets rows)
    single = [i for i, line in enumerate(plan) if "SinglePartition" in line]
    assert len(single) == 1
    assert "keys=[_bucket" in plan[single[0] + 1]


def test_rows_without_score_are_left_out(spark):
    df = spark.createDataFrame([(1, 0.9), (0, None), (1, 0.5), (0, 0.1), (None, 0.3)], "y int, y_proba double")
    rows = sorted((r["score"], r["tp"], r["fp"], r["total_pos"], r["total_neg"]) for r in M.pr_curve(df).collect())
    assert rows == [(0.1, 2, 1, 2, 1), (0.5, 2, 0, 2, 1), (0.9, 1, 0, 2, 1)]


def test_splitters_come_from_a_bounded_sample(spark):
    """Ranges of about equal size from a draw that depends on the rows alone, no sketch of each task."""
    from retentia.operators import ranking as RK

    df = spark.range(60000).selectExpr("id", "exp(id % 977 / 100.0) * id AS v")
    edges = RK.bucket_edges(df, "v", 16)
    assert edges == RK.bucket_edges(df.repartition(7, "id"), "v", 16)
    sizes = [r["count"] for r in RK.bucketize(df, "v", edges).groupBy("_bucket").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2.5 * 60000 / 16
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (1.0,), (1.0,)], "v double")
    assert RK.bucket_edges(odd, "v", 4) == [1.0] and RK.bucket_edges(odd.limit(0), "v", 4) == [] == RK.bucket_edges(df, "v", 1)
    ops = open(RK.__file__).read() + open(M.__file__).read()
    assert "percentile_approx" not in ops
