"""I6-I9, A12 as registered on the smallest scale against brute-force recomputation from the
stored model and split; the registry across sessions and data; the search's resumption."""

import shutil
import threading

import numpy as np
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from retentia import schemas as S
from retentia.operators import model as ML
from retentia.plans import q_model as QM
from retentia.plans.registry import EXITS
from retentia.sources import io as IO
from retentia.sources import proxies as P
from retentia.sources.model_store import ModelStore, files_digest

from conftest import SF001


def _brute(ys, ps, t):
    ys, ps = np.asarray(ys), np.asarray(ps)
    pred = ps >= t
    tp, fp = int((pred & (ys == 1)).sum()), int((pred & (ys == 0)).sum())
    fn, tn = int((~pred & (ys == 1)).sum()), int((~pred & (ys == 0)).sum())
    return tn, fp, fn, tp


def test_registered_model_queries(spark):
    row = QM.train_gbt(spark, SF001).first()
    assert row["n_trees"] == ML.BASE_PARAMS["maxIter"] == 100 and row["n_features"] > 5
    path = QM.released(spark, SF001)
    model, stored = IO.load_registry(path, spark)
    meta = QM.model_metadata(spark, SF001).first().asDict()
    assert sorted(meta) == sorted([
        "feature_columns", "categorical_columns", "numeric_columns", "encoded_feature_names", "decision_threshold", "model_version",
        "target_precision", "test_precision", "test_recall", "test_roc_auc", "scale_pos_weight",
    ])
    assert meta["model_version"].startswith(row["model_version"])
    # the report's confusion counts equal a brute-force count on the stored model's test scores
    test = spark.read.parquet(f"{QM.fitted(spark, SF001)}/split").where("is_test")
    scored = ML.positive_proba(model.transform(test)).select(S.LABEL_COLUMN, "y_proba").collect()
    ys, ps = [r[0] for r in scored], [r[1] for r in scored]
    report = QM.evaluation_report(spark, SF001).collect()
    assert [r["threshold_kind"] for r in report] == ["default", "tuned"] and {r["tuned_on"] for r in report} == {"out_of_fold"}
    for m in report:
        assert (m["tn"], m["fp"], m["fn"], m["tp"]) == _brute(ys, ps, m["threshold"])
    # scoring: every customer once, label = probability >= tuned threshold, the registry's version
    s = QM.score_all(spark, SF001)
    assert s.count() == s.select("prediction_id").distinct().count() == P.customers_v(spark, SF001).count()
    thr = float(meta["decision_threshold"])
    assert s.where((F.col("churn_probability") >= thr).cast("int") != F.col("predicted_label")).count() == 0
    assert {r[0] for r in QM.score_customers(spark, SF001).select("model_version").distinct().collect()} == {meta["model_version"]}
    # nothing is fitted again while data and parameters stay
    assert QM.released(spark, SF001) == path and len(ModelStore(spark).versions(path.split("/")[-2])) == 1


def test_model_store(spark, tmp_path):
    store = ModelStore(spark, f"file:{tmp_path}/models")
    assert store.current("k") is None and store.versions("k") == []
    put = lambda folder, name: spark.range(1).selectExpr(f"'{name}' AS name").write.parquet(folder)
    first = store.publish("k", put)
    assert ModelStore(spark, f"file:{tmp_path}/models").current("k") == first  # another session reads the pointer
    with pytest.raises(InterruptedError):  # a publisher that dies leaves the old version in use
        store.publish("k", lambda folder, name: (put(folder, name), (_ for _ in ()).throw(InterruptedError)))
    assert store.current("k") == first and len(store.versions("k")) == 2
    second = store.publish("k", put)
    assert store.current("k") == second and spark.read.parquet(second).first()["name"].startswith("v000003-")
    assert store.current("other") is None
    shutil.rmtree(second.removeprefix("file:"))
    assert store.current("k") is None  # a pointer to nothing is no model


def test_changed_files_are_another_key(spark, tmp_path):
    shutil.copytree(SF001, tmp_path / "t", copy_function=shutil.copy)
    data = str(tmp_path / "t")
    orders = [f"{data}/orders.parquet", f"{data}/customer.parquet"]
    before, key = files_digest(spark, orders), QM._key(spark, data, **ML.BASE_PARAMS)
    assert files_digest(spark, orders[::-1]) == before and QM._key(spark, data, **ML.BASE_PARAMS) == key
    n = P.customers_v(spark, data).count()
    rows = pq.read_table(orders[0])
    pq.write_table(rows.filter(pc.less(rows["o_custkey"], 70)), orders[0])
    assert files_digest(spark, orders) != before and QM._key(spark, data, **ML.BASE_PARAMS) != key
    assert QM._key(spark, data, **{**ML.BASE_PARAMS, "maxIter": 7}) != QM._key(spark, data, **ML.BASE_PARAMS)
    assert P.customers_v(spark, data).count() < n  # the built table follows the files


def test_search_goes_on_where_it_stopped(spark, tmp_path):
    train, _ = QM._training(QM._split_table(spark, SF001))
    _, table = ML.encoded(train)
    draws = ML.sample_params(2, max_trees=2)
    results = f"file:{tmp_path}/results"
    whole = ML.param_search(table, draws, results)
    assert len(whole) == 2 and all(0.0 <= r[-2] <= 1.0 for r in whole)
    one = spark.read.json(f"{results}/draw1-fold2").first()
    shutil.rmtree(tmp_path / "results" / "draw0-fold1")
    again = ML.param_search(table, draws, results)
    assert [r[:-1] for r in again] == [r[:-1] for r in whole]
    assert spark.read.json(f"{results}/draw1-fold2").first() == one  # not fitted again
    # the score is that of a fit without the fold, on the fold
    fit = ML.gbt(**ML.map_params(draws[1])).fit(table.where("fold <> 2"))
    assert abs(ML.average_precision_of(fit.transform(table.where("fold = 2"))) - one["average_precision"]) < 1e-12


def test_search_is_whole_and_left_out_of_the_queries():
    """The exit runs 15 draws with their 200-400 trees."""
    from retentia.plans import catalog

    draws = ML.sample_params()
    assert len(draws) == ML.SEARCH_DRAWS == 15 and all(200 <= d["n_estimators"] <= 400 for d in draws)
    assert "param_search" not in catalog.queries() and EXITS["param_search"].build is QM.param_search


def test_slots_keep_the_order(spark):
    assert ML.in_slots(spark, [lambda i=i: spark.range(i).count() for i in range(9)], 3) == list(range(9))


class _SmallFit:
    """The learner with two small trees; ``before(table)`` is called as each fit starts."""

    params = {"maxIter": 2, "maxDepth": 2, "stepSize": 0.3}

    def __init__(self, monkeypatch, before):
        real = ML.gbt

        class Learner:
            def __init__(self, *a, **k):
                self.learner = real(*a, **k)

            def fit(self, table):
                before(table)
                return self.learner.fit(table)

        monkeypatch.setattr(ML, "gbt", Learner)


def test_fit_uses_every_core_in_even_shares(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ML, "ROWS_PER_TASK", 10, raising=False)
    seen = []
    small = _SmallFit(monkeypatch, lambda t: seen.append([r[1] for r in t.groupBy(F.spark_partition_id()).count().collect()]))
    path = QM.fitted(spark, SF001, small.params, ModelStore(spark, f"file:{tmp_path}/models"))
    n = spark.read.parquet(f"{path}/split").where("not is_test").count()
    assert sum(seen[0]) == n == spark.read.parquet(f"{path}/train").count()
    assert len(seen[0]) == min(spark.sparkContext.defaultParallelism, n // 10) > 1 and max(seen[0]) < 3 * n / len(seen[0])


def test_training_parts():
    assert [ML.training_parts(n, 12) for n in (0, 1, 19_999, 60_000, 240_000, 6_000_000, 6_000_001, 60_000_000)] == [1, 1, 1, 3, 12, 12, 24, 120]


def test_all_fits_run_beside_each_other(spark, tmp_path, monkeypatch):
    meet = threading.Barrier(1 + ML.SEARCH_FOLDS, timeout=120)
    small = _SmallFit(monkeypatch, lambda t: meet.wait())
    monkeypatch.setattr(QM, "ModelStore", lambda spark, root=f"file:{tmp_path}/models": ModelStore(spark, root))
    path = QM.released(spark, SF001, params=small.params)
    assert spark.read.parquet(f"{path}/report").count() == 2


def test_fold_models_do_not_depend_on_what_ran_beside_them(spark, tmp_path, monkeypatch):
    rows = []
    small = _SmallFit(monkeypatch, lambda t: rows.append(t.count()))
    store = ModelStore(spark, f"file:{tmp_path}/models")
    path, models = QM._fits(spark, SF001, small.params, store, without_folds=True)  # four fits
    again, later = QM._fits(spark, SF001, small.params, store, without_folds=True)  # the whole one is published
    assert path == again and [m.toDebugString.split("\n", 1)[1] for m in models] == [m.toDebugString.split("\n", 1)[1] for m in later]
    split = spark.read.parquet(f"{path}/split").where("not is_test")
    n = split.count()
    left = [n - split.where(f"fold = {i}").count() for i in range(ML.SEARCH_FOLDS)]
    assert sorted(rows) == sorted([n, *left, *left])


def test_fits_beside_each_other_share_the_cores(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ML, "ROWS_PER_TASK", 10)
    seen = []
    small = _SmallFit(monkeypatch, lambda t: seen.append((t.count(), t.rdd.getNumPartitions())))
    store = ModelStore(spark, f"file:{tmp_path}/models")
    path, models = QM._fits(spark, SF001, small.params, store, without_folds=True)
    split = spark.read.parquet(f"{path}/split").where("not is_test")
    n, cores = split.count(), spark.sparkContext.defaultParallelism
    left = [n - split.where(f"fold = {i}").count() for i in range(ML.SEARCH_FOLDS)]
    # every row in its fits; the whole fit on all cores, the others on their part of them
    assert sorted(seen) == sorted([(n, min(cores, n // 10)), *[(k, max(1, min(cores // ML.SEARCH_FOLDS, k // 10))) for k in left]])
    later = QM._fits(spark, SF001, small.params, store, without_folds=True)[1]
    assert [m.toDebugString.split("\n", 1)[1] for m in models] == [m.toDebugString.split("\n", 1)[1] for m in later]
    # the whole model is that of the query that fits it alone
    alone = QM.fitted(spark, SF001, small.params, ModelStore(spark, f"file:{tmp_path}/alone"))
    trees = [IO.load_registry(p, spark)[0].stages[-1].toDebugString.split("\n", 1)[1] for p in (path, alone)]
    assert trees[0] == trees[1]


def test_report_draws_each_curve_once(spark, tmp_path, monkeypatch):
    drawn, real = [], ML.M.pr_curve
    monkeypatch.setattr(ML.M, "pr_curve", lambda df, *a, **k: (drawn.append(df.count()), real(df, *a, **k))[1])
    small = _SmallFit(monkeypatch, lambda t: None)
    monkeypatch.setattr(QM, "ModelStore", lambda spark, root=f"file:{tmp_path}/models": ModelStore(spark, root))
    path = QM.released(spark, SF001, params=small.params)
    split = spark.read.parquet(f"{QM.fitted(spark, SF001, small.params)}/split")
    assert sorted(drawn) == sorted([split.where("is_test").count(), split.where("not is_test").count()])  # every row, once
    test = ML.positive_proba(IO.load_registry(path, spark)[0].transform(split.where("is_test")))
    for m in spark.read.parquet(f"{path}/report").collect():
        brute = ML.evaluation_rows(test, m["threshold"])
        assert {k: m[k] for k in brute} == brute
