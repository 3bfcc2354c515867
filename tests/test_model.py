"""Split, encoding, evaluator and a small end-to-end fit."""

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from retentia import schemas as S
from retentia.operators import model as ML

from test_metrics import brute_ap


def _customers(spark, n=300):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.3)
        rows.append((
            i + 1, int(rng.integers(0, 73)), ["Month-to-month", "One year", "Two year"][i % 3], float(rng.uniform(18, 150)),
            float(rng.uniform(0, 5000)), ["Electronic check", "Mailed check"][i % 2], "DSL", "Yes", "No", "Yes",
            int(rng.integers(0, 6)) + 2 * y, float(rng.uniform(1, 5)), ["Low", "High"][i % 2], y,
        ))
    cols = [c for c in S.CUSTOMERS.fieldNames() if c != "signup_date"]
    types = {f.name: f.dataType.simpleString() for f in S.CUSTOMERS.fields}
    return spark.createDataFrame(rows, ", ".join(f"{c} {types[c]}" for c in cols))


def test_split_is_exactly_stratified(spark):
    df = _customers(spark)
    s = ML.stratified_split(df, "churned", "customer_id", 0.2)
    for r in s.groupBy("churned").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect():
        assert r["t"] == int(np.floor(r["n"] * 0.2 + 0.5))
    folds = s.where(~F.col("is_test")).groupBy("churned", "fold").count().collect()
    by_label = {}
    for r in folds:
        by_label.setdefault(r["churned"], []).append(r["count"])
    assert all(max(v) - min(v) <= 1 and len(v) == 3 for v in by_label.values())
    # deterministic: same ids, same split
    again = ML.stratified_split(df, "churned", "customer_id", 0.2)
    assert s.where("is_test").select("customer_id").exceptAll(again.where("is_test").select("customer_id")).count() == 0


def test_one_hot_unseen_and_null_are_all_zero(spark):
    train = spark.createDataFrame([("b",), ("a",), ("c",)], "x string")
    apply = spark.createDataFrame([("a",), ("c",), ("zzz",), (None,)], "x string")
    stages = ML.encoder_stages(["x"], [])[:2]
    enc = Pipeline(stages=stages).fit(train)
    got = [list(r[0]) for r in enc.transform(apply).select(vector_to_array("x__oh")).collect()]
    assert got == [[1.0, 0.0, 0.0], [0.0, 0.0, 1.0], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]]


def test_average_precision_evaluator(spark):
    from pyspark.ml.linalg import Vectors

    ys = [1, 0, 1, 0, 1, 0, 0]
    ps = [0.9, 0.8, 0.8, 0.3, 0.2, 0.2, 0.1]
    df = spark.createDataFrame([(y, Vectors.dense([1 - p, p])) for y, p in zip(ys, ps)], ["churned", "probability"])
    ev = ML.AveragePrecisionEvaluator("churned")
    assert abs(ev.evaluate(df) - brute_ap(ys, ps)) < 1e-12


def test_param_mapping_and_sampling():
    draws = ML.sample_params(4, max_trees=5)
    assert len(draws) == 4 and all(d["n_estimators"] <= 5 for d in draws)
    assert draws == ML.sample_params(4, max_trees=5)
    m = ML.map_params({**draws[0], "colsample_bytree": 1.0})
    assert m["featureSubsetStrategy"] == "all"


def test_small_fit_scores_every_row(spark):
    df = _customers(spark)
    tr, ratio = ML.with_class_weight(df, "churned")
    assert ratio > 1
    model = ML.fit_pipeline(tr, "churned", maxIter=3, maxDepth=2)
    scored = ML.positive_proba(model.transform(df))
    assert scored.where(F.col("y_proba").between(0, 1)).count() == df.count()
    names = ML.feature_names(model, df)
    assert names[-5:] == S.NUMERIC_COLUMNS and "contract_type_Month-to-month" in names
