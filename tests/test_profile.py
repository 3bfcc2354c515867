"""Profiling on edge rows: columns without values, order of results, declared keys that never occur."""

import pytest
from pyspark.sql import functions as F

from retentia.functions import vectors as V
from retentia.operators import model as ML
from retentia.operators import profile as PR
from retentia.operators import retrieve as R
from retentia.operators.ranking import running_totals


def test_columns_without_values_stay_in_the_profile(spark):
    df = spark.createDataFrame([(1.0, None, "a", None, None), (3.0, None, "a", None, None)],
                               "x double, y double, s string, t string, d date")
    n = {r["column"]: r for r in PR.describe_numeric(df, ["x", "y"]).collect()}
    assert (n["x"]["count"], n["x"]["q50"]) == (2, 2.0)
    assert n["y"]["count"] == 0 and n["y"]["mean"] is None and n["y"]["q50"] is None
    c = {r["column"]: tuple(r)[1:] for r in PR.describe_categorical(df, ["s", "t"]).collect()}
    assert c == {"s": (2, 1, "a", 2), "t": (0, 0, None, None)}
    (d,) = PR.describe_dates(df, ["d"]).collect()
    assert d["count"] == 0 and d["min"] is None


def test_counts_and_rates_come_sorted(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1), ("b", 1), ("c", 0), ("c", 1), (None, 1)], "k string, churned int")
    assert [tuple(r) for r in PR.value_counts(df, "k", normalize=True).collect()] == [("b", 2, 0.4), ("c", 2, 0.4), ("a", 1, 0.2)]
    assert [r["k"] for r in PR.rate_by(df, "k").collect()] == ["b", "c", "a"]


def test_declared_keys_that_never_occur_are_reported(spark):
    seen = spark.createDataFrame([("a", 4, 0.8), ("z", 1, 0.2)], "k string, n bigint, share double")
    declared = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "k string, expected_share double")
    out = {r["k"]: r for r in PR.deviation_from_expected(seen, "k", declared).collect()}
    assert (out["b"]["n"], out["b"]["share"], out["b"]["abs_deviation"]) == (0, 0.0, 0.5)
    assert out["z"]["expected_share"] is None and out["z"]["abs_deviation"] is None


def test_groups_without_values_stay_in_the_box_stats(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (0, 3.0), (0, 99.0), (1, None), (None, 5.0)], "g int, v double")
    out = {r["g"]: r for r in PR.box_stats(df, "g", "v").collect()}
    assert set(out) == {0, 1}
    assert out[0]["n_outliers"] == 1 and out[0]["whisker_high"] == 3.0
    assert out[1]["q1"] is None and out[1]["n"] == 1


def test_split_of_large_ids_does_not_depend_on_partitions(spark):
    # ids equal modulo 2^31 share a hash key; the id itself decides among them
    df = spark.range(3000).select((F.col("id") * F.lit(2**31) + F.col("id") % 3).alias("customer_id"), (F.col("id") % 2).cast("int").alias("y"))
    folds = [
        {r["customer_id"]: (r["is_test"], r["fold"]) for r in ML.stratified_split(df.repartition(n), "y", "customer_id").collect()}
        for n in (2, 7)
    ]
    assert folds[0] == folds[1]
    assert sum(t for t, _ in folds[0].values()) == 600


def test_draws_are_distinct(spark):
    draws = ML.sample_params(200)
    assert len({tuple(d.values()) for d in draws}) == 200
    assert all(d[k] in v for d in draws for k, v in ML.PARAM_DISTRIBUTIONS.items())


def test_limits_are_errors(spark):
    df = spark.createDataFrame([(1, 1, [1.0, 0.0])], "customer_id int, interaction_id int, embedding array<double>")
    ask = spark.createDataFrame([(1, 1, 50)], "request_id int, customer_id int, top_k int")
    with pytest.raises(Exception, match="asks for 50 hits"):
        R.scoped_search(df, ask, lambda: V.dot_literal(F.col("embedding"), [1.0, 0.0])).collect()
    with pytest.raises(Exception, match="unequal length"):
        df.select(V.dot_literal(F.col("embedding"), [1.0])).collect()
    with pytest.raises(ValueError, match="n_buckets"):
        running_totals(df, "customer_id", ["interaction_id"], n_buckets=1 << 20)
