"""Scale guards on the physical plans of registered queries."""

import __spark_entry__ as E

from conftest import SF001


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_topk_limits_before_the_shuffle(spark):
    for name in ["at_risk_context", "topk_per_customer", "scoped_search"]:
        plan = _plan(E.queries()[name](spark, SF001))
        assert plan.count("WindowGroupLimit") >= 2, name  # partial (map side) and final


def test_scans_are_pruned(spark):
    plan = _plan(E.queries()["churn_by_contract"](spark, SF001))
    schemas = [line for line in plan.splitlines() if "ReadSchema" in line or "FileScan" in line]
    assert schemas and all("signup_date" not in s for s in schemas)


def test_no_python_udf_in_core_queries(spark):
    qs = E.queries()
    for name in ["at_risk_context", "guardrail_chain", "scoped_search", "pr_curve", "describe_numeric"]:
        plan = _plan(qs[name](spark, SF001))
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan and "MapInPandas" not in plan, name


def test_dense_ids_single_partition_only_for_offsets(spark):
    from pyspark.sql import functions as F

    from retentia.operators.ranking import dense_ids

    df = spark.range(5000).select((F.col("id") * 7 + 3).alias("k"))
    plan = dense_ids(df, ["k"], "rid", n_buckets=8)._jdf.queryExecution().executedPlan().toString().splitlines()
    single = [i for i, line in enumerate(plan) if "SinglePartition" in line]
    assert len(single) == 1 and "keys=[_bucket" in plan[single[0] + 1]
