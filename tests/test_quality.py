"""CSV round trip with NA tokens, idempotent load, keys, references, constraints."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentia.operators import quality as Q
from retentia.session import work_dir
from retentia.sources import io as IO


def test_csv_na_tokens(spark):
    df = spark.createDataFrame([(1, "None"), (2, "NA"), (3, "x"), (4, "")], "id bigint, s string")
    path = IO.write_csv(df, work_dir(spark, "csv"))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("s", T.StringType())])
    plain = dict(IO.read_csv(spark, path, schema).collect())
    assert plain[1] == "None" and plain[2] == "NA"
    na = dict(IO.read_csv(spark, path, schema, na_tokens=IO.PANDAS_NA_TOKENS).collect())
    assert na == {1: None, 2: None, 3: "x", 4: None}


def test_append_new_is_idempotent(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "k bigint")
    path = work_dir(spark, "load")
    assert IO.append_new(spark, df, path, "k") == 10
    assert IO.append_new(spark, df, path, "k") == 0
    assert spark.read.parquet(path).count() == 10


def test_keys_and_references(spark):
    parent = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id bigint")
    s = Q.key_summary(parent, "id", "p").first()
    assert (s["n_rows"], s["n_null_keys"], s["n_distinct_keys"], s["n_duplicate_keys"]) == (4, 1, 2, 1)
    child = spark.createDataFrame([(10, 1), (11, 3), (12, None)], "cid bigint, id bigint")
    assert sorted(r["cid"] for r in Q.orphans(child, parent, "id", "id").collect()) == [11, 12]
    assert [r["cid"] for r in Q.valid_references(child, parent, "id", "id").collect()] == [10]


def test_constraint_report(spark):
    df = spark.createDataFrame([("Yes", 5), ("Maybe", 99), (None, 1)], "flag string, n int")
    rep = Q.constraint_report(df, not_null=["flag"], max_lengths={"flag": 3}, domains={"flag": ["Yes", "No"]}, ranges={"n": (0, 10)})
    got = {(r["column_name"], r["check_name"]): r["violations"] for r in rep.collect()}
    assert got[("flag", "not_null")] == 1
    assert got[("flag", "max_length_3")] == 1
    assert got[("flag", "domain")] == 1
    assert got[("n", "range")] == 1


def test_lookup_not_found(spark):
    req = spark.createDataFrame([(1, 5), (2, 6)], "request_id int, want bigint")
    table = spark.createDataFrame([(5, "a")], "k bigint, v string")
    got = dict((r["request_id"], r["status"]) for r in Q.lookup(req, table, "want", "k").collect())
    assert got == {1: "found", 2: "not_found"}


def test_create_tables_twice(spark):
    from retentia import schemas as S

    base = work_dir(spark, "tables")
    tables = {"t_predictions_test": S.PREDICTIONS}
    IO.create_tables(spark, base, tables)
    IO.create_tables(spark, base, tables)
    assert spark.table("t_predictions_test").columns == [f.name for f in S.PREDICTIONS.fields]


def test_reads_pandas_written_csv(spark, tmp_path):
    """A1 on files as a pandas writer produces them: one header, no index, space-separated
    microsecond timestamps, quoted text with commas."""
    import datetime as dt

    import pandas as pd

    from retentia import schemas as S

    path = tmp_path / "interactions.csv"
    pd.DataFrame({
        "interaction_id": [1, 2], "customer_id": [5, 6],
        "timestamp": [dt.datetime(2024, 1, 3, 9, 0, 0, 123456), dt.datetime(2024, 1, 4, 10, 0)],
        "channel": ["chat", "email"], "interaction_type": ["billing_issue", "complaint"],
        "sentiment": ["negative", "None"], "text": ["I was charged $15, twice", "ok"],
    }).to_csv(path, index=False)
    rows = IO.read_csv(spark, str(path), S.INTERACTIONS, na_tokens=IO.PANDAS_NA_TOKENS).orderBy("interaction_id").collect()
    assert rows[0]["timestamp"] == dt.datetime(2024, 1, 3, 9, 0, 0, 123456)
    assert rows[0]["text"] == "I was charged $15, twice"
    assert rows[1]["sentiment"] is None  # pandas reads the text None as missing


def test_bucketed_tables_join_without_shuffle(spark):
    from retentia.session import work_dir

    a = spark.createDataFrame([(i % 50, i) for i in range(500)], "customer_id bigint, interaction_id bigint")
    b = spark.createDataFrame([(i, i * 2) for i in range(50)], "customer_id bigint, v bigint")
    IO.write_bucketed(a, "t_bucket_a", "customer_id", 4, work_dir(spark, "ba"))
    IO.write_bucketed(b, "t_bucket_b", "customer_id", 4, work_dir(spark, "bb"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        j = spark.table("t_bucket_a").join(spark.table("t_bucket_b"), "customer_id")
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert j.count() == 500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_latest_per_key_and_duplicates(spark):
    log = spark.createDataFrame([(1, 10, True), (1, 12, False), (2, 11, True)], "prediction_id int, recommendation_id int, passed boolean")
    got = {r["prediction_id"]: (r["n_rows"], r["recommendation_id"], r["passed"]) for r in Q.latest_per_key(log, "prediction_id", "recommendation_id", "n_rows").collect()}
    assert got == {1: (2, 12, False), 2: (1, 11, True)}
    assert [tuple(r) for r in Q.duplicate_keys(log, "prediction_id").collect()] == [(1, 2)]


def test_gap_ids_unique(spark):
    from retentia.operators.ranking import gap_ids

    df = spark.range(1000).repartition(7)
    ids = gap_ids(df, "rid", start=5)
    assert ids.select("rid").distinct().count() == 1000 and ids.agg({"rid": "min"}).first()[0] >= 5


def test_ids_continue_from_the_log_and_stay(spark, tmp_path):
    from retentia.operators.ranking import dense_ids

    path = str(tmp_path / "log")
    batch = spark.createDataFrame([(i * 7,) for i in range(10)], "k long")
    assert IO.next_id(spark, path, "id") == 1
    IO.append_table(dense_ids(batch, ["k"], "id", IO.next_id(spark, path, "id")).withColumn("run", F.lit(1)), path)
    first = {(r["k"], r["id"]) for r in spark.read.parquet(path).collect()}
    IO.append_table(dense_ids(batch, ["k"], "id", IO.next_id(spark, path, "id")).withColumn("run", F.lit(2)), path)
    rows = spark.read.parquet(path).collect()
    assert sorted(r["id"] for r in rows) == list(range(1, 21))
    assert {(r["k"], r["id"]) for r in rows if r["run"] == 1} == first


def test_next_id_raises_what_is_no_missing_log(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.createDataFrame([(1,)], "other long").write.parquet(path)
    with pytest.raises(Exception, match="id"):
        IO.next_id(spark, path, "id")


def test_checked_append_refuses_orphans_and_keeps_the_rest(spark):
    from retentia.session import work_dir
    from retentia.sources import io as IO

    path = work_dir(spark, "checked")
    parent = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id int")
    rules = dict(references={"c": (parent, "id")}, not_null=["t"], max_lengths={"t": 3}, domains={"d": ["x", "y"]})
    cols = "k int, c int, t string, d string"

    def append(rows):
        return {r["k"]: r["broken"] for r in IO.checked_append(spark, spark.createDataFrame(rows, cols), path, "k", **rules).collect()}

    got = append([(1, 1, "abc", "x"), (2, 9, "abc", "x"), (3, None, "é漢字", None), (4, 1, "abcd", "z"), (5, 2, None, "y"), (None, 7, None, "q"), (6, 1, "a", "x"), (6, 2, "b", "y")])
    assert got == {1: [], 2: ["reference:c"], 3: [], 4: ["domain:d", "length:t"], 5: ["not_null:t"], None: ["domain:d", "key_null", "not_null:t", "reference:c"], 6: ["key_repeated"]}
    assert sorted(r["k"] for r in spark.read.parquet(path).collect()) == [1, 3]
    assert append([(1, 1, "abc", "x"), (2, 2, "abc", "x")]) == {1: ["key_exists"], 2: []}
    assert append([]) == {}
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("k", "c").collect()) == [(1, 1), (2, 2), (3, None)]
