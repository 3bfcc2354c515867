"""Streaming scoring equals batch scoring; the throughput counts every row, whatever the file layout."""

import datetime as dt

import pytest
from conftest import SF001
from pyspark.sql import functions as F

from retentia.session import work_dir
from retentia.streaming import jobs as J


def test_stream_scoring_equals_batch(spark):
    folder = work_dir(spark, "req")
    req = spark.createDataFrame([(i, i % 7) for i in range(50)], "request_id bigint, customer_id bigint")
    req.write.parquet(folder)
    scored = spark.createDataFrame([(c, c / 10.0, int(c > 3), 0.35) for c in range(1, 6)],
                                   "customer_id bigint, churn_probability double, predicted_label int, threshold_used double")
    sink = work_dir(spark, "sink")
    score = J.batch_sink(sink, lambda df, _: J.score_requests(df, scored, "v1"))
    J.run_available_now(J.file_stream(spark, folder), score, work_dir(spark, "ckpt"))
    got = J.read_sink(spark, sink).drop("batch_id")
    want = J.score_requests(req, scored, "v1")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert got.where("status = 'not_found'").count() == req.where("customer_id not between 1 and 5").count()


def per_minute(spark, path, name, sink=None, ckpt=None, **options):
    sink = sink or work_dir(spark, name)
    count = J.batch_sink(sink, lambda df, _: J.requests_per_minute(df, "ts", F.col("event_type") == "error"))
    J.run_available_now(J.file_stream(spark, path, **options), count, ckpt or work_dir(spark, f"{name}-ckpt"))
    return {r["minute"]: (r["requests"], r["failures"]) for r in J.total_per_minute(J.read_sink(spark, sink)).collect()}


def test_layout_and_order_of_files_do_not_matter(spark):
    events = spark.read.parquet(f"{SF001}/events.parquet").select("ts", "event_type")
    parts = work_dir(spark, "events-parts")
    events.orderBy(F.xxhash64("ts")).repartition(4).write.parquet(parts)
    whole = per_minute(spark, f"{SF001}/events.parquet", "rpm-file")
    assert sum(n for n, _ in whole.values()) == events.count()
    assert per_minute(spark, parts, "rpm-parts") == whole
    assert per_minute(spark, parts, "rpm-one-by-one", max_files_per_trigger=1) == whole


def test_late_rows_count_and_a_restart_resumes(spark):
    folder, sink, ckpt = (work_dir(spark, n) for n in ("late", "late-sink", "late-ckpt"))
    t0 = dt.datetime(2024, 1, 1, 12, 0)

    def add(rows):
        spark.createDataFrame(rows, "ts timestamp_ntz, event_type string").coalesce(1).write.mode("append").parquet(folder)

    add([(t0 + dt.timedelta(minutes=m), "view") for m in range(31)])
    assert len(per_minute(spark, folder, "late", sink, ckpt)) == 31
    add([(t0 - dt.timedelta(days=1), "error"), (t0, "error"), (None, "view")])
    out = per_minute(spark, folder, "late", sink, ckpt)  # same folders: only the new file is read
    assert out[t0 - dt.timedelta(days=1)] == (1, 1) and out[t0] == (2, 1) and out[None] == (1, 0)
    assert sum(n for n, _ in out.values()) == 34


def test_minutes_do_not_depend_on_session_zone(spark):
    folder = work_dir(spark, "dst")
    # 02:30 on 2024-03-10 does not exist in America/Los_Angeles
    rows = [(dt.datetime(2024, 3, 10, 2, 30, 15), "view"), (dt.datetime(2024, 3, 10, 2, 31), "error")]
    spark.createDataFrame(rows, "ts timestamp_ntz, event_type string").write.parquet(folder)
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        got = sorted((m, n) for m, (n, _) in per_minute(spark, folder, "dst").items())
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == [(dt.datetime(2024, 3, 10, 2, 30), 1), (dt.datetime(2024, 3, 10, 2, 31), 1)]


def test_a_replayed_batch_keeps_its_ids_and_times(spark):
    """Ids go on from batch to batch; a replay, also of an earlier batch, writes the same rows."""
    sink, ledger = work_dir(spark, "ids-sink"), work_dir(spark, "ids-ledger")
    frame = lambda rows: spark.createDataFrame(rows, "request_id bigint, status string")
    write = J.batch_sink(sink, lambda df, b: J.with_batch_ids(df, ledger, b, "request_id", "prediction_id", F.col("status") == "scored"))
    rows = lambda: sorted((r["request_id"], r["prediction_id"], r["created_at"], r["batch_id"]) for r in J.read_sink(spark, sink).collect())
    a, b = frame([(5, "scored"), (3, "scored"), (4, "not_found")]), frame([(9, "scored"), (1, "scored")])
    write(a, 0)
    write(b, 1)
    first = rows()
    assert [(r[0], r[1]) for r in first] == [(1, 3), (3, 1), (4, None), (5, 2), (9, 4)]
    assert first[2][2] is None and first[1][2] == first[3][2] <= first[0][2]
    write(a.repartition(5), 0)
    write(b, 1)
    assert rows() == first
    write(frame([(7, "not_found")]), 2)  # nothing to number
    write(frame([(8, "scored")]), 3)
    assert [r[1] for r in rows() if r[0] == 8] == [5]
    with pytest.raises(RuntimeError, match="ids were reserved"):
        write(frame([(8, "scored")]), 0)


def test_batches_that_died_after_the_reservation_are_replayed(spark):
    ledger = work_dir(spark, "ids-ledger")
    assert J.reserve_ids(spark, ledger, 0, 10, "t0") == (1, "t0")
    assert J.reserve_ids(spark, ledger, 0, 10, "t9") == (1, "t0")
    assert J.reserve_ids(spark, ledger, 1, 5, "t1") == (11, "t1")
    assert J.reserve_ids(spark, ledger, 2, 0, "t2") == (16, "t2")
    assert J.reserve_ids(spark, ledger, 3, 1, "t3") == (16, "t3")
