"""Structured Streaming jobs (S1-S3): the request-at-a-time endpoints of the original,
rebuilt as streams.

- Sources are file streams over a Parquet file or a folder of part files;
  ``trigger(availableNow=True)`` drains what is there and stops (a continuous deployment
  uses a processing-time trigger instead; the code is the same).
- No result depends on the order in which files arrive: scoring is per row, and throughput
  writes mergeable counts per micro-batch which the reader sums, so a row that comes late
  is counted in its minute and no watermark can drop it.
- Sinks are ``foreachBatch`` writers that overwrite the folder of *their own batch id*:
  a micro-batch replayed after a failure rewrites the same folder, so the log holds
  every request exactly once (idempotent by batch, and the checkpoint records which
  batches committed).
- Log ids are ranges reserved per micro-batch and stored with the batch id, and the time is taken
  once a batch, so a replay writes the same ids and times.
- Static sides (scored customers, retrieved contexts) are written to the shared folder
  once before the stream starts, so a micro-batch joins a stored table instead of
  re-running the whole customer pipeline every batch.
- The caller names sink and checkpoint folders (on the shared storage); starting again with
  the same two resumes where the last run stopped.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.operators.ranking import dense_ids
from retentia.session import stored, work_dir

LEDGER = "batch bigint, first bigint, n bigint, at string"


def file_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet file stream over ``path``, one file or a folder of part files (schema taken
    from what is there).  ``max_files_per_trigger`` sizes the micro-batches; unset, a
    micro-batch takes every new file, which is what a drain of many files wants."""
    folder, _, name = path.rstrip("/").rpartition("/")
    s = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files_per_trigger:
        s = s.option("maxFilesPerTrigger", max_files_per_trigger)
    # a one-name glob: the stream source takes a plain path for a folder, even if it is a file
    return s.parquet(f"{folder}/{{{name}}}")


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write a static side once to the shared folder and read it back."""
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def batch_sink(path: str, transform: Callable[[DataFrame, int], DataFrame] | None = None):
    """foreachBatch writer: (optionally transform, then) overwrite ``path/batch_id=<id>``."""

    def write(df: DataFrame, batch_id: int) -> None:
        out = transform(df, batch_id) if transform else df
        out.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def reserve_ids(spark: SparkSession, ledger: str, batch_id: int, n: int, now: str | None = None) -> tuple[int, str]:
    """(first id, time) of a micro-batch: the range of ``n`` ids after the largest one reserved so
    far, stored with the batch id before the batch is written.  A replay of the batch finds its
    entry and takes the same ids and the same time; a batch that failed after its reservation
    leaves no gap, as its replay comes first.  One stream writes to a ledger at a time."""
    try:
        entries = spark.read.schema(LEDGER).json(f"{ledger}/*")
        mine = entries.where(F.col("batch") == batch_id).first()
        if mine:
            if mine["n"] != n:
                raise RuntimeError(f"batch {batch_id} had {mine['n']} rows when its ids were reserved, now {n}")
            return mine["first"], mine["at"]
        first = (entries.agg(F.max(F.col("first") + F.col("n")).alias("m")).first()["m"] or 1)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        first = 1
    at = now or datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")
    entry = spark.createDataFrame([(batch_id, first, n, at)], LEDGER)
    entry.coalesce(1).write.mode("overwrite").json(f"{ledger}/batch{batch_id}")
    return first, at


def with_batch_ids(rows: DataFrame, ledger: str, batch_id: int, order: str, id_col: str, logged: Column, now: str | None = None) -> DataFrame:
    """The log identity of a micro-batch: dense ids (in the order of the unique ``order``) from the
    batch's reserved range and the batch's time on the rows that are ``logged``; nulls on others."""
    rows = stored(rows.withColumn("_logged", logged), "batch")
    mine = rows.where("_logged")
    first, at = reserve_ids(rows.sparkSession, ledger, batch_id, mine.count(), now)
    done = dense_ids(mine, [order], id_col, first).withColumn("created_at", F.to_timestamp_ntz(F.lit(at)))
    return done.unionByName(rows.where("NOT _logged"), allowMissingColumns=True).drop("_logged")


def run_available_now(stream: DataFrame, sink_fn, checkpoint: str) -> None:
    """Drain the source and stop; raises if the query failed."""
    q = (
        stream.writeStream.foreachBatch(sink_fn)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def read_sink(spark: SparkSession, path: str) -> DataFrame:
    """All committed batches of a ``batch_sink`` folder (``batch_id`` column included)."""
    return spark.read.parquet(path)


def score_requests(requests: DataFrame, scored: DataFrame, model_version: str) -> DataFrame:
    """S1 transformation: stream-static left join of requests to scored customers; a miss
    is logged with status ``not_found`` (the endpoint's 404)."""
    j = requests.join(scored, "customer_id", "left")
    return j.select(
        "request_id",
        "customer_id",
        F.when(F.col("churn_probability").isNull(), F.lit("not_found")).otherwise(F.lit("scored")).alias("status"),
        "churn_probability",
        "predicted_label",
        "threshold_used",
        F.when(F.col("churn_probability").isNull(), F.lit(None).cast("string")).otherwise(F.lit(model_version)).alias("model_version"),
    )


def requests_per_minute(events: DataFrame, ts: str = "ts", failed: F.Column | None = None) -> DataFrame:
    """S3 transformation of one micro-batch: requests and failures per minute, as partial
    counts that ``total_per_minute`` adds up over the batches.  A null time counts under a
    null minute.

    ``ts`` may be zone-less (``timestamp_ntz``, as in the test tables): ``minute`` then is
    zone-less too and does not go through the session time zone."""
    failed = failed if failed is not None else F.lit(False)
    col = F.col(ts)
    if dict(events.dtypes).get(ts) == "timestamp_ntz":
        minute = F.make_timestamp_ntz(F.year(col), F.month(col), F.dayofmonth(col), F.hour(col), F.minute(col), F.lit(0))
    else:
        minute = F.date_trunc("minute", col)
    return events.groupBy(minute.alias("minute")).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(failed).alias("failures")
    )


def total_per_minute(parts: DataFrame) -> DataFrame:
    """The partial counts of all micro-batches added up, with the share of failures."""
    t = parts.groupBy("minute").agg(F.sum("requests").alias("requests"), F.sum("failures").alias("failures"))
    return t.withColumn("failure_share", F.col("failures") / F.col("requests"))
