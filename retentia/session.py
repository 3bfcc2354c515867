"""Session helpers: a local session for tests/bench and the shared work folder.

Library code never creates a session of its own; every operator takes the
DataFrames (or the session) it is given.  ``work_dir`` is the one place that
decides where intermediate tables go: the folder the cluster names in
``spark.checkpoint.dir``.  Only when that is unset (local tests) a scratch
folder is created and registered as the checkpoint folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "retentia") -> SparkSession:
    """Session for tests and the bench (local mode, UI off, UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.default.parallelism", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("RETENTIA_DRIVER_MEMORY", "12g"))
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="retentia-wh-"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _checkpoint_dir(spark: SparkSession) -> str | None:
    d = spark.sparkContext.getCheckpointDir()
    if d:
        return d
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)


def is_local(spark: SparkSession) -> bool:
    """One JVM: ``local``, ``local[4]``, ``local[*]``; not ``local-cluster[...]``."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a scratch one only when unset."""
    d = _checkpoint_dir(spark)
    if not d:
        if not is_local(spark):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a shared work folder")
        d = tempfile.mkdtemp(prefix="retentia-ckpt-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return spark.sparkContext.getCheckpointDir() or d


def shared_root(spark: SparkSession) -> str:
    """The shared folder itself, the same in every session that names it (the checkpoint folder
    proper is a new one below it for each application)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return named.rstrip("/") if named else base.rpartition("/")[0]


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one written table, under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/retentia/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new folder of the shared work folder and read back: what follows
    starts from stored rows, and a lost executor costs a re-read, no recomputation."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
