"""What the operators of this package share: reading a table, work folders, Arrow helpers."""

from __future__ import annotations

import ctypes

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentia.plans.registry import Entry
from retentia.session import work_dir

#: name -> Entry of this package's queries (``__spark_entry__`` adds them to the others)
QUERIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` as a query of this package."""

    def deco(fn):
        QUERIES[name] = Entry(name, fn, sql, "")
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Spark's setting by which a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """``df`` written to a new folder of the shared work folder and read back: later steps
    start from stored rows, so a lost executor costs a re-read and no recomputation.
    ``release``: the shuffle files behind it go once it is written, not when the driver happens
    to collect its garbage."""
    spark = df.sparkSession
    path, before = work_dir(spark, name), spark.conf.get(CLEANUP, None)
    if release:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if release and before is None:
            spark.conf.unset(CLEANUP)
        elif release:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def fold(key: Column, n: int) -> Column:
    """crc32 of the key's decimal text, modulo ``n``; null keys give null."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(n)


HOT_KEYS, HOT_ROWS = 1_000, 1_000


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``left`` joined (inner or left) to ``right``, which has one row a key, on ``key``.  The rows of
    ``left`` under its most frequent keys (at most HOT_KEYS, of more than HOT_ROWS rows each) stay
    where they are and meet a broadcast of those keys' rows, rows without a key meet nothing and
    stay as well; the others are shuffled."""
    known = left.where(F.col(key).isNotNull())
    top = known.groupBy(key).count().orderBy(F.col("count").desc(), key).limit(HOT_KEYS).where(F.col("count") > HOT_ROWS)
    hot = [r[0] for r in top.select(key).collect()]
    if hot:
        is_hot = F.col(key).isin(hot)
        out = known.where(~is_hot).join(right.where(~is_hot), key, how)
        out = out.unionByName(known.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how))
    else:
        out = known.join(right, key, how)
    return out.unionByName(left.where(F.col(key).isNull()), allowMissingColumns=True) if how == "left" else out


def order_key(df: DataFrame, key: str, last: int, name: str | None = None) -> Column:
    """The key column, which must hold whole numbers, as a long; nulls as ``last``."""
    if not isinstance(df.schema[key].dataType, T.IntegralType):
        raise TypeError(f"{key} must be a column of whole numbers, not {df.schema[key].dataType.simpleString()}")
    return F.coalesce(F.col(name or key).cast("long"), F.lit(last))


def partitions(spark: SparkSession, at_least: int = 1) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(at_least), 1)


def give_back() -> None:
    """Freed memory goes back to the system: a Python worker lives on between tasks and stages, and
    what its allocators keep counts against the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def sub_batches(batch: pa.RecordBatch, text: str, most: int = 4 << 20):
    """The batch in slices of at most about ``most`` bytes of text (one row at least)."""
    col = batch.column(batch.schema.get_field_index(text))
    sizes = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, s in enumerate(sizes):
        if i > start and total + s > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(s)
    if start < len(sizes):
        yield batch.slice(start)
    give_back()
