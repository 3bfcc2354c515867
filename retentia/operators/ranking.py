"""Ordering operators: distributed running totals, top-k per key, dense ids,
attempt selection, sorted head and array set difference (E1-E6, A6).

The one piece of real design is ``running_totals``: an exact cumulative sum in a
global order that never moves all rows into one task.  Rows are bucketed by value
ranges (splitters from a hashed sample of a set size, however large the input is;
bucket ids by binary search), each bucket is summed, the
bucket sums are prefix-summed (``n_buckets`` rows, broadcast), and a window
*partitioned by bucket* finishes the job inside each bucket.  Sample and bucket ids
are functions of the values, so a lost executor recomputes the same buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_BUCKETS = 65536
SAMPLE_PER_BUCKET = 32


def _n_buckets(df: DataFrame, n_buckets: int | None) -> int:
    if n_buckets is not None and not 1 <= int(n_buckets) <= MAX_BUCKETS:
        raise ValueError(f"n_buckets must be between 1 and {MAX_BUCKETS}, got {n_buckets}")
    if n_buckets is not None:
        return int(n_buckets)
    return max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), MAX_BUCKETS))


def bucket_edges(df: DataFrame, order_col: str, n_buckets: int, ties: Sequence[str] = ()) -> list[float]:
    """Splitters that cut the rows, in the order of ``order_col``, into about ``n_buckets`` equal
    ranges: quantiles of the rows whose hash falls below a limit.  The limit is set by a count so
    that SAMPLE_PER_BUCKET rows a bucket are drawn, however many rows or tasks there are (no
    sketch of each task meets in one place), and the draw depends on the rows alone."""
    if n_buckets <= 1:
        return []
    value = F.col(order_col).cast("double")
    known = df.where(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))))
    n = known.count()
    wanted = n_buckets * SAMPLE_PER_BUCKET
    if n > wanted:
        known = known.where(F.pmod(F.xxhash64(order_col, *ties), F.lit(1 << 40)) < F.lit(int(wanted / n * (1 << 40))))
    drawn = sorted(r[0] for r in known.select(value).collect())
    return sorted({drawn[len(drawn) * i // n_buckets] for i in range(1, n_buckets)}) if drawn else []


def bucketize(df: DataFrame, order_col: str, edges: Sequence[float], out_col: str = "_bucket") -> DataFrame:
    """Bucket id = position of the value among the edges, by binary search in the JVM
    (MLlib ``Bucketizer``); monotone in the value, so every bucket is a value range.  Without
    edges (no values at all, or one bucket) every row is in bucket 0."""
    if not edges:
        return df.withColumn(out_col, F.lit(0))
    from pyspark.ml.feature import Bucketizer

    splits = [float("-inf"), *edges, float("inf")]
    x = df.withColumn("_ord", F.col(order_col).cast("double"))
    b = Bucketizer(splits=splits, inputCol="_ord", outputCol=out_col, handleInvalid="keep")
    return b.transform(x).withColumn(out_col, F.col(out_col).cast("int")).drop("_ord")


def running_totals(
    df: DataFrame,
    order_col: str,
    sum_cols: Sequence[str],
    descending: bool = False,
    groups: Sequence[str] = (),
    n_buckets: int | None = None,
    prefix: str = "cum_",
    edges: Sequence[float] | None = None,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Add ``cum_<c>`` = sum of ``c`` over all rows at or before each row in the order of
    ``order_col`` (within ``groups``).  ``order_col``, followed by the ``ties`` columns, must be unique per
    group, and ``order_col`` not null (aggregate ties and drop unknown values first): the totals
    then do not depend on the partitioning.  Rows equal in ``order_col`` share a bucket, so
    ``ties`` only order rows inside one.

    Buckets are value ranges of ``order_col`` over all rows (global quantiles), so each
    bucket holds about ``n / n_buckets`` rows whatever the groups are; ``groups`` only
    enter the partitioning of the final window and the offset table, which has at most
    ``n_groups * n_buckets`` rows (``groups`` is meant for a few labels or columns)."""
    groups = list(groups)
    if edges is None:
        edges = bucket_edges(df, order_col, _n_buckets(df, n_buckets), ties)
    x = bucketize(df, order_col, edges)
    # per-(group, bucket) sums -> prefix over buckets: bounded table, broadcast
    sums = x.groupBy(*groups, "_bucket").agg(*[F.sum(c).alias(f"_bs_{c}") for c in sum_cols])
    bw = Window.partitionBy(*groups).orderBy(F.col("_bucket").desc() if descending else F.col("_bucket").asc())
    offsets = sums.select(
        *groups,
        "_bucket",
        *[(F.sum(f"_bs_{c}").over(bw.rowsBetween(Window.unboundedPreceding, -1))).alias(f"_off_{c}") for c in sum_cols],
    )
    x = x.join(F.broadcast(offsets), [*groups, "_bucket"], "left")
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    w = Window.partitionBy(*groups, "_bucket").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for c in sum_cols:
        x = x.withColumn(f"{prefix}{c}", F.coalesce(F.col(f"_off_{c}"), F.lit(0)) + F.sum(c).over(w))
    return x.drop("_bucket", *[f"_off_{c}" for c in sum_cols])


def dense_ids(df: DataFrame, order_cols: Sequence[str], id_col: str, start: int = 1, n_buckets: int | None = None) -> DataFrame:
    """Dense ids ``start, start+1, ...`` in the order of ``order_cols`` (unique per row),
    without a single-partition window: a running count through ``running_totals``.

    Rows are bucketed on the order column, so it must identify rows (a primary key),
    which is what id allocation uses.
    """
    key = order_cols[0]
    if len(order_cols) > 1:
        raise ValueError("dense_ids orders by one unique key column")
    out = running_totals(df.withColumn("_one", F.lit(1)), key, ["_one"], n_buckets=n_buckets, prefix="_cum")
    return out.withColumn(id_col, (F.col("_cum_one") + F.lit(start - 1)).cast("bigint")).drop("_one", "_cum_one")


def gap_ids(df: DataFrame, id_col: str, start: int = 0) -> DataFrame:
    """A6, gap-tolerant variant: unique increasing ids with no extra pass or shuffle
    (``monotonically_increasing_id``: partition index in the upper bits), when only
    uniqueness is needed and gaps are acceptable.  Ids depend on the partitioning of the
    input, so a recomputation after lost executors may renumber: write the rows out with
    their ids before anything else refers to them."""
    return df.withColumn(id_col, F.monotonically_increasing_id() + F.lit(start))


def top_k_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[Column], k: int | Column, rank_col: str = "rank") -> DataFrame:
    """The first ``k`` rows per key in ``order``.  ``row_number() <= k`` lets Spark plan a
    ``WindowGroupLimit`` that trims each map partition to ``k`` rows per key before the
    shuffle, so a key with a huge history costs ``k`` rows of shuffle per map task."""
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(*order)
    kk = F.lit(k) if isinstance(k, int) else k
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= kk)


def first_pass_else_last(attempts: DataFrame, key: str, attempt_col: str = "attempt", passed_col: str = "passed") -> DataFrame:
    """Per key the first passing attempt, else the last attempt (one aggregate, no sort).

    ``min_by`` over ``(not passed, +n if passed else -n)`` picks the smallest passing n,
    or, when none passed, the largest n."""
    n = F.col(attempt_col)
    rank = F.struct((~F.col(passed_col)).alias("a"), F.when(F.col(passed_col), n).otherwise(-n).alias("b"))
    others = [c for c in attempts.columns if c != key]
    picked = attempts.groupBy(key).agg(F.min_by(F.struct(*others), rank).alias("_r"))
    return picked.select(key, "_r.*")


def head_by(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """E5: sorted head -> ``TakeOrderedAndProject`` (per-partition top-n, then merge)."""
    return df.orderBy(*order).limit(n)


def ungrounded(claimed, context) -> Column:
    """Sorted set difference claimed - context."""
    c = F.col(claimed) if isinstance(claimed, str) else claimed
    x = F.col(context) if isinstance(context, str) else context
    return F.array_sort(F.array_except(c, x))
