"""Profiling and audit queries over the customer and interaction tables.

Grouped rates are single ``groupBy`` aggregates (partial aggregation before the
shuffle, so a hot category costs one row per map task).  Multi-column profiles are
one pass over the table followed by an unpivot, never one job per column.  Exact
quantiles are distributed (``exact_quantiles``); no column is collected into a task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentia.operators.ranking import running_totals
from retentia.session import stored


def rate(df: DataFrame, label: str = "churned") -> DataFrame:
    """Global rate of a 0/1 column and the row count."""
    return df.agg(F.avg(label).alias("churn_rate"), F.count(F.lit(1)).alias("n_customers"))


def value_counts(df: DataFrame, col: str, normalize: bool = False, name: str = "n") -> DataFrame:
    """Counts per value (nulls dropped, like the grouped counts it replaces);
    most frequent first.  ``normalize`` adds ``share = n / total``; the
    total is a scalar subquery, so the distinct values stay spread."""
    g = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(name))
    if normalize:
        g = g.withColumn("share", F.col(name) / df.agg(F.count(col)).scalar())
    return g.orderBy(F.col(name).desc(), F.col(col))


def rate_by(df: DataFrame, by: str | Column, label: str = "churned", name: str | None = None) -> DataFrame:
    """Mean of the label per category (null category dropped), highest first."""
    key = F.col(by) if isinstance(by, str) else by
    key_name = name or (by if isinstance(by, str) else "category")
    return (
        df.select(key.alias(key_name), F.col(label))
        .where(F.col(key_name).isNotNull())
        .groupBy(key_name)
        .agg(F.avg(label).alias("churn_rate"), F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("churn_rate").desc_nulls_last(), key_name)
    )


def rate_by_bin(df: DataFrame, bin_col: str, idx_col: str, label: str = "churned") -> DataFrame:
    """Rate per bin with the bin's order; only observed bins, null bin dropped."""
    return (
        df.where(F.col(bin_col).isNotNull())
        .groupBy(bin_col, idx_col)
        .agg(F.avg(label).alias("churn_rate"), F.count(F.lit(1)).alias("n"))
    )


def rate_by_flags(df: DataFrame, flags: Sequence[str], label: str = "churned") -> DataFrame:
    """Rate per value of each flag column, as ``(flag, value, churn_rate, n)`` rows from
    one pass (the flags are unpivoted, then grouped once)."""
    stacked = df.select(
        F.col(label),
        F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).cast("string").alias("value")) for f in flags])).alias("_kv"),
    ).select("_kv.flag", "_kv.value", label)
    return stacked.where(F.col("value").isNotNull()).groupBy("flag", "value").agg(
        F.avg(label).alias("churn_rate"), F.count(F.lit(1)).alias("n")
    )


def _long(df: DataFrame, cols: Sequence[str], cast: str) -> DataFrame:
    """Unpivot ``cols`` into ``(column, value)`` rows with one ``explode`` (no per-column jobs)."""
    return df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(cast).alias("value")) for c in cols])).alias("_kv")
    ).select("_kv.column", "_kv.value")


def exact_quantiles(long_df: DataFrame, group: str, value: str, probs: Mapping[str, float], n_buckets: int | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles per group, distributed.

    Distinct values are counted per group (map-side combined), a running count in value
    order gives each distinct value its rank interval ``[cum - n, cum)``, and the values at
    ranks ``floor(p (N-1))`` and ``ceil(p (N-1))`` are picked with one conditional aggregate.
    ``group`` must be low-cardinality (a few columns or labels)."""
    counts = stored(long_df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_n")), "value-counts")
    cum = running_totals(counts, value, ["_n"], groups=[group], n_buckets=n_buckets, prefix="_cum")
    totals = counts.groupBy(group).agg(F.sum("_n").alias("_total"))
    x = cum.join(F.broadcast(totals), group)  # one row per group
    aggs = []
    for name, p in probs.items():
        h = F.lit(float(p)) * (F.col("_total") - 1)
        lo, hi = F.floor(h), F.ceil(h)
        start = F.col("_cum_n") - F.col("_n")
        aggs += [
            F.max(F.when((start <= lo) & (lo < F.col("_cum_n")), F.col(value))).alias(f"_lo_{name}"),
            F.max(F.when((start <= hi) & (hi < F.col("_cum_n")), F.col(value))).alias(f"_hi_{name}"),
            F.first(h - lo).alias(f"_fr_{name}"),
        ]
    g = x.groupBy(group).agg(*aggs)
    return g.select(
        group,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_fr_{n}")).alias(n)
            for n in probs
        ],
    )


def describe_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """D7 (numeric part): count, mean, std, min, quartiles, max; one row per column.  A column
    without values has count 0 and nulls."""
    long = _long(df, cols, "double")
    basic = long.groupBy("column").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    q = exact_quantiles(long, "column", "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return basic.join(q, "column", "left").select("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def describe_dates(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """D7 (date part): count, min, max and the mean and quartiles (linear) as days since
    1970-01-01; dates get no std, as in the original's describe."""
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.unix_date(F.col(c)).cast("double").alias("value")) for c in cols])).alias("_kv")
    ).select("_kv.column", "_kv.value")
    basic = long.groupBy("column").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean_days"),
        F.date_from_unix_date(F.min("value").cast("int")).alias("min"),
        F.date_from_unix_date(F.max("value").cast("int")).alias("max"),
    )
    q = exact_quantiles(long, "column", "value", {"q25_days": 0.25, "q50_days": 0.5, "q75_days": 0.75})
    return basic.join(q, "column", "left").select("column", "count", "mean_days", "min", "q25_days", "q50_days", "q75_days", "max")


def describe_categorical(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """D7 (text part): count, unique, top (most frequent; smallest value on ties), freq.  A
    column without values has count and unique 0 and nulls."""
    per_value = _long(df, cols, "string").groupBy("column", "value").agg(F.count("value").alias("n"))
    known = F.col("value").isNotNull()
    return per_value.groupBy("column").agg(
        F.sum("n").alias("count"),
        F.count("value").alias("unique"),
        F.min_by("value", F.when(known, F.struct(-F.col("n"), F.col("value")))).alias("top"),
        F.max(F.when(known, F.col("n"))).alias("freq"),
    )


def null_profile(df: DataFrame, table_name: str) -> DataFrame:
    """Null count per column and row count, one pass."""
    aggs = [F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *aggs)
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_count")) for c in df.columns])
    return one.select(F.lit(table_name).alias("table_name"), F.col("_rows").alias("row_count"), F.explode(pairs).alias("_p")).select(
        "table_name", "_p.column_name", "_p.null_count", "row_count"
    )


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair (pairwise-complete), one aggregate, unpivoted
    into ``(col_a, col_b, corr)`` rows of the full square matrix."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}") for a, b in pairs])
    cells = []
    for a, b in pairs:
        cells.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"{a}__{b}").alias("corr")))
        if a != b:
            cells.append(F.struct(F.lit(b).alias("col_a"), F.lit(a).alias("col_b"), F.col(f"{a}__{b}").alias("corr")))
    return one.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


def share_pivot(df: DataFrame, group: str, category: str, values: Sequence[str], weight: str | None = None) -> DataFrame:
    """Share of each category within each group, wide (one column per given value;
    absent cells null).  Null groups/categories are dropped first.  ``weight`` is a column of
    counts when the rows are counted already."""
    known = df.where(F.col(group).isNotNull() & F.col(category).isNotNull())
    n = F.sum(weight) if weight else F.count(F.lit(1))
    counts = known.groupBy(group, category).agg(n.alias("n"))
    shares = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(group)))
    return shares.groupBy(group).pivot(category, list(values)).agg(F.first("share"))


def box_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers (most extreme values inside the fences) and the
    outlier count per group (nulls where a group has no values; rows without a group are dropped)."""
    long = df.where(F.col(group).isNotNull()).select(F.col(group), F.col(value).cast("double").alias("value"))
    q = exact_quantiles(long, group, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    lo_f = F.col("q1") - F.lit(1.5) * F.col("iqr")
    hi_f = F.col("q3") + F.lit(1.5) * F.col("iqr")
    x = long.join(q, group, "left")
    inside = (F.col("value") >= lo_f) & (F.col("value") <= hi_f)
    return x.groupBy(group).agg(
        F.first("q1").alias("q1"),
        F.first("median").alias("median"),
        F.first("q3").alias("q3"),
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
        F.count(F.lit(1)).alias("n"),
    )


def per_key_ids(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """D18 (re-aimed): per key, the count and id range of its rows.  The original builds a
    key -> list-of-positions map; a list per key would put a hot key's whole history into
    one task, and the search (J4) does not need it, so only the summary is produced."""
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_interactions"),
        F.min(id_col).alias("first_interaction_id"),
        F.max(id_col).alias("last_interaction_id"),
    )


def deviation_from_expected(observed: DataFrame, key: str, expected: DataFrame) -> DataFrame:
    """Observed share per key next to the declared share; absolute deviation.
    ``observed`` has ``key, n, share``; ``expected`` has ``key, expected_share``.  A declared
    key that never occurs has n and share 0, an undeclared one no expected share."""
    d = observed.join(expected, key, "full").fillna(0, ["n", "share"])
    return d.withColumn("abs_deviation", F.abs(F.col("share") - F.col("expected_share")))


def share_within(counts: DataFrame, group: str, key: str, expected: Mapping[object, Mapping[str, float]]) -> DataFrame:
    """D20 per group: observed share of each key within its group next to the declared share.

    ``counts`` has ``group, key, n`` (few rows a group: it is counted already).  A declared cell
    that never occurs has n and share 0, an undeclared one no expected share; null groups and
    keys are dropped."""
    known = counts.where(F.col(group).isNotNull() & F.col(key).isNotNull()).groupBy(group, key).agg(F.sum("n").alias("n"))
    observed = known.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(group)))
    cells = [F.struct(F.lit(g).alias(group), F.lit(k).alias(key), F.lit(float(x)).alias("expected_share")) for g, keys in expected.items() for k, x in keys.items()]
    declared = counts.sparkSession.range(1).select(F.inline(F.array(*cells)))
    d = observed.join(declared, [group, key], "full").fillna(0, ["n", "share"])
    return d.withColumn("abs_deviation", F.abs(F.col("share") - F.col("expected_share")))
