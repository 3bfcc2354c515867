"""Key, reference and constraint checks (A7-A9, A11, J13) and the join operators that
serve them and the lookups (C1-C6).

Uniqueness is a grouped count (partial aggregation first); references are
``left_anti`` / ``left_semi`` equi-joins, so orphans go to a quarantine frame and
valid rows flow on without materialising the referenced table anywhere.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def key_summary(df: DataFrame, key: str, table_name: str) -> DataFrame:
    """Rows, null keys, distinct keys, keys occurring more than once and their rows,
    from one grouped count (the null key forms its own group)."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    real = F.col(key).isNotNull()
    return per_key.agg(
        F.lit(table_name).alias("table_name"),
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0)).alias("n_null_keys"),
        F.count_if(real).alias("n_distinct_keys"),
        F.count_if(real & (F.col("n") > 1)).alias("n_duplicate_keys"),
        F.coalesce(F.sum(F.when(real & (F.col("n") > 1), F.col("n"))), F.lit(0)).alias("n_rows_with_duplicate_key"),
    )


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys with more than one row and their counts."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key has no parent row (quarantine)."""
    p = parent.select(F.col(parent_key).alias("_pk"))
    return child.join(p, child[child_key] == p["_pk"], "left_anti")


def valid_references(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key exists in the parent."""
    p = parent.select(F.col(parent_key).alias("_pk"))
    return child.join(p, child[child_key] == p["_pk"], "left_semi")


def constraint_report(
    df: DataFrame,
    not_null: Sequence[str],
    max_lengths: Mapping[str, int],
    domains: Mapping[str, Sequence],
    ranges: Mapping[str, tuple],
) -> DataFrame:
    """One aggregate of ``count_if`` per (column, check), unpivoted into
    ``(column_name, check_name, violations)``."""
    checks = []
    for c in not_null:
        checks.append((c, "not_null", F.col(c).isNull()))
    for c, n in max_lengths.items():
        checks.append((c, f"max_length_{n}", F.length(F.col(c)) > F.lit(n)))
    for c, vals in domains.items():
        checks.append((c, "domain", F.col(c).isNotNull() & ~F.col(c).isin(list(vals))))
    for c, (lo, hi) in ranges.items():
        checks.append((c, "range", (F.col(c) < F.lit(lo)) | (F.col(c) > F.lit(hi))))
    one = df.agg(*[F.count_if(cond).alias(f"_k{i}") for i, (_, _, cond) in enumerate(checks)])
    cells = [
        F.struct(F.lit(c).alias("column_name"), F.lit(name).alias("check_name"), F.col(f"_k{i}").alias("violations"))
        for i, (c, name, _) in enumerate(checks)
    ]
    return one.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


def latest_per_key(df: DataFrame, key: str, order_col: str, count_col: str | None = None) -> DataFrame:
    """The latest row per key (largest ``order_col``), optionally with the number of
    rows the key has (``> 1`` = the one-to-one rule is broken).  One aggregate with
    map-side combine (``max_by`` over a struct), so a hot key is reduced in every map task
    instead of being sorted in one."""
    others = [c for c in df.columns if c != key]
    aggs = [F.max_by(F.struct(*others), F.col(order_col)).alias("_l")]
    if count_col:
        aggs.insert(0, F.count(F.lit(1)).alias(count_col))
    out = df.groupBy(key).agg(*aggs)
    return out.select(key, *([count_col] if count_col else []), *[F.col(f"_l.{c}").alias(c) for c in others])


def scope_leaks(hits: DataFrame, owners: DataFrame, asked_col: str = "customer_id", id_col: str = "interaction_id") -> DataFrame:
    """Hits whose row belongs to another customer than the one asked for."""
    o = owners.select(F.col(id_col).alias("_id"), F.col("customer_id").alias("_owner"))
    x = hits.join(o, hits[id_col] == o["_id"], "left")
    return x.agg(
        F.count(F.lit(1)).alias("n_hits"),
        F.count_if(F.col("_owner").isNull() | (F.col("_owner") != F.col(asked_col))).alias("n_leaks"),
    )


def lookup(requests: DataFrame, table: DataFrame, req_key: str, key: str) -> DataFrame:
    """Left join of a request table to a keyed table; ``status`` is found / not_found."""
    t = table.withColumnRenamed(key, "_key").withColumn("_found", F.lit(True))
    x = requests.join(t, requests[req_key] == t["_key"], "left").drop("_key")
    return x.withColumn("status", F.when(F.col("_found"), F.lit("found")).otherwise(F.lit("not_found"))).drop("_found")
