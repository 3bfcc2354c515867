"""Readers and sinks: CSV with a declared schema, append-only logs, idempotent bulk
load, clustered side tables, table creation, and the model registry (A1-A5, A10-A12).

All paths are folders of part files, so every sink is written by the executors in
parallel; nothing is funnelled through the driver.  Write locations default to the
shared checkpoint folder (``retentia.session.work_dir``).
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# pandas' default missing-value tokens that Spark's CSV reader keeps as text
PANDAS_NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
                    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


# RFC 4180 text: a quote inside a field is doubled, a field may hold line breaks
CSV_TEXT = {"header": True, "quote": '"', "escape": '"', "multiLine": True}


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """A2: header row, no index column; a folder of part files."""
    df.write.mode(mode).options(header=True, quote='"', escape='"').csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: T.StructType, na_tokens: Sequence[str] | None = None) -> DataFrame:
    """A1: CSV with header and an explicit schema (no inference), failing fast on bad rows.
    Text may hold quotes and line breaks, so one file is read by one task: write many files.

    ``na_tokens``: text values to read as null (string columns), like pandas' NA list.
    String columns are read as text first so the tokens can be matched, then cast."""
    if not na_tokens:
        return spark.read.schema(schema).options(**CSV_TEXT).option("mode", "FAILFAST").csv(path)
    as_text = T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema.fields])
    raw = spark.read.schema(as_text).options(**CSV_TEXT).option("mode", "FAILFAST").csv(path)
    toks = list(na_tokens)
    cols = [
        F.when(F.col(f.name).isin(toks), F.lit(None)).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ]
    return raw.select(*cols)


def append_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Plain append (not idempotent: a re-run duplicates rows)."""
    df.write.mode("append").format(fmt).save(path)


def next_id(spark: SparkSession, path: str, id_col: str, fmt: str = "parquet") -> int:
    """The id after the largest one in the log, 1 where there is no log yet.  Two
    appends to one log must not run at the same time: they would draw the same ids."""
    from pyspark.errors import AnalysisException

    try:
        log = spark.read.format(fmt).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 1
    return (log.agg(F.max(id_col).alias("m")).first()["m"] or 0) + 1


def append_new(spark: SparkSession, df: DataFrame, path: str, key: str, fmt: str = "parquet") -> int:
    """A3 idempotent variant: append only rows whose key is not in the table yet
    (``left_anti`` on the key); returns the number of new rows.  Null keys are an error, a key
    that the batch repeats is appended once; any failure but a missing table is raised.

    The new rows are staged in the shared folder first, so the append copies stored rows:
    a task retried during the append never re-evaluates the anti-join against a table
    that is being written."""
    from pyspark.errors import AnalysisException

    from retentia.session import work_dir

    if df.where(F.col(key).isNull()).limit(1).count():
        raise ValueError(f"append_new: null {key}")
    new = df.dropDuplicates([key])
    try:
        existing = spark.read.format(fmt).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        new = new.join(existing.select(key).distinct(), key, "left_anti")
    stage = work_dir(spark, "append-stage")
    new.write.format(fmt).save(stage)
    staged = spark.read.format(fmt).load(stage)
    n = staged.count()
    if n:
        staged.write.mode("append").format(fmt).save(path)
    return n


def checked_append(
    spark: SparkSession,
    batch: DataFrame,
    path: str,
    key: str,
    references: Mapping[str, tuple[DataFrame, str]] | None = None,
    not_null: Sequence[str] = (),
    max_lengths: Mapping[str, int] | None = None,
    domains: Mapping[str, Sequence] | None = None,
    table_columns: Sequence[str] | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    """A3 behind A7-A9: append the rows of ``batch`` that break no rule to the table at ``path`` and
    return all rows of the batch with ``broken``, the sorted names of the rules each breaks (none:
    appended).  The others are the quarantine.

    Rules: ``key_null``, ``key_repeated`` (the batch holds the key more than once; all such rows
    break it, as none is the right one), ``key_exists`` (the table holds it), ``reference:<c>`` (no row
    of the referenced frame has the value; null refers to nothing and is fine),
    ``not_null:<c>``, ``length:<c>``, ``domain:<c>`` (null is fine).  ``table_columns``: what the table
    holds of the batch (default: all).

    The batch is judged once and stored; the append copies stored rows, so a task retried during
    it never looks at a table that is growing.  Joins are left joins to distinct keys, whose left
    side AQE may split where a key is hot."""
    from pyspark.errors import AnalysisException

    from retentia.session import stored

    rows = stored(batch, "append-batch")
    rules = {"key_null": F.col(key).isNull()}
    repeated = rows.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key, F.lit(True).alias("_repeated"))
    marked = rows.join(repeated, key, "left")
    rules["key_repeated"] = F.col("_repeated").isNotNull()
    try:
        there = spark.read.format(fmt).load(path).select(key).distinct().withColumn("_exists", F.lit(True))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        marked = marked.join(there, key, "left")
        rules["key_exists"] = F.col("_exists").isNotNull()
    for i, (c, (parent, parent_key)) in enumerate((references or {}).items()):
        known = parent.select(F.col(parent_key).alias(c)).distinct().withColumn(f"_known{i}", F.lit(True))
        marked = marked.join(known, c, "left")
        rules[f"reference:{c}"] = F.col(c).isNotNull() & F.col(f"_known{i}").isNull()
    for c in not_null:
        rules[f"not_null:{c}"] = F.col(c).isNull()
    for c, n in (max_lengths or {}).items():
        rules[f"length:{c}"] = F.coalesce(F.length(c) > n, F.lit(False))
    for c, values in (domains or {}).items():
        rules[f"domain:{c}"] = F.col(c).isNotNull() & ~F.col(c).isin(list(values))
    broken = F.array_sort(F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()])))
    judged = stored(marked.select(*batch.columns, broken.alias("broken")), "append-judged")
    judged.where(F.size("broken") == 0).select(*(table_columns or batch.columns)).write.mode("append").format(fmt).save(path)
    return judged


def append_jdbc(df: DataFrame, url: str, table: str, properties: dict | None = None, batchsize: int = 5000) -> None:
    """A3 into a database: multi-row inserts of ``batchsize`` rows (5,000 in the original)
    from every partition in parallel.  Not exercised by the tests: there is no database
    in the test environment."""
    w = df.write.mode("append").format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batchsize)
    for k, v in (properties or {}).items():
        w = w.option(k, v)
    w.save()


def write_clustered(df: DataFrame, path: str, key: str, n_files: int | None = None, tiebreak: str | None = None) -> str:
    """Side table laid out by ``key`` (range-partitioned on ``key`` then ``tiebreak``,
    sorted inside files), so row-group statistics prune per-key reads.  The second range
    column splits a hot key over several files instead of one task writing a third of the
    table."""
    parts = n_files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [key] + ([tiebreak] if tiebreak else [])
    df.repartitionByRange(parts, *cols).sortWithinPartitions(*cols).write.mode("overwrite").parquet(path)
    return path


def write_bucketed(df: DataFrame, table: str, key: str, n_buckets: int, path: str, sort: bool = True) -> str:
    """A4/J3 with a catalog: a table bucketed (and sorted) by ``key`` into ``n_buckets``
    files per writer at ``path``.  Two tables bucketed by the same key into the same
    number of buckets join without a shuffle (sort-merge join on co-located buckets),
    which is how interactions, vectors and customers are kept for repeated per-customer
    work at scale."""
    w = df.write.mode("overwrite").format("parquet").option("path", path).bucketBy(n_buckets, key)
    if sort:
        w = w.sortBy(key)
    w.saveAsTable(table)
    return table


def column_ddl(schema: T.StructType, varchar_limits: dict[str, int] | None = None) -> list[tuple[str, str, bool]]:
    """(name, declared SQL type, nullable) per column; strings with a limit become varchar(n)."""
    limits = varchar_limits or {}
    out = []
    for f in schema.fields:
        typ = f"varchar({limits[f.name]})" if f.name in limits else f.dataType.simpleString()
        out.append((f.name, typ, bool(f.nullable)))
    return out


def create_tables(
    spark: SparkSession, base: str, tables: dict[str, T.StructType], varchar_limits: dict[str, dict[str, int]] | None = None
) -> list[str]:
    """A5: ``CREATE TABLE IF NOT EXISTS ... USING parquet`` from the declared schemas, with
    ``varchar(n)`` where a length is declared (Spark enforces it on insert) and ``NOT NULL``;
    safe to repeat."""
    made = []
    for name, schema in tables.items():
        ddl = column_ddl(schema, (varchar_limits or {}).get(name))
        cols = ", ".join(f"`{c}` {t}{'' if n else ' NOT NULL'}" for c, t, n in ddl)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({cols}) USING parquet LOCATION '{base}/{name}'")
        made.append(name)
    return made


def save_registry(model, metadata: dict, path: str, spark: SparkSession) -> str:
    """The fitted pipeline (encoder + assembler + model as one object) and a one-row
    metadata JSON table next to it."""
    model.write().overwrite().save(f"{path}/model")
    row = {k: (json.dumps(v) if isinstance(v, (list, dict)) else v) for k, v in metadata.items()}
    spark.createDataFrame([row]).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")
    return path


def load_registry(path: str, spark: SparkSession):
    from pyspark.ml import PipelineModel

    model = PipelineModel.load(f"{path}/model")
    meta = spark.read.json(f"{path}/metadata")
    return model, meta
