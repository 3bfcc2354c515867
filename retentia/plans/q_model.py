"""Registered queries: the churn model (I1-I9) and its registry.

Training is done once per data and parameters: the fitted pipeline and, with its
threshold, the released model are published in the model store of the shared folder, and
every later query and session reads them back, as the scorer of the original loads its
artifacts once."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from retentia import schemas as S
from retentia.functions import numeric as N
from retentia.operators import model as ML
from retentia.operators.ranking import dense_ids
from retentia.plans.registry import exit_query, query, r6
from retentia.plans.views_sql import q
from retentia.session import stored, work_dir
from retentia.sources import io as IO
from retentia.sources import proxies as P
from retentia.sources.model_store import ModelStore, model_key

LABEL = S.LABEL_COLUMN
TEST_FRAC = 0.2


def split_sql() -> tuple[str, str]:
    h = f"((customer_id % {ML.TWO_31}) * {ML.HASH_MULTIPLIER} + {ML.SEED}) % {ML.TWO_32}"
    return (
        "split",
        f"""SELECT *, CASE WHEN is_test THEN NULL ELSE CAST((rk - n_test - 1) % {ML.SEARCH_FOLDS} AS INTEGER) END AS fold FROM (
  SELECT *, rk <= n_test AS is_test FROM (
    SELECT *, row_number() OVER (PARTITION BY {LABEL} ORDER BY {h}, customer_id) AS rk,
           floor(count(*) OVER (PARTITION BY {LABEL}) * {TEST_FRAC} + 0.5) AS n_test
    FROM customers_v))""",
    )


TRAIN_SQL = ("train", "SELECT * FROM split WHERE NOT is_test")


def split_customers(spark, sf_dir):
    return ML.stratified_split(P.customers_v(spark, sf_dir), LABEL, "customer_id", TEST_FRAC)


def _split_table(spark, sf_dir):
    """The split written once to the shared folder (cuts the lineage the search re-reads)."""
    return stored(split_customers(spark, sf_dir), "split")


def _key(spark, sf_dir, **params) -> str:
    paths = [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in P.CUSTOMER_INPUTS]
    return model_key(spark, paths, {"learner": "gbt", "seed": ML.SEED, "test": TEST_FRAC, "folds": ML.SEARCH_FOLDS, **params})


def _training(split):
    """The weighted training rows and the weight of a positive one."""
    return ML.with_class_weight(split.where(~F.col("is_test")), LABEL)


def _fits(spark, sf_dir, params, store: ModelStore | None, without_folds: bool) -> tuple[str, list]:
    """The folder of the fit in use (``fitted``) and, ``without_folds``, the models fitted without
    each fold.  All fits that are missing run beside each other, each on a table of its own: a fit
    is some hundred short stages after one another, and the others fill the cores between them.
    The whole table is dealt over all cores and those without a fold over their part of them,
    whatever runs, so a model does not depend on which query asked first."""
    store, key = store or ModelStore(spark), _key(spark, sf_dir, **params)
    path, models = store.current(key), []

    def fit(rows, beside: int):
        table = ML.training_table(rows, beside=beside)
        try:
            return ML.gbt(LABEL, **params).fit(table)
        finally:
            table.unpersist()

    def run(table, whole: bool) -> list:
        jobs = [lambda: fit(table, 1)] if whole else []
        if without_folds:
            jobs += [lambda i=i: fit(table.where(F.col("fold") != i), ML.SEARCH_FOLDS) for i in range(ML.SEARCH_FOLDS)]
        return ML.in_slots(spark, jobs, len(jobs))

    def write(folder: str, name: str) -> None:
        split_customers(spark, sf_dir).write.parquet(f"{folder}/split")
        train, ratio = _training(spark.read.parquet(f"{folder}/split"))
        encoder, table = ML.encoded(train, LABEL, ["customer_id", "fold"])
        model, *rest = run(table, whole=True)
        models.extend(rest)
        table.write.parquet(f"{folder}/train")
        model = PipelineModel([*encoder.stages, model])
        IO.save_registry(model, {"model_version": f"gbt-{key[:8]}-{name[:7]}", "scale_pos_weight": ratio}, folder, spark)

    if path is None:
        return store.publish(key, write), models
    if without_folds:
        models = run(spark.read.parquet(f"{path}/train"), whole=False)
    return path, models


def fitted(spark, sf_dir, params=ML.BASE_PARAMS, store: ModelStore | None = None) -> str:
    """One weighted fit on all training rows, published with its split; the folder of the
    version in use.  Found again by every later session until data or parameters change."""
    return _fits(spark, sf_dir, params, store, without_folds=False)[0]


def released(spark, sf_dir, tune_on: str = "out_of_fold", params=ML.BASE_PARAMS) -> str:
    """I8 + A12: the fitted model with its decision threshold, report and metadata, published.

    ``tune_on="out_of_fold"`` (default) tunes the threshold on the training rows, each scored by
    a model fitted without its fold; ``tune_on="test"`` tunes on the test rows, as the original
    does (its tuned precision is then in-sample)."""
    store, key = ModelStore(spark), _key(spark, sf_dir, tune_on=tune_on, target=S.TARGET_PRECISION, **params)

    def write(folder: str, name: str) -> None:
        source, models = _fits(spark, sf_dir, params, store, without_folds=tune_on == "out_of_fold")
        model, made = IO.load_registry(source, spark)
        made = made.first()

        def on_test():
            test = stored(ML.positive_proba(model.transform(spark.read.parquet(f"{source}/split").where("is_test"))).select(LABEL, "y_proba"), "test-scores")
            return test, ML.auc_of(test)  # the curve has no threshold: once for both rows of the report

        def on_training():
            rows = ML.out_of_fold_scores(spark.read.parquet(f"{source}/train"), models).select(LABEL, "y_proba")
            return ML.tune_threshold(stored(rows, "out-of-fold-scores"), S.TARGET_PRECISION, LABEL)

        if tune_on == "out_of_fold":
            (test, auc), tuned = ML.in_slots(spark, [on_test, on_training], 2)
        else:
            test, auc = on_test()
            tuned = ML.tune_threshold(test, S.TARGET_PRECISION, LABEL)
        report = [(kind, {**ML.threshold_metrics(test, t, LABEL), "roc_auc": auc}) for kind, t in (("default", S.DEFAULT_THRESHOLD), ("tuned", float(tuned["threshold"])))]
        rows = [(kind, float(m["threshold"]), float(m["precision"]), float(m["recall"]), float(m["f1"]), m["roc_auc"], int(m["tn"]), int(m["fp"]), int(m["fn"]), int(m["tp"]), tune_on) for kind, m in report]
        spark.createDataFrame(rows, REPORT).coalesce(1).write.parquet(f"{folder}/report")
        at_tuned = report[1][1]
        metadata = {
            "feature_columns": S.FEATURE_COLUMNS,
            "categorical_columns": S.CATEGORICAL_COLUMNS,
            "numeric_columns": S.NUMERIC_COLUMNS,
            "encoded_feature_names": ML.feature_names(model, spark.read.parquet(f"{source}/split")),
            "decision_threshold": float(tuned["threshold"]),
            "target_precision": S.TARGET_PRECISION,
            "test_precision": float(at_tuned["precision"]),
            "test_recall": float(at_tuned["recall"]),
            "test_roc_auc": at_tuned["roc_auc"],
            "scale_pos_weight": made["scale_pos_weight"],
            "model_version": f"{made['model_version']}-{key[:4]}{name[:7]}",
        }
        IO.save_registry(model, metadata, folder, spark)

    return store.current(key) or store.publish(key, write)


REPORT = ("threshold_kind string, threshold double, precision double, recall double, f1 double, roc_auc double, "
          "tn bigint, fp bigint, fn bigint, tp bigint, tuned_on string")


def search(spark, sf_dir, draws: int = ML.SEARCH_DRAWS, max_trees: int | None = None, slots: int | None = None) -> list[tuple]:
    """The drawn maps x folds on one encoded table; results per fit in the shared folder,
    under a key of the data and the draws, so a search goes on where another session stopped."""
    drawn = ML.sample_params(draws, max_trees=max_trees)
    split = _split_table(spark, sf_dir)
    train, _ = _training(split)
    _, table = ML.encoded(train, LABEL)
    return ML.param_search(table, drawn, f"{ModelStore(spark).root}/search-{_key(spark, sf_dir, draws=drawn)}", LABEL, slots=slots)


# ---------------------------------------------------------------------------
# SQL-checked
# ---------------------------------------------------------------------------
@query(
    "split_balance",
    "I1",
    q(
        f"""SELECT {LABEL}, count(*) AS n, count(*) FILTER (WHERE is_test) AS n_test,
  round(count(*) FILTER (WHERE is_test) / count(*), 6) AS test_share,
  count(*) FILTER (WHERE fold = 0) AS n_fold0, count(*) FILTER (WHERE fold = 1) AS n_fold1,
  count(*) FILTER (WHERE fold = 2) AS n_fold2 FROM split GROUP BY {LABEL}""",
        split_sql(),
    ),
)
def split_balance(spark, sf_dir):
    s = _split_table(spark, sf_dir)
    return s.groupBy(LABEL).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("is_test").alias("n_test"),
        r6(F.count_if("is_test") / F.count(F.lit(1))).alias("test_share"),
        *[F.count_if(F.col("fold") == i).alias(f"n_fold{i}") for i in range(ML.SEARCH_FOLDS)],
    )


def _slot_sql(c: str) -> str:
    return (
        f"(SELECT CAST(r - 1 AS INTEGER) FROM (SELECT v, row_number() OVER (ORDER BY v) AS r FROM "
        f"(SELECT DISTINCT {c} AS v FROM train WHERE {c} IS NOT NULL)) d WHERE d.v = s.{c}) AS {c}_slot"
    )


@query(
    "one_hot",
    "I2 B2",
    q(
        "SELECT customer_id, " + ", ".join(_slot_sql(c) for c in S.CATEGORICAL_COLUMNS) + " FROM customers_v s",
        split_sql(),
        TRAIN_SQL,
    ),
)
def one_hot(spark, sf_dir):
    """Encoder fitted on the training rows, applied to every customer: the active slot of
    each categorical block, null when the block is all zeros (unseen or null value)."""
    from pyspark.ml import Pipeline

    stages = ML.encoder_stages()[:2]
    tr = _split_table(spark, sf_dir).where(~F.col("is_test"))
    enc = Pipeline(stages=stages).fit(tr)
    out = enc.transform(P.customers_v(spark, sf_dir))
    cols = []
    for c in S.CATEGORICAL_COLUMNS:
        pos = F.array_position(vector_to_array(F.col(f"{c}__oh")), F.lit(1.0)).cast("int")
        cols.append(F.when(pos > 0, pos - 1).cast("int").alias(f"{c}_slot"))
    return out.select("customer_id", *cols)


def _names_sql() -> str:
    parts = [f"SELECT DISTINCT {i} AS g, '{c}' AS col, {c} AS v FROM train WHERE {c} IS NOT NULL" for i, c in enumerate(S.CATEGORICAL_COLUMNS)]
    cats = "\nUNION ALL\n".join(parts)
    nums = " UNION ALL ".join(f"SELECT {i} AS j, '{c}' AS name" for i, c in enumerate(S.NUMERIC_COLUMNS))
    return q(
        f"""SELECT CAST(row_number() OVER (ORDER BY g, v) - 1 AS INTEGER) AS position, col || '_' || v AS name FROM ({cats})
UNION ALL
SELECT CAST((SELECT count(*) FROM ({cats})) + j AS INTEGER), name FROM ({nums})""",
        split_sql(),
        TRAIN_SQL,
    )


@query("feature_names", "I3 I4", _names_sql())
def feature_names_query(spark, sf_dir):
    from pyspark.ml import Pipeline

    tr = _split_table(spark, sf_dir).where(~F.col("is_test"))
    model = Pipeline(stages=ML.encoder_stages()).fit(tr)
    names = ML.feature_names(model, tr)  # one name per feature slot: bounded by the schema
    return spark.createDataFrame(list(enumerate(names)), "position int, name string")


@query(
    "class_weights",
    "I5 D12",
    q(
        """SELECT customer_id, churned, round(CASE WHEN churned = 1 THEN
  (SELECT count(*) FILTER (WHERE churned = 0) / count(*) FILTER (WHERE churned = 1) FROM train) ELSE 1.0 END, 6) AS weight FROM train""",
        split_sql(),
        TRAIN_SQL,
    ),
)
def class_weights(spark, sf_dir):
    tr = _split_table(spark, sf_dir).where(~F.col("is_test"))
    w, _ = ML.with_class_weight(tr, LABEL)
    return w.select("customer_id", LABEL, r6("weight").alias("weight"))


# ---------------------------------------------------------------------------
# Model training and scoring (rows-checked; model parity is not a goal)
# ---------------------------------------------------------------------------
@query("train_gbt", "I6 I4 I5")
def train_gbt(spark, sf_dir, store=None):
    """One weighted fit with the learner's default rounds and depth on all training rows, published
    in ``store`` (default: the shared registry, where a model of these data may be already)."""
    path = fitted(spark, sf_dir, store=store)
    model, made = IO.load_registry(path, spark)
    g = model.stages[-1]
    test = spark.read.parquet(f"{path}/split").where("is_test")
    # scored once: the curve reads the rows several times
    scored = stored(ML.positive_proba(model.transform(test)).select(LABEL, "y_proba"), "test-scores")
    auc = ML.evaluation_rows(scored, S.DEFAULT_THRESHOLD, LABEL)["roc_auc"]
    row = (int(g.getNumTrees), int(g.totalNumNodes), int(g.numFeatures), float(auc or 0.0), made.first()["model_version"])
    return spark.createDataFrame([row], "n_trees int, total_nodes int, n_features int, test_roc_auc double, model_version string")


@exit_query("param_search", "I7 D17")
def param_search(spark, sf_dir):
    """The whole search: 15 draws x 3 folds of 200-400 trees.  Beyond the limits of a registered
    query (README, Deviations): run it with ``python -m retentia run param_search``."""
    cols = ", ".join(f"{k} double" for k in ML.PARAM_DISTRIBUTIONS)
    return spark.createDataFrame(search(spark, sf_dir), f"draw int, {cols}, avg_average_precision double, fit_seconds double")


@query("evaluation_report", "I8 D13 D14 D15 D16")
def evaluation_report(spark, sf_dir):
    return spark.read.parquet(f"{released(spark, sf_dir)}/report")


def score_all(spark, sf_dir, model_path: str | None = None):
    """Score every customer with the released model and its tuned threshold
    (model and threshold loaded once; the model travels to executors with the plan)."""
    model, meta = IO.load_registry(model_path or released(spark, sf_dir), spark)
    made = meta.select("decision_threshold", "model_version").first()
    thr = float(made["decision_threshold"])
    scored = ML.positive_proba(model.transform(P.customers_v(spark, sf_dir)))
    scored = scored.select(
        "customer_id",
        F.col("y_proba").alias("churn_probability"),
        (F.col("y_proba") >= F.lit(thr)).cast("int").alias("predicted_label"),
        F.lit(thr).alias("threshold_used"),
        F.lit(made["model_version"]).alias("model_version"),
    )
    # scored once: the ids read the rows several times
    return dense_ids(stored(scored, "scored"), ["customer_id"], "prediction_id")


@query("score_customers", "I9 A10")
def score_customers(spark, sf_dir):
    s = score_all(spark, sf_dir)
    return s.select(
        "prediction_id", "customer_id", r6("churn_probability").alias("churn_probability"), "predicted_label",
        "threshold_used", "model_version",
        N.created_at(P.FIXED_CREATED_AT).alias("created_at"),
    )


@query("model_metadata", "A12")
def model_metadata(spark, sf_dir):
    _, meta = IO.load_registry(released(spark, sf_dir), spark)
    return meta.select(*[F.col(k).cast("string").alias(k) for k in sorted(meta.columns)])


TABLE_PREFIX = "retentia_"


def _declared():
    return {k: IO.column_ddl(v, S.VARCHAR_LIMITS.get(k)) for k, v in S.TABLES.items()}


def _table_schemas_sql() -> str:
    from retentia.plans.q_quality import PREDICTIONS_SQL
    from retentia.plans.q_recommend import ATTEMPTS_SQL, JOB_CTES, JOB_SQL

    source = {"customers": "customers_v", "interactions": "interactions_v", "predictions": "predictions", "recommendations": "job"}
    parts = []
    for t, cols in _declared().items():
        for i, (c, typ, nullable) in enumerate(cols):
            parts.append(
                f"SELECT '{TABLE_PREFIX}{t}' AS table_name, {i} AS position, '{c}' AS column_name, '{typ}' AS data_type, "
                f"{str(nullable).lower()} AS nullable, (SELECT count(*) FROM {source[t]}) AS n_rows, "
                f'(SELECT count(*) FILTER (WHERE "{c}" IS NULL) FROM {source[t]}) AS n_nulls'
            )
    body = "SELECT table_name, CAST(position AS INTEGER) AS position, column_name, data_type, nullable, n_rows, n_nulls FROM (\n"
    body += "\nUNION ALL\n".join(parts) + ")"
    ctes = [c for c in JOB_CTES if c[0] != "predictions"]
    return q(body, PREDICTIONS_SQL, *ctes, *ATTEMPTS_SQL, ("job", JOB_SQL))


@query("table_schemas", "A5 A9 A10 A11", _table_schemas_sql())
def table_schemas(spark, sf_dir):
    """A5: CREATE TABLE IF NOT EXISTS for the four declared tables (twice: safe to repeat),
    then INSERT OVERWRITE of the engine's own rows (customers, interactions, the prediction
    log, the at-risk job's log) through the declared schemas, which enforces the
    varchar limits; reported per column with the declared type, row count and nulls found
    (NOT NULL is declared but not enforced by file-based tables, so it is counted here)."""
    from retentia.plans.q_quality import predictions_log
    from retentia.plans.q_recommend import at_risk_job

    base = work_dir(spark, "tables")
    names = {k: f"{TABLE_PREFIX}{k}" for k in S.TABLES}
    tables = {names[k]: v for k, v in S.TABLES.items()}
    limits = {names[k]: v for k, v in S.VARCHAR_LIMITS.items()}
    IO.create_tables(spark, base, tables, limits)
    IO.create_tables(spark, base, tables, limits)
    data = {
        "customers": P.customers_v(spark, sf_dir),
        "interactions": P.interactions_v(spark, sf_dir),
        "predictions": predictions_log(spark, sf_dir),
        "recommendations": at_risk_job(spark, sf_dir),
    }
    out = None
    for k, cols in _declared().items():
        names_k = [c for c, _, _ in cols]
        data[k].select(*names_k).write.insertInto(names[k], overwrite=True)
        t = spark.table(names[k])
        stats = t.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in names_k])
        cells = F.array(*[
            F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"), F.lit(typ).alias("data_type"),
                     F.lit(nullable).alias("nullable"), F.col(c).alias("n_nulls"))
            for i, (c, typ, nullable) in enumerate(cols)
        ])
        rows = stats.select(F.lit(names[k]).alias("table_name"), F.col("_n").alias("n_rows"), F.explode(cells).alias("_c")).select(
            "table_name", "_c.position", "_c.column_name", "_c.data_type", "_c.nullable", "n_rows", "_c.n_nulls"
        )
        out = rows if out is None else out.unionByName(rows)
    return out
