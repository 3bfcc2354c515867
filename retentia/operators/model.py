"""Churn model dataflow on MLlib: split, encode, weight, train, search, evaluate, score
(I1-I9) and the model registry (A12).

Everything is a DataFrame stage: the split and the folds are map-side columns computed
from a multiplicative hash of the id and a distributed per-label rank (no
``randomSplit``, whose rows depend on partitioning, and no single-partition window);
one-hot encoding is ``StringIndexer`` + ``OneHotEncoder`` fitted on the training rows
only; boosted trees are MLlib's ``GBTClassifier`` with a weight column.  Metrics reuse
``retentia.operators.metrics`` (exact, distributed), including average precision, which
MLlib's evaluators do not compute (its ``areaUnderPR`` is a trapezoid area).
"""

from __future__ import annotations

import math
import random
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia import schemas as S
from retentia.operators import metrics as M
from retentia.operators.ranking import running_totals
from retentia.session import stored

HASH_MULTIPLIER = 2654435761  # Knuth's multiplicative constant; odd, so a bijection mod 2^32
TWO_31 = 2**31
TWO_32 = 2**32

# The original search space (XGBoost parameter names)
PARAM_DISTRIBUTIONS = {
    "n_estimators": [200, 300, 400],
    "max_depth": [3, 4, 5, 6, 7],
    "learning_rate": [0.01, 0.03, 0.05, 0.1],
    "subsample": [0.7, 0.8, 0.9, 1.0],
    "colsample_bytree": [0.7, 0.8, 0.9, 1.0],
    "min_child_weight": [1, 3, 5],
    "reg_lambda": [0.5, 1, 2, 5],
    "reg_alpha": [0, 0.1, 0.5, 1],
}
# The original learner's defaults, used when nothing is searched
BASE_PARAMS = {"maxIter": 100, "maxDepth": 6, "stepSize": 0.3}
SEARCH_DRAWS = 15
ROWS_PER_FILE = 250_000
# rows of a training task: fewer cost more to schedule at every tree level than to count, more
# make one kept block too large
ROWS_PER_TASK = 20_000
MAX_ROWS_PER_TASK = 500_000
SEARCH_FOLDS = 3
SEED = 42
# XGBoost parameters GBTClassifier has no counterpart for (reported, not applied)
IGNORED_PARAMS = ["reg_lambda", "reg_alpha"]


def hash_key(id_col: str, seed: int = SEED) -> F.Column:
    """Deterministic pseudo-random key per id: ``(id mod 2^31) * 2654435761 + seed`` mod 2^32.
    Unique for ids below 2^31 (larger ones may tie: order by the id after it), computable in
    any SQL engine, independent of partitioning."""
    return F.pmod(F.pmod(F.col(id_col), F.lit(TWO_31)) * F.lit(HASH_MULTIPLIER) + F.lit(seed), F.lit(TWO_32))


def stratified_split(
    df: DataFrame, label: str, id_col: str, test_frac: float = 0.2, n_folds: int = SEARCH_FOLDS, seed: int = SEED
) -> DataFrame:
    """Per label, the ``round(test_frac * n_label)`` rows with the smallest (hash key, id)
    are the test split (exact stratification); the other rows get ``fold`` 0..n_folds-1 by their
    rank, so the search folds are stratified too.

    The per-label rank is a distributed running count (``running_totals`` grouped by label:
    value-range buckets, bounded offset table), never a one-task window."""
    x = df.withColumn("_h", hash_key(id_col, seed)).withColumn("_one", F.lit(1))
    ranked = running_totals(x, "_h", ["_one"], groups=[label], prefix="_rank", ties=[id_col])
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))  # one row per label
    n_test = F.floor(F.col("_n") * F.lit(float(test_frac)) + F.lit(0.5))
    out = ranked.join(F.broadcast(sizes), label).withColumn("is_test", F.col("_rank_one") <= n_test)
    out = out.withColumn(
        "fold", F.when(F.col("is_test"), F.lit(None)).otherwise(F.pmod(F.col("_rank_one") - n_test - 1, F.lit(n_folds))).cast("int")
    )
    return out.drop("_h", "_one", "_rank_one", "_n")


def with_class_weight(train: DataFrame, label: str, weight_col: str = "weight") -> tuple[DataFrame, float]:
    """Positive rows weigh ``negatives / positives`` of the training rows."""
    r = M.class_ratio(train, label).first()
    ratio = float(r["scale_pos_weight"] or 1.0)
    return train.withColumn(weight_col, F.when(F.col(label) == 1, F.lit(ratio)).otherwise(F.lit(1.0))), ratio


def encoder_stages(cat_cols: Sequence[str] = S.CATEGORICAL_COLUMNS, num_cols: Sequence[str] = S.NUMERIC_COLUMNS):
    """Categories in alphabetical order, unseen and null -> all-zero block (the
    "keep" slot is the dropped last one), then categoricals first, numerics after."""
    idx = [f"{c}__idx" for c in cat_cols]
    oh = [f"{c}__oh" for c in cat_cols]
    return [
        StringIndexer(inputCols=list(cat_cols), outputCols=idx, handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=idx, outputCols=oh, dropLast=True),
        VectorAssembler(inputCols=oh + list(num_cols), outputCol="features", handleInvalid="keep"),
    ]


def feature_names(model: PipelineModel, df: DataFrame) -> list[str]:
    """``<column>_<value>`` for each one-hot slot, then the numeric columns (from the
    assembled column's ML attributes)."""
    out = model.transform(df.limit(0))
    attrs = out.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    flat = sorted([a for group in attrs.values() for a in group], key=lambda a: a["idx"])
    names = []
    for a in flat:
        n = a["name"]
        for c in S.CATEGORICAL_COLUMNS:
            pre = f"{c}__oh_"
            if n.startswith(pre):
                n = f"{c}_{n[len(pre):]}"
        names.append(n)
    return names


def gbt(label: str = S.LABEL_COLUMN, weight_col: str = "weight", **params) -> GBTClassifier:
    """Boosted trees with log-loss on the weighted rows."""
    g = GBTClassifier(featuresCol="features", labelCol=label, weightCol=weight_col, seed=SEED, lossType="logistic")
    return g.setParams(**params) if params else g


def map_params(p: dict) -> dict:
    """Original parameter names -> GBTClassifier parameters (see SURVEY I6)."""
    frac = float(p["colsample_bytree"])
    return {
        "maxIter": int(p["n_estimators"]),
        "maxDepth": int(p["max_depth"]),
        "stepSize": float(p["learning_rate"]),
        "subsamplingRate": float(p["subsample"]),
        "featureSubsetStrategy": "all" if frac >= 1.0 else str(frac),
        "minInstancesPerNode": int(p["min_child_weight"]),
    }


def sample_params(n_draws: int = SEARCH_DRAWS, seed: int = SEED, max_trees: int | None = None) -> list[dict]:
    """Seeded random draws, all different, from the original distributions (``max_trees`` caps
    the tree count for a reduced compute budget)."""
    rng = random.Random(seed)
    draws = []
    for number in rng.sample(range(math.prod(map(len, PARAM_DISTRIBUTIONS.values()))), n_draws):
        d = {}
        for k, v in PARAM_DISTRIBUTIONS.items():
            number, i = divmod(number, len(v))
            d[k] = v[i]
        if max_trees:
            d["n_estimators"] = min(int(d["n_estimators"]), int(max_trees))
        draws.append(d)
    return draws


def positive_proba(df: DataFrame, prob_col: str = "probability", out: str = "y_proba") -> DataFrame:
    return df.withColumn(out, vector_to_array(F.col(prob_col))[1])


def encoded(train: DataFrame, label: str = S.LABEL_COLUMN, keep: Sequence[str] = ("fold",)) -> tuple[PipelineModel, DataFrame]:
    """I2-I4 once for all fits: the fitted encoder and the stored (``keep``, label, weight,
    features) table, in files of about ROWS_PER_FILE rows."""
    encoder = Pipeline(stages=encoder_stages()).fit(train)
    table = encoder.transform(train).select(*keep, label, "weight", "features")
    files = max(1, math.ceil(train.count() / ROWS_PER_FILE))
    return encoder, stored(table.repartition(files), "encoded-train")


def training_parts(rows: int, cores: int) -> int:
    """Partitions of a table that one fit reads hundreds of times: every core has a share, none
    under ROWS_PER_TASK rows; above MAX_ROWS_PER_TASK rows a share, whole rounds of the cores."""
    rounds = max(1, math.ceil(rows / (cores * MAX_ROWS_PER_TASK)))
    return max(1, min(rounds * cores, rows // ROWS_PER_TASK))


def training_table(table: DataFrame, key: str = "customer_id", beside: int = 1) -> DataFrame:
    """An encoded table kept for its fit, in even shares over the cores (a scan deals whole files,
    few for few rows) and in the order of its key, so that a fit does not hang on arrival.  Of
    ``beside`` fits at a time each takes its part of the cores: the stages of all of them fill the
    cluster, and a tree level is fewer, longer tasks."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    parts = training_parts(table.count(), max(1, cores // beside))
    return persist(table.repartition(parts, key).sortWithinPartitions(key))


def in_slots(spark: SparkSession, jobs: Sequence[Callable], slots: int) -> list:
    """Results of the jobs in their order, ``slots`` at a time: a fit of a small table leaves most
    cores idle between its stages, so several share the cluster."""
    with ThreadPoolExecutor(max_workers=max(1, slots)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(j)) for j in jobs]]


def free_slots(table: DataFrame) -> int:
    """Fits that fit beside each other: cores over the tasks of one stage."""
    return max(1, table.sparkSession.sparkContext.defaultParallelism // max(1, table.rdd.getNumPartitions()))


def average_precision_of(scored: DataFrame, label: str = S.LABEL_COLUMN, proba: str = "probability") -> float:
    """D17 of a scored frame (scored once: the curve reads stored counts)."""
    s = positive_proba(scored, proba).select(F.col(label).cast("int").alias("y"), "y_proba")
    return float(M.average_precision(M.pr_curve(s)).first()[0] or 0.0)


class AveragePrecisionEvaluator(Evaluator):
    """D17 as an MLlib evaluator: step-wise average precision on the positive-class
    probability, computed by the distributed PR curve (exact, ties grouped)."""

    labelCol = Param(Params._dummy(), "labelCol", "label column", typeConverter=TypeConverters.toString)
    probabilityCol = Param(Params._dummy(), "probabilityCol", "probability column", typeConverter=TypeConverters.toString)

    def __init__(self, labelCol: str = S.LABEL_COLUMN, probabilityCol: str = "probability"):
        super().__init__()
        self._setDefault(labelCol=S.LABEL_COLUMN, probabilityCol="probability")
        self._set(labelCol=labelCol, probabilityCol=probabilityCol)

    def _evaluate(self, dataset: DataFrame) -> float:
        return average_precision_of(dataset, self.getOrDefault(self.labelCol), self.getOrDefault(self.probabilityCol))

    def isLargerBetter(self) -> bool:
        return True


def param_search(table: DataFrame, draws: list[dict], results: str, label: str = S.LABEL_COLUMN, fold_col: str = "fold", slots: int | None = None) -> list[tuple]:
    """Every drawn parameter map on every fold of an encoded table, scored by average
    precision on the fold left out.  Each (draw, fold) is written to its own folder below
    ``results`` when it is done and never fitted again: a search that was stopped goes on where it
    was.  Returns one row per draw: number, the drawn values, mean average precision, seconds."""
    spark = table.sparkSession
    table = persist(table)
    folds = int(table.agg(F.max(fold_col)).first()[0]) + 1
    kind = "draw int, fold int, average_precision double, seconds double"

    def known() -> dict:
        try:
            rows = spark.read.schema(kind).json(f"{results}/*").collect()  # draws x folds rows
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        return {(r["draw"], r["fold"]): r for r in rows if r["average_precision"] is not None}

    def job(i: int, fold: int) -> Callable:
        def run() -> None:
            t0 = time.perf_counter()
            fitted = gbt(label, **map_params(draws[i])).fit(table.where(F.col(fold_col) != fold))
            ap = average_precision_of(fitted.transform(table.where(F.col(fold_col) == fold)), label)
            row = spark.createDataFrame([(i, fold, ap, round(time.perf_counter() - t0, 1))], kind)
            row.coalesce(1).write.mode("overwrite").json(f"{results}/draw{i}-fold{fold}")

        return run

    done = known()
    # the longest fits first, so that the last slots do not wait for one of them
    todo = sorted(((i, f) for i in range(len(draws)) for f in range(folds) if (i, f) not in done), key=lambda x: -draws[x[0]]["n_estimators"] * 2 ** draws[x[0]]["max_depth"])
    in_slots(spark, [job(i, f) for i, f in todo], slots or free_slots(table))
    done = known()
    table.unpersist()
    rows = []
    for i, d in enumerate(draws):
        mine = [done[i, f] for f in range(folds)]
        rows.append((i, *[float(d[k]) for k in PARAM_DISTRIBUTIONS], sum(r["average_precision"] for r in mine) / folds, sum(r["seconds"] for r in mine)))
    return rows


def fit_pipeline(train: DataFrame, label: str = S.LABEL_COLUMN, **gbt_params) -> PipelineModel:
    """Encoder + assembler + weighted GBT as one fitted object."""
    return Pipeline(stages=[*encoder_stages(), gbt(label, **gbt_params)]).fit(train)


def out_of_fold_scores(table: DataFrame, models: Sequence, fold_col: str = "fold") -> DataFrame:
    """Every row of an encoded table scored by the model that was fitted without its fold."""
    parts = [positive_proba(m.transform(table.where(F.col(fold_col) == i))).select(*table.columns, "y_proba") for i, m in enumerate(models)]
    return reduce(DataFrame.unionByName, parts)


def threshold_metrics(scored: DataFrame, threshold: float, label: str = S.LABEL_COLUMN) -> dict:
    """I8: precision/recall/F1/confusion at a threshold (one pass)."""
    return M.precision_recall_f1(scored.select(F.col(label).cast("int").alias("y"), "y_proba"), threshold).first().asDict()


def auc_of(scored: DataFrame, label: str = S.LABEL_COLUMN) -> float | None:
    """D15 of a scored frame."""
    auc = M.roc_auc(M.pr_curve(scored.select(F.col(label).cast("int").alias("y"), "y_proba"))).first()[0]
    return float(auc) if auc is not None else None


def evaluation_rows(scored: DataFrame, threshold: float, label: str = S.LABEL_COLUMN) -> dict:
    """I8: the metrics at a threshold, plus ROC-AUC (one pass each)."""
    return {**threshold_metrics(scored, threshold, label), "roc_auc": auc_of(scored, label)}


def tune_threshold(scored: DataFrame, target: float = S.TARGET_PRECISION, label: str = S.LABEL_COLUMN) -> dict:
    """D16 on a scored frame."""
    s = scored.select(F.col(label).cast("int").alias("y"), "y_proba")
    return M.tuned_threshold(M.pr_curve(s), target).first().asDict()


def persist(df: DataFrame) -> DataFrame:
    """Training input is read once per tree level; keep it, spilling to disk if needed."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
