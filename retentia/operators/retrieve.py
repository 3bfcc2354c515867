"""Embedding, vector tables and customer-scoped exact search.

Search is exact (every candidate row of the customer is scored) and scoped *before*
ranking: candidates are only ever the asked customer's rows, reached by an
equi-join or filter on ``customer_id``.  Ranking is ``row_number() <= k`` per request,
which Spark plans as a partial ``WindowGroupLimit`` before the shuffle, so a customer
with a huge history sends ``k`` rows per map task, not its history.

Candidates are scored where they are read: with one query for everybody (``search_scan``)
the query is a constant of the plan, and requests of their own queries are counted first
and broadcast when they fit ``broadcast_bytes``.  In both cases the only shuffle of
candidates comes after the top-k.  More requests than that meet the candidates in a
shuffled join: hot customers (more candidate rows than ``rows_per_task``) are then split
across several join tasks by salting: the few hot keys are found with a grouped count
(bounded: at most ``total / rows_per_task`` keys, so the hot-key table is broadcast safely),
their rows get a salt, and their requests are replicated once per salt.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentia.functions import text as X
from retentia.functions import vectors as V
from retentia.operators.ranking import top_k_per_key
from retentia.session import stored

ROWS_PER_TASK = 2_000_000
BROADCAST_BYTES = 64 << 20  # requests above this are shuffled
MAX_SALTS = 1 << 17  # a key with 1e12 rows still gets ~8M rows per task


def embed_text(
    df: DataFrame,
    text_col: str = "text",
    out_col: str = "embedding",
    method: str = "terms",
    embed_fn: Callable | None = None,
    dim: int = 256,
    batch_size: int = 256,
) -> DataFrame:
    """Text -> vector column.

    - ``embed_fn``: a model hook ``f(pandas.Series[str]) -> 2-D float array``, run under
      ``mapInPandas`` so each Python worker loads the model once and sees Arrow batches;
      the model itself gets ``batch_size`` texts per call (256 in the original).
    - ``method="terms"`` (default): sparse vector of all words, as sorted term hashes and
      counts (JVM built-ins; its cosine is reproducible in SQL).
    - ``method="keyword"``: whole-word counts over a fixed vocabulary, dense.
    - ``method="hashing"``: tokenizer + feature hashing + L2 normaliser (MLlib, JVM).
    """
    if embed_fn is not None:
        schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.ArrayType(T.FloatType()), True)])

        def run(batches):
            import numpy as np

            for pdf in batches:
                texts = pdf[text_col].fillna("")
                parts = [np.asarray(embed_fn(texts.iloc[i : i + batch_size]), dtype="float32") for i in range(0, len(texts), batch_size)]
                pdf[out_col] = list(np.concatenate(parts)) if parts else []
                yield pdf

        return df.mapInPandas(run, schema)
    if method == "terms":
        return df.withColumn(out_col, V.term_vector(F.col(text_col)))
    if method == "keyword":
        return df.withColumn(out_col, V.keyword_counts(F.col(text_col)))
    if method == "hashing":
        from pyspark.ml import Pipeline
        from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
        from pyspark.ml.functions import vector_to_array

        pipe = Pipeline(
            stages=[
                RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=r"\W+"),
                HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim),
                Normalizer(inputCol="_tf", outputCol="_nv", p=2.0),
            ]
        )
        out = pipe.fit(df).transform(df)
        return out.withColumn(out_col, vector_to_array("_nv", "float32")).drop("_tok", "_tf", "_nv")
    raise ValueError(f"unknown embedding method {method}")


def normalize(df: DataFrame, col: str = "embedding", out_col: str | None = None) -> DataFrame:
    """L2-normalised vectors (zero vectors stay zero)."""
    return df.withColumn(out_col or col, V.l2_normalize(F.col(col)))


def vector_table_stats(vectors: DataFrame) -> DataFrame:
    """Per customer, vector count, dimension range and mean norm."""
    return vectors.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n_vectors"),
        F.min(F.size("embedding")).alias("min_dim"),
        F.max(F.size("embedding")).alias("max_dim"),
        F.avg(V.l2_norm(F.col("embedding"))).alias("mean_norm"),
    )


def search_one(
    vectors: DataFrame, query_vec: Sequence[float], k: int, customer_ids: Sequence[int] | None = None, batched: bool = False
) -> DataFrame:
    """One query vector against the given customers' rows (all customers when None).
    The vector is a plan constant (one vector), so no join is needed; the customer filter
    is pushed into the scan.  ``batched`` scores on Arrow batches (faster for wide vectors)."""
    v = vectors if customer_ids is None else vectors.where(F.col("customer_id").isin(list(customer_ids)))
    if batched:
        q = F.array(*[F.lit(float(x)).cast("double") for x in query_vec])
        scored = v.withColumn("similarity", V.dot_batched(F.col("embedding"), q))
    else:
        scored = v.withColumn("similarity", V.dot_literal(F.col("embedding"), query_vec))
    top = top_k_per_key(scored, "customer_id", [F.col("similarity").desc(), F.col("interaction_id").asc()], k)
    return top.drop("embedding")


def search_scan(candidates: DataFrame, similarity: F.Column, k: int, key: str = "customer_id", id_col: str = "interaction_id") -> DataFrame:
    """J4 with one constant query: every customer's ``k`` most similar rows, scored on the scan."""
    scored = candidates.withColumn("similarity", similarity)
    return top_k_per_key(scored, key, [F.col("similarity").desc(), F.col(id_col).asc()], k)


def table_bytes(df: DataFrame) -> int:
    """Upper bound of a stored table's size when broadcast: eight times the bytes of its rows as JSON
    text, in which every value takes a byte at least."""
    text = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    return 8 * int(df.agg(F.sum(F.octet_length(text).cast("bigint"))).first()[0] or 0)


def _hot_keys(candidates: DataFrame, key: str, rows_per_task: int) -> DataFrame:
    counts = candidates.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") > rows_per_task).select(
        key, F.least(F.ceil(F.col("_n") / F.lit(rows_per_task)), F.lit(MAX_SALTS)).cast("int").alias("_salts")
    )


def scoped_search(
    candidates: DataFrame,
    requests: DataFrame,
    similarity: Callable[[], F.Column],
    k_col: str = "top_k",
    request_key: str = "request_id",
    key: str = "customer_id",
    id_col: str = "interaction_id",
    rows_per_task: int = ROWS_PER_TASK,
    k_max: int = 20,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """J4 for many requests: each request ``(request_id, customer_id, top_k, ...)`` gets the
    ``top_k`` most similar rows of *its own* customer.  ``similarity()`` builds the score
    from the joined columns of a candidate row and its request.  ``k_max`` bounds what a
    request may ask for; one that asks for more is an error, never a shorter answer.

    Returns one row per hit: request columns, candidate columns, ``similarity``, ``rank``.
    """
    too_many = F.raise_error(F.format_string(f"a request asks for %d hits, the limit is {k_max}", F.col(k_col).cast("long")))
    requests = stored(requests.withColumn(k_col, F.when(F.col(k_col) > k_max, too_many.cast("int")).otherwise(F.col(k_col))), "search-requests")
    order = [F.col("similarity").desc(), F.col(id_col).asc()]
    if table_bytes(requests) <= broadcast_bytes:  # counted: candidates stay where they are read
        joined = candidates.join(F.broadcast(requests), key)
        top = top_k_per_key(joined.withColumn("similarity", similarity()), request_key, order, k_max)
        return top.where(F.col("rank") <= F.col(k_col))
    hot = F.broadcast(_hot_keys(candidates, key, rows_per_task))
    c = candidates.join(hot, key, "left").withColumn(
        "_salt",
        F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(F.col(id_col)), F.col("_salts"))).cast("int"),
    ).drop("_salts")
    r = requests.join(hot, key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    ).drop("_salts")
    joined = r.join(c, [key, "_salt"], "inner").drop("_salt")
    scored = joined.withColumn("similarity", similarity())
    # the literal bound lets Spark plan WindowGroupLimit
    top = top_k_per_key(scored, request_key, order, k_max)
    return top.where(F.col("rank") <= F.col(k_col))


def context_items(hits: DataFrame, group: str) -> DataFrame:
    """J5 input: per request, its hits as an array in rank order (``scoped_search`` bounds
    them by its ``k_max``), with their ``timestamp`` where the hits carry one."""
    when = ["timestamp"] if "timestamp" in hits.columns else []
    item = F.struct("rank", "interaction_id", "interaction_type", "sentiment", "text", "similarity", *when)
    return hits.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("context_items"))


def with_context_text(df: DataFrame, items_col: str = "context_items") -> DataFrame:
    """The numbered context text (fixed sentence when there is no history)."""
    return df.withColumn("context_text", X.format_context(F.col(items_col)))


def centroids(vectors: DataFrame, key: str = "customer_id", col: str = "embedding", out_col: str = "query_vec") -> DataFrame:
    """Per-key unit-norm mean vector (a "what is this customer mostly about" query).

    ``Summarizer.mean`` is a JVM aggregate over ``VectorUDT`` with map-side combine, so the
    rows of a key are never gathered: each task folds its rows into one d-vector."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    v = vectors.select(key, array_to_vector(F.col(col)).alias("_v"))
    m = v.groupBy(key).agg(Summarizer.mean(F.col("_v")).alias("_m"))
    return m.select(key, V.l2_normalize(vector_to_array(F.col("_m"), "float64")).alias(out_col))
