"""Registered queries: embedding, vector tables, customer-scoped exact search, context
formatting and the scope-leak audit (J1-J5, J13, C4)."""

from __future__ import annotations

import re
import string
from collections import Counter

from pyspark.sql import functions as F

from retentia import schemas as S
from retentia.functions import vectors as V
from retentia.operators import quality as Q
from retentia.operators import retrieve as R
from retentia.plans.registry import query, r6
from retentia.plans.views_sql import q
from retentia.sources import proxies as P

# The search text used against the interaction history
SEARCH_QUERY = "Customer reports an error with a charge on the bill"
SEARCH_K = 5

EMPTY_CTX_SQL = S.EMPTY_CONTEXT_TEXT.replace("'", "''")


TERMS_SQL = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{V.TERM_RE}')"
HASH_SQL = f"CAST('0x' || substr(md5(t), 1, {V.TERM_HASH_DIGITS}) AS BIGINT)"


def cosine_sql(tokens: str, query_text: str) -> str:
    """The cosine of a token list and a constant query over integer counts."""
    low = query_text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    asked = Counter(re.findall(V.TERM_RE, low))
    dot = " + ".join(f"{n} * len(list_filter({tokens}, lambda x: x = '{t}'))" for t, n in sorted(asked.items())) or "0"
    norms = f"list_sum(list_transform({tokens}, lambda x: len(list_filter({tokens}, lambda y: y = x)))) * {sum(n * n for n in asked.values())}"
    return f"CASE WHEN len({tokens}) > 0 THEN CAST({dot} AS DOUBLE) / sqrt(CAST({norms} AS DOUBLE)) ELSE 0.0 END"


EMB_SQL = ("emb", f"SELECT *, {TERMS_SQL} AS tokens FROM interactions_v")
VEC_SQL = (
    "vec",
    f"""SELECT i.interaction_id, coalesce(v.hs, []) AS hs, coalesce(v.ws, []) AS ws FROM interactions_v i LEFT JOIN (
  SELECT interaction_id, list(h ORDER BY h) AS hs, list(n ORDER BY h) AS ws FROM (
    SELECT interaction_id, {HASH_SQL} AS h, count(*) AS n FROM (SELECT interaction_id, unnest(tokens) AS t FROM emb) GROUP BY ALL)
  GROUP BY interaction_id) v USING (interaction_id)""",
)
HITS_SQL = (
    "hits",
    f"""SELECT * FROM (
  SELECT e.customer_id, e.interaction_id, e.interaction_type, e.sentiment, e.text, e."timestamp", e.sim AS similarity,
         row_number() OVER (PARTITION BY e.customer_id ORDER BY e.sim DESC, e.interaction_id) AS rank
  FROM (SELECT *, {cosine_sql('tokens', SEARCH_QUERY)} AS sim FROM emb) e
  JOIN customers_v c ON e.customer_id = c.customer_id) WHERE rank <= {SEARCH_K}""",
)


def embedded_interactions(spark, sf_dir):
    """J1 (offline embedder): sparse vectors of all words of the interaction texts, in the JVM."""
    return R.embed_text(P.interactions_v(spark, sf_dir), "text", "vector")


def search_hits(spark, sf_dir, k: int = SEARCH_K):
    """J4 over every customer: the SEARCH_QUERY against each customer's own history, scored on
    the scan of the interactions; only k rows a customer and task leave it."""
    cand = embedded_interactions(spark, sf_dir)
    top = R.search_scan(cand, V.sparse_cosine("vector", V.term_vector_literal(SEARCH_QUERY)), k).drop("vector")
    return top.join(P.customers_v(spark, sf_dir).select("customer_id"), "customer_id", "left_semi")


@query(
    "embed_text",
    "J1",
    q(
        """SELECT interaction_id, array_to_string(list_transform(list_zip(hs, ws), lambda x: x[1] || ':' || x[2]), ',') AS vector,
  CAST(coalesce(list_sum(ws), 0) AS BIGINT) AS n_terms FROM vec""",
        EMB_SQL,
        VEC_SQL,
    ),
)
def embed_text(spark, sf_dir):
    e = embedded_interactions(spark, sf_dir)
    cells = F.zip_with(F.col("vector.terms"), F.col("vector.weights"), lambda t, w: F.concat(t.cast("string"), F.lit(":"), w.cast("string")))
    return e.select(
        "interaction_id",
        F.array_join(cells, ",").alias("vector"),
        F.aggregate("vector.weights", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_terms"),
    )


@query(
    "normalize_vectors",
    "J2",
    q(
        """SELECT interaction_id, round(norm, 6) AS norm_before,
  round(coalesce(sqrt(list_sum(list_transform(ws, lambda x: (x / norm) * (x / norm)))), 0.0), 6) AS norm_after,
  round(list_max(list_transform(ws, lambda x: x / norm)), 6) AS max_component
FROM (SELECT *, sqrt(CAST(coalesce(list_sum(list_transform(ws, lambda x: x * x)), 0) AS DOUBLE)) AS norm FROM vec)""",
        EMB_SQL,
        VEC_SQL,
    ),
)
def normalize_vectors(spark, sf_dir):
    e = embedded_interactions(spark, sf_dir).withColumn("nv", V.sparse_normalize("vector"))
    return e.select(
        "interaction_id",
        r6(F.sqrt(V.sparse_norm2(F.col("vector")).cast("double"))).alias("norm_before"),
        r6(V.l2_norm(F.col("nv"))).alias("norm_after"),
        r6(F.array_max("nv")).alias("max_component"),
    )


EMBED_DIM = 64


def model_embed(texts):
    """Stands in for an embedding model: the words of each text hashed into EMBED_DIM counts."""
    import numpy as np

    out = np.zeros((len(texts), EMBED_DIM), dtype="float32")
    for i, t in enumerate(texts):
        found, counts = V.term_vector_py(t)
        np.add.at(out[i], [h % EMBED_DIM for h in found], counts)
    return out


@query(
    "embed_text_model",
    "J1 J2",
    q(
        f"""SELECT i.interaction_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_terms, count(n) AS n_filled, round(coalesce(sqrt(CAST(sum(n * n) AS DOUBLE)), 0.0), 4) AS norm
FROM interactions_v i LEFT JOIN (
  SELECT interaction_id, h % {EMBED_DIM} AS slot, sum(w) AS n FROM (SELECT interaction_id, unnest(hs) AS h, unnest(ws) AS w FROM vec) GROUP BY ALL) s
ON i.interaction_id = s.interaction_id GROUP BY i.interaction_id""",
        EMB_SQL,
        VEC_SQL,
    ),
)
def embed_text_model(spark, sf_dir):
    """J1 through the model hook: Arrow batches of texts to dense vectors."""
    e = R.embed_text(P.interactions_v(spark, sf_dir).select("interaction_id", "text"), "text", "vector", embed_fn=model_embed)
    return e.select(
        "interaction_id",
        F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double")).cast("bigint").alias("n_terms"),
        F.size(F.filter("vector", lambda x: x > 0)).cast("bigint").alias("n_filled"),
        F.round(V.l2_norm(F.col("vector")), 4).alias("norm"),
    )


@query(
    "vector_table_stats",
    "J3 A4",
    q(
        """SELECT customer_id, count(*) AS n_vectors, CAST(min(len(embedding)) AS INTEGER) AS min_dim,
  CAST(max(len(embedding)) AS INTEGER) AS max_dim,
  round(avg(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)))), 6) AS mean_norm
FROM vectors_v GROUP BY customer_id"""
    ),
)
def vector_table_stats(spark, sf_dir):
    """The vector table is written clustered by customer (range-partitioned, sorted in
    files) to the shared folder, then profiled from the stored table."""
    from retentia.session import work_dir
    from retentia.sources import io as IO

    path = IO.write_clustered(P.vectors_v(spark, sf_dir), work_dir(spark, "vector-table"), "customer_id", tiebreak="interaction_id")
    s = R.vector_table_stats(spark.read.parquet(path))
    return s.select("customer_id", "n_vectors", "min_dim", "max_dim", r6("mean_norm").alias("mean_norm"))


@query(
    "scoped_search",
    "J4 E1 C4",
    q(
        "SELECT customer_id, interaction_id, interaction_type, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM hits",
        EMB_SQL,
        HITS_SQL,
    ),
)
def scoped_search(spark, sf_dir):
    h = search_hits(spark, sf_dir)
    return h.select("customer_id", "interaction_id", "interaction_type", r6("similarity").alias("similarity"), F.col("rank").cast("int").alias("rank"))


@query(
    "scoped_search_all",
    "J4 J2 E1",
    q(
        """SELECT customer_id, interaction_id, round(sim, 6) AS similarity, CAST(rk AS INTEGER) AS rank, top_k FROM (
  SELECT v.customer_id, v.interaction_id, r.top_k, list_inner_product(CAST(v.embedding AS DOUBLE[]), r.qv) AS sim,
         row_number() OVER (PARTITION BY v.customer_id ORDER BY list_inner_product(CAST(v.embedding AS DOUBLE[]), r.qv) DESC,
                            v.interaction_id) AS rk
  FROM vectors_v v JOIN req r ON v.customer_id = r.customer_id)
WHERE rk <= top_k""",
        (
            "cm",
            """SELECT customer_id, i, avg(CAST(x AS DOUBLE)) AS m FROM (
  SELECT customer_id, unnest(embedding) AS x, unnest(generate_series(1, len(embedding))) AS i FROM vectors_v)
GROUP BY customer_id, i""",
        ),
        (
            "req",
            """SELECT customer_id, CAST(1 + customer_id % 20 AS INTEGER) AS top_k,
  list_transform(list(m ORDER BY i), lambda x: x / sqrt(sum(m * m))) AS qv FROM cm GROUP BY customer_id""",
        ),
    ),
)
def scoped_search_all(spark, sf_dir):
    """Every customer asks for its own most representative vectors: the query is the
    customer's unit mean vector, ``top_k = 1 + id % 20`` (all of 1..20 occur)."""
    vec = P.vectors_v(spark, sf_dir)
    req = R.centroids(vec).withColumn("request_id", F.col("customer_id")).withColumn(
        "top_k", (F.lit(1) + F.pmod(F.col("customer_id"), F.lit(20))).cast("int")
    )
    hits = R.scoped_search(vec, req, lambda: V.dot(F.col("embedding"), F.col("query_vec")), k_max=S.TOP_K_MAX)
    return hits.select("customer_id", "interaction_id", r6("similarity").alias("similarity"), F.col("rank").cast("int").alias("rank"), "top_k")


def context_sql() -> str:
    line = "CAST(rank AS VARCHAR) || '. [' || interaction_type || ', ' || sentiment || '] ' || text"
    return f"""SELECT c.customer_id, CAST(coalesce(x.n, 0) AS INTEGER) AS n_context, coalesce(x.context_text, '{EMPTY_CTX_SQL}') AS context_text
FROM customers_v c LEFT JOIN (
  SELECT customer_id, count(*) AS n, string_agg({line}, chr(10) ORDER BY rank) AS context_text FROM hits GROUP BY customer_id) x
ON c.customer_id = x.customer_id"""


def customer_contexts(spark, sf_dir, asked=None):
    """J5 for every customer (or the ``asked`` ones): numbered hit lines, or the fixed sentence
    without history."""
    cust = asked if asked is not None else P.customers_v(spark, sf_dir).select("customer_id")
    # only k hits a customer leave the search: those of customers nobody asked for go here
    hits = search_hits(spark, sf_dir).join(cust.select("customer_id").distinct(), "customer_id", "left_semi")
    return R.with_context_text(cust.join(R.context_items(hits, "customer_id"), "customer_id", "left"))


@query("customer_context", "J5 C5 E3 F5", q(context_sql(), EMB_SQL, HITS_SQL))
def customer_context(spark, sf_dir):
    c = customer_contexts(spark, sf_dir)
    return c.select("customer_id", F.coalesce(F.size("context_items"), F.lit(0)).cast("int").alias("n_context"), "context_text")


@query(
    "scope_leak_audit",
    "J13",
    q(
        """SELECT count(*) AS n_hits, count(*) FILTER (WHERE o.customer_id IS NULL OR o.customer_id <> h.customer_id) AS n_leaks
FROM hits h LEFT JOIN interactions_v o ON h.interaction_id = o.interaction_id""",
        EMB_SQL,
        HITS_SQL,
    ),
)
def scope_leak_audit(spark, sf_dir):
    hits = search_hits(spark, sf_dir).select("customer_id", "interaction_id")
    owners = P.interactions_v(spark, sf_dir).select("interaction_id", "customer_id")
    return Q.scope_leaks(hits, owners)
