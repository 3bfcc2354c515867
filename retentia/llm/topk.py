"""Operator 4, exact top-k inner-product search with block-at-a-time pruning.

Vectors are dealt into shards of about SHARD rows by a hash of id and components; within a
shard they are ordered by their strongest dimensions, so that neighbours resemble each other, and
cut into document-range blocks of BLOCK rows.  A block keeps per dimension ("term") its largest
and smallest component.  A query's bound for a block is the sum over its dimensions of the best
product the block can offer; its blocks are visited by falling bound, and each visited block is
scored in full through its rows (forward index), until the next bound is below the query's
k-th score.  A bound equal to it is still visited, as ties go to the smaller id.

Rows equal in id and components are counted first, on the map side, and of each such group as
many rows go on as can be in a result (k): a hot id is spread by its vectors, a hot row is k rows.

Queries travel to the shards in groups of at most QUERY_GROUP rows, so a task holds one shard
and one group whatever the size of either side; each returns at most k rows per query and the
best k of those are the result.

Cases: vectors that are null, empty or hold a null or non-finite component take no part.  A
query meets vectors of its own length only.  Rows with the query's own id count as its own
row.  Repeated rows of another id are candidates of their own, and so are rows without an id,
which come after all others of their score; without an id no row is a query.  A query row whose id
occurs several times is one query per distinct vector.  Scores beyond a long are clipped to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retentia.llm.common import partitions, query, stored, table

SHARD = 32_768
LEAST_SHARD = 2_048  # smaller tables are dealt to the partitions there are, down to this size
BLOCK = 64
QUERY_GROUP = 8_192


def _matrix(col: pa.Array) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0), np.int64)


def _scores(q: np.ndarray, x: np.ndarray, exact: str) -> np.ndarray:
    """Inner products, exact: in floats where no sum can reach 2**53, else in integers."""
    if exact == "float":
        return (q.astype(float) @ x.T.astype(float)).astype(np.int64)
    if exact == "long":
        return q @ x.T
    big = q.astype(object) @ x.T.astype(object)
    return np.clip(big, -(2**63), 2**63 - 1).astype(np.int64)


def search_shard(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int, visited: list | None = None):
    """(query row, id, score) of the best ``k`` rows of the shard for each query."""
    top = float(np.abs(x.astype(float)).max(initial=0)) * float(np.abs(q.astype(float)).max(initial=0)) * max(1, x.shape[1])
    exact = "float" if top < 2**53 else "long" if top < 2**62 else "object"
    # rows whose strongest dimensions agree stand together
    n_strong = min(3, x.shape[1])
    strong = np.argsort(-np.abs(x.astype(float)), axis=1, kind="stable")[:, :n_strong]
    sign = np.take_along_axis(x, strong, axis=1) > 0
    order = np.lexsort([ids, *((strong * 2 + sign).T[::-1])])
    ids, x = ids[order], x[order]
    cuts = list(range(0, len(ids), BLOCK))
    if exact == "object":
        bounds = np.full((len(q), len(cuts)), np.inf)
    else:
        high = np.stack([x[a : a + BLOCK].max(axis=0) for a in cuts])
        low = np.stack([x[a : a + BLOCK].min(axis=0) for a in cuts])
        bounds = _scores(np.maximum(q, 0), high, exact) + _scores(np.minimum(q, 0), low, exact)
    visit = np.argsort(-bounds, axis=1, kind="stable")
    # per query its best k so far: score falling, then id; unset: no score
    none = np.iinfo(np.int64).min
    best_s = np.full((len(q), k), none, dtype=np.int64)
    best_i = np.full((len(q), k), np.iinfo(np.int64).max, dtype=np.int64)
    filled = np.zeros(len(q), dtype=np.int64)
    active = np.arange(len(q))
    for turn in range(len(cuts)):
        block = visit[active, turn]
        go = (filled[active] < k) | (bounds[active, block] >= best_s[active, k - 1])
        active, block = active[go], block[go]
        if not len(active):
            break
        if visited is not None:
            visited.append(len(active))
        for b in np.unique(block):
            rows = active[block == b]
            a = cuts[b]
            s = _scores(q[rows], x[a : a + BLOCK], exact)
            cand = np.broadcast_to(ids[a : a + BLOCK], s.shape)
            own = cand == q_ids[rows][:, None]
            all_s = np.concatenate([best_s[rows], np.where(own, none, s)], axis=1)
            all_i = np.concatenate([best_i[rows], np.where(own, np.iinfo(np.int64).max, cand)], axis=1)
            pick = np.lexsort((all_i, -all_s.astype(float) if exact == "float" else ~all_s), axis=1)[:, :k]
            best_s[rows] = np.take_along_axis(all_s, pick, axis=1)
            best_i[rows] = np.take_along_axis(all_i, pick, axis=1)
            filled[rows] = np.minimum(k, filled[rows] + (~own).sum(axis=1))
    row, col = np.nonzero(np.arange(k)[None, :] < filled[:, None])
    return row, best_i[row, col], best_s[row, col]


def top_k(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, scale: int = 256) -> DataFrame:
    """(query_id, rank, id, score) of each query's ``k`` best rows of ``vectors``."""
    spark = vectors.sparkSession

    def usable(df):
        x = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where(
            (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
        return x.select("id", F.transform("v", lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))).alias("x"))

    v, q = usable(vectors).groupBy("id", "x").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n")), usable(queries).where("id IS NOT NULL").distinct()
    v = stored(v.select("id", "x", F.explode(F.sequence(F.lit(1), "n")).alias("copy")).drop("copy"), "topk-rows")
    sizes = v.count(), q.count()
    # a task holds one shard, one group and their bounds (SHARD / BLOCK by QUERY_GROUP numbers); every
    # vector travels once a group and every query once a shard, so both are as large as fits
    shards = max(1, -(-sizes[0] // SHARD), min(partitions(spark), sizes[0] // LEAST_SHARD))
    groups = max(1, -(-sizes[1] // QUERY_GROUP))
    slot = lambda n: F.pmod(F.xxhash64("id", "x"), F.lit(n)).cast("int")
    v = v.select("id", "x", F.size("x").alias("d"), slot(shards).alias("s"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    q = q.select("id", "x", F.size("x").alias("d"), slot(groups).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"))

    def run(_, left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "query_no": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return empty
        # ids as their places in id order, rows without one last
        known, q_ids = np.unique(left["id"].drop_null().to_numpy()), right["id"].to_numpy()
        has = left["id"].is_valid().to_numpy()
        place = np.where(has, np.searchsorted(known, left["id"].fill_null(0).to_numpy()), len(known))
        own = np.searchsorted(known, q_ids)
        own = np.where(np.append(known, 0)[own] == q_ids, np.where(own < len(known), own, -1), -1)
        row, found, score = search_shard(place, _matrix(left["x"]), own, _matrix(right["x"]), k)
        ids = pa.array(known).take(pa.array(np.where(found < len(known), found, 0), mask=found >= len(known))) if len(known) else pa.nulls(len(found), pa.int64())
        return pa.table({"query_id": q_ids[row], "query_no": right["no"].to_numpy()[row], "id": ids, "score": score})

    q = q.withColumn("no", F.xxhash64("x"))  # tells queries that share an id apart
    keys = ["d", "s", "g"]
    part = v.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(run, "query_id long, query_no long, id long, score long")
    w = Window.partitionBy("query_id", "query_no").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")


@query(
    "op4_topk",
    """
    WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
               FROM embeddings
               WHERE len(embedding) > 0
                 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    q AS (SELECT vec_id AS query_id, generate_subscripts(v, 1) AS d, unnest(v) AS a FROM e WHERE vec_id % 50 = 0),
    c AS (SELECT vec_id, generate_subscripts(v, 1) AS d, unnest(v) AS b FROM e),
    s AS (SELECT query_id, vec_id, CAST(sum(a * b) AS BIGINT) AS score FROM q JOIN c USING (d)
          WHERE query_id IS DISTINCT FROM vec_id GROUP BY query_id, vec_id),
    r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
)
def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows for every row whose vec_id is divisible by 50, over all embeddings."""
    e = table(spark, sf_dir, "embeddings")
    return top_k(e, e.where(F.col("vec_id") % 50 == 0), "vec_id", "embedding", 5)
