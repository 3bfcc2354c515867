"""Scoped exact search, salting of hot customers, context, embedding hooks."""

import numpy as np
from pyspark.sql import functions as F

from retentia.functions import vectors as V
from retentia.operators import quality as Q
from retentia.operators import retrieve as R
from retentia.session import work_dir


def _cands(spark):
    rng = np.random.default_rng(0)
    rows = []
    iid = 0
    for cust, n in [(1, 40), (2, 3), (3, 1)]:
        for _ in range(n):
            v = rng.normal(size=8)
            v = v / np.linalg.norm(v)
            rows.append((iid, cust, [float(x) for x in v]))
            iid += 1
    return spark.createDataFrame(rows, "interaction_id bigint, customer_id bigint, embedding array<double>"), rows


def _brute(rows, q, k):
    out = {}
    for cust in {r[1] for r in rows}:
        mine = [(float(np.dot(r[2], q)), r[0]) for r in rows if r[1] == cust]
        mine.sort(key=lambda t: (-t[0], t[1]))
        out[cust] = [i for _, i in mine[:k]]
    return out


def test_scoped_search_matches_brute_force_and_salting(spark):
    cands, rows = _cands(spark)
    q = [1.0] + [0.0] * 7
    req = spark.createDataFrame([(10, 1, 5), (11, 2, 5), (12, 3, 5), (13, 4, 5)], "request_id int, customer_id bigint, top_k int")
    want = _brute(rows, q, 5)
    sim = lambda: V.dot_literal(F.col("embedding"), q)
    # scored on the scan, then the shuffled join, whole and with customer 1 in salted pieces
    for size, rows_per_task in ((R.BROADCAST_BYTES, 10**6), (0, 10**6), (0, 7)):
        hits = R.scoped_search(cands, req, sim, rows_per_task=rows_per_task, broadcast_bytes=size)
        got = {}
        for r in hits.orderBy("request_id", "rank").collect():
            got.setdefault(r["customer_id"], []).append(r["interaction_id"])
        assert got == want  # customer 4 has no history: no hits; customer 3 has fewer than k
        leaks = Q.scope_leaks(hits, cands.select("interaction_id", "customer_id")).first()
        assert leaks["n_leaks"] == 0


def test_per_request_k(spark):
    cands, rows = _cands(spark)
    req = spark.createDataFrame([(1, 1, 2), (2, 1, 7)], "request_id int, customer_id bigint, top_k int")
    hits = R.scoped_search(cands, req, lambda: V.dot(F.col("embedding"), F.col("embedding")))
    counts = dict(hits.groupBy("request_id").count().collect())
    assert counts == {1: 2, 2: 7}


def below_first_exchange(df) -> str:
    """The part of the plan under its lowest hash exchange."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[plan.rindex("Exchange hashpartitioning"):]


def test_candidates_are_scored_and_limited_before_their_first_shuffle(spark):
    path = work_dir(spark, "cands")
    _cands(spark)[0].write.parquet(path)
    cands = spark.read.parquet(path)
    req = spark.createDataFrame([(1, 1, 3, [1.0] * 8)], "request_id int, customer_id bigint, top_k int, qv array<double>")
    for hits in (R.scoped_search(cands, req, lambda: V.dot("embedding", "qv")), R.search_scan(cands, V.dot_literal("embedding", [1.0] * 8), 3)):
        part = below_first_exchange(hits)
        assert "WindowGroupLimit" in part and "FileScan" in part and "SortMergeJoin" not in part


def test_request_sizes_are_counted(spark):
    df = spark.createDataFrame([(1, "é" * 100, [1.5] * 10), (2, None, None)], "k int, t string, v array<double>")
    assert 8 * 250 < R.table_bytes(df) < 8 * 320 and R.table_bytes(df.limit(0)) == 0


WORDS = [None, "", " .,!", "error", "Error ERROR error", "a b a_b É é 漢字 漢字", "charge of $17, charge of $18", "x " * 3000 + "y", "1 2 3 " + " ".join(f"w{i % 700}" for i in range(4000))]


def test_term_vectors_hold_every_word(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(WORDS)], "k int, text string").withColumn("v", V.term_vector("text"))
    got = {r["k"]: (r["v"]["terms"], r["v"]["weights"]) for r in df.collect()}
    assert got == {i: V.term_vector_py(t) for i, t in enumerate(WORDS)}
    assert got[4] == got[3][:1] + ([3],) and sum(got[8][1]) == 4003 and len(got[5][0]) == 5


def test_sparse_products_match_python(spark):
    def dot(a, b):
        x, y = (dict(zip(*V.term_vector_py(t), strict=True)) for t in (a, b))
        return sum(n * y.get(t, 0) for t, n in x.items())

    df = spark.createDataFrame([(a, b) for a in WORDS for b in WORDS], "a string, b string")
    df = df.withColumns({"va": V.term_vector("a"), "vb": V.term_vector("b")})
    for r in df.select("a", "b", V.sparse_dot("va", "vb").alias("d"), V.sparse_cosine("va", "vb").alias("c"), V.sparse_normalize("va").alias("n")).collect():
        assert r["d"] == dot(r["a"], r["b"])
        size = dot(r["a"], r["a"]) * dot(r["b"], r["b"])
        assert r["c"] == (r["d"] / size**0.5 if size else 0.0)
        assert not r["n"] or abs(sum(x * x for x in r["n"]) - 1) < 1e-12
    literal = df.select("a", V.sparse_dot("va", V.term_vector_literal("Error of charge charge")).alias("d")).distinct().collect()
    assert all(r["d"] == dot(r["a"], "Error of charge charge") for r in literal)


def test_normalize_and_centroids(spark):
    df = spark.createDataFrame([(1, 1, [3.0, 4.0]), (2, 1, [0.0, 0.0]), (3, 2, [1.0, 1.0])], "interaction_id int, customer_id int, embedding array<double>")
    n = {r["interaction_id"]: r["embedding"] for r in R.normalize(df).collect()}
    assert n[1] == [0.6, 0.8] and n[2] == [0.0, 0.0]
    c = {r["customer_id"]: r["query_vec"] for r in R.centroids(df).collect()}
    assert np.allclose(c[1], [0.6, 0.8]) and np.allclose(c[2], [2 ** -0.5] * 2)


def test_embed_hooks(spark):
    df = spark.createDataFrame([(1, "billing charge error"), (2, "")], "k int, text string")
    kw = {r["k"]: r["embedding"] for r in R.embed_text(df, method="keyword").collect()}
    assert sum(kw[1]) == 3 and sum(kw[2]) == 0
    hs = R.embed_text(df, method="hashing", dim=32).where("k = 1").first()["embedding"]
    assert abs(float(np.linalg.norm(hs)) - 1.0) < 1e-6

    sizes = []

    def fn(texts):
        sizes.append(len(texts))
        return np.stack([np.full(4, len(t), dtype="float32") for t in texts])

    out = {r["k"]: r["embedding"] for r in R.embed_text(df, embed_fn=fn).collect()}
    assert out[1] == [20.0] * 4 and out[2] == [0.0] * 4
    many = spark.createDataFrame([(i, "x" * (i % 7)) for i in range(600)], "k int, text string").coalesce(1)
    got = {r["k"]: r["embedding"][0] for r in R.embed_text(many, embed_fn=fn, batch_size=256).collect()}
    assert all(got[i] == float(i % 7) for i in range(600))


def test_keyword_cosine_matches_numpy(spark):
    qc = V.keyword_counts_py("charge error refund")
    df = spark.createDataFrame([("error charge of $5",), ("nothing here",)], "text string")
    got = [r[0] for r in df.select(V.keyword_cosine(V.keyword_counts("text"), qc)).collect()]
    c = np.array(V.keyword_counts_py("error charge of $5"))
    want = float(c @ np.array(qc) / np.sqrt((c @ c) * (np.array(qc) @ np.array(qc))))
    assert abs(got[0] - want) < 1e-12 and got[1] == 0.0


def test_context_items_ordered(spark):
    hits = spark.createDataFrame(
        [(1, 2, 7, "complaint", "negative", "b", 0.5), (1, 1, 9, "billing_issue", "neutral", "a", 0.9)],
        "customer_id int, rank int, interaction_id int, interaction_type string, sentiment string, text string, similarity double",
    )
    out = R.with_context_text(R.context_items(hits, "customer_id")).first()["context_text"]
    assert out == "1. [billing_issue, neutral] a\n2. [complaint, negative] b"


def test_batched_dot_matches_hof(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=16)], [float(x) for x in rng.normal(size=16)]) for i in range(300)]
    rows.append((300, None, [1.0] * 16))
    df = spark.createDataFrame(rows, "k int, a array<double>, b array<double>")
    got = {r["k"]: (r["x"], r["y"]) for r in df.select("k", V.dot("a", "b").alias("x"), V.dot_batched("a", "b").alias("y")).collect()}
    assert all(abs(x - y) < 1e-9 for k, (x, y) in got.items() if k != 300)
    assert got[300][1] is None


def test_search_one_batched_equals_default(spark):
    cands, rows = _cands(spark)
    q = [0.5] * 8
    a = {(r["customer_id"], r["interaction_id"]) for r in R.search_one(cands, q, 3).collect()}
    b = {(r["customer_id"], r["interaction_id"]) for r in R.search_one(cands, q, 3, batched=True).collect()}
    assert a == b and len(a) == 3 + 3 + 1


def test_context_items_carry_the_time_of_the_hit(spark):
    hits = spark.sql("SELECT 1 AS customer_id, 1 AS rank, 7 AS interaction_id, 'a' AS interaction_type, 'b' AS sentiment, 'c' AS text, 0.5D AS similarity, timestamp_ntz'2024-01-02 03:04:05' AS timestamp")
    assert str(R.context_items(hits, "customer_id").first()["context_items"][0]["timestamp"]) == "2024-01-02 03:04:05"
