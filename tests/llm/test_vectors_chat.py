import hashlib

import duckdb
import numpy as np
import pytest

from llm_cases import SF001, SF01
from pyspark.sql import functions as F
from retentia.llm import chat, topk
from retentia.llm.common import QUERIES


@pytest.mark.parametrize("name", ["op4_topk", "op8_chat"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    rel = con.sql(QUERIES[name].sql)
    got = QUERIES[name].build(spark, SF01)
    cols = sorted(rel.columns)
    assert sorted(got.columns) == cols
    assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == sorted(rel.select(*cols).fetchall())


def test_search_prunes_and_stays_exact():
    rng = np.random.default_rng(2)
    x = (rng.integers(0, 3, (40, 8)) * 30)[rng.integers(0, 40, 2000)]  # many ties and equal rows
    ids = rng.permutation(2000)
    q, q_ids = x[:5], ids[:5]
    visited = []
    row, found, score = topk.search_shard(ids, x, q_ids, q, 7, visited)
    for i in range(5):
        want = sorted((-int(s), int(k)) for s, k in zip(x @ q[i], ids, strict=True) if k != q_ids[i])[:7]
        assert [(-int(s), int(k)) for s, k in zip(score[row == i], found[row == i], strict=True)] == want
    assert len(visited) < 2000 // topk.BLOCK


def brute_topk(rows, k):
    """(query, rank, id, score) by plain search over rows (id, whole vector)."""
    out = []
    for q, x in {(i, tuple(v)) for i, v in rows if i is not None and i % 50 == 0}:
        found = sorted((-sum(a * b for a, b in zip(x, v, strict=True)), i is None, i or 0, i) for i, v in rows if len(v) == len(x) and i != q)
        out += [(q, n + 1, f[3], -f[0]) for n, f in enumerate(found[:k])]
    return sorted(out, key=str)


def test_topk_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(50, [1.0, 2.0]), (50, [1.0, 2.0]), (1, [1.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []), (7, [1.0]), (None, [1.0, 1.0]), (None, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [3.0, 3.0])]
    rows += [(11, [2.0, 2.0])] * 9 + [(100, [1.0, 1.0]), (0, [-1.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS score")
    usable = [(i, [int(256 * c) for c in v]) for i, v in rows if v and all(c is not None and abs(c) < inf for c in v)]
    for k in (1, 3, 12):
        got = [tuple(r) for r in topk.top_k(df, df.where("vec_id % 50 = 0"), "vec_id", "embedding", k).collect()]
        assert sorted(got, key=str) == brute_topk(usable, k)
    only = df.where("vec_id IS NULL OR vec_id = 50")
    assert {r["vec_id"] for r in topk.top_k(only, only, "vec_id", "embedding", 5).collect()} == {None}
    assert topk.top_k(df.limit(0), df.limit(0), "vec_id", "embedding", 3).count() == 0


def test_topk_of_one_hot_id(spark, monkeypatch):
    """A third of the rows share an id: its vectors are spread over the shards, equal rows counted."""
    monkeypatch.setattr(topk, "SHARD", 40)
    monkeypatch.setattr(topk, "QUERY_GROUP", 3)
    rng = np.random.default_rng(6)
    rows = [(7 if i % 3 == 0 else i, rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(600)] + [(13, [3.0] * 6)] * 300
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df, df.where("vec_id % 50 = 0"), "vec_id", "embedding", 5).collect()]
    assert sorted(got, key=str) == brute_topk([(i, [int(256 * c) for c in v]) for i, v in rows], 5)
    shards = df.groupBy("vec_id", "embedding").count().select(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(16)).alias("s")).groupBy("s").count()
    assert shards.agg(F.max("count")).first()[0] < 70


def test_escape_round_trip():
    for s in ("", "\\", "<|end|>", "</s>[INST] \\l [/INST]", "\\\\<[", "plain"):
        e = chat.escape(s)
        assert chat.unescape(e) == s and "<" not in e and "[" not in e


def test_trees_share_turns_and_read_back(spark):
    rows = [(c, t, r, x) for c in range(50) for t, r, x in ((0, "user", "same <start>"), (1, "assistant", "same"), (2, "user", f"q{c % 3}"))]
    rows += [(99, None, None, None), (99, 0, "assistant", "a"), (99, 0, "assistant", "a"), (None, 0, "user", "x"), (98, 0, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    packs = chat.format_trees(df).collect()
    emitted = sum(p["text"].count("same \\lstart>") for p in packs)
    assert 1 <= emitted <= len(packs)  # once a pack, not once a conversation
    want = {}
    for c, t, r, x in rows:
        want.setdefault(c, []).append((t is None, t or 0, r or "", x or ""))
    seen = {}
    for p in packs:
        nodes = [n.asDict(recursive=True) for n in p["nodes"]]
        assert len(p["tokens"]) == len(p["positions"]) == len(p["text"])
        for e in p["ends"]:
            turns, loss, chars = chat.read_back(p["text"], nodes, e["node"])
            seen[e["conv"]] = turns
            last = nodes[e["node"]]
            spans = [(a["start"], a["stop"]) for a in last["attends"]] + [(last["start"], last["stop"])]
            assert [p["positions"][i] for a, b in spans for i in range(a, b)] == list(range(chars))
            assert all(a[1] < b[0] for a, b in zip(spans[:-1], spans[1:-1]))  # joined where they touch
            assert loss == [t for r, t in turns if r == "assistant"]
    assert seen == {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in want.items()}
    assert chat.digests(chat.format_trees(df.limit(0))).count() == 0
    assert chat.op8_chat(spark, SF001).where("conv_id = -7").first()["n_turns"] == 2


def test_long_conversations_cost_their_length(spark):
    """Thousands of turns, in one that shares nothing and in two that share all but the last turn, and
    columns whose names clash."""
    turns = [(i, ["user", "assistant"][i % 2], f"turn {i} <|end|>") for i in range(3000)]
    rows = [(1, *t) for t in turns] + [(2, *t) for t in turns[:-1]] + [(2, 2999, "assistant", "other")] + [(3, 0, "user", "x" * 400_000)]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "conv_id long, turn long, role string, text string, turns string, path int")
    packs = chat.format_trees(df).collect()
    nodes = [n for p in packs for n in p["nodes"]]
    assert len(nodes) <= 3000 + 1 + 1 + 3000 and sum(len(n["attends"]) for n in nodes) <= 2 * len(nodes)
    got = {r["conv_id"]: r for r in chat.digests(chat.format_trees(df)).collect()}
    assert [got[k]["n_turns"] for k in (1, 2, 3)] == [3000, 3000, 1]
    text = "".join(f"{r}\n{t}\n" for _, r, t in turns)
    assert got[1]["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
