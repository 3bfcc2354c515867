import math
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from llm_cases import SF001, SF01, odd_rows
from retentia.llm import lexical as L
from retentia.llm.common import QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    """(item, rank, doc, score) over lists of (key, text)."""
    d = [(key, terms(t)) for key, t in docs]
    d = [(key, Counter(t), len(t)) for key, t in d if t]
    n_docs, total = len(d), sum(n for _, _, n in d)
    df = Counter(t for _, c, _ in d for t in c)
    out = []
    for item, text in {(i, t) for i, t in items if t is not None}:
        ask = Counter(terms(text))
        rows = []
        for key, c, n in d:
            m = 75 + 25 * n * n_docs // total
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in ask.items() if c[t])
            if s > 0:
                rows.append((-s, key is None, key or 0, key))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(rows, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("sf", [SF001, SF01])
def test_matches_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    rel = con.sql(QUERIES["op12_lexical_search"].sql)
    got = QUERIES["op12_lexical_search"].build(spark, sf)
    assert got.columns == rel.columns
    assert sorted(map(tuple, got.collect())) == sorted(rel.fetchall())


def frames(spark, docs, items):
    return (spark.createDataFrame([(k, t, 1, 2, "x") for k, t in docs], "doc_id long, text string, item long, k int, n string"),
            spark.createDataFrame([(k, t, 5, "y") for k, t in items], "item_id int, text string, doc_id int, terms string"))


@pytest.mark.parametrize("block_terms", [L.BLOCK_TERMS, 20])
def test_odd_rows_against_brute_force(spark, block_terms):
    docs = [(r[0], r[1]) for r in odd_rows()] + [(500 + i, f"tie {'pad ' * 3}w{i % 3} É漢 a_b") for i in range(60)]
    items = [(1, "the of tie w1 W1 É漢"), (1, "the of tie w1 W1 É漢"), (1, "tie"), (2, None), (3, ""), (4, "..., !"), (5, "nowhere"), (None, "a b"), (6, docs[5][1]), (7, docs[13][1]), (8, "xX " * 2000 + "É")]
    d, i = frames(spark, docs, items)
    got = L.rank_documents(d, i, k=7, block_terms=block_terms)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, 7)


def test_no_rows(spark):
    d, i = frames(spark, [(1, "a")], [(1, "a")])
    null, _ = frames(spark, [(1, None), (2, "--")], [(1, "a")])
    for x, y in ((d.limit(0), i), (d, i.limit(0)), (null, i), (d.limit(0), i.limit(0))):
        assert L.rank_documents(x, y).columns == ["item_id", "rank", "doc_id", "score"]
        assert L.rank_documents(x, y).count() == 0


def segment(rng, docs, vocabulary):
    """Skewed lists: term 0 in nearly all documents, the last ones in a few."""
    n = rng.integers(5, 60, docs)
    share = 1.2 / np.arange(1, vocabulary + 1)
    owner, term = np.nonzero(rng.random((docs, vocabulary)) < share)
    tf = np.minimum(rng.integers(1, 4, len(owner)), n[owner])
    df = np.bincount(term, minlength=vocabulary)
    return L.Segment(n, owner, term, tf, L.weights(df, docs), docs, int(n.sum()))


def test_hybrid_search_is_exact_and_skips():
    rng = np.random.default_rng(7)
    seg = segment(rng, 9000, 400)
    order = rng.permutation(9000)
    skipped = 0
    for turn in range(40):
        ask = np.unique(rng.integers(0, 400, rng.integers(1, 25)))
        if turn % 2:
            ask = np.unique(np.concatenate([ask, [0, 1, 2]]))
        counts = rng.integers(1, 3, len(ask))
        score = np.zeros(9000, dtype=np.int64)
        for t, c in zip(ask, counts, strict=True):
            at, impact = seg.postings(t)
            score[at] += impact * c
        want = [i for i in np.lexsort((order, -score)) if score[i] > 0][:10]
        for short in (0.0, 1 / 64, L.SHORT, 1.0):
            visited = []
            place, value = seg.search(ask, counts, 10, 0, order, short, visited)
            assert place.tolist() == want and value.tolist() == score[want].tolist()
            skipped += 18 - len(visited)
            floor = int(score[want[len(want) // 2]])
            place, value = seg.search(ask, counts, 10, floor, order, short)
            assert place.tolist() == [i for i in want if score[i] >= floor]
    assert skipped > 100


def test_segments_keep_every_row(monkeypatch):
    monkeypatch.setattr(L, "SEGMENT_DOCS", 7)
    monkeypatch.setattr(L, "SEGMENT_POSTINGS", 20)
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 30, 50)
    cells = [list(range(s)) for s in sizes]
    t = pa.table({"k": pa.array(range(50), pa.int64()), "n": pa.array(range(1, 51), pa.int64()), "terms": pa.array(cells, pa.list_(pa.int32())), "counts": pa.array(cells, pa.list_(pa.int32()))})
    got = list(L.segments(t.to_batches(max_chunksize=9)))
    assert [k for s in got for k in s[0].to_pylist()] == list(range(50))
    assert [n for s in got for n in np.bincount(s[2], minlength=len(s[0])).tolist()] == sizes.tolist()
    assert all(len(s[0]) <= 7 and (len(s[3]) <= 20 or len(s[0]) == 1) for s in got)
