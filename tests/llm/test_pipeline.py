"""``corpus_pipeline.run`` row by row against plain Python: each stage on its own input."""

import collections
import os
import re
import sys

import numpy as np
import pytest

from llm_cases import SF01

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_text_operators import brute_leaks, brute_rows, key  # noqa: E402

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark):
    """Clean documents of the given tables with planted junk, exact and near copies (also without
    ids and under shared ids), passages of over 50 words, leaks, nulls, empty and long texts."""
    rng = np.random.default_rng(12)
    docs = spark.read.parquet(f"{SF01}/documents.parquet").join(spark.read.parquet(f"{SF01}/labels.parquet").where("quality = 1"), "doc_id")
    clean = [r["text"] for r in docs.where("length(text) BETWEEN 500 AND 3000").orderBy("doc_id").limit(70).collect()]
    items = [(1, " ".join(clean[0].split()[:40])), (2, "水是由氢和氧组成的一种化合物请问它的沸点是多少度呢"), (3, "zyxw vuts rqpo nmlk jihg"), (4, None)]
    passage = " ".join(clean[1].split()[:70])
    texts = [(100 + i, t) for i, t in enumerate(clean[2:50])]
    texts += [(300 + i, clean[2 + i]) for i in range(6)]  # exact copies
    texts += [(400 + i, clean[10 + i] + " and one more") for i in range(6)]  # near copies
    texts += [(None, clean[20] + " tail"), (None, clean[50]), (None, clean[50]), (None, clean[51]), (500, clean[52]), (500, clean[53]), (501, clean[54]), (501, clean[54])]
    texts += [(600 + i, clean[55 + i] + "\n" + passage + "\n" + clean[56 + i]) for i in range(0, 8, 2)]  # a shared passage
    texts += [(700, clean[64] + " " + items[0][1]), (701, clean[65] + "\n" + items[1][1]), (702, clean[66] + " Zyxw, vuts; rqpo nmlk jihg. " + clean[67])]
    texts += [(800 + i, "$$ ## @@ {} <> " * 40 + str(i)) for i in range(5)] + [(900, None), (901, ""), (902, "  \n"), (903, " ".join(clean[:60]))]
    rows = [(k, t, "en", [None, "b", "a", "c"][int(rng.integers(0, 4))], None if t is None else len(t)) for k, t in texts]
    return rows, items


def plain_spans(rows, span=50):
    """Texts without the words under windows that also start in a document with a smaller id."""
    order = lambda k: 2**63 - 1 if k is None else k
    words = [[(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")] for _, t, *_ in rows]
    first = {}
    for (k, t, *_), w in zip(rows, words, strict=True):
        for i in range(len(w) - span + 1):
            x = tuple(t[a:b] for a, b in w[i : i + span])
            first[x] = min(first.get(x, 2**63), order(k))
    out = []
    for (k, t, lang, source, n), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - span + 1):
            if first[tuple(t[a:b] for a, b in w[i : i + span])] < order(k):
                gone.update(range(i, i + span))
        if gone:
            pieces, keep = [], [i for i in range(len(w)) if i not in gone]
            while keep:
                n_run = next((j for j in range(1, len(keep)) if keep[j] != keep[0] + j), len(keep))
                pieces.append(t[w[keep[0]][0] : w[keep[n_run - 1]][1]])
                keep = keep[n_run:]
            t = "\n".join(pieces)
        out.append((k, t, lang, source, None if t is None else len(t)))
    return out


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=key)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows, items = corpus(spark)
    spark.createDataFrame(rows, KIND).repartition(7).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_every_stage_against_plain_python_and_run(spark, folder):
    import corpus_pipeline as C
    from retentia.llm import mixing, quality

    docs = C.table(spark, folder, "documents")
    items = [tuple(r) for r in C.table(spark, folder, "benchmark").collect()]
    given = {}
    for name, stage in C.STAGES:
        given[name] = (rows_of(docs), docs)
        docs = C.stored(stage(spark, docs, folder), f"plain-{name}")
        if name != "mix":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        given[name] += (rows_of(docs),)
    # quality: the rows the scorer keeps, every clean one among them
    before, frame, after = given["quality"]
    scored = quality.score(frame, "doc_id", "text", quality.fit(frame, "doc_id", "text"))
    bad = {r["doc_id"] for r in scored.where("NOT kept").collect()}
    assert bad >= {800, 801, 802, 803, 804, 900, 901, 902} and after == [r for r in before if r[0] not in bad]
    # near duplicates: one row of each component, one with its smallest id
    before, _, after = given["near_duplicates"]
    sets, root = brute_rows([(r[0], r[1]) for r in before], 5, 80, 100)
    groups = collections.defaultdict(list)
    for r, s, c in zip(before, sets, root, strict=True):
        groups[c if s else ("lone", len(groups))].append(r)
    assert len(after) == len(groups) < len(before)
    left = list(after)
    for rows in groups.values():
        ids = [r[0] for r in rows if r[0] is not None]
        mine = next(r for r in left if r in rows and r[0] == min(ids, default=None))
        left.remove(mine)
    assert not left
    # substrings
    before, _, after = given["substrings"]
    assert after == sorted(plain_spans(before), key=key) and after != before
    # decontamination
    before, _, after = given["decontaminate"]
    leaks = collections.Counter((k, bool(ids)) for k, ids, _ in brute_leaks([(r[0], r[1]) for r in before], items))
    assert {k for (k, hit), _ in leaks.items() if hit} >= {700, 701, 702}
    assert collections.Counter(r[0] for r in after) == collections.Counter({k: n for (k, hit), n in leaks.items() if not hit})
    # mix: sizes by plain count, taken words near each source's target
    before, _, after = given["mix"]
    n_words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r[0], r[1]) for r in after if r[0] is not None) == sorted((r[0], n_words(r[1])) for r in before if r[0] is not None)
    source, taken, target = {r[0]: r[3] for r in before}, collections.Counter(), {}
    for r in after:
        if r[0] is not None and list(x[0] for x in before).count(r[0]) == 1:
            target[source[r[0]]] = r[3]
    mixed = mixing.mix_sources(given["mix"][1])
    for r in mixed.collect():
        taken[round(r["target"], 3)] += r["taken"]
    assert all(abs(sum(1 for s in target if round(target[s], 3) == t) * t - n) <= 0.02 * t + 60 for t, n in taken.items())
    # run() applies the same stages to the same rows
    assert rows_of(C.run(spark, folder)) == given["mix"][2]


def test_stages_on_odd_and_empty_tables(spark, tmp_path):
    """Empty tables, tables of nulls only, and extra columns whose names clash go through all stages."""
    import corpus_pipeline as C

    extra = KIND + ", k string, t string, _low string, _items string, _stretches string, o long, th long, part int, h long, size long, row string"
    nulls = [(None,) * 16] * 3 + [(1, None, None, None, None, "k", "t", "l", "i", "s", 1, 2, 3, 4, 5, "r")]
    for name, rows in (("empty", []), ("nulls", nulls)):
        path = str(tmp_path / name)
        docs = spark.createDataFrame(rows, extra)
        docs.write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(1, "a b c d e f g")] if rows else [], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        assert C.run(spark, path).count() == 0
        for stage_name, stage in C.STAGES[:-1]:
            out = stage(spark, docs, path)
            assert out.columns == docs.columns
            assert out.count() == (0 if stage_name == "quality" else len(rows))
        assert C.mix(spark, docs, path).count() == len(rows)
