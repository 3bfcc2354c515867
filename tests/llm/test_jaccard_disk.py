"""What the near-duplicate join keeps on disk: signatures, sets and shuffle files."""

import os
import sys
import time

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_text_operators import brute_components, chained_rows, compared  # noqa: E402

from retentia.llm import jaccard  # noqa: E402
from retentia.llm.common import CLEANUP, stored  # noqa: E402


def some_sets(rng, n, most=900):
    return [np.unique(rng.integers(1, 2**63, int(m)).astype(np.uint64)) for m in np.exp(rng.uniform(0, np.log(most), n))]


def test_classes_lie_in_few_partitions(spark):
    """A class names itself once in each partition that it signs in: those are few, however many
    partitions there are, and each holds about as many signatures."""
    rng = np.random.default_rng(8)
    bands, parts = jaccard.Bands(80, 100), 1200
    sets = some_sets(rng, 1500)
    size = np.array([len(s) for s in sets])
    sig, node, own = jaccard.signatures(sets, bands)
    rows = spark.createDataFrame([(int(n),) for n in size] + [(0,)], "n long")
    start, share = jaccard.deal_bands(rows, bands, int(size.max()), parts)
    band = bands.of(size)[node] + ~own
    p = start[band] + (sig >> np.uint64(40)).astype(np.int64) % share[band]
    assert (np.diff(start) == share[:-1]).all() and p.max() < share.sum() <= parts + len(share)
    entries = len(np.unique(node * 10_000 + p))
    plain = len(np.unique(node * 10_000 + (sig >> np.uint64(40)).astype(np.int64) % parts))
    assert entries < 0.5 * plain
    filled = np.bincount(p, minlength=share.sum())
    assert filled.max() < 3 * len(sig) / parts
    assert [len(x) for x in jaccard.deal_bands(rows.limit(0), bands, 0, parts)] == [2, 2]


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(9)
    for _ in range(300):
        a = some_sets(rng, 1)[0]
        b = np.unique(np.concatenate([a[: int(rng.integers(0, len(a) + 1))], some_sets(rng, 1)[0]]))
        x, none, y = jaccard.sketches([a, np.zeros(0, np.uint64), b])
        apart = len(np.setxor1d(a, b))
        assert none == b"" and jaccard.apart_by(x, y) == jaccard.apart_by(y, x) <= apart and jaccard.apart_by(x, x) == 0
        assert 8 * len(x) >= len(a) and 8 * len(y) >= len(b)
    assert jaccard.sketches([]) == []


def test_chance_candidates_send_no_sets(spark):
    """Of candidate pairs all that link stay; those that share half their shingles go before their sets
    are made, also where one class is in most of the pairs."""
    rng = np.random.default_rng(10)
    bands, sets, pairs = jaccard.Bands(80, 100), [], []
    for a in some_sets(rng, 400, 2000):
        n, k = len(a), int(rng.choice([0, 0.05, 0.1, 0.5, 0.9]) * len(a))
        new = np.unique(rng.integers(1, 2**63, k).astype(np.uint64))
        pairs.append((len(sets) + 1, len(sets)))
        sets += [a, np.unique(np.concatenate([a[: n - k], new]))]
    pairs += [(i, 0) for i in range(2, len(sets))]
    own = spark.createDataFrame([(i, len(s), bytearray(x)) for i, (s, x) in enumerate(zip(sets, jaccard.sketches(sets), strict=True))], "f long, n long, sk binary")
    got = {tuple(r) for r in jaccard.could_link(spark.createDataFrame(pairs, "a long, b long"), own, bands).collect()}
    inter = {(a, b): len(np.intersect1d(sets[a], sets[b])) for a, b in pairs}
    ratio = {(a, b): i / (len(sets[a]) + len(sets[b]) - i) for (a, b), i in inter.items()}
    assert {x for x in pairs if ratio[x] >= 0.8} <= got <= set(pairs)
    far = [x for x in pairs if ratio[x] < 0.5 and len(sets[x[0]]) > 50]
    assert len(far) > 300 and not got & set(far)


def test_open_classes_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PAIRS_UP_TO", 1)
    monkeypatch.setattr(jaccard, "OPEN_SETS", 7)
    monkeypatch.setattr(jaccard, "verify_pairs", lambda p, *a: p.limit(0))
    seen, rows = compared(monkeypatch), chained_rows(np.random.default_rng(22))
    got = jaccard.join_components(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 3, 90, 100, count=False).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == brute_components(rows, 3, 90, 100) and seen["open"] > 100


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for i in range(found.size()) if (f := found.apply(i).getName()).startswith("shuffle_")}


def test_shuffle_files_go_when_a_step_is_written(spark):
    before, setting = shuffle_files(spark), spark.conf.get(CLEANUP, None)
    df = spark.range(100_000).selectExpr("id % 1000 AS k", "id AS x").repartition(8, "k").groupBy("k").applyInArrow(lambda t: t, "k long, x long")
    kept = stored(df, "released", release=True)
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    assert not shuffle_files(spark) - before and kept.count() == 100_000
    assert spark.conf.get(CLEANUP, None) == setting
