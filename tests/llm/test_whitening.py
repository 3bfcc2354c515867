import numpy as np
import pytest

from llm_cases import SF01
from retentia.llm import whitening as W
from retentia.llm.common import QUERIES


def factors():
    rng = np.random.default_rng(1)
    turn = np.linalg.qr(rng.normal(size=(30, 30)))[0]
    yield from (np.triu(rng.normal(size=(d, d))) for d in (1, 2, 3, 64))
    yield np.eye(6)
    yield np.linalg.qr(rng.normal(size=(64, 3)) @ rng.normal(size=(3, 64)), mode="r")
    yield np.linalg.qr(rng.normal(size=(100, 20)) * np.logspace(0, -12, 20), mode="r")
    yield np.linalg.qr(rng.normal(size=(100, 20)) * np.logspace(-12, 0, 20), mode="r")
    for top in ([3, 3, 3, 3, 1], [3, 3 + 1e-9, 3 - 1e-12, 2, 1]):
        yield np.linalg.qr(np.diag(top + [0.5] * 25) @ turn, mode="r")
    yield np.ones((5, 5)) * 1e9


@pytest.mark.parametrize("r", list(factors()), ids=lambda r: str(r.shape))
def test_solver_against_svd(r):
    s2, v = W.directions(r, 4)
    s = np.linalg.svd(r, compute_uv=False)
    assert len(s2) == min(4, int((s > len(r) * 1e-15 * s[0]).sum()))
    assert np.allclose(s2, s[: len(s2)] ** 2, rtol=1e-13)
    assert np.abs(v.T @ v - np.eye(len(s2))).max() < 1e-14
    assert np.abs(r.T @ (r @ v) - v * s2).max() < 1e-13 * s2[0]


def test_zero_matrix_has_no_directions():
    assert W.directions(np.zeros((4, 4)), 4)[1].shape == (4, 0)


def test_dqds_keeps_small_singular_values():
    """Their product is the determinant, however far they spread."""
    for a, b in ((np.logspace(0, -20, 12), np.logspace(-1, -15, 11)), (np.logspace(-18, 0, 40), np.full(39, 1e-9)), (np.ones(50), np.full(49, 3.0))):
        s2 = W.dqds(a, b)
        assert np.isclose(np.log(s2).sum(), 2 * np.log(a).sum(), rtol=1e-12)
        assert np.isclose(s2.sum(), (a * a).sum() + (b * b).sum(), rtol=1e-13)


def check(rows, got):
    """Rows of one length against numpy; ``rows``: (id, whole numbers)."""
    x = np.array([v for _, v in rows], dtype=float)
    fit = np.unique(x, axis=0)
    n, s = len(fit), [sum(int(v) for v in c) for c in fit.T]
    cov = np.cov(fit.T, bias=True).reshape(x.shape[1], -1)
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    k = min(4, int((e > 1e-12 * e[0]).sum()))
    want = (x - fit.mean(axis=0)) @ v[:, :k] / np.sqrt(e[:k])
    dev = [sum((n * int(c) - t) ** 2 for c, t in zip(r, s, strict=True)) for _, r in rows]
    assert len(got) == len(rows) * k
    by = {}
    for r in got:
        assert r["n"] == n and abs(r["identity_error"]) < 1e-9
        assert abs(r["explained"] - e[r["component"] - 1] / np.trace(cov)) < 1e-9
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    for c in range(k):
        mine = [by[i, c + 1].pop() for i, _ in rows]
        assert [r["deviation"] for r in mine] == dev
        a, b = np.array([r["whitened"] for r in mine]), want[:, c]
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8


def whole(v):
    return [int(np.floor(256 * float(c))) for c in v]


def test_query_against_numpy(spark):
    df = QUERIES["op13_whitening"].build(spark, SF01)
    rows = [(r["vec_id"], whole(r["embedding"])) for r in spark.read.parquet(f"{SF01}/embeddings.parquet").collect()]
    check(rows, df.collect())


@pytest.mark.parametrize("parts", [1, 40])
def test_odd_rows(spark, parts):
    rng = np.random.default_rng(3)
    nan, inf = float("nan"), float("inf")
    bad = [(1, None), (2, []), (3, [None] * 6), (4, [nan] * 6), (5, [1.0, inf, 0.0, 0.0]), (6, [1.0, None, 0.0, 0.0])]
    hot = rng.normal(size=6).tolist()
    good = [(10 + i, (rng.normal(size=6) * [9, 5, 3, 2, 1, 0] + 1000).tolist()) for i in range(90)] + [(500 + i, hot) for i in range(60)] + [(7, hot), (7, hot), (None, [-0.0] * 6)]
    short = [(900 + i, [float(i), 2.0 * i, 3.0]) for i in range(9)]  # rank 1
    lone = [(950, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame([(k, v, "n", 3, 0.5) for k, v in bad + good + short + lone], "vec_id long, embedding array<double>, x string, component int, whitened double").repartition(parts)
    got = W.whiten(df).collect()
    ids = {k for k, _ in good}
    check([(k, whole(v)) for k, v in good], [r for r in got if r["vec_id"] in ids])
    check([(k, whole(v)) for k, v in short], [r for r in got if r["vec_id"] in {k for k, _ in short}])
    assert {r["vec_id"] for r in got} == ids | {k for k, _ in short}
    assert [r["component"] for r in got if r["vec_id"] == 900] == [1]
    assert W.whiten(df.limit(0)).collect() == [] == W.whiten(spark.createDataFrame(lone * 3, "vec_id long, embedding array<float>")).collect()


def test_deviations_up_to_a_long():
    c = W.Centre(10, [5, -7])
    x = np.array([[2**27, -(2**27)], [2**29, 0], [2**60, 2**62], [0, 0], [303700050, 0]], dtype=np.int64)
    want = [sum((10 * int(a) - s) ** 2 for a, s in zip(r, [5, -7], strict=True)) for r in x]
    assert c.deviations(x) == [w if w < 2**63 else None for w in want]
    assert c.deviations(x)[2] is None


def test_large_components(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, (rng.normal(size=3) * 1e30).tolist()) for i in range(20)] + [(30 + i, [1e15 + i, 1.0, 2.0 * i]) for i in range(5)], "vec_id int, embedding array<double>")
    got = W.whiten(df).collect()
    assert all(np.isfinite(r["whitened"]) for r in got) and {r["vec_id"] for r in got} == set(range(20)) | set(range(30, 35))
