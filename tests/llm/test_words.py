import numpy as np
import pyarrow as pa

from retentia.llm import words as W

from llm_cases import odd_rows
from retentia.llm import common


def test_word_hashes_follow_bytes_split():
    texts = [r[1] for r in odd_rows()]
    h, first = W.word_hashes(pa.array(texts, pa.string()), lower=True)
    want = [w for t in texts for w in (t or "").encode().lower().split()]
    assert np.diff(first).tolist() == [len((t or "").encode().split()) for t in texts]
    seen = {}
    for w, x in zip(want, h.tolist(), strict=True):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    s = W.sequence_hashes(h, 4)
    runs = {}
    for i in range(len(s)):
        assert runs.setdefault(tuple(want[i : i + 4]), s[i]) == s[i]
    assert len(set(runs.values())) == len(runs)


def test_hot_keys_stay_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    left = spark.createDataFrame([(7 if i % 3 else i, i) for i in range(200)] + [(None, 500)] * 30, "k int, x int")
    right = spark.createDataFrame([(i, str(i)) for i in range(0, 200, 2)] + [(7, "seven")], "k int, y string")
    for how in ("inner", "left"):
        got = common.join_hot(left, right, "k", how)
        assert got.columns == ["k", "x", "y"]
        assert got.exceptAll(left.join(right, "k", how)).count() == 0 == left.join(right, "k", how).exceptAll(got).count()
    assert "BroadcastHashJoin" in common.join_hot(left, right, "k")._jdf.queryExecution().executedPlan().toString()
