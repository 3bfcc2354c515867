"""Operator 2, quality classifier trained on weak labels.

Heuristic labellers look at a whole text and vote bad, good or abstain; they overlap, and none
is trusted.  The counts of all vote patterns over all documents (one aggregate, at most
3**labellers rows) feed an expectation-maximisation that estimates each labeller's vote
probabilities under good and bad documents without any gold label.  The share of bad documents is estimated with them, between 0.0001 and
0.9999: a corpus may be mostly junk.  The posteriors then label a bounded sample of documents, on which a logistic scorer over hashed word-shape features is
trained; the scorer, not the labellers, decides about every document.

A word's shape has its letters as one class, capitals, digits and each other character as
classes of their own, runs collapsed: it is the same in every language.

Cases: a null text or one without words has score 0 and is not kept.  Repeated rows get equal
scores.  With no documents nothing is trained and the result is empty.  Columns other than the
key and the text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.llm.common import query, sub_batches, table
from retentia.llm.words import mix, span_hashes, text_bytes, word_spans

#: Bound of the fit: about this many documents train the scorer.
SAMPLE_DOCS = 6_000
BUCKETS = 1 << 12
CHUNK = 1 << 20  # bytes of text handled at a time: some 60 bytes of memory each
#: Shares are taken of this many words at least, so that short texts lean towards the prior.
SHORT = 30
#: A document is kept when its score is at least this (losing a clean one costs more).
KEEP = 0.4

_LETTER, _UPPER, _DIGIT = 1, 2, 3
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[128:] = _LETTER
_CLASS[97:123] = _LETTER
_CLASS[65:91] = _UPPER
_CLASS[48:58] = _DIGIT
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#$%&*+<=>@\\^_`{|}~"]] = True

#: (name, statistic, bad from, good up to): votes bad at or over the first, good at or under
#: the second, abstains between.  None: never votes that way.
LABELLERS = [
    ("symbols", "symbol_share", 0.06, None),
    ("few_letters", "other_share", 0.22, 0.12),
    ("symbol_words", "symbol_word_share", 0.20, None),
    ("capitals", "upper_word_share", 0.30, 0.05),
    ("punctuation_runs", "run_share", 0.15, 0.02),
    ("bare_marks", "mark_word_share", 0.15, None),
    ("stutter", "repeat_share", 0.25, None),
    ("few_word_pairs", "pair_repeat_share", 0.40, None),
    ("no_sentences", "words_per_stop", 45.0, 20.0),
]


def statistics(col: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(statistics per text, words per text, feature bucket of every word shape and shape
    pair, text of each feature)."""
    data, offsets = text_bytes(col)
    starts, ends, first = word_spans(data, offsets)
    n_docs, n = len(offsets) - 1, np.diff(first)
    doc = np.repeat(np.arange(n_docs), n)
    cls = _CLASS[data]
    per = np.maximum(n, SHORT)  # a few odd words in a short text prove nothing

    def prefix(flag):  # inclusive counts, for sums over spans
        out = np.zeros(len(flag) + 1, dtype=np.int64)
        np.cumsum(flag, out=out[1:])
        return out

    def by_word(flag):
        p = prefix(flag)
        return p[ends] - p[starts]

    def by_doc(values):
        return np.bincount(doc, weights=values, minlength=n_docs)

    length = ends - starts
    letters, uppers = by_word(cls <= _UPPER), by_word(cls == _UPPER)
    symbols = by_word(_SYMBOL[data])
    chars = np.maximum(by_doc(length), 5 * SHORT)
    mark = ~((cls <= _DIGIT) | (data == 32) | ((data >= 9) & (data <= 13)))
    run = np.zeros(len(data), dtype=bool)
    run[1:] = mark[1:] & (data[1:] == data[:-1])
    stops = by_word((data == ord(".")) | (data == ord("!")) | (data == ord("?")))
    word = span_hashes(data, starts, ends)
    again = np.zeros(len(word), dtype=bool)
    again[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    pair = np.zeros(len(word), dtype=np.uint64)
    pair[1:] = mix(word[1:] * np.uint64(3) + word[:-1])
    inner = np.zeros(len(word), dtype=bool)
    inner[1:] = doc[1:] == doc[:-1]
    order = np.lexsort((pair[inner], doc[inner])) if inner.any() else np.zeros(0, np.int64)
    p, d = pair[inner][order], doc[inner][order]
    seen = np.zeros(len(p), dtype=bool)
    seen[1:] = (p[1:] == p[:-1]) & (d[1:] == d[:-1])
    stats = {
        "symbol_share": by_doc(symbols) / chars,
        "other_share": by_doc(length - letters) / chars,
        "symbol_word_share": by_doc((symbols > 0) & (letters > 0)) / per,
        "upper_word_share": by_doc((uppers >= 2) & (uppers == letters)) / per,
        "run_share": by_doc(by_word(run) > 0) / per,
        "mark_word_share": by_doc((letters == 0) & (by_word(cls == _DIGIT) == 0)) / per,
        "repeat_share": by_doc(again) / per,
        "pair_repeat_share": np.bincount(d, weights=seen, minlength=n_docs) / np.maximum(per - 1, 1),
        "words_per_stop": n / (1.0 + by_doc(np.minimum(stops, 1))),
    }
    # shapes: a byte stays when its class differs from the one before it in its word
    keep = np.ones(len(data), dtype=bool)
    keep[1:] = (cls[1:] != cls[:-1]) | (cls[1:] > _DIGIT)
    keep[starts] = True
    at = prefix(keep)
    shape = span_hashes(cls[keep], at[starts], at[ends])
    pairs = mix(shape[1:] * np.uint64(5) + shape[:-1])[inner[1:]] if len(shape) else shape
    buckets = np.concatenate([shape, pairs]) & np.uint64(BUCKETS - 1)
    return stats, n, buckets.astype(np.int64), np.concatenate([doc, doc[inner]])


def votes(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Vote pattern of each text: base-3 digits, 0 abstains, 1 bad, 2 good."""
    pattern = None
    for _, stat, bad, good in LABELLERS:
        x = stats[stat]
        v = np.where(x >= bad, 1, 0)
        if good is not None:
            v = np.where(x <= good, 2, v)
        pattern = v if pattern is None else pattern * 3 + v
    return pattern.astype(np.int64)


def digits(patterns: np.ndarray) -> np.ndarray:
    k = len(LABELLERS)
    return (np.asarray(patterns)[:, None] // 3 ** np.arange(k - 1, -1, -1)) % 3


@dataclass
class LabelModel:
    """Prior of bad and per class (good, bad) each labeller's vote probabilities."""

    prior: float
    votes: np.ndarray  # 2 x labellers x 3

    def bad(self, patterns: np.ndarray) -> np.ndarray:
        """Posterior that a text with this vote pattern is bad."""
        v = digits(patterns)
        k = np.arange(v.shape[1])
        log = [np.log(self.votes[c][k, v]).sum(axis=1) + np.log(p) for c, p in ((0, 1 - self.prior), (1, self.prior))]
        return 1.0 / (1.0 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over the counted vote patterns, started from each pattern's
    share of bad votes among those cast."""
    v, counts = digits(patterns), np.asarray(counts, dtype=float)
    bad, good = (v == 1).sum(axis=1), (v == 2).sum(axis=1)
    resp = (bad + 0.1) / (bad + 0.25 * good + 1.0)
    for _ in range(rounds):
        prior = float(np.clip((resp @ counts) / max(counts.sum(), 1), 1e-4, 1 - 1e-4))
        tables = np.empty((2, v.shape[1], 3))
        for c, r in ((0, 1 - resp), (1, resp)):
            w = r * counts
            for x in range(3):
                tables[c, :, x] = ((v == x) * w[:, None]).sum(axis=0) + 0.5
            tables[c] /= tables[c].sum(axis=1, keepdims=True)
        model = LabelModel(prior, tables)
        new = model.bad(patterns)
        if np.abs(new - resp).max(initial=0.0) < 1e-7:
            break
        resp = new
    return model


def train_scorer(x: np.ndarray, good: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets (weights, bias); classes weigh the same."""
    w, b = np.zeros(x.shape[1], dtype=np.float32), 0.0
    share = float(np.clip(good.mean(), 0.02, 0.98)) if len(good) else 0.5
    weight = (good * 0.5 / share + (1 - good) * 0.5 / (1 - share)).astype(np.float32)
    m, s, mb, sb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        err = weight * (1.0 / (1.0 + np.exp(-np.clip(x @ w + b, -30, 30))) - good).astype(np.float32)
        g, gb = x.T @ err / len(x) + 1e-6 * w, float(err.mean())
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        mb, sb = 0.9 * mb + 0.1 * gb, 0.999 * sb + 0.001 * gb * gb
        fix, fix2 = 1 - 0.9**t, 1 - 0.999**t
        w -= 0.3 * (m / fix) / (np.sqrt(s / fix2) + 1e-8)
        b -= 0.3 * (mb / fix) / (sb / fix2) ** 0.5 if sb > 0 else 0.0
    return w, b


def fit(docs: DataFrame, key: str, text: str, sample_docs: int = SAMPLE_DOCS):
    """(label model, weights, bias) from all documents' votes and a hashed sample, or None
    where there are no documents with words."""
    src = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))

    def patterns(batches):
        for batch in batches:
            for part in sub_batches(batch, "t", CHUNK):
                stats, n, _, _ = statistics(part.column(1))
                p, c = np.unique(votes(stats)[n > 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(c)], names=["p", "n"])

    got = src.mapInArrow(patterns, "p long, n long").groupBy("p").agg(F.sum("n").alias("n")).collect()
    if not got:
        return None
    got.sort(key=lambda r: r["p"])
    total = sum(r["n"] for r in got)
    model = fit_labels(np.array([r["p"] for r in got]), np.array([r["n"] for r in got]))

    def features(batches):
        for batch in batches:
            for part in sub_batches(batch, "t", CHUNK):
                stats, n, bucket, doc = statistics(part.column(1))
                cell, count = np.unique(doc * BUCKETS + bucket, return_counts=True)
                owner = cell // BUCKETS
                size = np.maximum(np.bincount(owner, weights=count, minlength=len(n)), 2 * SHORT)
                some = pa.array(n > 0)  # a text without words has no cells
                edges = pa.array(np.searchsorted(owner, np.append(np.flatnonzero(n > 0), len(n))), pa.int32())
                cells = (pa.ListArray.from_arrays(edges, pa.array(v)) for v in (cell % BUCKETS, count / size[owner]))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(some), pa.array(votes(stats)).filter(some), *cells], names=["h", "p", "b", "x"])

    share = min(1.0, sample_docs / total)
    h = F.xxhash64(F.lit(29), "k", F.length("t"))
    chosen = src.select(h.alias("h"), "t").where(F.col("t").isNotNull() & (F.pmod("h", F.lit(1_000_003)) < F.lit(share * 1_000_003)))
    rows = chosen.mapInArrow(features, "h long, p long, b array<long>, x array<double>").orderBy("h", "p").limit(2 * sample_docs).collect()
    x = np.zeros((len(rows), BUCKETS), dtype=np.float32)
    for i, r in enumerate(rows):
        x[i, r["b"]] = r["x"]
    good = 1.0 - model.bad(np.array([r["p"] for r in rows], dtype=np.int64)) if rows else np.zeros(0)
    w, b = train_scorer(x, good) if rows else (np.zeros(BUCKETS, dtype=np.float32), 0.0)
    return model, w, b


def score(docs: DataFrame, key: str, text: str, fitted, keep: float = KEEP) -> DataFrame:
    """Per row: key, score (0 to 1), weak_label (posterior of good from the votes), kept."""
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    shared = spark.sparkContext.broadcast(fitted)

    def run(batches):
        model, w, b = shared.value or (None, None, None)
        for batch in batches:
            for part in sub_batches(batch, "t"):
                stats, n, bucket, doc = statistics(part.column(1))
                s = np.zeros(len(n))
                weak = np.zeros(len(n))
                if model is not None:
                    total = np.bincount(doc, weights=w[bucket], minlength=len(n))
                    size = np.maximum(np.bincount(doc, minlength=len(n)), 2 * SHORT)
                    s = 1.0 / (1.0 + np.exp(-np.clip(total / size + b, -50, 50)))
                    weak = 1.0 - model.bad(votes(stats))
                s, weak = np.where(n > 0, s, 0.0), np.where(n > 0, weak, 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array(weak), pa.array(s >= keep)], names=["k", "score", "weak_label", "kept"])

    out = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, score double, weak_label double, kept boolean")
    return out.withColumnRenamed("k", key)


def keep_good(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` (all columns) whose text scores at least ``keep``."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, key, text))
    at = docs.columns.index(text)

    def run(batches):
        fitted = shared.value
        for batch in batches:
            for part in sub_batches(batch, text, CHUNK):
                _, n, bucket, doc = statistics(part.column(at))
                if fitted is None:
                    continue
                total = np.bincount(doc, weights=fitted[1][bucket], minlength=len(n))
                size = np.maximum(np.bincount(doc, minlength=len(n)), 2 * SHORT)
                s = 1.0 / (1.0 + np.exp(-np.clip(total / size + fitted[2], -50, 50)))
                yield part.filter(pa.array((s >= keep) & (n > 0)))

    return docs.mapInArrow(run, docs.schema)


@query("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and decision of the quality classifier for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, "doc_id", "text", fit(docs, "doc_id", "text"))
