"""Operator 3, language-model scoring by deleted interpolation.

The model mixes three estimates, bigram and unigram maximum likelihood and the uniform one,

    P(w | v) = a(b) * c(v w) / c(v) + u(b) * c(w) / N + z(b) / (V + 1),

with weights per bucket ``b`` of the context's frequency (its power of two).  The weights come
from expectation-maximisation over all training bigrams, each held out of its own counts
("deleted": c - 1).  A context never seen uses the first bucket's weights without ``a``.
Probabilities sum to one over the V training types and one unknown word.

How the work is dealt (N tokens, chunks of about CHUNK bytes of text):

1. Unigrams are counted with map-side aggregation and stored.  Words with at least a 2**20th of
   all tokens, held out or not, at most 2**20 of them, are broadcast with their counts ("hot").
2. Every chunk sends its bigrams once, in compact blocks, to the partition that can count
   them: hot pairs by pair, a rare context by context, a rare word by word (a pair rare on
   both sides goes to both).  A pair that fills a chunk sends one count instead of one entry
   per occurrence, so a pair that makes up a third of a corpus costs one entry a chunk.
3. The partitions count; a first job over them gathers the held-out statistics (cells of
   quantised probabilities, bounded) for the weights, a second, over the same shuffle files,
   sends each chunk its documents' sums, where they are added up.

Cases: null text is empty and has one token, the end.  Null doc_id counts as training.
Repeated rows are documents of their own.  No training rows: N = V = 0, every word is unknown.
"""

from __future__ import annotations

import math
import pickle
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.llm.common import fold, partitions, query, stored, sub_batches, table
from retentia.llm.words import mix, word_hashes

CHUNK = 4 << 20
HOT_BITS = 20
HOT = 1 << HOT_BITS
TOKENS_PER_PARTITION = 1_500_000
#: A pair with this many occurrences in a chunk sends their number only.
HEAVY = 64

START, END = np.uint64(0x5353535353535353), np.uint64(0x4545454545454545)


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes with an end token after each text, text of each token)."""
    h, first = word_hashes(col, lower=True)
    n = np.diff(first)
    w = np.insert(h, first[1:], END)
    return w, np.repeat(np.arange(len(n)), n + 1)


def count_words(docs: DataFrame) -> DataFrame:
    """(h, c, n): hash of every token type, its count in the rows with ``held`` false and in all."""

    def run(batches):
        for batch in batches:
            for part in sub_batches(batch, "t", CHUNK):
                w, doc = tokens(part.column(2))
                trains = ~part.column(1).to_numpy(zero_copy_only=False)
                u, inverse, n = np.unique(w, return_inverse=True, return_counts=True)
                c = np.bincount(inverse, weights=trains[doc], minlength=len(u)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c), pa.array(n)], names=["h", "c", "n"])

    return docs.mapInArrow(run, "h long, c long, n long").groupBy("h").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


class Counts:
    """N, V and the hot words (sorted hashes with counts); START and END are always hot."""

    def __init__(self, n: int, v: int, docs: int, hot: list[tuple[int, int]]):
        extra = {int(START): docs, int(END): docs}
        words = {h & (2**64 - 1): c for h, c in hot} | extra
        self.hash = np.array(sorted(words), dtype=np.uint64)
        self.count = np.array([words[int(h)] for h in self.hash], dtype=np.int64)
        self.n, self.v = n, v
        self.start = int(np.searchsorted(self.hash, START))
        self.end = int(np.searchsorted(self.hash, END))
        top = (self.hash >> np.uint64(44)).astype(np.int64)  # a first step for the search below
        self.first = np.searchsorted(top, np.arange((1 << 20) + 1))

    def find(self, w: np.ndarray) -> np.ndarray:
        """Index of each hash among the hot words, or -1."""
        i = self.first[(w >> np.uint64(44)).astype(np.int64)]
        last = len(self.hash) - 1
        out = np.full(len(w), -1, dtype=np.int64)
        todo = np.arange(len(w))
        while len(todo):  # slots hold a fraction of a word on average: a few steps
            at = np.minimum(i[todo], last)
            hit = self.hash[at] == w[todo]
            out[todo[hit]] = at[hit]
            more = ~hit & (i[todo] < last) & (self.hash[at] < w[todo])
            todo = todo[more]
            i[todo] += 1
        return out

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.n + self.v + 1))


def planes(x: np.ndarray) -> tuple[str, int, bytes]:
    """Bytes of an integer array, all first bytes, then all second ones: high zeros compress."""
    top = int(x.max()) if len(x) else 0
    kind = next(k for k, m in (("u1", 8), ("u2", 16), ("u4", 32), ("u8", 64)) if top >> m == 0)
    a = np.ascontiguousarray(x.astype(kind))
    return kind, len(a), a.view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b""


def unplanes(p: tuple[str, int, bytes]) -> np.ndarray:
    kind, n, raw = p
    if not n:
        return np.zeros(0, dtype=kind)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(-1, n).T).view(kind).ravel()


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of the runs of equal values."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return starts, np.diff(np.append(starts, len(x)))


def emit(part: pa.RecordBatch, chunk: int, counts: Counts, parts: int):
    """(partition, block) rows of one chunk; columns of ``part``: key, held, text."""
    w, doc = tokens(part.column(2))
    held = part.column(1).to_numpy(zero_copy_only=False)
    wi = counts.find(w)
    first = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
    vi, v = np.roll(wi, 1), np.roll(w, 1)
    vi[first], v[first] = counts.start, START
    tag = doc * 2 + held[doc]  # what a block says of an occurrence: its text and whether it counts
    blocks: dict[int, list] = {}

    def deal(key: np.ndarray, order_by: np.ndarray, at: np.ndarray):
        """The occurrences ``at`` sorted by partition of ``key``, then ``order_by``."""
        p = (mix(key) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((order_by, p))
        s, n = runs(p[order])
        for a, k in zip(s.tolist(), n.tolist(), strict=True):
            yield int(p[order[a]]), at[order[a : a + k]]

    hot = np.flatnonzero((vi >= 0) & (wi >= 0))
    code = (vi[hot] << (HOT_BITS + 1) | wi[hot]).astype(np.uint64)
    uniq, inverse, n = np.unique(code, return_inverse=True, return_counts=True)
    heavy = n >= HEAVY
    on_heavy = heavy[inverse]
    train = np.bincount(inverse, weights=~held[doc[hot]], minlength=len(uniq)).astype(np.int64)
    hu, ht = uniq[heavy], train[heavy]
    order = np.argsort(inverse[on_heavy], kind="stable")
    mine = (hu, small(n[heavy]), planes(doc[hot[on_heavy]][order]))  # stays with the chunk
    p = (mix(hu) % np.uint64(parts)).astype(np.int64)
    for k in np.unique(p).tolist():
        blocks.setdefault(k, []).append(("H", chunk, planes(hu[p == k]), planes(ht[p == k])))
    light = hot[~on_heavy]
    code_of = np.zeros(len(w), dtype=np.uint64)
    code_of[light] = code[~on_heavy]
    for k, at in deal(code_of[light], code_of[light], light):
        c = code_of[at]
        s, length = runs(c)
        blocks.setdefault(k, []).append(("A", chunk, planes(np.diff(c[s], prepend=np.uint64(0))), planes(length), planes(tag[at])))
    for kind, sel, key, other in (("B", (vi < 0) & (wi >= 0), v, wi), ("C", (vi >= 0) & (wi < 0), w, vi)):
        at = np.flatnonzero(sel)
        for k, at in deal(key[at], key[at], at):
            s, length = runs(key[at])
            blocks.setdefault(k, []).append((kind, chunk, six(key[at][s]), planes(length), planes(other[at]), planes(tag[at])))
    at_both = np.flatnonzero((vi < 0) & (wi < 0))
    for kind, key in (("D", v), ("E", w)):
        for k, at in deal(key[at_both], key[at_both], at_both):
            blocks.setdefault(k, []).append((kind, chunk, six(key[at]), six(w[at]) if kind == "D" else b"", planes(at), planes(tag[at])))
    known = np.where(wi >= 0, counts.count[wi], 0)
    base = np.bincount(doc, weights=np.where(wi >= 0, counts.base(known), 0.0), minlength=len(held))
    meta = {"keys": part.column(0).to_pylist(), "held": held, "tokens": np.bincount(doc, minlength=len(held)), "base": base,
            "known": np.bincount(doc, weights=known > 0, minlength=len(held)), "heavy": mine, "pairs": planes(doc[at_both])}
    blocks.setdefault(chunk_part(chunk) % parts, []).append(("M", chunk, meta))
    for k, rows in blocks.items():
        yield k, pickle.dumps(rows, protocol=5)


def chunk_part(c: int) -> int:
    """Where a chunk (partition << 32 | number) is dealt: chunks of one number spread evenly over any
    number of partitions."""
    return int(mix(np.array([c], dtype=np.uint64))[0] >> np.uint64(1))


def hot_pair(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two hot words' indices in a pair's code."""
    return (code >> np.uint64(HOT_BITS + 1)).astype(np.int64), (code & np.uint64((2 << HOT_BITS) - 1)).astype(np.int64)


def six(x: np.ndarray) -> bytes:
    """Low six bytes of each hash: with the partition they tell its words apart."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unsix(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def small(x: np.ndarray) -> np.ndarray:
    """The integers in the narrowest type that holds them."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.int64)


def bucket(c: np.ndarray) -> np.ndarray:
    """Context-frequency bucket: 0 for unseen, else 1 + floor(log2)."""
    return np.where(c > 0, np.frexp(np.maximum(c, 1).astype(float))[1], 0).astype(np.int64)


NONE = 1023  # a quantised probability of zero


def cells(c_vw, c_v, c_w, n: int) -> dict[int, int]:
    """Held-out statistics of training pair types: (bucket, quantised deleted bigram and
    unigram estimates) -> occurrences.  Quarters of a power of two."""
    ok = c_vw > 0
    c_vw, c_v, c_w = c_vw[ok].astype(float), c_v[ok], c_w[ok].astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        q2 = np.where(c_vw > 1, np.rint(-4 * np.log2((c_vw - 1) / np.maximum(c_v - 1, 1))), NONE)
        q1 = np.where(c_w > 1, np.rint(-4 * np.log2((c_w - 1) / max(n - 1, 1))), NONE)
    cell = (bucket(c_v) << 20) | (np.clip(q2, 0, NONE).astype(np.int64) << 10) | np.clip(q1, 0, NONE).astype(np.int64)
    u, inverse = np.unique(cell, return_inverse=True)
    total = np.bincount(inverse, weights=c_vw, minlength=len(u)).astype(np.int64)
    return dict(zip(u.tolist(), total.tolist(), strict=True))


def learn_weights(stats: dict[int, int], v: int, rounds: int = 100) -> np.ndarray:
    """buckets x (a, u, z) by expectation-maximisation; unseen buckets get their lower
    neighbour's weights, the bucket of unseen contexts no ``a``."""
    out = np.tile(np.array([0.4, 0.4, 0.2]), (64, 1))
    by: dict[int, list] = {}
    for cell, n in stats.items():
        by.setdefault(cell >> 20, []).append((cell >> 10 & 1023, cell & 1023, n))
    last = None
    for b in range(1, 64):
        if b in by:
            q2, q1, n = (np.array(x, dtype=float) for x in zip(*by[b], strict=True))
            p = np.stack([np.where(q2 == NONE, 0.0, 2.0 ** (-q2 / 4)), np.where(q1 == NONE, 0.0, 2.0 ** (-q1 / 4)), np.full(len(n), 1.0 / (v + 1))])
            x = np.array([0.4, 0.4, 0.2])
            for _ in range(rounds):
                share = p * x[:, None]
                share /= share.sum(axis=0)
                x = (share @ n + np.array([0.0, 0.01, 0.01])) / (n.sum() + 0.02)
            last = x
        if last is not None:
            out[b] = last
    first = out[min(by)] if by else out[1]
    out[0] = np.array([0.0, first[1], first[2]]) / max(first[1] + first[2], 1e-12)
    if not by:
        out[:] = np.array([0.0, 0.0, 1.0])
    return out


def count_pairs(rows, counts: Counts):
    """The blocks of one partition, counted.  Yields per kind (kind, fields)."""
    got: dict[str, list] = {}
    for row in rows:
        got.setdefault(row[0], []).append(row)
    cat = lambda xs, kind=None: np.concatenate(xs) if xs else np.zeros(0, dtype=kind or np.int64)

    def chunks(rows, lengths):
        return np.repeat(np.array([r[1] for r in rows], dtype=np.int64), lengths)

    # pairs of hot words; each kind's blocks are dropped once they are counted
    a, h = got.pop("A", []), got.pop("H", [])
    length = [unplanes(r[3]).astype(np.int64) for r in a]
    code = cat([np.repeat(np.cumsum(unplanes(r[2]).astype(np.uint64), dtype=np.uint64), n) for r, n in zip(a, length, strict=True)], np.uint64)
    tag = cat([unplanes(r[4]).astype(np.int64) for r in a])
    h_code = [unplanes(r[2]).astype(np.uint64) for r in h]
    h_n = [unplanes(r[3]).astype(np.int64) for r in h]
    uniq, inverse = np.unique(np.concatenate([code, cat(h_code, np.uint64)]), return_inverse=True)
    weight = np.concatenate([1 - (tag & 1), cat(h_n)])
    c_vw = np.bincount(inverse, weights=weight, minlength=len(uniq)).astype(np.int64)
    vi, wi = hot_pair(uniq)
    yield "A", (c_vw, counts.count[vi], counts.count[wi], inverse[: len(code)], chunks(a, [int(n.sum()) for n in length]), tag)
    yield "H", (uniq, c_vw, inverse[len(code) :], chunks(h, [len(x) for x in h_n]))
    del a, h, length, code, tag, h_code, h_n, uniq, inverse, weight, c_vw, vi, wi
    # rare contexts: B with hot words, D with rare ones
    b, d = got.pop("B", []), got.pop("D", [])
    length = [unplanes(r[3]).astype(np.int64) for r in b]
    v = cat([np.repeat(unsix(r[2]), n) for r, n in zip(b, length, strict=True)] + [unsix(r[2]) for r in d], np.uint64)
    hot = cat([unplanes(r[4]).astype(np.int64) for r in b])
    rare = cat([unsix(r[3]) for r in d], np.uint64)
    tag = cat([unplanes(r[5]).astype(np.int64) for r in b + d])
    order = np.lexsort((np.concatenate([hot.astype(np.uint64), rare]), np.arange(len(v)) >= len(hot), v))
    other = np.concatenate([hot.astype(np.uint64), rare])[order]
    far = order >= len(hot)
    new_v = np.concatenate([[True], v[order][1:] != v[order][:-1]]) if len(v) else np.zeros(0, bool)
    new_p = new_v.copy()
    new_p[1:] |= (other[1:] != other[:-1]) | (far[1:] != far[:-1])
    in_v, in_p = np.cumsum(new_v) - 1, np.cumsum(new_p) - 1
    train = 1 - (tag[order] & 1)
    c_v = np.bincount(in_v, weights=train).astype(np.int64)[in_v] if len(v) else np.zeros(0, np.int64)
    c_p = np.bincount(in_p, weights=train).astype(np.int64)[in_p] if len(v) else np.zeros(0, np.int64)
    where = np.concatenate([chunks(b, [int(n.sum()) for n in length]), chunks(d, [r[5][1] for r in d])])[order]
    near = ~far
    heads = np.flatnonzero(near & new_p)  # one of each pair type
    c_w = np.zeros(len(order), dtype=np.int64)
    c_w[near] = counts.count[hot[order[near]]]
    yield "B", (c_p, c_v, c_w, heads, where, tag[order], near)
    spot = cat([unplanes(r[4]).astype(np.int64) for r in d])
    yield "D", (where[far], spot[order[far] - len(hot)], c_v[far], c_p[far], new_p[far])
    del b, d, length, v, hot, rare, tag, order, other, far, new_v, new_p, in_v, in_p, train, c_v, c_p, where, near, heads, c_w, spot
    # rare words: C after hot contexts, E after rare ones
    c, e = got.pop("C", []), got.pop("E", [])
    length = [unplanes(r[3]).astype(np.int64) for r in c]
    w = cat([np.repeat(unsix(r[2]), n) for r, n in zip(c, length, strict=True)] + [unsix(r[2]) for r in e], np.uint64)
    ctx = cat([unplanes(r[4]).astype(np.int64) for r in c])
    tag = cat([unplanes(r[5]).astype(np.int64) for r in c + e])
    k = len(ctx)
    ctx = np.concatenate([ctx, np.full(len(w) - k, -1)])
    order = np.lexsort((ctx, w))
    new_w = np.concatenate([[True], w[order][1:] != w[order][:-1]]) if len(w) else np.zeros(0, bool)
    new_p = new_w.copy()
    new_p[1:] |= ctx[order][1:] != ctx[order][:-1]
    train = 1 - (tag[order] & 1)
    in_w, in_p = np.cumsum(new_w) - 1, np.cumsum(new_p) - 1
    c_w = np.bincount(in_w, weights=train).astype(np.int64)[in_w] if len(w) else np.zeros(0, np.int64)
    c_p = np.bincount(in_p, weights=train).astype(np.int64)[in_p] if len(w) else np.zeros(0, np.int64)
    where = np.concatenate([chunks(c, [int(n.sum()) for n in length]), chunks(e, [r[5][1] for r in e])])[order]
    near = ctx[order] >= 0
    yield "C", (c_p, counts.count[np.maximum(ctx[order], 0)], c_w, np.flatnonzero(near & new_p), where, tag[order], near)
    far = ~near
    spot = cat([unplanes(r[4]).astype(np.int64) for r in e])
    yield "E", (where[far], spot[order[far] - k], c_w[far])
    for row in got.get("M", []):
        yield "M", (row[1], row[2])


def by_chunk(where: np.ndarray, *fields: np.ndarray):
    order = np.argsort(where, kind="stable")
    s, n = runs(where[order])
    for a, k in zip(s.tolist(), n.tolist(), strict=True):
        at = order[a : a + k]
        yield int(where[at[0]]), [f[at] if f.dtype == bool or f.dtype == float else small(f[at]) for f in fields]


def both_rare(parts: dict) -> tuple[np.ndarray, ...]:
    """A chunk's pairs of rare words: (spot, c_v, c_vw, head of its type, c_w), joined by spot."""
    spot, c_v, c_p = (np.concatenate([p[i] for p in parts["D"]]).astype(np.int64) for i in range(3))
    head = np.concatenate([p[3] for p in parts["D"]])
    spot2, c_w = (np.concatenate([p[i] for p in parts["E"]]).astype(np.int64) for i in range(2))
    o, o2 = np.argsort(spot), np.argsort(spot2)
    return spot[o], c_v[o], c_p[o], head[o], c_w[o2]


def log_p(weights, v_types: int, n: int, c_vw, c_v, c_w) -> np.ndarray:
    x = weights[bucket(c_v)]
    return np.log10(x[:, 0] * c_vw / np.maximum(c_v, 1) + x[:, 1] * c_w / max(n, 1) + x[:, 2] / (v_types + 1))


def lm_score(docs: DataFrame, key: str, text: str, held: F.Column) -> DataFrame:
    """Scores of every row of ``docs``; rows where ``held`` is true do not train."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    kind = docs.schema[key].dataType
    src = docs.select(F.col(key).alias("k"), F.coalesce(held, F.lit(False)).alias("held"), F.col(text).alias("t"))
    uni = stored(count_words(src), "lm-words")
    total = uni.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("all")).first()
    n, v, all_tokens = int(total["n"]), int(total["v"]), int(total["all"])
    # frequent in all rows, trained on or not: at most HOT by the threshold, as their counts add up
    # to no more than all tokens
    hot = uni.where(F.col("n") >= max(2, math.ceil(all_tokens / HOT))).collect()
    ends = next((r["c"] for r in hot if r["h"] == int(END)), None)
    if ends is None:
        row = uni.where(F.col("h") == int(END)).first()
        ends = row["c"] if row else 0
    shared = sc.broadcast(Counts(n, v, ends, [(r["h"], r["c"]) for r in hot]))
    parts = partitions(spark, all_tokens // TOKENS_PER_PARTITION)

    def send(batches):
        from pyspark import TaskContext

        chunk, counts = TaskContext.get().partitionId() << 32, shared.value
        for batch in batches:
            for part in sub_batches(batch, "t", CHUNK):
                rows = list(emit(part, chunk, counts, parts))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["p", "b"])
                chunk += 1

    sent = src.mapInArrow(send, "p int, b binary").rdd.map(lambda r: (r[0], bytes(r[1]))).partitionBy(parts, int)

    def load(it):
        for _, b in it:
            yield from pickle.loads(b)

    def gather(index, it):
        """Held-out statistics of a partition, under a key of its own; pairs of rare words go on to
        their chunk."""
        counts, found = shared.value, {}
        for what, x in count_pairs(load(it), counts):
            if what == "A":
                new = cells(x[0], x[1], x[2], counts.n)
            elif what in "BC":
                new = cells(x[0][x[3]], x[1][x[3]], x[2][x[3]], counts.n)
            else:
                if what == "D":
                    yield from ((c, ("D", f)) for c, f in by_chunk(*x))
                elif what == "E":
                    yield from ((c, ("E", f)) for c, f in by_chunk(*x))
                continue
            for cell, m in new.items():
                found[cell] = found.get(cell, 0) + m
        yield 1 << 62 | index, ("stats", found)

    def gather_rare(it):
        counts, chunks, found = shared.value, {}, {}
        for c, (what, f) in it:
            if what == "stats":
                for cell, m in f.items():
                    found[cell] = found.get(cell, 0) + m
            else:
                chunks.setdefault(c, {}).setdefault(what, []).append(f)
        for x in chunks.values():
            _, c_v, c_p, head, c_w = both_rare(x)
            for cell, m in cells(c_p[head], c_v[head], c_w[head], counts.n).items():
                found[cell] = found.get(cell, 0) + m
        return iter(found.items())

    stats = dict(sent.mapPartitionsWithIndex(gather).partitionBy(parts, chunk_part).mapPartitions(gather_rare).reduceByKey(add, max(1, parts // 8)).collect())
    weights = sc.broadcast(learn_weights(stats, v))

    def score(it):
        counts, x = shared.value, weights.value
        for what, f in count_pairs(load(it), counts):
            if what == "A":
                c_vw, c_v, c_w, inverse, where, tag = f
                s = log_p(x, counts.v, counts.n, c_vw, c_v, c_w)[inverse]
                for c, (s1, t1) in by_chunk(where, s, tag):
                    d, sums = doc_sums(t1 >> 1, s1)
                    yield c, ("S", d, sums)
            elif what == "H":
                uniq, c_vw, inverse, where = f
                for c, (u, m) in by_chunk(where, uniq[inverse].astype(np.int64), c_vw[inverse]):
                    yield c, ("H", u, m)
            elif what == "B":
                c_p, c_v, c_w, _, where, tag, near = f
                s = log_p(x, counts.v, counts.n, c_p[near], c_v[near], c_w[near])
                for c, (s1, t1) in by_chunk(where[near], s, tag[near]):
                    d, sums = doc_sums(t1 >> 1, s1)
                    yield c, ("S", d, sums)
            elif what == "C":
                c_p, c_v, c_w, _, where, tag, near = f
                s = log_p(x, counts.v, counts.n, c_p[near], c_v[near], c_w[near])
                for c, (s1, t1, cw) in by_chunk(where[near], s, tag[near], c_w[near]):
                    d, sums, base, known = doc_sums(t1 >> 1, s1, counts.base(cw.astype(np.int64)), cw > 0)
                    yield c, ("R", d, sums, base, small(known.astype(np.int64)))
            elif what == "D":
                yield from ((c, ("D", f)) for c, f in by_chunk(*f))
            elif what == "E":
                yield from ((c, ("E", f)) for c, f in by_chunk(*f))
            else:
                yield f[0], ("M", f[1])

    def doc_sums(doc, *values):
        u, inverse = np.unique(doc, return_inverse=True)
        return small(u), *(np.bincount(inverse, weights=x, minlength=len(u)) for x in values)

    def finish(it):
        counts, x, chunks = shared.value, weights.value, {}
        for c, row in it:
            chunks.setdefault(c, {}).setdefault(row[0], []).append(row[1] if row[0] in "MDE" else row[1:])
        while chunks:
            _, got = chunks.popitem()
            meta = got["M"][0]
            size = len(meta["keys"])
            s, base, known = np.zeros(size), meta["base"].copy(), meta["known"].copy()
            for d, sums in got.get("S", []):
                s[d] += sums
            for d, sums, b, k in got.get("R", []):
                s[d] += sums
                base[d] += b
                known[d] += k
            codes, times, docs_of = meta["heavy"]
            if len(codes):
                u = np.concatenate([g[0] for g in got["H"]])
                m = np.concatenate([g[1] for g in got["H"]]).astype(np.int64)[np.argsort(u)]  # as codes are sorted
                vi, wi = hot_pair(codes)
                each = log_p(x, counts.v, counts.n, m, counts.count[vi], counts.count[wi])
                s += np.bincount(unplanes(docs_of), weights=np.repeat(each, times), minlength=size)
            doc = unplanes(meta["pairs"])  # in the order of the spots
            if len(doc):
                _, c_v, c_p, _, c_w = both_rare(got)
                s += np.bincount(doc, weights=log_p(x, counts.v, counts.n, c_p, c_v, c_w), minlength=size)
                base += np.bincount(doc, weights=counts.base(c_w), minlength=size)
                known += np.bincount(doc, weights=c_w > 0, minlength=size)
            for i, k in enumerate(meta["keys"]):
                yield k, bool(meta["held"][i]), int(meta["tokens"][i]), int(known[i]), counts.n, float(base[i]), float(s[i])

    rows = sent.mapPartitions(score).partitionBy(parts, chunk_part).mapPartitions(finish)
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(key, kind), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
                           T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    return spark.createDataFrame(rows, schema, verifySchema=False)


@query("op3_lm_score")
def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted-interpolation and base scores of all documents; trained where crc32(doc_id) mod 7 is not 2."""
    docs = table(spark, sf_dir, "documents")
    return lm_score(docs, "doc_id", "text", fold(F.col("doc_id"), 7) == 2)
