"""Operator 10, substring deduplication by relative Lempel-Ziv factors.

A document is parsed against a reference, all documents with smaller ids, as a sequence of
factors and literals.  The reference is indexed by its windows of ``span`` words: a window that
is not there is a literal, a window that is there opens a factor, which is extended word by word
as long as the reference document goes on alike (``parse``).  As a factor ends where its own
reference ends, the windows across its end are looked up one by one, so a copy that goes on in
another reference document is found as well.  Factors are ``span`` words at least, and the
words under them are the duplicate spans.

The reference is indexed in blocks.  A window's anchor is the smallest hash among its runs of
SEED words; equal windows have equal anchors, so a window can only have a copy in the block of
its anchor, and each run of windows with one anchor is parsed against that block alone instead of
against every block.  Blocks are hash partitions of the anchors and grow in number with the
input.  A frequent anchor (a common line of SEED words; counted on a bounded sample of the
documents) would make one block of all documents that hold it: its windows are dealt one by one
by their own hash, and equal windows still meet.

Map side, a chunk's documents are parsed against each other first: of equal windows only the
smallest document's go out, so a passage in a third of all documents costs one entry a
chunk.  Per window about six bytes are shuffled.  Factors come back as (document, from, to) and are
made distinct; while they are few (counted) they are broadcast and the texts stay where they are
read, beyond that both sides are joined by a shuffle.

Documents with null keys come after all others and never count as reference for one another.

Cases: the key is a column of whole numbers (another type is a TypeError).  Null text has no
words.  Repeated rows with one id do not remove each other.  Documents shorter than ``span`` keep
all words.  Empty tables give empty results.  Other columns, whatever their names, are passed
through by ``remove_spans``.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.llm.common import give_back, order_key, partitions, query, stored, sub_batches, table
from retentia.llm.lm import planes, runs, unplanes
from retentia.llm.words import mix, sequence_hashes, spread, text_bytes, word_hashes, word_spans

SPAN = 50
SEED = 16
CHUNK = 4 << 20
WINDOWS_PER_BLOCK = 3_000_000
SAMPLE_CHARS = 1 << 25  # of documents in which anchors are counted
BROADCAST_BYTES = 1 << 25  # factors above this are joined by a shuffle
LAST = 2**63 - 1  # the order of a null key
_LOW40 = np.uint64((1 << 40) - 1)


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each run of ``n`` entries (doubling)."""
    out, width = x, 1
    while 2 * width <= n:
        out = np.minimum(out[: len(out) - width], out[width:])
        width *= 2
    rest = n - width
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def five(x: np.ndarray) -> bytes:
    """Low five bytes of each value."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unfive(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def ranges(at: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted positions merged to (owner, start, stop) of consecutive ones with one owner."""
    if not len(at):
        z = np.zeros(0, np.int64)
        return z, z, z
    s, n = runs(np.cumsum(np.concatenate([[0], (np.diff(at) != 1) | (owner[1:] != owner[:-1])])))
    return owner[s], at[s], at[s] + n


def references(ident: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For every window the place of the first equal one in the smallest document that has it,
    if that document is smaller than the window's own; else -1."""
    out = np.full(len(ident), -1, dtype=np.int64)
    # copies are few: only windows that are there twice are looked at further
    order = np.argsort(ident, kind="stable")
    s, n = runs(ident[order])
    many = n > 1
    place = order[spread(s[many], n[many])]
    group = np.repeat(np.arange(int(many.sum())), n[many])
    by = np.lexsort((place, key[place], group))
    first = place[by[np.searchsorted(group[by], np.arange(int(many.sum())))]]
    smaller = key[first[group]] < key[place]
    out[place[smaller]] = first[group[smaller]]
    return out


def parse(ident: np.ndarray, ref: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors (first window, last window + 1, first window of the reference) of runs of
    consecutive windows that lie at ``start`` and are ``size`` long; ``ref`` from ``references``."""
    hits = np.flatnonzero(ref >= 0)
    run = np.searchsorted(start, hits, side="right") - 1
    of_ref = np.searchsorted(start, ref[hits], side="right") - 1
    ends, stops = (start + size)[run].tolist(), (start + size)[of_ref].tolist()
    out, p, places, refs = [], 0, hits.tolist(), ref[hits].tolist()
    while p < len(places):
        i, j = places[p], refs[p]
        n = min(ends[p] - i, stops[p] - j)
        length = step = 1
        while length < n:  # word by word, compared in growing steps
            same = ident[i + length : i + min(n, length + step)] == ident[j + length : j + min(n, length + step)]
            if not same.all():
                length += int(np.argmin(same))
                break
            length, step = length + len(same), step * 8
        out.append((i, i + length, j))
        p += length  # every window of a factor is a hit: the next one is the first across its end
        while p < len(places) and places[p] < i + length:
            p += 1
    a = np.array(out, dtype=np.int64).reshape(-1, 3)
    return a[:, 0], a[:, 1], a[:, 2]


def windows_of(part: pa.RecordBatch, span: int, seed: int):
    """(windows, anchors, document and place of each, first window of each document)."""
    h, first = word_hashes(part.column(2))
    n = np.maximum(np.diff(first) - span + 1, 0)
    if not n.sum():
        return None
    w, a = sequence_hashes(h, span), sliding_min(sequence_hashes(h, seed), span - seed + 1)
    at = spread(first[:-1], n)
    return w[at], a[at], np.repeat(np.arange(len(n)), n), at - np.repeat(first[:-1], n), np.cumsum(n) - n, n


def emit(part: pa.RecordBatch, blocks: int, span: int, seed: int, hot: np.ndarray):
    """(block, pickled rows) of one chunk; columns: order key, text hash, text."""
    found = windows_of(part, span, seed)
    if found is None:
        return
    w, a, doc, at, head, size = found
    keys, text_hash = part.column(0).to_numpy(), part.column(1).to_numpy()
    # the chunk against itself: of equal windows only the smallest document's go out
    some = size > 0
    ref = references(w, keys[doc])
    s, e, r = parse(w, ref, head[some], size[some])
    out: dict[int, list] = {}
    if len(s):
        out.setdefault(int(mix(np.array([text_hash[0]]))[0] % np.uint64(blocks)), []).append(("L", keys[doc[s]], text_hash[doc[s]], at[s], at[s] + e - s, keys[doc[r]], at[r]))
    go = np.flatnonzero(ref < 0)
    common = np.zeros(len(go), dtype=bool)
    if len(hot):
        common = hot[np.minimum(np.searchsorted(hot, a[go]), len(hot) - 1)] == a[go]
    new = common.copy()
    new[:1] = True
    new[1:] |= (a[go[1:]] != a[go[:-1]]) | (go[1:] != go[:-1] + 1) | (doc[go[1:]] != doc[go[:-1]])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(go)))
    block = (mix(np.where(common[head], w[go[head]], a[go[head]])) % np.uint64(blocks)).astype(np.int64)
    by = np.argsort(block, kind="stable")
    bs, bn = runs(block[by])
    for i, k in zip(bs.tolist(), bn.tolist(), strict=True):
        r = by[i : i + k]
        at_run = go[head[r]]
        docs, local = np.unique(doc[at_run], return_inverse=True)
        windows = w[go[spread(head[r], size[r])]]
        out.setdefault(int(block[r[0]]), []).append((
            "W", keys[docs], text_hash[docs], planes(local), planes(at[at_run]), planes(size[r]), five(a[at_run]), five(windows)))
    for k, rows in out.items():
        yield k, pickle.dumps(rows, protocol=5)


FACTORS = "o long, th long, start long, stop long, ref_o long, ref_start long"


def factor(rows: list) -> tuple[np.ndarray, ...]:
    """Factors (order key, text hash, first window, last + 1, reference's key and first window) of
    the runs in one block."""
    found = [r[1:] for r in rows if r[0] == "L"]
    sent = [r for r in rows if r[0] == "W"]
    if sent:
        base = np.cumsum([0] + [len(r[1]) for r in sent])
        keys, hashes = np.concatenate([r[1] for r in sent]), np.concatenate([r[2] for r in sent])
        doc = np.concatenate([unplanes(r[3]).astype(np.int64) + b for r, b in zip(sent, base, strict=False)])
        start = np.concatenate([unplanes(r[4]).astype(np.int64) for r in sent])
        size = np.concatenate([unplanes(r[5]).astype(np.int64) for r in sent])
        anchor = np.concatenate([unfive(r[6]) for r in sent])
        window = np.concatenate([unfive(r[7]) for r in sent])
        run = np.repeat(np.arange(len(size)), size)
        ident = mix(window | anchor[run] << np.uint64(40)) + (anchor[run] >> np.uint64(24)) * np.uint64(0x9E3779B97F4A7C15)
        head = np.cumsum(size) - size
        s, e, r = parse(ident, references(ident, keys[doc[run]]), head, size)
        at = start[run[s]] + s - head[run[s]]
        found.append((keys[doc[run[s]]], hashes[doc[run[s]]], at, at + e - s, keys[doc[run[r]]], start[run[r]] + r - head[run[r]]))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    return tuple(np.concatenate([f[i] for f in found]) for i in range(6))


def hot_anchors(src: DataFrame, chars: int, blocks: int, span: int, seed: int) -> np.ndarray:
    """Anchors that hold more than an eighth of an average block's windows, from a sample of about
    SAMPLE_CHARS characters (at most 8 * blocks anchors can, and only those are returned)."""
    share = min(1.0, SAMPLE_CHARS / max(1, chars))
    drawn = src.where(F.pmod(F.xxhash64(F.lit(43), "o", "th"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))

    def count(batches):
        for batch in batches:
            for part in sub_batches(batch, "t", CHUNK):
                found = windows_of(part, span, seed)
                a, n = np.unique(found[1], return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(n, pa.int64()), pa.array(np.full(len(a), n.sum()), pa.int64())], names=["a", "n", "all"])

    counts = stored(drawn.mapInArrow(count, "a long, n long, all long").groupBy("a").agg(F.sum("n").alias("n")), "anchors")
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    rows = counts.where((F.col("n") > F.lit(total / (8 * blocks))) & (F.col("n") > span - seed + 1)).select("a").collect()
    return np.sort(np.array([r["a"] for r in rows], dtype=np.int64).view(np.uint64))


def find_factors(docs: DataFrame, key: str, text: str, span: int = SPAN) -> DataFrame:
    """(o, th, start, stop, ref_o, ref_start): window starts [start, stop) of a document (by its
    order key and text hash) whose windows start, one after the other, in the document ``ref_o``
    with a smaller key, from its window ``ref_start`` on."""
    spark = docs.sparkSession
    seed = min(SEED, span)
    src = docs.select(order_key(docs, key, LAST).alias("o"), F.xxhash64(text).alias("th"), F.col(text).alias("t"))
    chars = src.agg(F.sum(F.length("t")).alias("n")).first()["n"] or 0
    blocks = 2 * partitions(spark, chars // 6 // WINDOWS_PER_BLOCK)
    hot = spark.sparkContext.broadcast(hot_anchors(src, chars, blocks, span, seed))

    def send(batches):
        for batch in batches:
            for part in sub_batches(batch, "t", CHUNK):
                got = list(emit(part, blocks, span, seed, hot.value))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.int32()), pa.array([b for _, b in got], pa.binary())], names=["p", "b"])

    def look(t: pa.Table) -> pa.Table:
        rows = [r for b in t["b"] for r in pickle.loads(b.as_py())]
        out = pa.table(dict(zip(("o", "th", "start", "stop", "ref_o", "ref_start"), factor(rows), strict=True)))
        del rows
        give_back()
        return out

    return src.mapInArrow(send, "p int, b binary").groupBy("p").applyInArrow(look, FACTORS)


def with_stretches(docs: DataFrame, key: str, text: str, span: int, name: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with the document's factors as an array column ``name`` of (start, stop), null: none.
    Repeated rows find the same factors: they are one entry, and each row gets it."""
    spans = find_factors(docs, key, text, span).select("o", "th", F.struct("start", "stop").alias("s"))
    found = stored(spans.groupBy("o", "th").agg(F.collect_set("s").alias(name)), "factors")
    size = found.agg(F.sum(64 + 32 * F.size(name)).alias("n")).first()["n"] or 0
    left = docs.select(F.struct("*").alias("row")).select("row", order_key(docs, key, LAST, f"row.`{key}`").alias("o"), F.xxhash64(f"row.`{text}`").alias("th"))
    return left.join(F.broadcast(found) if size <= broadcast_bytes else found, ["o", "th"], "left").select("row.*", name)


def kept_words(n: int, stretches: list[dict] | None, span: int) -> np.ndarray:
    """Mask of the words that stay."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for s in stretches or ():
        edge[s["start"]] += 1
        edge[min(n, s["stop"] + span - 1)] -= 1
    return np.cumsum(edge[:n]) == 0


def remove_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars", span: int = SPAN) -> DataFrame:
    """The rows of ``docs`` with their duplicate spans cut out of the text (what is left keeps its
    own white space, pieces are joined by a line break); ``n_chars`` is brought up to date."""
    name = "_stretches"
    while name in docs.columns:
        name += "_"
    at, names = docs.columns.index(text), docs.columns

    def cut(batches):
        for batch in batches:
            marks = batch.column(len(names)).to_pylist()
            texts = batch.column(at).to_pylist()
            for i, m in enumerate(marks):
                if m:
                    raw, offsets = text_bytes(pa.array([texts[i]], pa.string()))
                    starts, ends, _ = word_spans(raw, offsets)
                    keep = kept_words(len(starts), m, span)
                    _, a, b = ranges(np.flatnonzero(keep), np.zeros(int(keep.sum()), np.int64))
                    whole = raw.tobytes()
                    texts[i] = b"\n".join(whole[starts[x] : ends[y - 1]] for x, y in zip(a.tolist(), b.tolist(), strict=True)).decode()
            columns = [pa.array(texts, pa.string()) if c == at else batch.column(c) for c in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = with_stretches(docs, key, text, span, name).mapInArrow(cut, docs.schema)
    if n_chars in names:
        out = out.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType))
    return out


@query(
    "op10_substring_dedup",
    r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS o,
                      coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
    x AS (SELECT r, o, i, md5(array_to_string(w[i:i + 49], ' ')) AS s
          FROM (SELECT r, o, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
    f AS (SELECT s, min(o) AS first FROM x GROUP BY s),
    g AS (SELECT DISTINCT r, unnest(generate_series(i, i + 49)) AS p FROM x JOIN f USING (s) WHERE first < o),
    n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
    t AS (SELECT r, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM d),
    k AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS kept FROM t ANTI JOIN g USING (r, p) GROUP BY r)
    SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN n USING (r) LEFT JOIN k USING (r)
    """,
)
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document after its duplicate 50-word spans are removed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def digest(batches):
        for batch in batches:
            n, gone, sha = [], [], []
            for text, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = (text or "").encode().split()  # bytes split on exactly the contract's white space
                keep = kept_words(len(words), marks, SPAN) if marks else None
                left = [x for x, k in zip(words, keep.tolist(), strict=True) if k] if marks else words
                n.append(len(words))
                gone.append(len(words) - len(left))
                sha.append(hashlib.sha256(b" ".join(left)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return with_stretches(docs, "doc_id", "text", SPAN, "stretches").mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
