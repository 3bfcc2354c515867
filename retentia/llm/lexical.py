"""Operator 12, ranked lexical search by hybrid term-at-a-time / document-at-a-time evaluation.

Terms are runs of letters, digits and non-ASCII characters, A-Z lower-cased.  Every item is
ranked against all documents by the integer score of the contract: a term weighs
``w = floor(1000 * ln((2N + 2) / (2 df + 1)))`` and adds ``w * (10**9 tf div (1000 tf + 12 m))``
with ``m = 75 + 25 n N div L`` for each of its occurrences in the item.

One pass over the texts writes a forward index of the items' terms (key, n, terms, counts) to the
shared folder; N, L and df come from it.  A task then reads its part of the index in segments of at
most SEGMENT_DOCS documents, turns each into postings with impacts, and answers every item:

* the item's short lists are summed term at a time into accumulators, which from there on act as
  one list with a known maximum per block of BLOCK documents;
* the long lists are walked document at a time beside it, block by block in document order.
  A block whose summed maxima stay below the item's k-th score so far is skipped.  In a visited
  block long lists are added by falling maximum while those left could lift an unseen
  document to the k-th score; after that only documents already met that can still reach it are
  looked up in the other lists.

The k-th scores are carried from segment to segment of a task.  Each segment returns at most k
documents an item and only such as reach the k-th score, and the best k of all are the result.

Scale: texts are never shuffled; a task holds one segment's postings.  Items are taken in blocks of
about BLOCK_TERMS terms, each broadcast and dropped again after its pass, so neither the driver
nor a task holds more than a block (a single item's distinct terms stay together).  A hot item is
k rows a segment.  Terms are compared by 64-bit hashes (a false match has a chance of 2**-64).

Cases: null texts and texts without a term are no documents: they do not count in N and rank
nowhere.  Rows with a null or repeated key are documents of their own; a null key comes after
all others of its score.  Items without text or known terms have no rows.  Rows that repeat
an item and its text are one item; one key with several texts is ranked once for each of them.  No
documents or no items: no rows.  Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retentia.llm.common import query, stored, sub_batches, table
from retentia.llm.words import span_hashes, text_bytes, word_spans

TOP = 20
BLOCK = 512  # documents of a skipped or visited block
SEGMENT_DOCS = 32_768
SEGMENT_POSTINGS = 4_000_000
SHORT = 1 / 16  # lists of at most this share of a segment are summed into the accumulators
BLOCK_TERMS = 250_000

# every byte that is part of no term reads as a blank, A-Z as a-z
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[b for b in range(128) if not chr(b).isalnum()]] = 32


def term_hashes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every term, first term of each text)."""
    data, offsets = text_bytes(col)
    data = _FOLD[data]
    starts, ends, first = word_spans(data, offsets)
    return span_hashes(data, starts, ends), first


def counted(owner: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes of each owner 0..n-1 with their counts: (list offsets, codes, counts)."""
    by = np.lexsort((code, owner))
    owner, code = owner[by], code[by]
    new = np.ones(len(code), dtype=bool)
    new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    head = np.flatnonzero(new)
    return np.searchsorted(owner[head], np.arange(n + 1)), code[head], np.diff(np.append(head, len(code)))


def lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


class Items:
    """A block of items: keys, terms as places in the sorted vocabulary, and their counts."""

    def __init__(self, rows: list):
        self.keys = [r["item"] for r in rows]
        self.no = [r["no"] for r in rows]
        each = [np.array(r["terms"], dtype=np.int64).astype(np.uint64) for r in rows]
        self.vocabulary = np.unique(np.concatenate(each)) if each else np.zeros(0, np.uint64)
        self.terms = [np.searchsorted(self.vocabulary, e) for e in each]
        self.counts = [np.array(r["counts"], dtype=np.int64) for r in rows]


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, no, terms, counts) per different (key, text); ``no`` tells texts of one key apart."""
    kind = items.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in sub_batches(batch, "t"):
                h, first = term_hashes(part.column(2))
                at, codes, n = counted(np.repeat(np.arange(part.num_rows), np.diff(first)), h, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists(at, pa.array(codes.view(np.int64))), lists(at, pa.array(n, pa.int64()))], names=["item", "no", "terms", "counts"])

    src = items.select(F.col(key).alias("item"), F.xxhash64(text).alias("no"), F.col(text).alias("t")).where("t IS NOT NULL").dropDuplicates()
    return src.mapInArrow(run, f"item {kind}, no long, terms array<long>, counts array<long>").where(F.size("terms") > 0)


def forward_index(docs: DataFrame, key: str, text: str, block) -> DataFrame:
    """(key, n, terms, counts) of every document with a term; terms: those of the item block."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        vocabulary = block.value.vocabulary
        for batch in batches:
            for part in sub_batches(batch, "t"):
                h, first = term_hashes(part.column(1))
                n = np.diff(first)
                slot = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                known = np.flatnonzero(vocabulary[slot] == h)
                at, codes, tf = counted(np.repeat(np.arange(len(n)), n)[known], slot[known], len(n))
                out = pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), lists(at, pa.array(codes, pa.int32())), lists(at, pa.array(tf, pa.int32()))], names=["k", "n", "terms", "counts"])
                yield out.filter(pa.array(n > 0))

    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, n long, terms array<int>, counts array<int>")


def document_frequencies(index: DataFrame, size: int) -> np.ndarray:
    """df of each vocabulary term: counted per task, then summed (one row a term at the driver)."""

    def run(batches):
        df = np.zeros(size, dtype=np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at], pa.int64())], names=["term", "df"])

    out = np.zeros(size, dtype=np.int64)
    for r in index.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r["term"]] = r["df"]
    return out


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)


class Segment:
    """Postings of some documents by term: document places (rising) and impacts."""

    def __init__(self, n: np.ndarray, owner: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int):
        self.docs = len(n)
        m = 75 + 25 * n * n_docs // n_terms
        by = np.argsort(term, kind="stable")
        term, self.owner, tf = term[by], owner[by], tf[by].astype(np.int64)
        self.impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[self.owner]))
        self.start = np.searchsorted(term, np.arange(len(weight) + 1))
        self.edges = np.arange(0, self.docs + BLOCK, BLOCK)
        self._blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.start[term], self.start[term + 1]
        return self.owner[a:b], self.impact[a:b]

    def blocks(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each block begins in the term's list, and its largest impact there."""
        if term not in self._blocks:
            at, impact = self.postings(term)
            cut = np.searchsorted(at, self.edges)
            top = np.zeros(len(cut) - 1, dtype=np.int64)
            some = np.flatnonzero(np.diff(cut))
            if len(some):
                top[some] = np.maximum.reduceat(impact, cut[some])
            self._blocks[term] = cut, top
        return self._blocks[term]

    def search(self, terms: np.ndarray, counts: np.ndarray, k: int, floor: int, order: np.ndarray, short: float = SHORT, visited: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The best ``k`` documents (places, scores) that score at least ``floor``; ``order`` ranks
        the documents among equal scores."""
        size = self.start[terms + 1] - self.start[terms]
        # term at a time: the short lists into accumulators
        sums = np.zeros(len(self.edges[1:]) * BLOCK, dtype=np.int64)
        for t, c in zip(terms[size <= short * self.docs].tolist(), counts[size <= short * self.docs].tolist(), strict=True):
            at, impact = self.postings(t)
            sums[at] += impact * c
        bound = sums.reshape(-1, BLOCK).max(axis=1, initial=0)
        long = [(t, c, *self.blocks(t)) for t, c in zip(terms[size > short * self.docs].tolist(), counts[size > short * self.docs].tolist(), strict=True)]
        for _, c, _, top in long:
            bound = bound + top * c
        best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        least = max(floor, 1)
        # document at a time: the accumulators as one list beside the long ones
        for b in np.flatnonzero(bound >= least).tolist():
            if bound[b] < least:
                continue
            if visited is not None:
                visited.append(b)
            score = sums[b * BLOCK : (b + 1) * BLOCK].copy()
            here = sorted(((int(top[b]) * c, t, c, cut[b], cut[b + 1]) for t, c, cut, top in long if top[b]), reverse=True)
            rest = sum(x[0] for x in here)
            i = 0
            while i < len(here) and rest >= least:  # unseen documents could still come in
                top, t, c, x, y = here[i]
                at, impact = self.postings(t)
                score[at[x:y] - b * BLOCK] += impact[x:y] * c
                rest -= top
                i += 1
            met = np.flatnonzero((score > 0) & (score + rest >= least))
            value = score[met]
            for top, t, c, x, y in here[i:]:
                at, impact = self.postings(t)
                place = np.minimum(np.searchsorted(at[x:y], met + b * BLOCK), y - x - 1) + x
                value = value + np.where(at[place] == met + b * BLOCK, impact[place] * c, 0)
                rest -= top
                go = value + rest >= least
                met, value = met[go], value[go]
            go = value >= least
            if go.any():
                place, value = np.concatenate([best[0], met[go] + b * BLOCK]), np.concatenate([best[1], value[go]])
                by = np.lexsort((order[place], -value))[:k]
                best = place[by], value[by]
                if len(by) == k:
                    least = max(least, int(best[1][-1]))
        return best


def segments(batches):
    """Index batches as (keys, n, owner, term, count), cut and joined to bounded segments."""
    held, docs, postings = [], 0, 0
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column(2)).to_numpy())
        a = 0
        while a < batch.num_rows:
            before = int(ends[a - 1]) if a else 0
            b = int(np.searchsorted(ends, before + SEGMENT_POSTINGS - postings, side="right"))
            b = min(max(b, a + (not held)), a + SEGMENT_DOCS - docs, batch.num_rows)
            if b > a:
                held.append(batch.slice(a, b - a))
                docs, postings = docs + b - a, postings + int(ends[b - 1]) - before
            if b < batch.num_rows or docs == SEGMENT_DOCS:
                yield joined(held)
                held, docs, postings = [], 0, 0
            a = b
    if held:
        yield joined(held)


def joined(held: list[pa.RecordBatch]):
    t = pa.Table.from_batches(held).combine_chunks()
    keys, n, terms, counts = (t.column(i).chunk(0) for i in range(4))
    size = pc.list_value_length(terms).to_numpy()
    return keys, n.to_numpy(), np.repeat(np.arange(len(n)), size), terms.flatten().to_numpy(), counts.flatten().to_numpy()


def search_index(index: DataFrame, block, weight, n_docs: int, n_terms: int, item_type: pa.DataType, kinds: tuple[str, str], k: int) -> DataFrame:
    """(item, no, k, score): each segment's best documents of every item of the block."""

    def run(batches):
        items, w = block.value, weight.value
        tops = [np.zeros(0, np.int64) for _ in items.keys]  # the best scores met in this task
        for keys, n, owner, term, tf in segments(batches):
            seg = Segment(n, owner, term, tf, w, n_docs, n_terms)
            order = np.empty(len(n), dtype=np.int64)
            order[pc.sort_indices(keys).to_numpy()] = np.arange(len(n))
            of, place, score = [], [], []
            for q, (terms, counts) in enumerate(zip(items.terms, items.counts, strict=True)):
                floor = int(tops[q][-1]) if len(tops[q]) == k else 0
                p, s = seg.search(terms, counts, k, floor, order)
                if len(p):
                    tops[q] = -np.sort(-np.concatenate([tops[q], s]))[:k]
                    of.append(np.full(len(p), q))
                    place.append(p)
                    score.append(s)
            if of:
                of = np.concatenate(of)
                yield pa.RecordBatch.from_arrays([
                    pa.array([items.keys[q] for q in of], item_type), pa.array([items.no[q] for q in of], pa.int64()),
                    keys.take(pa.array(np.concatenate(place))), pa.array(np.concatenate(score))], names=["item", "no", "k", "score"])

    return index.mapInArrow(run, f"item {kinds[0]}, no long, k {kinds[1]}, score long")


def rank_documents(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
                   k: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item, rank, key, score): the ``k`` best documents of every item."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    kinds = items.schema[item_key].dataType.simpleString(), docs.schema[key].dataType.simpleString()
    asked = stored(item_terms(items, item_key, item_text), "lexical-items")
    total = asked.agg(F.sum(F.size("terms")).alias("n")).first()["n"] or 0
    n_blocks = max(1, -(-total // block_terms))
    found = []
    for b in range(n_blocks):
        rows = asked.where(F.pmod(F.xxhash64("item", "no"), F.lit(n_blocks)) == b).collect()  # about block_terms terms
        if not rows:
            continue
        block = spark.sparkContext.broadcast(Items(rows))
        index = stored(forward_index(docs, key, text, block), "lexical-index")
        sizes = index.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        if sizes["docs"]:
            df = document_frequencies(index, len(block.value.vocabulary))
            weight = spark.sparkContext.broadcast(weights(df, sizes["docs"]))
            best = search_index(index, block, weight, sizes["docs"], sizes["terms"], to_arrow_type(items.schema[item_key].dataType), kinds, k)
            w = Window.partitionBy("item", "no").orderBy(F.col("score").desc(), F.col("k").asc_nulls_last())
            found.append(stored(best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), "lexical-best"))
            weight.unpersist()
        block.unpersist()
    if not found:
        return spark.createDataFrame([], f"{item_key} {kinds[0]}, rank int, {key} {kinds[1]}, score long")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select(F.col("item").alias(item_key), "rank", F.col("k").alias(key), "score")


@query(
    "op12_lexical_search",
    r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                      regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
               FROM documents WHERE text IS NOT NULL),
    n AS (SELECT r, doc_id, len(terms) AS n, terms FROM d WHERE len(terms) > 0),
    g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS l FROM n),
    i AS (SELECT item_id, term, count(*) AS qtf FROM (
            SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
    p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM n) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
    w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), g),
    c AS (SELECT r, p.term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // l))) AS c FROM p JOIN n USING (r) JOIN w USING (term), g),
    s AS (SELECT item_id, r, CAST(sum(qtf * c) AS BIGINT) AS score FROM i JOIN c USING (term) GROUP BY ALL HAVING sum(qtf * c) > 0),
    o AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s JOIN n USING (r))
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 20
    """,
)
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for every benchmark item, over all documents."""
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
