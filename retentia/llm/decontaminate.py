"""Operator 9, benchmark decontamination by pigeonhole edit matching.

A test item of m words may occur with up to ``e = floor(rate * m)`` word edits (substitutions,
insertions, deletions).  Its words are split into e + 1 pieces; an occurrence within the
budget leaves one piece untouched, so every occurrence shows an exact piece hit.  Documents are
searched for the hashes of all pieces' first ``seed`` words (vectorised, a bitmap before the exact
table); a hit fixes where the item would begin, and Myers' bit-parallel algorithm, on
words, decides whether the item occurs there within the budget.

Words are lower-case letters and digits (and all other letters) between any ASCII marks or
blanks, so case and punctuation do not hide a leak.  In scripts written without blanks
(UNSPACED) every character is a word.

The benchmark is small by nature but not by proof: it is taken in groups of about GROUP_CHARS
characters.  One group is broadcast in one pass over the documents; of several, each has a
stored pass of its own, which returns only the documents with hits, and is released before the
next one is read, so the driver and the tasks hold one group at a time.

Cases: an item of fewer than ``min_words`` words is matched word for word (its budget is 0) if
it has at least ``min_bytes`` bytes of letters and digits in UTF-8; a shorter one, "two words",
cannot be told from chance and is matched nowhere.  Null or empty texts match nothing; repeated
items are reported under each id; repeated documents are rows of their own.  An empty benchmark
leaves everything clean.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentia.llm.common import query, stored, sub_batches, table
from retentia.llm.words import sequence_hashes, span_hashes, text_bytes, word_spans

RATE = 0.1
MIN_WORDS = 6
MIN_BYTES = 20  # of items with fewer words than MIN_WORDS
GROUP_CHARS = 6_000_000

# Code points of scripts that put no blanks between words (Thai and Lao, Myanmar,
# Khmer, kana, ideographs)
UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FFFF)]

# every ASCII byte that is no letter or digit reads as a blank
_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[[b for b in range(128) if not chr(b).isalnum()]] = 32


def normal_words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every normalised word, first word of each text); the text is lower case already."""
    data, offsets = apart(*text_bytes(col))
    data = _BLANK[data]
    starts, ends, first = word_spans(data, offsets)
    return span_hashes(data, starts, ends), first


def apart(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a blank on both sides of every character of an unspaced script."""
    lead = np.flatnonzero(data >= 0xE0)  # three or four bytes: everything from U+0800 on
    if not len(lead):
        return data, offsets
    four = data[lead] >= 0xF0
    b = [data[np.minimum(lead + i, len(data) - 1)].astype(np.int64) & 0x3F for i in (1, 2, 3)]
    point = np.where(four, (data[lead] & 7).astype(np.int64) << 18 | b[0] << 12 | b[1] << 6 | b[2], (data[lead] & 15).astype(np.int64) << 12 | b[0] << 6 | b[1])
    alone = np.zeros(len(lead), dtype=bool)
    for low, high in UNSPACED:
        alone |= (point >= low) & (point <= high)
    at, size = lead[alone], np.where(four, 4, 3)[alone]
    return np.insert(data, np.concatenate([at, at + size]), 32), offsets + 2 * np.searchsorted(at, offsets)


def within_budget(pattern: np.ndarray, text: np.ndarray, budget: int) -> bool:
    """Whether ``pattern`` occurs in ``text`` with at most ``budget`` edits: Myers' algorithm,
    the pattern's words as bits of one integer, any start and end in the text."""
    m = len(pattern)
    where: dict[int, int] = {}
    for i, w in enumerate(pattern.tolist()):
        where[w] = where.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    for w in text.tolist():
        eq = where.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score <= budget:
            return True
    return False


class Items:
    """A group of test items, indexed by the seeds of their pieces."""

    def __init__(self, rows: list[tuple[object, np.ndarray]], rate: float):
        self.ids, self.words, self.budget = [], [], []
        seeds: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for item, w in rows:
            e = int(rate * len(w) + 1e-9)
            k = len(self.ids)
            self.ids.append(item)
            self.words.append(w)
            self.budget.append(e)
            cuts = [len(w) * i // (e + 1) for i in range(e + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                length = min(b - a, 8)  # the seed: a piece's first words
                seeds.setdefault(length, {}).setdefault(int(sequence_hashes(w[a : a + length], length)[0]), []).append((k, a))
        self.seeds = []
        for length, table_ in sorted(seeds.items()):
            keys = np.array(sorted(table_), dtype=np.uint64)
            bits = np.zeros(1 << 16, dtype=bool)
            bits[(keys >> np.uint64(48)).astype(np.int64)] = True
            self.seeds.append((length, keys, bits, [table_[int(x)] for x in keys]))

    def search(self, w: np.ndarray, first: np.ndarray) -> dict[int, set[int]]:
        """Texts (by place in the batch) -> indices of the items they hold."""
        found: dict[int, set[int]] = {}
        tried: set[tuple[int, int, int]] = set()
        for length, keys, bits, places in self.seeds:
            h = sequence_hashes(w, length)
            if not len(h):
                continue
            at = np.flatnonzero(bits[(h >> np.uint64(48)).astype(np.int64)])
            slot = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
            hit = keys[slot] == h[at]
            at, slot = at[hit], slot[hit]
            doc = np.searchsorted(first, at, side="right") - 1
            inside = at + length <= first[doc + 1]
            for p, s, d in zip(at[inside].tolist(), slot[inside].tolist(), doc[inside].tolist(), strict=True):
                for k, offset in places[s]:
                    if k in found.get(d, ()):
                        continue
                    e, start = self.budget[k], p - offset
                    if (d, k, start) in tried:
                        continue
                    tried.add((d, k, start))
                    a, b = max(int(first[d]), start - e), min(int(first[d + 1]), start + len(self.words[k]) + e)
                    if within_budget(self.words[k], w[a:b], e):
                        found.setdefault(d, set()).add(k)
        return found


def item_groups(benchmark: DataFrame, key: str, text: str, rate: float, min_words: int, min_bytes: int, group_chars: int):
    """Broadcastable groups of items of about ``group_chars`` characters; the next one is read when
    the one before is done with."""
    src = benchmark.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.lower(F.col(text)).alias("t"))
    total = src.agg(F.sum(F.length("t")).alias("n")).first()["n"] or 0
    groups = max(1, -(-total // group_chars))
    for g in range(groups):
        rows = src.where(F.pmod(F.xxhash64("k", "t"), F.lit(groups)) == g).orderBy("k", "t").collect()
        col = pa.array([r["t"] for r in rows], pa.string())
        w, first = normal_words(col)
        items = []
        for i, r in enumerate(rows):
            words = w[first[i] : first[i + 1]]
            if len(words) >= min_words or len(words) and letters(r["t"]) >= min_bytes:
                items.append((r["k"], words))
        yield groups, Items(items, rate)


def letters(text: str) -> int:
    """Bytes of a lower-case text that are no blanks to ``normal_words``."""
    return int((_BLANK[np.frombuffer(text.encode(), dtype=np.uint8)] != 32).sum())


def search_rows(docs: DataFrame, benchmark: DataFrame, text: str, item_key: str, item_text: str, rate: float, min_words: int, min_bytes: int, group_chars: int, name: str) -> DataFrame:
    """``docs`` with an array column ``name`` of the items each row holds."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark, item = docs.sparkSession, benchmark.schema[item_key].dataType
    item_type = pa.list_(to_arrow_type(item))
    low, rid = (free_name(docs, x) for x in ("_low", "_row"))
    src, found = docs.withColumn(low, F.lower(F.col(text))), None
    for groups, items in item_groups(benchmark, item_key, item_text, rate, min_words, min_bytes, group_chars):
        shared = spark.sparkContext.broadcast(items)

        def run(batches, shared=shared, sparse=groups > 1):
            for batch in batches:
                n = batch.num_columns - 1  # the last one is the lower-case text
                for part in sub_batches(batch, low):
                    hits = shared.value.search(*normal_words(part.column(n)))
                    ids = [sorted({shared.value.ids[k] for k in hits.get(i, ())}, key=lambda v: (v is None, v)) for i in range(part.num_rows)]
                    out = pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(ids, item_type)], names=[*part.schema.names[:n], name])
                    yield out.filter(pa.array([bool(x) for x in ids])) if sparse else out

        if groups == 1:
            return src.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(item))]))
        if found is None:
            src = stored(src.withColumn(rid, F.monotonically_increasing_id()), "leak-rows")
        kind = T.StructType([T.StructField(rid, T.LongType()), T.StructField(name, T.ArrayType(item))])
        part = stored(src.select(rid, low).mapInArrow(run, kind), "leak-hits")
        shared.unpersist()
        found = part if found is None else found.unionByName(part)
    merged = found.groupBy(rid).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(name)))).alias(name))
    out = src.join(merged, rid, "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(T.ArrayType(item))))
    return out.select(*docs.columns, name)


def free_name(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
               rate: float = RATE, min_words: int = MIN_WORDS, min_bytes: int = MIN_BYTES, group_chars: int = GROUP_CHARS) -> DataFrame:
    """Per row: key, item_ids (sorted, of all items it holds), contaminated."""
    src = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    out = search_rows(src, benchmark, "t", item_key, item_text, rate, min_words, min_bytes, group_chars, "item_ids")
    return out.select(F.col("k").alias(key), "item_ids", (F.size("item_ids") > 0).alias("contaminated"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", rate: float = RATE,
               min_words: int = MIN_WORDS, min_bytes: int = MIN_BYTES, group_chars: int = GROUP_CHARS) -> DataFrame:
    """The rows of ``docs`` (all columns) that hold no item."""
    name = free_name(docs, "_items")
    out = search_rows(docs, benchmark, text, item_key, item_text, rate, min_words, min_bytes, group_chars, name)
    return out.where(F.size(name) == 0).drop(name)


@query("op9_decontaminate")
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items held by every document."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
