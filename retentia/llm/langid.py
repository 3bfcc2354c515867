"""Operator 1, language identification by cross-parsing.

``fit`` draws a bounded sample of labelled text per language and builds the suffix automaton
of each.  A text is cut greedily into phrases, each the longest match from its position that
occurs in the language's sample; ``c`` phrases in ``m`` characters against a sample of ``n``
characters estimate the cross entropy ``c * log2(n) / m``.  The language with the fewest
phrases so normalised wins.

Before parsing, letters are folded to lower case and every run of other characters becomes
one blank, so digits, punctuation and capitals carry no weight.  Long texts are parsed in
blocks of ``BLOCK`` characters side by side (a block's end closes its last phrase); every
character of every text is parsed.

Cases: null text, or text without a letter: ``und`` with score 0.  Equal estimates: the
smaller language name.  A null doc_id counts as not held out.  No training rows: every text
is ``und``.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retentia.llm.common import fold, query, stored, sub_batches, table

#: Bound of the fit: characters of labelled text per language, in pieces from many rows.
SAMPLE_CHARS = 24_000
PIECE_CHARS = 1_500
#: Bound of all languages' samples together: with more languages each gets less.
TOTAL_CHARS = 4_000_000
#: Letters with a column of the dense table (the most frequent); the others are looked up by search.
DENSE_LETTERS = 120
BLOCK = 512


@dataclass
class Parser:
    """A language's automaton.  State 0 is 'no phrase open', where every character begins a
    phrase.  Frequent letters have columns of a dense table, whose entries are states times its
    row length; transitions by the other letters are a sorted list of (state, letter)."""

    lang: str
    letters: np.ndarray  # code points of the sample; the first DENSE_LETTERS have columns 1..
    table: np.ndarray  # int32, states x columns, flat; column 0: not in the sample
    first: np.ndarray  # int32, per letter + 1: the state after a phrase's first character
    sparse: np.ndarray  # int64, state << 32 | letter, sorted
    to: np.ndarray  # int32, the state that each leads to
    n: int  # characters of the sample

    @property
    def width(self) -> int:
        return min(len(self.letters), DENSE_LETTERS) + 1


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the start."""
    trans: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(trans)
        trans.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in trans[p]:
            trans[p][c] = cur
            p = link[p]
        if p >= 0:
            q = trans[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(trans)
                trans.append(dict(trans[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[cur] = clone
                while p >= 0 and trans[p].get(c) == q:
                    trans[p][c] = clone
                    p = link[p]
        last = cur
    return trans


def build_parser(lang: str, pieces: list[str]) -> Parser:
    points = [p for p in (normalised(x)[0] for x in pieces) if len(p)]
    joined = np.concatenate(points) if points else np.zeros(0, np.uint32)
    values, counts = np.unique(joined, return_counts=True)
    letters = values[np.argsort(-counts, kind="stable")]
    number = {int(v): i + 1 for i, v in enumerate(letters.tolist())}
    codes: list[int] = []
    for k, p in enumerate(points):
        # a code of its own between two pieces: no match runs across them
        codes += [-k - 1] + [number[v] for v in p.tolist()]
    trans = suffix_automaton(codes)
    width = min(len(letters), DENSE_LETTERS) + 1
    flat = np.zeros((len(trans) + 1) * width, dtype=np.int32)
    first = np.zeros(len(letters) + 1, dtype=np.int32)
    rare: list[tuple[int, int]] = []
    for s, t in enumerate(trans):
        for c, to in t.items():
            if c > 0:
                if c < width:
                    flat[(s + 1) * width + c] = (to + 1) * width
                else:
                    rare.append((s + 1 << 32 | c, (to + 1) * width))
                if s == 0:
                    first[c] = (to + 1) * width
    rare.sort()
    sparse, to = (np.array([x[i] for x in rare], dtype=kind) for i, kind in ((0, np.int64), (1, np.int32)))
    return Parser(lang, letters, flat, first, sparse, to, max(2, len(joined)))


_fold: np.ndarray | None = None


def _fold_table() -> np.ndarray:
    """Code point of the basic plane -> its lower-case letter, or 0 if it is no letter."""
    global _fold
    if _fold is None:
        t = np.zeros(0x10000, dtype=np.uint32)
        for i in range(0x10000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                t[i] = ord(low) if len(low) == 1 else i
        _fold = t
    return _fold


def normalised(text: str) -> tuple[np.ndarray, bool]:
    """(code points with letters folded and other runs as one blank, whether any letter)."""
    x = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    y = _fold_table()[np.minimum(x, 0xFFFF)]
    for i in np.flatnonzero(x > 0xFFFF):
        c = chr(int(x[i]))
        y[i] = ord(c.lower()[0]) if c.isalpha() else 0
    letter = y > 0
    any_letter = bool(letter.any())
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of others stays, as the blank
    out = y[keep]
    out[out == 0] = 32
    return out, any_letter


def count_phrases(parser: Parser, lanes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Phrases of each lane.  ``lanes``: BLOCK x lanes code points, lanes by falling length."""
    lut = np.zeros(max(0x10000, int(lanes.max(initial=0)) + 1), dtype=np.int32)
    known = parser.letters < len(lut)
    lut[parser.letters[known]] = np.flatnonzero(known) + 1
    width = parser.width
    state = np.zeros(lanes.shape[1], dtype=np.int32)
    count = np.zeros(lanes.shape[1], dtype=np.int32)
    active = np.searchsorted(-lengths, -np.arange(len(lanes)), side="left")
    for j in range(len(lanes)):
        k = active[j]
        if not k:
            break
        c = lut[lanes[j, :k]]
        if len(parser.sparse):
            nxt = parser.table[state[:k] + np.where(c < width, c, 0)]
            rare = np.flatnonzero(c >= width)
            if len(rare):
                ask = (state[rare] // width).astype(np.int64) << 32 | c[rare]
                at = np.minimum(np.searchsorted(parser.sparse, ask), len(parser.sparse) - 1)
                nxt[rare] = np.where(parser.sparse[at] == ask, parser.to[at], 0)
        else:
            nxt = parser.table[state[:k] + c]
        new = nxt == 0
        count[:k] += new
        state[:k] = np.where(new, parser.first[c], nxt)
    return count


def identify(texts: list[str | None], parsers: list[Parser]) -> tuple[list[str], list[float]]:
    """Predicted language and score (share of the runner-up's entropy in the best two's sum,
    0.5 to 1) of each text."""
    points, owner, lang, score = [], [], ["und"] * len(texts), [0.0] * len(texts)
    for i, t in enumerate(texts):
        p, letters = normalised(t) if t else (None, False)
        if letters and parsers:
            points.append(p)
            owner.append(i)
    if not points:
        return lang, score
    sizes = np.array([len(p) for p in points])
    cuts = [(d, a, min(a + BLOCK, n)) for d, n in enumerate(sizes) for a in range(0, n, BLOCK)]
    cuts.sort(key=lambda x: x[1] - x[2])
    lengths = np.array([b - a for _, a, b in cuts])
    wide = any(int(p.max()) > 0xFFFF for p in points)
    lanes = np.zeros((int(lengths[0]), len(cuts)), dtype=np.uint32 if wide else np.uint16)
    for k, (d, a, b) in enumerate(cuts):
        lanes[: b - a, k] = points[d][a:b]
    docs = np.array([d for d, _, _ in cuts])
    bits = np.empty((len(parsers), len(points)))
    for r, p in enumerate(parsers):
        bits[r] = np.bincount(docs, weights=count_phrases(p, lanes, lengths), minlength=len(points)) * math.log2(p.n) / sizes
    order = np.sort(bits, axis=0)
    best = bits.argmin(axis=0)  # parsers are sorted by name: ties to the smaller
    second = order[1] if len(parsers) > 1 else np.full(len(points), np.inf)
    with np.errstate(invalid="ignore"):
        ratio = np.where(np.isinf(second), 1.0, second / np.maximum(order[0] + second, 1e-300))
    for d, i in enumerate(owner):
        lang[i], score[i] = parsers[best[d]].lang, float(ratio[d])
    return lang, score


def fit(train: DataFrame, key: str, text: str, label: str, sample_chars: int = SAMPLE_CHARS, total_chars: int = TOTAL_CHARS) -> list[Parser]:
    """One parser per label from a sample of at most ``sample_chars`` characters each, and at most
    ``total_chars`` of all labels together.

    Two passes, however many labels there are: rows per label are counted, then a share of each
    label's, chosen by a hash of the key, is read; of each chosen row one piece of ``PIECE_CHARS``
    characters from a hashed offset goes to the driver, at most 12 times what is used."""
    rows = train.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).cast("string").alias("l"))
    rows = rows.withColumn("h", F.xxhash64(F.lit(17), "k", F.length("t")))
    counts = stored(rows.groupBy("l").agg(F.count("*").alias("n")), "languages")  # one row a label
    sample_chars = min(sample_chars, total_chars // max(1, counts.count()))
    want = 3 * max(1, sample_chars // PIECE_CHARS)
    drawn = rows.join(F.broadcast(counts), "l").where(F.pmod("h", F.lit(1_000_003)) < F.lit(want * 1_000_003) / F.col("n"))
    at = F.pmod(F.col("h"), F.greatest(F.lit(1), F.length("t") - PIECE_CHARS + 1)).cast("int") + 1
    pieces_of = drawn.select("l", "h", F.col("t").substr(at, F.lit(PIECE_CHARS)).alias("p"))
    first = F.row_number().over(Window.partitionBy("l").orderBy("h", "p"))
    got: dict[str, list[str]] = {}
    for r in pieces_of.withColumn("i", first).where(F.col("i") <= 4 * want).orderBy("l", "i").toLocalIterator():
        got.setdefault(r["l"], []).append(r["p"])
    parsers = []
    for lang in sorted(got):
        pieces, total = [], 0
        for p in dict.fromkeys(got[lang]):
            if total >= sample_chars:
                break
            pieces.append(p[: sample_chars - total])
            total += len(pieces[-1])
        if any(normalised(p)[1] for p in pieces):
            parsers.append(build_parser(lang, pieces))
    return parsers


def predict(spark: SparkSession, docs: DataFrame, key: str, text: str, parsers: list[Parser]) -> DataFrame:
    """(key, lang_pred, score) for every row, in one pass; the parsers are broadcast (a sample of n
    characters has at most 2 n states of DENSE_LETTERS + 1 columns and 3 n transitions; the samples
    together are at most TOTAL_CHARS)."""
    shared = spark.sparkContext.broadcast(parsers)

    def run(batches):
        model = shared.value
        for batch in batches:
            for part in sub_batches(batch, "t", 1 << 20):
                lang, score = identify(part.column(1).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["k", "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, lang_pred string, score double")
    return out.withColumnRenamed("k", key)


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents; learned from those whose crc32(doc_id) mod 3 is not 1."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    parsers = fit(docs.where(~held_out), "doc_id", "text", "lang")
    out = predict(spark, docs.select("doc_id", "text"), "doc_id", "text", parsers)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
