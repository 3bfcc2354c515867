"""Operator 6, n-gram Jaccard join with PartEnum signatures.

A document's set holds the hashes of its distinct word n-grams.  Two sets link when
|A & B| / |A | B| >= t.  Sets are classed in size bands whose ends grow by 1/t, so linked
sets lie in one band or two neighbouring ones; a set signs for its own band and, as the smaller
side, for the next.  In a band with largest size r linked sets differ in at most
k = floor(2 r (1 - t) / (1 + t)) elements.

PartEnum: the domain is partitioned into n1 parts and each part into n2 = 3 subparts.  Of
n1 > k / 2 parts at least n1 - floor(k / 2) differ in one element at most, and leaving out the
subpart with that element leaves two equal ones; so the signatures (part, two of its
subparts, their elements), all three subsets enumerated, include one that linked sets share.  n1
is chosen with room: a set whose parts without elements in two subparts number less than
n1 - floor(k / 2) signs no empty subset, and no link is lost, because a shared good part
with elements is left over (equal projections are empty on both sides or on neither).
Shingles that many different sets hold (shared lines and passages) are left out of the
signatures, not of the sets: on the rest of the domain linked sets differ in no more than k
elements either, so any such list loses nothing.  It is drawn from a bounded sample.  Sets with
too little else sign a second time with all their elements, to meet each other.

Steps: (1) sets are reduced to fingerprints and parity sketches; documents with one fingerprint are
one class.  (2) Every chunk sends its classes' signatures once, in compact blocks, to partitions by
band and signature: a class signs for two bands and so names itself in the partitions of two,
however many partitions there are.  Classes that share a signature are candidate pairs: all pairs of
a signature with at most PAIRS_UP_TO classes, and of a more frequent ("hot") one each class with the
smallest.  (3) Sizes and sketches, a few bits a shingle, strike out candidate pairs that cannot
link; most share one signature by chance.  (4) The others are verified, exactly: the sets of their
classes are made again from one row each, dealt into blocks bounded in sets and in shingles, and only
to block pairs that hold a candidate.  Sets are shuffled as they are made and not stored, and the
shuffle files of a large step go when its result is written.  Their links give components.  (5) A hot signature whose classes ended in one component is done, which m near
copies reach with m - 1 pairs a signature.  Of the others, the classes of different components are
compared in larger blocks, pairs that are connected by then are passed over.  (6) Components of all
links.  With ``count`` all pairs of every signature are candidates and the links of each class are
counted; that is as much work as there are links.

Rows of equal sets never meet: a class is represented by one row, found by its hash, and while
those rows are few (counted) they are broadcast and no text is shuffled.

Cases: null texts and texts without words have the empty set and link with nothing.  Fewer than
n words: the whole sequence is the one shingle.  Every row counts by its own set, also where rows
share an id.  A null id takes part like any other (a class is known by its fingerprint and one of its
rows), but a component's id is the smallest one that is not null.  Empty tables give empty results.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.llm.common import give_back, join_hot, order_key, partitions, query, stored, sub_batches, table
from retentia.llm.lm import planes, runs, unplanes
from retentia.llm.substring import five, unfive
from retentia.llm.words import mix, sequence_hashes, spread, word_hashes

CHUNK = 4 << 20
SIGNATURES_PER_PARTITION = 4_000_000
#: Signatures shared by more classes than this pair each class with the smallest only.
PAIRS_UP_TO = 8
#: Sets compared against each other in one task: two blocks of about so many sets and shingles.
BLOCK_SETS, BLOCK_SHINGLES = 256, 2_000_000
#: Sets of a block where all blocks of a cluster meet, and each set travels once a block.
OPEN_SETS = 2_048
#: Rows that stand for classes in pairs: above this they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Shared shingles are looked for in about so many documents; at most so many are listed.
HOT_SAMPLE, HOT_LIST = 20_000, 1 << 18
HOT_FROM = 4
SKETCH_WORDS = 16  # 1,024 parity bits
LEAST_BITS, MOST_BITS = 64, 1 << 20  # of a set's own sketch
TIES = "a long, b long, s long"


class Bands:
    """Size bands and PartEnum parameters of a threshold (``num`` / ``den``)."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.t = num, den, num / den
        self.room = 1.15 if self.t >= 0.85 else 1.5

    def of(self, n: np.ndarray) -> np.ndarray:
        """Band of each set size: band j ends at ``ends[j]``."""
        return np.searchsorted(self.ends(int(n.max(initial=1))), n, side="left")

    def ends(self, top: int) -> np.ndarray:
        out = [1]
        while out[-1] < top:
            # the next band starts at end + 1 and holds all sizes up to (end + 1) / t
            out.append((out[-1] + 1) * self.den // self.num)
        return np.array(out + [(out[-1] + 1) * self.den // self.num], dtype=np.int64)

    def budget(self, r: np.ndarray) -> np.ndarray:
        """Largest difference of linked sets of at most ``r`` elements."""
        return 2 * r * (self.den - self.num) // (self.den + self.num)

    def parts(self, k: np.ndarray) -> np.ndarray:
        return np.ceil((k // 2 + 1) * self.room).astype(np.int64) + 2


def shingle_sets(col: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, first = word_hashes(col, lower=True)
    s = sequence_hashes(h, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(s[a : b - n + 1]))
        elif b > a:
            out.append(mix(sequence_hashes(h[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprint(s: np.ndarray) -> int:
    """One number for a set (as a signed long); 0 for the empty set."""
    if not len(s):
        return 0
    x = int(mix(np.array([np.add.reduce(mix(s)) + np.uint64(len(s))], dtype=np.uint64))[0]) or 1
    return x - (1 << 64) if x >> 63 else x


def sketches(sets: list[np.ndarray]) -> list[bytes]:
    """A parity sketch of each set: every element flips one of as many bits as the set has elements or
    more, a power of two.  A longer sketch folds onto a shorter one (``apart_by``)."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    bits = np.left_shift(1, np.ceil(np.log2(np.clip(size, LEAST_BITS, MOST_BITS))).astype(np.int64))
    bits[size == 0] = 0
    end = np.cumsum(bits)
    first, mask = np.repeat(end - bits, size), np.repeat((bits - 1).astype(np.uint64), size)
    at = first + (mix(np.concatenate([*sets, np.zeros(0, np.uint64)])) & mask).astype(np.int64)
    odd = np.bincount(at, minlength=int(bits.sum())).astype(np.uint8) & 1
    raw = np.packbits(odd, bitorder="little").tobytes()
    return [raw[(e - b) // 8 : e // 8] for e, b in zip(end.tolist(), bits.tolist(), strict=True)]


def apart_by(a: bytes, b: bytes) -> int:
    """A lower bound of the number of elements that only one of two sets has, by their sketches."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    n, m = 8 * len(a), 8 * len(b)
    while n > m:
        n //= 2
        x = (x >> n) ^ (x & ((1 << n) - 1))
    while m > n:
        m //= 2
        y = (y >> m) ^ (y & ((1 << m) - 1))
    return (x ^ y).bit_count()


class Shared:
    """The listed shingles: a bitmap before an exact search."""

    def __init__(self, hashes: list[int]):
        self.hash = np.sort(np.array(hashes, dtype=np.int64).view(np.uint64))
        self.bits = np.zeros(1 << 24, dtype=bool)
        self.bits[(self.hash >> np.uint64(40)).astype(np.int64)] = True

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = self.bits[(x >> np.uint64(40)).astype(np.int64)]
        at = np.flatnonzero(out)
        if len(at):
            out[at] = self.hash[np.minimum(np.searchsorted(self.hash, x[at]), len(self.hash) - 1)] == x[at]
        return out


def find_shared(src: DataFrame, n: int, total: int) -> Shared:
    """Shingles of at least HOT_FROM different sets of a hashed sample of the documents."""

    def count_sets(batches):
        for batch in batches:
            for part in sub_batches(batch, "t", CHUNK):
                sets = {fingerprint(s): s for s in shingle_sets(part.column(1), n)}
                u, c = np.unique(np.concatenate([*sets.values(), np.zeros(0, np.uint64)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], names=["h", "c"])

    share = min(1.0, HOT_SAMPLE / max(1, total))
    # by the row, not the id alone: rows that share an id or have none are sampled one by one
    sample = src.where(F.pmod(F.xxhash64(F.lit(61), "k"), F.lit(1_000_003)) < F.lit(share * 1_000_003))
    rows = sample.mapInArrow(count_sets, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= HOT_FROM)
    return Shared([r["h"] for r in rows.orderBy(F.col("c").desc(), "h").limit(HOT_LIST).select("h").collect()])


def sign(elements: np.ndarray, owner: np.ndarray, n1: np.ndarray, k: np.ndarray, family: np.ndarray, empty: bool):
    """([(signatures, set of each)], sparse sets): the subsets of subparts of each set's ``n1``
    parts.  Sparse sets have no good part with elements for certain; ``empty`` has them
    sign empty subsets."""
    total, n_sets = int(n1.sum()), len(n1)
    if not total:
        return [], np.zeros(n_sets, dtype=bool)
    cell0 = np.cumsum(n1) - n1
    live = n1[owner] > 0
    elements, owner = elements[live], owner[live]
    inner = mix(elements ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    sub = (inner % np.uint64(3)).astype(np.int64)
    # a part is a range of the hash, so a set's parts lie one after another
    cell = cell0[owner] + (((elements >> np.uint64(32)).astype(np.int64) * n1[owner]) >> 32)
    s, _ = runs(cell)
    sums, filled = np.zeros((3, total), dtype=np.uint64), np.zeros((3, total), dtype=bool)
    for q in range(3) if len(s) else ():
        chosen = sub == q
        sums[q, cell[s]] = np.add.reduceat(np.where(chosen, inner, np.uint64(0)), s)
        filled[q, cell[s]] = np.add.reduceat(chosen.astype(np.int64), s) > 0
    of = np.repeat(np.arange(n_sets), n1)
    lone = filled.sum(axis=0) <= 1  # two subparts empty: some subset is
    sparse = (n1 > 0) & (np.bincount(of, weights=lone, minlength=n_sets) >= n1 - k // 2)
    tag = mix(family[of].astype(np.uint64) << np.uint64(40) | (np.arange(total) - cell0[of]).astype(np.uint64))
    out = []
    for q in range(3):
        a, b = (q + 1) % 3, (q + 2) % 3
        go = filled[a] | filled[b] | (sparse[of] & empty)
        out.append((mix(sums[a] + sums[b] * np.uint64(3) + tag + np.uint64(q))[go], of[go]))
    return out, sparse


def signatures(sets: list[np.ndarray], bands: Bands, shared: Shared | None = None) -> tuple[np.ndarray, ...]:
    """(signature, set index, whether the set is of the band itself) for every set."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    if not len(size) or not size.sum():
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z.astype(bool)
    band, ends = bands.of(size), bands.ends(int(size.max()))
    elements = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    rare = ~shared.holds(elements) if shared is not None else np.ones(len(elements), dtype=bool)
    out = []
    for up in (0, 1):
        k = bands.budget(ends[band + up])
        n1 = np.where((k > 0) & (size > 0), bands.parts(k), 0)
        got, sparse = sign(elements[rare], owner[rare], n1, k, (band + up) * 2, shared is None)
        out += [(sig, of, np.full(len(sig), up == 0)) for sig, of in got]
        if shared is not None and sparse.any():
            # little but shared shingles: two such sets meet by signatures of all their elements
            n1 = np.where(sparse, n1, 0)
            go = sparse[owner]
            got, _ = sign(elements[go], owner[go], n1, k, (band + up) * 2 + 1, True)
            out += [(sig, of, np.full(len(sig), up == 0)) for sig, of in got]
    if not out:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z.astype(bool)
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def tie(rows: list, most: int | None = PAIRS_UP_TO) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, s) from a partition's blocks: candidate pairs a > b of classes that share a signature
    (s = 0), and of a signature with more than ``most`` classes (None: no limit) each class a with
    the smallest b, under the signature's own number s."""
    base = np.cumsum([0] + [len(r[0]) for r in rows])
    classes = np.concatenate([r[0] for r in rows])
    node = np.concatenate([unplanes(r[1]).astype(np.int64) + b for r, b in zip(rows, base, strict=False)])
    own = np.concatenate([np.unpackbits(np.frombuffer(r[2], np.uint8), count=r[1][1]) for r in rows]).astype(bool)
    sig = np.concatenate([unfive(r[3]) for r in rows])
    cls = classes[node]
    order = np.lexsort((~own, cls, sig))
    new = np.ones(len(order), dtype=bool)  # one entry of each class and signature, its own band's first
    new[1:] = (sig[order][1:] != sig[order][:-1]) | (cls[order][1:] != cls[order][:-1])
    order = order[new]
    s, n = runs(sig[order])
    found = []
    hot = n > len(order) if most is None else n > most
    # all pairs of the small groups, by distance of their members; two sets that both sign for the
    # band above theirs meet in their own band as well
    for step in range(1, int(n[~hot].max(initial=1))):
        wide = ~hot & (n > step)
        y = spread(s[wide], n[wide] - step)
        x, y = order[y + step], order[y]
        go = own[x] | own[y]
        found.append((cls[x[go]], cls[y[go]], np.zeros(int(go.sum()), np.int64)))
    at = order[spread(s[hot], n[hot])]
    group = np.repeat(np.arange(int(hot.sum())), n[hot])
    any_own = np.bincount(group, weights=own[at], minlength=int(hot.sum())) > 0
    first = cls[order[s[hot]]]  # members lie by class
    go = any_own[group] & (cls[at] != first[group])
    number = (mix(sig[order[s[hot]]]) >> np.uint64(1)).astype(np.int64) | 1
    found.append((cls[at[go]], first[group[go]], number[group[go]]))
    a, b, c = (np.concatenate([f[i] for f in found]) for i in range(3))
    keep = np.unique(np.stack([a, b, c], axis=1), axis=0) if len(a) else np.zeros((0, 3), np.int64)
    return keep[:, 0], keep[:, 1], keep[:, 2]


def forest(edges: DataFrame) -> DataFrame:
    """Fewer edges (a, b) with the same components: dealt by hash into groups of bounded size,
    each keeps a spanning forest of its own edges."""
    n = edges.count()
    groups = max(16, -(-n // 200_000))

    def span(t: pa.Table) -> pa.Table:
        nodes, at = np.unique(np.concatenate([t["a"].to_numpy(), t["b"].to_numpy()]), return_inverse=True)
        root = list(range(len(nodes)))
        keep = []
        half = len(at) // 2
        for i, (x, y) in enumerate(zip(at[:half].tolist(), at[half:].tolist(), strict=True)):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            while root[y] != y:
                root[y] = root[root[y]]
                y = root[y]
            if x != y:
                root[max(x, y)] = min(x, y)
                keep.append(i)
        return t.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    dealt = edges.select("a", "b", F.pmod(F.xxhash64("a", "b"), F.lit(groups)).cast("int").alias("g"))
    return dealt.groupBy("g").applyInArrow(span, "a long, b long")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root): one root for all nodes that hang together over ``edges`` (a, b).

    Every round a node takes the smallest of itself and its neighbours, labels jump twice, and
    the edges are contracted to their labels; what is left shrinks round by round."""
    edges = stored(forest(stored(edges.where("a <> b"), f"{name}-edges")), f"{name}-edges")
    labels = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up"))
        up = stored(up, f"{name}-labels")
        for _ in range(2):
            jump = up.select(F.col("node").alias("up"), F.col("up").alias("far"))
            up = join_hot(up, jump, "up").select("node", F.col("far").alias("up"))
        up = stored(up, f"{name}-labels")
        if labels is None:
            labels = up.withColumnRenamed("up", "root")
        else:
            step = up.select(F.col("node").alias("root"), "up")
            labels = stored(join_hot(labels, step, "root", "left").select("node", F.coalesce("up", "root").alias("root")), f"{name}-labels")
        ends = join_hot(edges, up.select(F.col("node").alias("b"), F.col("up").alias("y")), "b").join(up.select(F.col("node").alias("a"), F.col("up").alias("x")), "a")
        edges = stored(ends.select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b").distinct(), f"{name}-edges")
        if not edges.limit(1).count():
            return labels


def common(a: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Elements that each of the other sets shares with ``a`` (all sorted)."""
    joined = np.concatenate(others)
    at = np.searchsorted(a, joined)
    at[at == len(a)] = 0
    sizes = np.array([len(x) for x in others])
    return np.add.reduceat((a[at] == joined).astype(np.int64), np.cumsum(sizes) - sizes)


def linked(x: np.ndarray, others: list[np.ndarray], bands: Bands) -> np.ndarray:
    """Which of the other sets link with ``x``."""
    size = np.array([len(o) for o in others])
    inter = common(x, others)
    return inter * bands.den >= (len(x) + size - inter) * bands.num


def link_pairs(f: np.ndarray, sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, bands: Bands) -> np.ndarray:
    """Which of the pairs (a, b) of classes link; ``f``: the classes of the sets, rising."""
    out = np.zeros(len(a), dtype=bool)
    i, j = np.searchsorted(f, a), np.searchsorted(f, b)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    close = np.minimum(size[i], size[j]) * bands.den >= np.maximum(size[i], size[j]) * bands.num
    at = np.flatnonzero(close)
    at = at[np.argsort(i[at], kind="stable")]
    for start, n in zip(*(r.tolist() for r in runs(i[at])), strict=True):
        p = at[start : start + n]
        for q in range(0, n, 64):  # the others of one set, some at a time
            out[p[q : q + 64]] = linked(sets[i[p[0]]], [sets[x] for x in j[p[q : q + 64]]], bands)
    return out


def link_block(f: np.ndarray, sets: list[np.ndarray], label: np.ndarray, first_half: np.ndarray, within: bool, bands: Bands) -> list[tuple[int, int]]:
    """Links that connect sets of different labels: between the halves, or all if ``within``.  Pairs
    that are connected already are passed over; sizes, a parity sketch (a lower bound of the
    difference) and the exact intersection decide about the others."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    sketch = np.zeros((len(sets), SKETCH_WORDS), dtype=np.uint64)
    bits = SKETCH_WORDS * 64
    for i, s in enumerate(sets):
        odd = np.bincount((mix(s) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
        sketch[i] = np.packbits(odd.astype(np.uint8)).view(np.uint64)
    root = np.unique(label, return_inverse=True)[1]
    links = []
    for i in range(len(sets)):
        if within:
            j = np.arange(i + 1, len(sets))
        elif first_half[i]:
            j = np.flatnonzero(~first_half)
        else:
            continue
        j = j[root[j] != root[i]]
        j = j[np.minimum(size[i], size[j]) * bands.den >= np.maximum(size[i], size[j]) * bands.num]
        # |A & B| >= t/(1+t) (a+b), so the difference is at most (1-t)/(1+t) (a+b)
        least = np.bitwise_count(sketch[j] ^ sketch[i]).sum(axis=1)
        j = j[least <= (size[i] + size[j]) * (bands.den - bands.num) // (bands.den + bands.num)]
        if not len(j):
            continue
        j = j[linked(sets[i], [sets[x] for x in j], bands)]
        for r, x in zip(*np.unique(root[j], return_index=True), strict=True):
            if r != root[i]:
                links.append((int(f[i]), int(f[j[x]])))
                root[root == r] = root[i]
    return links


def in_blocks(nodes: DataFrame, clusters: DataFrame, own: DataFrame, most_sets: int) -> DataFrame:
    """(f, root, nb, i): the block of each of the classes ``nodes`` (f) in its cluster."""
    x = stored(nodes.join(clusters.withColumnRenamed("node", "f"), "f").join(own.select("f", "n"), "f"), "jaccard-nodes")
    size = x.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / most_sets), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("nb"))
    return stored(join_hot(x, size, "root").select("f", "root", "nb", F.pmod(F.xxhash64("f"), F.col("nb")).cast("int").alias("i")), "jaccard-blocks")


def could_link(pairs: DataFrame, own: DataFrame, bands: Bands) -> DataFrame:
    """The pairs (a, b) of classes that can link for all that sizes and sketches tell."""
    side = lambda c: own.select(F.col("f").alias(c), F.col("n").alias(f"n_{c}"), F.col("sk").alias(f"sk_{c}"))
    both = join_hot(pairs.select("a", "b"), side("b"), "b").join(side("a"), "a")  # b: the smallest class of a hot signature
    near = both.where(F.least("n_a", "n_b") * bands.den >= F.greatest("n_a", "n_b") * bands.num)

    def run(batches):
        for batch in batches:
            x, y, u, v = (batch.column(batch.schema.get_field_index(c)) for c in ("n_a", "n_b", "sk_a", "sk_b"))
            # |A & B| >= t/(1+t) (a+b), so the difference is at most (1-t)/(1+t) (a+b)
            most = (x.to_numpy() + y.to_numpy()) * (bands.den - bands.num) // (bands.den + bands.num)
            go = pa.array([apart_by(p, q) <= k for p, q, k in zip(u.to_pylist(), v.to_pylist(), most.tolist(), strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(go)

    return near.select("a", "b", "n_a", "n_b", "sk_a", "sk_b").mapInArrow(run, "a long, b long")


def verify_pairs(pairs: DataFrame, blocks: DataFrame, deal, bands: Bands) -> DataFrame:
    """The pairs (a, b) that link; sets travel (``deal``) to the block pairs that hold one of their pairs."""
    place = lambda c: blocks.select(F.col("f").alias(c), F.col("root").alias(f"root_{c}"), F.col("i").alias(f"i_{c}"))
    p = join_hot(pairs, place("b"), "b").join(place("a"), "a")
    p = stored(p.select("a", "b", F.xxhash64("root_a", F.least("i_a", "i_b"), F.greatest("i_a", "i_b")).alias("c")), "jaccard-pairs")

    def run(_, left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return right.select(["a", "b"])
        f, at = np.unique(left["f"].to_numpy(), return_index=True)  # rows of one class, once
        got = [np.frombuffer(left["s"][int(k)].as_py(), np.uint64) for k in at]
        go = link_pairs(f, got, right["a"].to_numpy(), right["b"].to_numpy(), bands)
        return right.select(["a", "b"]).filter(pa.array(go))

    there = deal(p.select(F.col("a").alias("f"), "c").unionAll(p.select(F.col("b").alias("f"), "c")).distinct())
    return there.groupBy("c").cogroup(p.groupBy("c")).applyInArrow(run, "a long, b long")


def verify_blocks(blocks: DataFrame, labels: DataFrame, deal, bands: Bands) -> DataFrame:
    """Links (a, b) that connect classes of different labels in one cluster, all blocks against all."""
    pair = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda j: F.struct(F.least("i", j).alias("x"), F.greatest("i", j).alias("y")))
    cells = blocks.join(labels, "f").withColumn("pair", F.explode(pair))
    cells = cells.select("f", "label", F.xxhash64("root", "pair.x", "pair.y").alias("c"), (F.col("i") == F.col("pair.x")).alias("first"), F.expr("pair.x = pair.y").alias("within"))
    cells = stored(cells, "jaccard-cells")

    def run(_, left: pa.Table, right: pa.Table) -> pa.Table:
        f, at = np.unique(left["f"].to_numpy(), return_index=True)  # rows of one class, once
        got = [np.frombuffer(left["s"][int(k)].as_py(), np.uint64) for k in at]
        there, by = np.unique(right["f"].to_numpy(), return_index=True)
        by = by[np.searchsorted(there, f)]
        label, first, within = (right[c].to_numpy()[by] for c in ("label", "first", "within"))
        links = link_block(f, got, label, first, bool(within.any()), bands)
        return pa.table({"a": pa.array([p[0] for p in links], pa.int64()), "b": pa.array([p[1] for p in links], pa.int64())})

    return deal(cells.select("f", "c")).groupBy("c").cogroup(cells.groupBy("c")).applyInArrow(run, "a long, b long")


def deal_bands(rows: DataFrame, bands: Bands, top: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(first partition, partitions) of each band's signatures: about ``parts`` in all, dealt by the
    number of signatures of the sets (n, at most ``top``) that sign for a band, its own and those of
    the band below."""

    def count_bands(batches):
        for batch in batches:
            j, m = np.unique(bands.of(batch.column(0).to_numpy()), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(j, pa.int64()), pa.array(m, pa.int64())], names=["j", "m"])

    found = rows.where("n > 0").select("n").mapInArrow(count_bands, "j long, m long").groupBy("j").agg(F.sum("m").alias("m")).collect()
    ends = bands.ends(top)
    sets = np.zeros(len(ends))
    for r in found:
        sets[r["j"] : r["j"] + 2] += r["m"]
    work = sets * bands.parts(bands.budget(ends))
    share = np.maximum(1, np.rint(parts * work / max(1, work.sum()))).astype(np.int64)
    return np.cumsum(share) - share, share


def find_components(docs: DataFrame, key: str, text: str, row: Column, n: int, num: int, den: int, count: bool) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): per row id, k (``row``, a hash that equal rows share), n and f (size and
    fingerprint of its set); per class f, its first row (id, k), the first row (low_id, low_k) of its
    component and links.  Rows are ordered by id, nulls last, and k."""
    spark = docs.sparkSession
    bands = Bands(num, den)
    order_key(docs, key, 0)  # whole numbers only
    src = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"), row.alias("k"))

    def reduce_sets(batches):
        for batch in batches:
            for part in sub_batches(batch, "t", CHUNK):
                sets = shingle_sets(part.column(1), n)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.int64()), pa.array(sketches(sets), pa.binary())], names=["id", "k", "n", "f", "sk"])

    rows = stored(src.mapInArrow(reduce_sets, "id long, k long, n long, f long, sk binary"), "jaccard-sets")
    size = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("n"), F.lit(0)).alias("top"), F.count("*").alias("rows")).first()
    parts = partitions(spark, size["n"] // SIGNATURES_PER_PARTITION)
    start, share = deal_bands(rows, bands, size["top"], 2 * parts)
    hot = spark.sparkContext.broadcast(find_shared(src, n, size["rows"]))

    def send(batches):
        for batch in batches:
            for part in sub_batches(batch, "t", CHUNK):
                sets = {fingerprint(s): s for s in shingle_sets(part.column(1), n)}
                sets.pop(0, None)
                classes = np.array(list(sets), dtype=np.int64)
                sig, node, own = signatures(list(sets.values()), bands, hot.value)
                band = bands.of(np.array([len(s) for s in sets.values()], dtype=np.int64))[node] + ~own
                p = start[band] + (sig >> np.uint64(40)).astype(np.int64) % share[band]
                order = np.argsort(p, kind="stable")
                s, m = runs(p[order])
                out = []
                for a, k in zip(s.tolist(), m.tolist(), strict=True):
                    at = order[a : a + k]
                    at = at[np.argsort(node[at], kind="stable")]
                    here, local = np.unique(node[at], return_inverse=True)
                    out.append((int(p[at[0]]), pickle.dumps((classes[here], planes(local), np.packbits(own[at]).tobytes(), five(sig[at])), protocol=5)))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], names=["p", "b"])

    most = None if count else PAIRS_UP_TO

    def meet(t: pa.Table) -> pa.Table:
        out = pa.table(dict(zip("abs", tie([pickle.loads(x.as_py()) for x in t["b"]], most), strict=True)))
        give_back()
        return out

    ties = stored(src.select("id", "t").mapInArrow(send, "p int, b binary").groupBy("p").applyInArrow(meet, TIES).distinct(), "jaccard-candidates", release=True)
    # one row stands for a class; its set is made again from its text
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k")).alias("own")
    own = stored(rows.where("f <> 0").groupBy("f").agg(first, F.first("n").alias("n"), F.first("sk").alias("sk")), "jaccard-classes", release=True)

    def placed(out):
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["f", "c", "s"])

    def again(batches):
        seen = set()  # rows equal to the chosen one: one of them a task
        for batch in batches:
            for part in sub_batches(batch, "t", CHUNK):
                part = part.take(pa.array([i for i, f in enumerate(part.column(1).to_pylist()) if f not in seen], pa.int64()))
                sets = shingle_sets(part.column(0), n)
                out, held = [], 0
                for s, f, cells in zip(sets, part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    if f in seen or fingerprint(s) != f:
                        continue
                    seen.add(f)
                    raw = s.tobytes()
                    for c in cells:
                        if held > 2 * CHUNK:
                            yield placed(out)
                            out, held = [], 0
                        out.append((f, c, raw))
                        held += len(raw)
                yield placed(out)

    def deal(places: DataFrame) -> DataFrame:
        """(f, c, s): the sets of classes at their places (f, c)."""
        chosen = own.select("f", "own.k").join(places, "f").groupBy("k", "f").agg(F.collect_set("c").alias("cells"))
        chosen = stored(chosen, "jaccard-members")
        few = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen.hint("merge")
        return src.select("t", "k").join(few, "k").select("t", "f", "cells").mapInArrow(again, "f long, c long, s binary")

    pairs = stored(could_link(ties.select("a", "b").distinct(), own, bands), "jaccard-near", release=True)
    clusters = components(pairs, "jaccard-ties")
    blocks = in_blocks(clusters.select(F.col("node").alias("f")), clusters, own, BLOCK_SETS)
    links = stored(verify_pairs(pairs, blocks, deal, bands), "jaccard-links", release=True)
    comp = components(links, "jaccard-comp")
    degree = links.select(F.explode(F.array("a", "b")).alias("f")).groupBy("f").agg(F.count("*").alias("links")) if count else None
    # hot signatures whose classes are still apart
    label = F.coalesce("root", "f").alias("label")
    in_hot = ties.where("s <> 0").select("s", F.col("a").alias("f")).unionAll(ties.where("s <> 0").select("s", F.col("b").alias("f"))).distinct()
    known = comp.withColumnRenamed("node", "f")
    labelled = stored(in_hot.join(known, "f", "left").select("s", "f", label), "jaccard-hot")
    apart = labelled.groupBy("s").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("s")
    open_ = stored(join_hot(labelled, apart, "s").select("f", "label").distinct(), "jaccard-open")
    if open_.limit(1).count():
        clusters = components(join_hot(ties.where("s <> 0"), apart, "s").select("a", "b").distinct(), "jaccard-ties")
        more = verify_blocks(in_blocks(open_.select("f"), clusters, own, OPEN_SETS), open_, deal, bands)
        comp = components(links.unionAll(stored(more, "jaccard-links", release=True)), "jaccard-comp")
    # every class: its first row, and its component's
    classes = stored(own.join(comp.withColumnRenamed("node", "f"), "f", "left"), "jaccard-classes")
    classes = classes.join(degree, "f", "left") if count else classes.withColumn("links", F.lit(None).cast("long"))
    low = classes.where("root IS NOT NULL").groupBy("root").agg(F.min("own").alias("low"))
    classes = join_hot(classes, low, "root", "left").withColumn("low", F.coalesce("low", "own"))
    return rows, classes.select("f", "own.id", "own.k", F.col("low.id").alias("low_id"), F.col("low.k").alias("low_k"), F.coalesce("links", F.lit(0)).alias("links"))


def join_components(docs: DataFrame, key: str, text: str, n: int, num: int, den: int, count: bool = True) -> DataFrame:
    """Per row: key, n_shingles, component_id, class_id (smallest key with the same set), links
    (the other classes its class links with; without ``count`` null)."""
    rows, classes = find_components(docs, key, text, F.xxhash64(F.col(key).cast("long"), F.col(text)), n, num, den, count)
    out = join_hot(rows, classes.select("f", F.col("id").alias("class_id"), F.col("low_id").alias("component_id"), "links"), "f", "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce("class_id", "id").alias("class_id"), (F.coalesce("links", F.lit(0)) if count else F.lit(None).cast("long")).alias("links"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` (all columns) without near copies: of each component exactly one row
    stays, one with the smallest key (null only where all its keys are; among rows with that key
    the one with the smallest hash of all columns).  Rows without words are copies of nothing and all stay."""
    row = F.xxhash64(*[docs[c] for c in docs.columns])
    rows, classes = find_components(docs, key, text, row, n, num, den, count=False)
    first = F.col("id").eqNullSafe(F.col("low_id")) & (F.col("k") == F.col("low_k"))
    found = join_hot(rows, classes.select("f", "low_id", "low_k"), "f").groupBy("id", "k").agg(F.min(first).alias("first"), F.count("*").alias("m"))
    marks = stored(found.where("NOT first OR m > 1").select(F.col("id").alias("_id"), F.col("k").alias("_k"), "first"), "jaccard-marks")
    same = docs[key].cast("long").eqNullSafe(F.col("_id")) & (row == F.col("_k"))
    # the marks of copies are few beside the rows; whole rows are shuffled only above that
    small = marks.count() <= BROADCAST_ROWS
    near = (lambda df: F.broadcast(df)) if small else (lambda df: df.hint("merge"))
    out = docs.join(near(marks), same, "left_anti")
    twice = marks.where("first")  # kept rows that stand in the table more than once: equal in all columns
    if twice.limit(1).count():
        out = out.unionAll(docs.join(near(twice), same, "left_semi").distinct())
    return out


@query(
    "op6_jaccard_join",
    r"""
    WITH RECURSIVE d AS (
      SELECT row_number() OVER () AS r, doc_id,
             coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+'), []) AS w FROM documents),
    g AS (SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                 WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM d),
    f AS (SELECT r, doc_id, len(s) AS n, s, CASE WHEN len(s) > 0 THEN md5(array_to_string(s, chr(10))) END AS c FROM g),
    c AS (SELECT c, min(doc_id) AS class_id, any_value(n) AS n, any_value(s) AS s FROM f WHERE c IS NOT NULL GROUP BY c),
    e AS (SELECT c, n, unnest(s) AS x FROM c),
    l AS (SELECT a.c AS a, b.c AS b FROM e a JOIN e b ON a.x = b.x AND a.c <> b.c GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
    t(a, b) AS (SELECT c, c FROM c UNION SELECT t.a, l.b FROM t JOIN l ON t.b = l.a),
    m AS (SELECT a AS c, min(class_id) AS component_id FROM t JOIN c ON t.b = c.c GROUP BY a)
    SELECT doc_id, CAST(f.n AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(class_id, doc_id) AS class_id
    FROM f LEFT JOIN m USING (c) LEFT JOIN c USING (c)
    """,
)
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets reach a Jaccard similarity of 0.9."""
    return join_components(table(spark, sf_dir, "documents"), "doc_id", "text", 3, 90, 100, count=False).drop("links")
