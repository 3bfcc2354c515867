"""Operators on texts: brute force or held-out accuracy, and the odd rows."""

import collections
import hashlib
import math
import pickle
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_cases import SF001, SF01, nothing, odd, odd_rows  # noqa: F401
from retentia.llm import decontaminate, jaccard, langid, licenses, lm, mixing, quality, substring
from retentia.llm.common import QUERIES, fold


def key(r):
    return tuple((x is None, str(x)) for x in r)


def test_language_held_out_accuracy(spark):
    got = langid.op1_language_id(spark, SF01).where("held_out")
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang")
    assert got.join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_language_odd_rows(odd, nothing):
    parsers = langid.fit(odd, "doc_id", "text", "lang")
    got = langid.predict(odd.sparkSession, odd, "doc_id", "text", parsers).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    by = {r[0]: r for r in got}
    assert by[1]["lang_pred"] == by[2]["lang_pred"] == "und" and by[6]["lang_pred"] in ("en", "de")
    assert langid.fit(nothing, "doc_id", "text", "lang") == []
    assert {r["lang_pred"] for r in langid.predict(odd.sparkSession, odd, "doc_id", "text", []).collect()} == {"und"}


def plain_phrases(text, sample):
    """Greedy phrases of a text: each the longest match in the sample, one character at least."""
    phrases = i = 0
    while i < len(text):
        n = 1
        while i + n <= len(text) and text[i : i + n] in sample:
            n += 1
        i += max(1, n - 1)
        phrases += 1
    return phrases


def test_phrases_against_plain_search():
    rng = np.random.default_rng(4)
    few, many, far = "abc", "".join(chr(0x4E00 + i) for i in range(700)), "".join(chr(0x10400 + i) for i in range(40)) + "ab"
    for letters in (few, many, far):
        for _ in range(12):
            sample = "".join(rng.choice(list(letters), 400))
            at = int(rng.integers(0, 300))
            texts = ["".join(rng.choice(list(letters), 60)), sample[at : at + 90] + "zz" + sample[:40], "q"]
            p = langid.build_parser("x", [sample])
            assert len(p.letters) == len(set(langid.normalised(sample)[0].tolist()))  # none is left out
            folded = ["".join(map(chr, langid.normalised(t)[0])) for t in [sample, *texts]]
            lengths = np.array(sorted((len(t) for t in folded[1:]), reverse=True))
            lanes = np.zeros((lengths[0], 3), dtype=np.uint32)
            for k, t in enumerate(sorted(folded[1:], key=len, reverse=True)):
                lanes[: len(t), k] = [ord(c) for c in t]
            assert langid.count_phrases(p, lanes, lengths).tolist() == [plain_phrases(t, folded[0]) for t in sorted(folded[1:], key=len, reverse=True)]


def test_languages_of_many_and_of_far_letters(spark):
    """Ideographs by the thousand, letters beyond U+FFFF, forty labels, and equal estimates."""
    rng = np.random.default_rng(5)
    han, far = [chr(0x4E00 + i) for i in range(3000)], [chr(0x10400 + i) for i in range(40)]
    words = {f"l{j:02d}": ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(30)] for j in range(40)}
    words |= {"han": ["".join(rng.choice(han, 3)) for _ in range(800)], "far": ["".join(rng.choice(far, 4)) for _ in range(50)]}
    rows = [(i, " ".join(rng.choice(words[lang], 80)), lang) for i, lang in enumerate(sorted(words) * 8)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    parsers = langid.fit(train, "doc_id", "text", "lang")
    assert [p.lang for p in parsers] == sorted(words) and max(len(p.letters) for p in parsers) > 500
    assert sum(p.n for p in langid.fit(train, "doc_id", "text", "lang", total_chars=42_000)) <= 42_000 + 2 * 42
    asked = spark.createDataFrame([(i, " ".join(rng.choice(words[lang], 40)), lang) for i, lang in enumerate(sorted(words) * 3)], train.schema)
    got = langid.predict(spark, asked, "doc_id", "text", parsers).join(asked.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) > 0.97 * len(got)
    same = [langid.build_parser(n, ["abc abc"]) for n in ("a", "b")]
    assert langid.identify(["abc", "abc abd"], same) == (["a", "a"], [0.5, 0.5])


def test_language_prediction_against_plain_search(spark, odd):
    """The whole query on rows and samples small enough for plain search: fewest phrases times
    log2(sample), ties to the smaller name."""
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in odd.collect() if r["text"] and len(r["text"]) < 500]
    parsers = langid.fit(odd.where(F.length("text") < 500), "doc_id", "text", "lang")
    got = {r[0]: r for r in langid.predict(spark, odd.where(F.length("text") < 500), "doc_id", "text", parsers).collect()}
    pieces = collections.defaultdict(list)
    for k, t, lang in rows:
        if lang:
            pieces[lang].append("".join(map(chr, langid.normalised(t)[0])))
    whole = {lang: "\x00".join(dict.fromkeys(p)) for lang, p in pieces.items()}
    assert all(p.n >= sum(map(len, dict.fromkeys(pieces[p.lang]))) for p in parsers)  # nothing was left out
    for k, t, _ in rows:
        folded = "".join(map(chr, langid.normalised(t)[0]))
        if any(c.isalpha() for c in folded):
            cost = {p.lang: plain_phrases(folded, whole[p.lang]) * math.log2(p.n) for p in parsers}
            assert got[k]["lang_pred"] == min(cost, key=lambda x: (cost[x], x))


def test_quality_on_labels(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    got = quality.op2_quality(spark, SF01).join(spark.read.parquet(f"{SF01}/labels.parquet"), "doc_id")
    r = got.agg(F.avg(F.when(F.col("quality") == 1, F.col("kept").cast("int"))), F.avg(F.when(F.col("quality") == 0, F.col("kept").cast("int")))).first()
    assert r[0] > 0.98 and r[1] < 0.05
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_quality_odd_rows(odd, nothing):
    got = quality.score(odd, "doc_id", "text", quality.fit(odd, "doc_id", "text")).collect()
    assert len(got) == odd.count()
    assert {(r["score"], r["kept"]) for r in got if r["doc_id"] in (1, 2, 3)} == {(0.0, False)}
    assert quality.fit(nothing, "doc_id", "text") is None and quality.keep_good(nothing).count() == 0


def brute_lm(rows):
    train = [r for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2]
    toks = lambda t: [*(t or "").encode().lower().split(), None]
    uni, pair, ctx = collections.Counter(), collections.Counter(), collections.Counter()
    for _, t in train:
        p = 0
        for w in toks(t):
            uni[w] += 1
            pair[p, w] += 1
            ctx[p] += 1
            p = w
    n, v = sum(uni.values()), len(uni)
    stats = lm.cells(np.array([*pair.values(), 0]), np.array([*(ctx[p] for p, _ in pair), 0]), np.array([*(uni[w] for _, w in pair), 0]), n)
    weights = lm.learn_weights(stats, v)
    out = []
    for k, t in rows:
        base = score = 0.0
        p = 0
        for w in toks(t):
            base += math.log10((uni[w] + 1) / (n + v + 1))
            score += float(lm.log_p(weights, v, n, np.array([pair[p, w]]), np.array([ctx[p]]), np.array([uni[w]]))[0])
            p = w
        out.append((k, len(toks(t)), sum(uni[w] > 0 for w in toks(t)), n, round(base, 6), round(score, 6)))
    return sorted(out, key=key)


def test_lm_against_brute_force(spark, odd, nothing):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").limit(60)
    for df in (odd, docs):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        got = lm.lm_score(df, "doc_id", "text", fold(F.col("doc_id"), 7) == 2).collect()
        assert sorted([(r[0], r[2], r[3], r[4], round(r[5], 6), round(r[6], 6)) for r in got], key=key) == brute_lm(rows)
    assert lm.lm_score(nothing, "doc_id", "text", F.lit(False)).count() == 0
    assert len(lm.lm_score(odd, "doc_id", "text", F.lit(True)).collect()) == odd.count()


def test_lm_heavy_pairs(spark):
    df = spark.createDataFrame([(i, "of the " * 30 + str(i % 7)) for i in range(40)], "doc_id long, text string")
    got = lm.lm_score(df, "doc_id", "text", fold(F.col("doc_id"), 7) == 2).collect()
    assert sorted([(r[0], r[2], r[3], r[4], round(r[5], 6), round(r[6], 6)) for r in got], key=key) == brute_lm([(r[0], r[1]) for r in df.collect()])


def test_lm_words_frequent_only_in_held_out_rows(spark):
    """A hot id that does not train: its words are hot all the same, with count 0."""
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    df = spark.createDataFrame([(held, "new words only here " * 20 + "the of")] * 40 + [(i, "the of and") for i in range(200, 215)], "doc_id long, text string")
    got = lm.lm_score(df, "doc_id", "text", fold(F.col("doc_id"), 7) == 2).collect()
    assert sorted([(r[0], r[2], r[3], r[4], round(r[5], 6), round(r[6], 6)) for r in got], key=key) == brute_lm([(r[0], r[1]) for r in df.collect()])
    src = df.select(F.col("doc_id").alias("k"), (F.col("doc_id") == held).alias("held"), F.col("text").alias("t"))
    counts = lm.count_words(src).collect()
    assert {(r["c"], r["n"]) for r in counts} >= {(0, 800), (15, 55)}


def test_lm_chunks_are_spread():
    for parts in (8, 16, 64, 200, 211, 256):
        for chunks in ([p << 32 for p in range(40 * parts)], [(p << 32) + 3 for p in range(40 * parts)]):
            sizes = collections.Counter(lm.chunk_part(c) % parts for c in chunks)
            assert len(sizes) == parts and max(sizes.values()) < 40 * 2.5


def brute_components(rows, n, num, den):
    sets = {}
    for k, t in rows:
        w = (t or "").encode().lower().split()
        sets[k] = frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            inter = len(sets[a] & sets[b])
            if sets[a] and inter * den >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in ids}


def test_jaccard_against_brute_force(spark, odd, nothing):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").where("doc_id < 400")
    for df in (odd.where("doc_id IS NOT NULL"), docs):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        for n, num in ((3, 90), (5, 80)):
            got = jaccard.join_components(df, "doc_id", "text", n, num, 100).collect()
            assert {r[0]: (r[1], r[2]) for r in got} == brute_components(rows, n, num, 100) and len(got) == len(rows)
    assert jaccard.join_components(nothing, "doc_id", "text", 3, 90, 100).count() == 0
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert {1, 2, 3, 4, 6} <= ids and not ids & {5, 7, 8, 9}


def brute_rows(rows, n, num, den):
    """(set, root) of each row, whatever its id: roots are row numbers."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and len(a & sets[j]) * den >= num * len(a | sets[j]):
                x, y = root[i], root[j]
                root = [y if r == x else r for r in root]
    return sets, root


def near_rows():
    """Near copies that hang together only through a row without an id, copies that all lack
    one, texts under one id, repeated rows, and rows without ids that copy nothing."""
    w = [f"w{i}" for i in range(100)]
    step = lambda k: " ".join([*(f"v{i}" for i in range(k)), *w[k:]])
    lone = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcdefgh"]
    rows = [(1, step(0)), (None, step(4)), (2, step(8)), (None, lone[0]), (None, lone[0] + " end"), (None, lone[1]), (None, lone[2]), (3, lone[2] + " end"), (4, lone[3]), (5, lone[3]), (5, lone[4]), (5, lone[5])]
    rows += [(6, lone[6]), (6, lone[6]), (None, lone[7]), (None, lone[7]), (None, ""), (None, ""), (7, None), (7, None), (8, lone[5]), (5, lone[5] + " end")]
    return rows


def test_jaccard_rows_without_ids(spark):
    """Rows without an id link like others; only component_id passes over them."""
    rows = near_rows()
    for n, num in ((3, 90), (5, 80)):
        got = jaccard.join_components(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", n, num, 100).collect()
        sets, root = brute_rows(rows, n, num, 100)
        least = lambda ids: min((x for x in ids if x is not None), default=None)
        want = []
        for i, (k, _) in enumerate(rows):
            of = least(rows[j][0] for j in range(len(rows)) if root[j] == root[i]) if sets[i] else k
            links = {s for s in sets if s != sets[i] and len(s & sets[i]) * 100 >= num * len(s | sets[i])} if sets[i] else ()
            want.append((k, len(sets[i]), of, least(rows[j][0] for j in range(len(rows)) if sets[j] == sets[i]) if sets[i] else k, len(links)))
        assert sorted([tuple(r) for r in got], key=key) == sorted(want, key=key)


def test_one_row_of_each_component_stays(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(*r, i // 2) for i, r in enumerate(rows)], "doc_id long, text string, k int")
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    sets, root = brute_rows(rows, 5, 80, 100)
    want = [r for r, s in zip(rows, sets, strict=True) if not s]
    for c in {c for c, s in zip(root, sets, strict=True) if s}:
        group = [r for r, x in zip(rows, root, strict=True) if x == c]
        ids = [k for k, _ in group if k is not None]
        choice = [r for r in group if r[0] == min(ids, default=None)]
        mine = [r for r in got if r in group]
        assert len(mine) == 1 and mine[0] in choice
        want += mine
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {t for k, t in got if k is None} >= {rows[5][1], rows[14][1]}


def test_near_copies_in_blocks(spark):
    """More sets than a block holds; links across blocks are found and counted."""
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join([*base[:-3], f"a{i}", f"b{i}"])) for i in range(600)]
    got = jaccard.join_components(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 3, 90, 100).collect()
    assert {r["component_id"] for r in got} == {0} and {r["links"] for r in got} == {599}


def compared(monkeypatch):
    """Records how many candidate pairs are verified, and how many classes blockwise."""
    seen = {"pairs": 0, "open": 0}
    pairs, blocks = jaccard.verify_pairs, jaccard.verify_blocks
    monkeypatch.setattr(jaccard, "verify_pairs", lambda p, *a: (seen.update(pairs=p.count()), pairs(p, *a))[1])
    monkeypatch.setattr(jaccard, "verify_blocks", lambda b, *a: (seen.update(open=b.count()), blocks(b, *a))[1])
    return seen


def test_near_copies_cost_their_number(spark, monkeypatch):
    """Components of m near copies take candidate pairs in proportion to m, and no blocks."""
    seen, sizes = compared(monkeypatch), {}
    base = [f"w{i}" for i in range(200)]
    for m in (100, 400):
        rows = [(i, " ".join([*base[:-3], f"a{i}", f"b{i}"])) for i in range(m)]
        got = jaccard.join_components(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 3, 90, 100, count=False).collect()
        assert {r["component_id"] for r in got} == {0} and len(got) == m
        sizes[m] = seen["pairs"]
    assert seen["open"] == 0 and sizes[400] < 6 * sizes[100] and sizes[400] < 40 * 400


def chained_rows(rng):
    """Families of near copies that drift: neighbours link, distant members do not."""
    rows = []
    for f in range(4):
        words = [f"f{f}w{i}" for i in range(150)]
        for i in range(30):
            words = list(words)
            for at in rng.integers(0, 150, 2):
                words[at] = f"n{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(words)))
    order = rng.permutation(len(rows))
    return [(int(k), rows[i][1]) for k, i in enumerate(order)]


@pytest.mark.parametrize("stars", [True, False])
def test_hot_signatures_lose_no_link(spark, monkeypatch, stars):
    """Every shared signature taken for a hot one, and small blocks: what the smallest class does not
    connect the blocks do, also when it connects nothing at all."""
    monkeypatch.setattr(jaccard, "PAIRS_UP_TO", 1)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 7)
    if not stars:
        monkeypatch.setattr(jaccard, "verify_pairs", lambda p, *a: p.limit(0))
    seen = compared(monkeypatch)
    rows = chained_rows(np.random.default_rng(21))
    got = jaccard.join_components(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 3, 90, 100, count=False).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == brute_components(rows, 3, 90, 100)
    assert stars or seen["open"] > 100


def test_candidates_of_a_partition_against_plain_pairs():
    rng = np.random.default_rng(5)
    for most in (None, 1, 3):
        rows, members = [], collections.defaultdict(dict)
        for _ in range(4):
            classes = rng.choice(1000, 12, replace=False).astype(np.int64)
            node, sig, own = rng.integers(0, 12, 60), rng.integers(0, 25, 60).astype(np.uint64), rng.random(60) < 0.6
            rows.append((classes, jaccard.planes(node), np.packbits(own).tobytes(), jaccard.five(sig)))
            for x, s, o in zip(classes[node].tolist(), sig.tolist(), own.tolist(), strict=True):
                members[s][x] = members[s].get(x, False) or o
        want_pairs, want_stars = set(), set()
        for s, of in members.items():
            if most is None or len(of) <= most:
                want_pairs |= {(a, b) for a in of for b in of if a > b and (of[a] or of[b])}
            elif any(of.values()):
                want_stars |= {(a, min(of), s) for a in of if a != min(of)}
        a, b, c = (x.tolist() for x in jaccard.tie(rows, most))
        assert {(x, y) for x, y, z in zip(a, b, c, strict=True) if z == 0} == want_pairs
        stars = [(x, y, z) for x, y, z in zip(a, b, c, strict=True) if z != 0]
        number = {s: int(jaccard.mix(np.array([s], dtype=np.uint64))[0] >> np.uint64(1)) | 1 for s in members}
        assert sorted(stars) == sorted((x, y, number[s]) for x, y, s in want_stars)


def test_partenum_loses_no_link():
    rng = np.random.default_rng(3)
    for num in (80, 90):
        bands = jaccard.Bands(num, 100)
        for _ in range(300):
            n = int(rng.integers(2, 300))
            a = np.unique(rng.integers(1, 2**63, n).astype(np.uint64))
            k = int(rng.integers(0, max(1, n // 8) + 1))
            b = np.unique(np.concatenate([a[: len(a) - k], rng.integers(1, 2**63, int(rng.integers(0, k + 1))).astype(np.uint64)]))
            inter = len(np.intersect1d(a, b))
            if inter * 100 < num * (len(a) + len(b) - inter) or jaccard.fingerprint(a) == jaccard.fingerprint(b):
                continue
            for shared in (None, jaccard.Shared(a[: len(a) * 9 // 10].view(np.int64).tolist())):
                sig, of, own = jaccard.signatures([a, b], bands, shared)
                both = set(sig[of == 0].tolist()) & set(sig[of == 1].tolist())
                assert both & set(sig[own].tolist())


def brute_spans(rows, span=50):
    order = lambda k: 2**63 - 1 if k is None else k
    first = {}
    for k, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - span + 1):
            x = tuple(w[i : i + span])
            first[x] = min(first.get(x, 2**63), order(k))
    out = []
    for k, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for i in range(len(w) - span + 1):
            if first[tuple(w[i : i + span])] < order(k):
                gone.update(range(i, i + span))
        out.append((k, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return sorted(out, key=key)


def test_substrings_against_brute_force(spark, odd, nothing, tmp_path):
    for name, df in (("odd", odd), ("none", nothing), ("given", spark.read.parquet(f"{SF001}/documents.parquet"))):
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
        got = substring.op10_substring_dedup(spark, str(tmp_path / name)).collect()
        assert sorted([tuple(r) for r in got], key=key) == brute_spans([(r["doc_id"], r["text"]) for r in df.collect()])
    cut = substring.remove_spans(odd)
    assert cut.columns == odd.columns and cut.count() == odd.count()
    left = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert left[7] == "" and left[6] == odd_rows()[5][1] and left[1] is None


def brute_parse(docs, span):
    """Greedy factors of each (key, words): the longest stretch from the first word of a window that
    a smaller document holds, then on from the next window; as covered words per document."""
    out = []
    for k, w in docs:
        smaller, covered, i = [v for q, v in docs if q < k], set(), 0
        while i + span <= len(w):
            best = 0
            for v in smaller:
                for j in range(len(v) - span + 1):
                    n = 0
                    while i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                        n += 1
                    best = max(best, n)
            if best >= span:
                covered.update(range(i, i + best))
                i += best - span + 1
            else:
                i += 1
        out.append(covered)
    return out


def test_greedy_factors_and_the_windows_across_their_ends():
    rng = np.random.default_rng(11)
    for _ in range(60):
        span, docs = 4, []
        for k in rng.permutation(6).tolist():
            words = rng.integers(0, 30, int(rng.integers(0, 40))).tolist()
            for _, v in docs[:3]:
                at, n = int(rng.integers(0, max(1, len(v)))), int(rng.integers(3, 15))
                words += v[at : at + n]
            docs.append((k, words))
        ident, start, size, key = [], [], [], []
        for k, w in docs:
            n = max(0, len(w) - span + 1)
            if n:
                start.append(len(ident))
                size.append(n)
                ident += [hash(tuple(w[i : i + span])) % 2**62 for i in range(n)]
                key += [k] * n
        ident, key, start, size = np.array(ident, dtype=np.uint64), np.array(key), np.array(start), np.array(size)
        owner = [i for i, (_, w) in enumerate(docs) if len(w) >= span]
        s, e, r = substring.parse(ident, substring.references(ident, key), start, size)
        got = [set() for _ in docs]
        for a, b, c in zip(s.tolist(), e.tolist(), r.tolist(), strict=True):
            run, of = (int(np.searchsorted(start, x, side="right")) - 1 for x in (a, c))
            assert key[c] < key[a] and b <= start[run] + size[run] and c + b - a <= start[of] + size[of]
            assert (ident[a:b] == ident[c : c + b - a]).all()  # a factor is a stretch of its reference
            assert b == start[run] + size[run] or c + b - a == start[of] + size[of] or ident[b] != ident[c + b - a]  # and cannot go on in it
            got[owner[run]].update(range(a - start[run], b - start[run] + span - 1))
        assert got == brute_parse(docs, span)


def test_factors_name_their_reference(spark):
    w = [f"w{i}" for i in range(200)]
    docs = [(1, " ".join(w)), (5, " ".join(["x", *w[20:90], "y", *w[100:170]])), (9, " ".join(w[20:90]))]
    got = substring.find_factors(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text").collect()
    words = {k: t.split() for k, t in docs}
    for r in got:
        n = r["stop"] - r["start"] + 49
        assert r["ref_o"] < r["o"] and words[r["o"]][r["start"] : r["start"] + n] == words[r["ref_o"]][r["ref_start"] : r["ref_start"] + n]
    assert {r["o"] for r in got} == {5, 9} and {r["ref_o"] for r in got} == {1}


def common_line_rows():
    """A line of 30 words in a third of the texts, texts that copy others, equal rows."""
    rng = np.random.default_rng(9)
    pick = lambda n: [f"w{i}" for i in rng.integers(0, 5000, n)]
    line, rows = pick(30), []
    for i in range(300):
        words = [*pick(60), *(line if i % 3 == 0 else []), *pick(60)]
        if i % 10 == 9:
            words = words[:40] + rows[i - 5][1].split()[20:100] + words[40:]
        rows.append((i, " ".join(words)))
    return rows + [rows[39]] * 40


def test_substrings_with_a_common_line(spark, tmp_path, monkeypatch):
    rows = common_line_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = substring.op10_substring_dedup(spark, str(tmp_path))
    assert sorted([tuple(r) for r in got.collect()], key=key) == brute_spans(rows)
    shuffled = substring.with_stretches(df, "doc_id", "text", 50, "s", broadcast_bytes=0).collect()
    assert {len(r["s"] or ()) for r in shuffled if r["doc_id"] == 39} == {len({(x["start"], x["stop"]) for x in r["s"]}) for r in shuffled if r["doc_id"] == 39 and r["s"]}
    # the common line's windows do not fill one block
    src = df.select(F.col("doc_id").alias("o"), F.xxhash64("text").alias("th"), F.col("text").alias("t"))
    blocks = 60
    hot = substring.hot_anchors(src, 10**6, blocks, 50, 16)
    assert 0 < len(hot) <= 8 * blocks
    part = src.toArrow().to_batches()
    for few, anchors in ((False, np.zeros(0, np.uint64)), (True, hot)):
        sizes = collections.Counter()
        for p in part:
            for i in range(0, p.num_rows, 4):  # chunks of four documents
                for block, raw in substring.emit(p.slice(i, 4), blocks, 50, 16, anchors):
                    sizes[block] += sum(len(r[7]) // 5 for r in pickle.loads(raw) if r[0] == "W")
        assert (max(sizes.values()) < 3 * sum(sizes.values()) / blocks) == few


def test_text_keys_are_refused(spark):
    df = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    with pytest.raises(TypeError, match="whole numbers"):
        substring.remove_spans(df)


def test_myers_against_dynamic_programming():
    rng = np.random.default_rng(1)
    for _ in range(400):
        p, t, e = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 25)), int(rng.integers(0, 4))
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p):
            new = [i + 1]
            for j, b in enumerate(t):
                new.append(min(row[j] + (a != b), row[j + 1] + 1, new[-1] + 1))
            row = new
        assert decontaminate.within_budget(p.astype(np.uint64), t.astype(np.uint64), e) == (min(row) <= e)


def test_leaks_with_edits(spark, odd, nothing):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi omi pi rho sig tau ups".split()
    edited = [*item[:4], "changed", *item[5:12], "new", *item[12:]]
    rows = [(1, "x " + " ".join(item).upper() + ", y"), (2, "x, " + "; ".join(edited)), (3, " ".join(item[:10])), (4, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (7, None), (8, "two words"), (8, " ,"), (9, " ".join(item))], "item_id long, text string")
    got = decontaminate.find_leaks(docs, bench).collect()
    assert sorted((r[0], r[1], r[2]) for r in got) == [(1, [7, 9], True), (2, [7, 9], True), (3, [], False), (4, [], False), (4, [], False)]
    assert sorted(r[0] for r in decontaminate.drop_leaks(docs, bench).collect()) == [3, 4, 4]
    assert decontaminate.find_leaks(odd, bench).where("contaminated").count() == 0
    assert decontaminate.drop_leaks(odd, bench.limit(0)).count() == odd.count()
    assert decontaminate.find_leaks(nothing, bench).count() == 0


def plain_words(text):
    """Words of a lower-case text by plain rules, characters of unspaced scripts one by one."""
    out, word = [], ""
    for c in (text or "").lower() + " ":
        lone = any(a <= ord(c) <= b for a, b in decontaminate.UNSPACED)
        if lone or (ord(c) < 128 and not c.isalnum()):
            out += [word] if word else []
            word = ""
        if lone:
            out.append(c)
        elif ord(c) >= 128 or c.isalnum():
            word += c
    return out


def brute_leaks(docs, items):
    """Item ids per document: the least edit distance of the item to any stretch of its words."""
    out = []
    for k, text in docs:
        words, ids = plain_words(text), set()
        for item, t in items:
            p = plain_words(t)
            if not p or (len(p) < 6 and len("".join(p).encode()) < 20):
                continue
            row = [0] * (len(words) + 1)
            for i, a in enumerate(p):
                new = [i + 1]
                for j, b in enumerate(words):
                    new.append(min(row[j] + (a != b), row[j + 1] + 1, new[-1] + 1))
                row = new
            if min(row) <= len(p) // 10:
                ids.add(item)
        out.append((k, sorted(ids), bool(ids)))
    return sorted(out, key=key)


def leak_rows():
    """Random documents with planted items: whole, edited within and beyond the budget, short ones,
    items in scripts without blanks, at either end of a text and split over two."""
    rng = np.random.default_rng(8)
    pick = lambda n: [f"w{i}" for i in rng.integers(0, 300, n)]
    items = [(i, " ".join(pick(int(n)))) for i, n in enumerate([60, 35, 20, 12, 10, 9, 7, 6])]
    items += [(20, "five whole words standing here"), (21, "seventeenletters ab cd"), (22, "two words"), (23, "w1 w2 w3 w4 w5"), (24, "水是由氢和氧组成的一种化合物请问它的沸点是多少度呢"), (25, "ตอบคำถาม"), (26, "氢和氧化合"), (27, None), (28, ""), (29, "née Größe, ÀÉÎ; ça va bien là-bas")]
    docs = []
    for n in range(160):
        item = plain_words(items[int(rng.integers(0, len(items)))][1])
        for _ in range(int(rng.integers(0, 1 + len(item) // 6))):
            at = int(rng.integers(0, len(item)))
            item[at : at + int(rng.integers(0, 2))] = ["new"] * int(rng.integers(0, 2))
        words = [*pick(int(rng.integers(0, 40))), *item, *pick(int(rng.integers(0, 40)))]
        joined = "".join(w if any(ord(c) > 0xE00 for c in w) else f" {w}" for w in words)
        docs.append((n, joined.upper() if n % 3 else joined.replace(" ", ", ")))
    docs += [(900, None), (900, ""), (901, items[0][1][:100]), (902, items[0][1][100:]), (None, items[8][1] + "!"), (903, "x" * 30000), (904, "界" * 3000)]
    return docs, items


def test_leaks_against_brute_force(spark):
    docs, items = leak_rows()
    d = spark.createDataFrame([(*r, 1, "x", "y") for r in docs], "doc_id long, text string, _low int, item_ids string, _row string")
    b = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, _low string")
    want = brute_leaks(docs, items)
    assert sum(r[2] for r in want) > 60 and sum(not r[2] for r in want) > 20 and any(24 in r[1] for r in want) and any(20 in r[1] for r in want)
    for chars in (decontaminate.GROUP_CHARS, 500):  # one pass, and a stored pass for each of several groups
        assert sorted([tuple(r) for r in decontaminate.find_leaks(d, b, group_chars=chars).collect()], key=key) == want
        clean = decontaminate.drop_leaks(d, b, group_chars=chars)
        assert clean.columns == d.columns
        assert sorted([r["doc_id"] for r in clean.collect()], key=str) == sorted([r[0] for r in want if not r[2]], key=str)


def test_licences(spark, odd, nothing):
    mit = " ".join(f"{licenses.SENTENCES[x].capitalize()}." for x in ("mit-grant", "mit-notice", "mit-as-is", "mit-liability"))
    rows = [(1, "Copyright 2020 X\n" + mit.replace(" of this ", "\nof this ")), (2, "Foo bar\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0."),
            (3, "It is not released under the MIT license here."), (4, None), (5, licenses.SENTENCES["bsd-grant"]),
            (6, "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 X\n"),
            (7, "                 Apache License\n           Version 2.0, January 2004\n        http://www.apache.org/licenses/\n"),
            (8, "// SPDX-License-Identifier: Apache-2.0 OR mit\n/* spdx-license-identifier: (GPL-2.0+ AND Frob-1) */\n# SPDX-License-Identifier:\n"),
            (9, "see SPDX-License-Identifier: MIT"), (1, "MIT License")]
    got = sorted((r[0], r[1], r[3]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, ["MIT"], 0), (1, ["MIT"], 0), (2, ["MIT", "CC-BY-NC-4.0"], 0), (3, [], 0), (4, [], 0), (5, [], 1), (6, ["GPL-3.0"], 0), (7, ["Apache-2.0"], 0),
                   (8, ["Apache-2.0", "MIT", "GPL-2.0"], 0), (9, [], 0)]
    assert licenses.scan(odd).where("size(licenses) > 0").count() == 0 and licenses.scan(nothing).count() == 0
    assert licenses.with_texts([]).filtered  # every built-in sentence passes the filter of key words
    assert {p for _, parts in licenses.RULES for p in parts} == set(licenses.SENTENCES)
    assert {name for name, parts in licenses.RULES} - set(licenses.SPDX) == {"All-Rights-Reserved"}


def test_licence_rules_against_plain_matching():
    """At each place the longest rule that fits, ties to the first in the table; brute force over all."""
    rng = np.random.default_rng(3)
    names = list("abcde")
    table = licenses.Rules({n: f"licence {n}" for n in names}, [(f"L{i}", tuple(rng.choice(names, int(rng.integers(1, 5))))) for i in range(12)] + [("tie1", ("a", "e")), ("tie2", ("a", "e"))])
    for _ in range(300):
        ids = rng.choice([*names, "copyright", "rights-reserved"], int(rng.integers(0, 12))).tolist()
        used, want = set(), []
        for i in range(len(ids)):
            fits = []
            for order, (name, parts) in enumerate(table.rules):
                j, at = i, []
                for p in parts:
                    while at and j < len(ids) and ids[j] in licenses.FILLERS:
                        j += 1
                    if j == len(ids) or ids[j] != p or j in used:
                        break
                    at.append(j)
                    j += 1
                if len(at) == len(parts):
                    fits.append((-len(parts), order, name, at))
            if fits and i not in used:
                _, _, name, at = min(fits)
                used |= set(at)
                want.append(name)
        assert table.match(ids) == (want, sum(x != "copyright" and i not in used for i, x in enumerate(ids)))


def test_whole_licence_texts(spark):
    a = "Frob Public License\nVersion 7\n\nYou may frob this work and\nshare it. You must not unfrob it!\n\n  1. Frobbing means to frob; see below.\n"
    b = "Grob License\n\nYou must not unfrob it! Grobbing is free."
    texts = spark.createDataFrame([("Frob-7", a), ("Grob", b), ("Grob", None), ("None", " ,")], "licence string, text string")
    docs = [(1, "int x;\n" + a + "\nint y;"), (2, b.upper()), (3, a.replace("You must not unfrob it!", "")), (4, a + b), (5, "Released under the MIT license.\n" + b), (6, "you may frob this work")]
    got = {r[0]: (r[1], r[3]) for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string"), texts=texts).collect()}
    assert got[1] == (["Frob-7"], 0) and got[2] == (["Grob"], 0) and got[4] == (["Frob-7", "Grob"], 0) and got[5] == (["MIT", "Grob"], 0)
    assert got[3][0] == [] and got[3][1] > 2 and got[6] == ([], 0)
    table = licenses.with_texts([tuple(r) for r in texts.collect()])
    assert len([s for s in table.sentences.values() if s == "you must not unfrob it"]) == 1 and not table.filtered


def test_mix_meets_targets(spark, odd, nothing):
    for df in (odd, spark.read.parquet(f"{SF01}/documents.parquet")):
        rows = df.select("doc_id", "text", "source").collect()
        words = collections.Counter()
        for r in rows:
            words[r["source"]] += len((r["text"] or "").encode().split())
        names = sorted(words, key=lambda s: (s is None, s or ""))
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
        capped, level = set(), 0
        while True:
            level = (1.5 * sum(words.values()) - sum(2 * words[s] for s in capped)) / max(1e-9, sum(weight[s] for s in names if s not in capped))
            more = {s for s in names if s not in capped and weight[s] * level > 2 * words[s]}
            if not more:
                break
            capped |= more
        target = {s: 2.0 * words[s] if s in capped else weight[s] * level for s in names}
        got = mixing.mix_sources(df).collect()
        assert len(got) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
        assert sorted((r["source_size"], round(r["target"], 3)) for r in got) == sorted((words[r["source"]], round(target[r["source"]], 3)) for r in rows)
        if df is not odd:
            source = {r["doc_id"]: r["source"] for r in rows}
            taken = collections.Counter()
            for r in got:
                taken[source[r["doc_id"]]] += r["taken"]
            assert all(abs(target[s] - n) <= 0.01 * target[s] + 40 for s, n in taken.items())
            assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_sources(df.repartition(7)).collect()))
    assert mixing.mix_sources(nothing).count() == 0


def test_mix_of_hot_rows(spark):
    """A third of the rows are equal (null key, one text), another third share a size: targets are
    met, equal rows get whole copies each, and reruns over other partitions agree."""
    rows = [(None, "a b c", None)] * 70 + [(i, f"w{i} x y", "s1") for i in range(70)] + [(500 + i, "t " * (i % 9), ["s2", "s3"][i % 2]) for i in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(df).collect()
    assert len(got) == 210 and all(0 <= r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"] for r in got)
    of = lambda k: "none" if k is None else "s1" if k < 500 else k % 2
    taken, target = collections.Counter(), {of(r["doc_id"]): r["target"] for r in got}
    for r in got:
        taken[of(r["doc_id"])] += r["taken"]
    assert len(target) == 4 and all(abs(t - taken[s]) <= 9 for s, t in target.items())
    hot = [r["copies"] for r in got if r["doc_id"] is None]
    assert len(hot) == 70 and max(hot) - min(hot) <= 1
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, mixing.mix_sources(df.repartition(5)).collect()), key=key)


def test_balance_converges_on_hard_targets(spark):
    """Sizes from 1 to a million, targets from nearly nothing to nearly the whole cap."""
    rows = [(f"s{j}", s, n, w) for j, w in enumerate((1e-9, 0.01, 0.5, 1.0, 1.999, 1.9999999)) for s, n in ((1, 1000), (7, 50), (1000, 3), (10**6, 1))]
    words = sum(s * n for _, s, n, w in rows if w == 0.5)
    hist = spark.createDataFrame([(k, s, n, words, 1054, w * words) for k, s, n, w in rows], "sk string, size long, n long, words long, docs long, target double")
    lam = {r["sk"]: r["lam"] for r in mixing.balance(hist, 2).collect()}
    for j, w in enumerate((1e-9, 0.01, 0.5, 1.0, 1.999, 1.9999999)):
        got = sum(s * n * min(2.0, math.exp(min(50.0, lam[f"s{j}"] * s * 1054 / words))) for k, s, n, _ in rows if k == f"s{j}")
        assert abs(got - w * words) <= 1e-6 * max(1.0, w * words)


def test_label_model_finds_the_share_of_bad_documents():
    """Votes drawn from a known model: mostly good, even, and mostly junk corpora."""
    rng = np.random.default_rng(2)
    k = len(quality.LABELLERS)
    for share in (0.1, 0.5, 0.85):
        bad = rng.random(20000) < share
        vote = np.where(bad[:, None], rng.choice(3, (20000, k), p=[0.4, 0.5, 0.1]), rng.choice(3, (20000, k), p=[0.4, 0.05, 0.55]))
        codes, counts = np.unique(vote @ 3 ** np.arange(k - 1, -1, -1), return_counts=True)
        model = quality.fit_labels(codes, counts)
        assert abs(model.prior - share) < 0.03
        assert np.abs(model.votes[1][:, 1] - 0.5).max() < 0.05 and np.abs(model.votes[0][:, 2] - 0.55).max() < 0.06


def test_every_operator_is_registered():
    from retentia.llm.queries import queries

    assert {int(k[2:].split("_")[0]) for k in queries()} == set(range(1, 14)) and set(QUERIES) == set(queries())


def test_pipeline(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    n = docs.count()
    for name, stage in C.STAGES[:-1]:
        docs = C.stored(stage(spark, docs, SF001), f"test-{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and 0 < docs.count() <= n
        n = docs.count()
    assert C.mix(spark, docs, SF001).count() == n
