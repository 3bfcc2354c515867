"""Operator 5, mixing sources to target weights by entropy balancing (DataFrame functions only).

Every source has a target in words.  Among all document rates w between 0 and ``cap`` that meet
the targets, the ones closest to 1 in relative entropy are ``w = min(cap, exp(lambda_s * z))``
with z the document's size over its source's mean size and one multiplier per source: the
dual of the convex problem.  Its maximum is found by safeguarded Newton steps, each one
aggregate over the (source, size) histogram.  The rates are rounded into copies: per source the
sizes in falling order carry the rounding error on, and what is left of a source's target is
then settled in whole copies, larger sizes first.  Within one size the documents that get
the additional copy are those first in the order of a hash of their key and text.

Targets: sources in code-point order, null last, weigh 5, 2, 1, repeating, and share
``budget`` times all words; none gets more than ``cap`` times its words, the excess is shared
again by weight.

Scale: the text is read once, for its word count; the stored (key, source, size) rows are
grouped by size before any iteration.  A source has at most sqrt(2 * words) different
sizes, and only those meet in one task, never its documents.  Documents are ranked within
(source, size, slice) with slices by hash, so a hot source or a hot size is spread out; rows equal
in key and text are counted on the map side and ranked as one entry, so a hot row is too.

Ends: the Newton steps go on until every target is met to GAP or its bracket holds no further
double; targets still missed then raise an error.  Settling goes on until nothing moves.

Cases: null text has size 0; size 0 takes 0 words.  A source whose target is its whole cap takes
every document ``cap`` times.  Repeated rows are documents of their own.  Null keys are allowed.
No documents: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retentia.llm.common import partitions, query, stored, table
from retentia.llm.words import WORD_PATTERN

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
CAP = 2
GAP = 1e-10  # of a target, at which its multiplier is found


def source_targets(sizes: DataFrame, weights: Sequence[int], budget: float, cap: int) -> DataFrame:
    """(sk, words, docs, target) per source key."""
    spark = sizes.sparkSession
    by = sizes.groupBy("sk").agg(F.sum("size").alias("words"), F.count("*").alias("docs"))
    # ranks without a single sorting task: ranges of the key order, counted, then offset
    ranged = by.repartitionByRange(partitions(spark), "sk").withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "mix-sources")
    n = ranged.groupBy("part").agg(F.count("*").alias("n"))  # at most one row a partition
    before = n.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("sk")) + F.col("before")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    src = ranged.join(before, "part").select("sk", "words", "docs", w.alias("weight"))
    src = stored(src, "mix-weights")
    total = budget * (src.agg(F.sum("words").alias("s")).first()["s"] or 0)
    level, capped = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("words") * cap <= F.col("weight") * level
        x = src.agg(F.coalesce(F.sum(F.when(full, F.col("words") * cap)), F.lit(0)).alias("c"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("w"), F.count_if(full).alias("n")).first()
        if x["n"] == capped or not x["w"]:
            break
        capped, level = x["n"], max(0.0, total - x["c"]) / x["w"]
    return src.select("sk", "words", "docs", F.least(F.col("words") * float(cap), F.col("weight") * F.lit(level or 0.0)).alias("target"))


def balance(hist: DataFrame, cap: int) -> DataFrame:
    """Multipliers (sk, lam) that meet the targets; null where the target is the whole cap.

    ``hist``: sk, size, n, words, docs, target; sizes above 0 only."""
    z = F.col("size") * F.col("docs") / F.col("words")
    hist = hist.where(F.col("target") < F.col("words") * cap * (1 - 1e-12)).select("sk", "size", "n", z.alias("z"), "target")
    state = hist.select("sk").distinct().select("sk", F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(1.0).alias("gap"), F.lit(False).alias("closed"))
    state = stored(state, "mix-dual")
    turn = 0
    while True:
        turn += 1
        e = F.exp(F.least(F.col("lam") * F.col("z"), F.lit(50.0)))
        words = F.col("size") * F.col("n")
        g = F.sum(words * F.least(e, F.lit(float(cap)))) - F.first("target")
        slope = F.sum(F.when(e < cap, words * F.col("z") * e).otherwise(0.0))
        step = hist.join(state, "sk").groupBy("sk", "lam", "lo", "hi").agg(g.alias("g"), slope.alias("slope"), F.first("target").alias("target"))
        lo = F.when(F.col("g") <= 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(F.col("g") >= 0, F.col("lam")).otherwise(F.col("hi"))
        step = step.select("sk", "lam", lo.alias("lo"), hi.alias("hi"), "g", "slope", (F.abs("g") / F.greatest(F.col("target"), F.lit(1.0))).alias("gap"))
        both = F.col("lo").isNotNull() & F.col("hi").isNotNull()
        newton = F.when(F.col("slope") > 0, F.col("lam") - F.col("g") / F.col("slope"))
        reach = F.greatest(F.lit(1.0), 2 * F.abs("lam"))
        fallback = F.when(both, (F.col("lo") + F.col("hi")) / 2).otherwise(F.col("lam") - F.signum("g") * reach)
        inside = (newton > F.coalesce("lo", F.col("lam") - reach)) & (newton < F.coalesce("hi", F.col("lam") + reach))
        # every fourth step halves the bracket whatever Newton offers, so the loop ends: at the
        # latest when no double lies between the ends
        halve = both & F.lit(turn % 4 == 0)
        closed = F.coalesce(both & (F.col("hi") - F.col("lo") <= 1e-15 * F.greatest(F.abs("lo"), F.abs("hi"))), F.lit(False))
        new = F.when((F.col("gap") < GAP) | closed, F.col("lam")).when(inside & ~halve, newton).otherwise(fallback)
        state = stored(step.select("sk", new.alias("lam"), "lo", "hi", "gap", closed.alias("closed")), "mix-dual")
        left = state.where((F.col("gap") >= GAP) & ~F.col("closed")).count()
        if not left:
            break
    worst = state.agg(F.max("gap").alias("m")).first()["m"] or 0.0
    if worst > 1e-6:
        raise RuntimeError(f"no multiplier meets a target: off by {worst} of it")
    return state.select("sk", "lam")


def allot(hist: DataFrame, cap: int) -> DataFrame:
    """Whole copies per (sk, size): the rounded rates, then the rest of each target settled."""
    down = Window.partitionBy("sk").orderBy(F.col("size").desc())
    upto, before = down.rowsBetween(Window.unboundedPreceding, 0), down.rowsBetween(Window.unboundedPreceding, -1)
    carried = F.round(F.sum(F.col("n") * F.col("rate")).over(upto))
    hist = hist.withColumn("upto", carried.cast("long"))
    hist = hist.withColumn("copies", F.col("upto") - F.coalesce(F.lag("upto").over(down), F.lit(0))).drop("upto")
    hist = stored(hist, "mix-copies")
    while True:  # what is due halves with each pass at least, in whole words
        due = F.col("target") - F.sum(F.col("copies") * F.col("size")).over(Window.partitionBy("sk"))
        x = hist.withColumn("due", due)
        room = F.when(F.col("due") > 0, cap * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("due"))
        x = x.withColumn("room", F.when(fits, room).otherwise(0))
        left = F.abs("due") - F.coalesce(F.sum(F.col("room") * F.col("size")).over(before), F.lit(0))
        # the largest size that fits moves at least once, so what is due halves at least
        moved = F.least(F.col("room"), F.floor(F.greatest(left, F.lit(0.0)) / F.col("size")))
        moved = F.when(F.col("size") > 0, moved).otherwise(0).cast("long")
        x = x.withColumn("moved", moved)
        x = stored(x.select(*[c for c in hist.columns if c != "copies"], (F.col("copies") + F.when(F.col("due") > 0, F.col("moved")).otherwise(-F.col("moved"))).alias("copies"), "moved"), "mix-copies")
        hist = x.drop("moved")
        if not x.agg(F.sum("moved").alias("m")).first()["m"]:
            break
    return hist


def mix_sources(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
                weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, cap: int = CAP) -> DataFrame:
    """Per row: key, size, source_size, target, taken (words), copies."""
    spark = docs.sparkSession
    # the source as a sorting key: null after every name
    sk = F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    sizes = docs.select(F.col(key).alias("key"), sk.alias("sk"), size.alias("size"), F.xxhash64(F.lit(41), F.col(key), F.col(text)).alias("h"))
    sizes = stored(sizes.withColumn("part", F.spark_partition_id()), "mix-sizes")
    src = source_targets(sizes, weights, budget, cap)
    hist = sizes.groupBy("sk", "size").agg(F.count("*").alias("n"))
    hist = stored(hist.join(src, "sk"), "mix-hist")
    dual = balance(hist.where("size > 0"), cap)
    z = F.col("size") * F.col("docs") / F.col("words")
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("lam").isNull(), float(cap)).otherwise(F.least(F.exp(F.least(F.col("lam") * z, F.lit(50.0))), F.lit(float(cap))))
    hist = allot(hist.join(dual, "sk", "left").select("sk", "size", "n", "words", "target", rate.alias("rate")), cap)
    # within a size the additional copies go by hash order; rows equal in key and text (h) are one
    # entry of m rows, however many there are, and entries are counted per slice of the hash
    total = sizes.count()
    slices = max(64, math.ceil(total / 50_000))
    entry = ["sk", "size", "key", "h"]
    same = sizes.groupBy(*entry).agg(F.count("*").alias("m")).withColumn("slice", F.pmod("h", F.lit(slices)))
    n = same.groupBy("sk", "size", "slice").agg(F.sum("m").alias("m"))
    ahead = F.coalesce(F.sum("m").over(Window.partitionBy("sk", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = n.withColumn("ahead", ahead).join(hist, ["sk", "size"])
    each = F.floor(F.col("copies") / F.col("n"))
    more = F.col("copies") - each * F.col("n") - F.col("ahead")
    n = n.select("sk", "size", "slice", "words", "target", each.alias("each"), more.alias("more"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("sk", "size", "slice").orderBy("h", "key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = same.withColumn("before", before).join(n, ["sk", "size", "slice"])
    extra = F.greatest(F.lit(0), F.least(F.col("m"), F.col("more") - F.col("before")))
    same = same.select(*entry, "words", "target", "each", "m", extra.alias("extra"))
    match = [F.col("r.sk") == F.col("s.sk"), F.col("r.size") == F.col("s.size"), F.col("r.key").eqNullSafe(F.col("s.key")), F.col("r.h") == F.col("s.h")]
    rows = sizes.alias("r").join(same.alias("s"), match).select("r.*", "s.words", "s.target", "s.each", "s.m", "s.extra")
    # equal rows of which only some get the copy (one entry a size at most): numbered per stored part
    some = (F.col("extra") > 0) & (F.col("extra") < F.col("m"))
    parts = rows.where(some).groupBy(*entry, "part").agg(F.count("*").alias("here"))
    earlier = F.coalesce(F.sum("here").over(Window.partitionBy(*entry).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*entry, "part", earlier.alias("earlier"))
    match = [F.col("r.sk") == F.col("p.sk"), F.col("r.size") == F.col("p.size"), F.col("r.key").eqNullSafe(F.col("p.key")), F.col("r.h") == F.col("p.h"), F.col("r.part") == F.col("p.part")]
    split = rows.where(some).alias("r").join(parts.alias("p"), match).select("r.*", "p.earlier")
    place = F.row_number().over(Window.partitionBy(*entry, "part").orderBy("each")) + F.col("earlier")
    plus = split.select(*rows.columns, F.when(place <= F.col("extra"), 1).otherwise(0).alias("plus"))
    rows = rows.where(~some).withColumn("plus", F.when(F.col("extra") > 0, 1).otherwise(0)).unionByName(plus)
    copies = (F.col("each") + F.col("plus")).cast("long")
    return rows.select(F.col("key").alias(key), "size", F.col("words").alias("source_size"), "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


@query("op5_mix")
def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents to the sources' target weights."""
    return mix_sources(table(spark, sf_dir, "documents"))
