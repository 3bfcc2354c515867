"""Operator 11, URL filters by a Bloom filter cascade (DataFrame functions only).

A rule (host, path, verdict) fits a url whose host is the rule's or a subdomain of it and whose
path starts with the rule's; the longest fitting rule (characters of host and path, ties to the
longer host) gives the verdict.  A url offers one key per fitting pair of lengths: host suffix
plus path prefix.  Whether a key is a listed rule is answered by a cascade of Bloom filters:
level 1 encodes the listed keys, level 2 the corpus keys that level 1 passes wrongly, level 3 the
listed keys that level 2 passes wrongly, and so on until a level passes nothing wrongly.  As the
levels are built over every key that any url of the corpus offers, the answer is exact for all of
them.  A first cascade tells listed keys from the others, a second one, over the listed keys alone,
blocked from allowed.

Scale: the keys of the corpus are made distinct in one aggregate (partial on the map side, so a
hot host is one row a task) which also marks the listed ones; no join.  Each level is one
aggregate into 4 KB bitmaps and the scan of the keys that are still open, which shrink
geometrically.  The rows of ``pages`` are judged where they are read, without shuffle: the levels
are binary literals of the expression.  A level holds at most LEVEL_BITS bits; listed keys beyond
it are dealt by hash into shards of a cascade each, tried by the key's shard.  The driver holds
the levels and the distinct lengths of the rules, nothing of the corpus.

Cases: a null url and one without ``://`` have an empty host and path.  A url that no rule fits
holds no listed key: the cascade's verdict is allow.  A rule listed twice counts once; with both
verdicts it blocks.  A rule that holds a null, a host with ``/?#`` or a path that neither is
empty nor starts with ``/`` can fit no url and is ignored.  An empty host fits an empty host only.  Repeated and null page ids are rows of their own.  No rules:
all is allowed; no pages: no rows.  Other columns of ``pages`` are not read.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.llm.common import query, stored, table

BLOCK_BITS = 32_768  # bits of one bitmap of Spark's bitmap aggregate
LEVEL_BITS = 1 << 26  # 8 MB a level
MOST_LEVELS = 200
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

Levels = list[tuple[bytes, int, int]]  # (bits, number of bits, probes) per level


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    low = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(low, F.lit("")), F.coalesce(path, F.lit(""))


def offered(host: Column, path: Column, host_lengths: list[int], path_lengths: list[int]) -> Column:
    """Array of (size, host_size, key): the keys a url offers, of the lengths rules have."""
    n = F.length(host)
    whole = lambda s: (s == n) | ((s > 0) & (s < n) & (F.substr(host, n - s, F.lit(1)) == "."))
    hosts = F.filter(F.array(*[F.lit(x) for x in host_lengths]), whole)
    paths = F.filter(F.array(*[F.lit(x) for x in path_lengths]), lambda p: p <= F.length(path))
    key = lambda s, p: F.struct(
        (s + p).alias("size"), s.alias("host_size"), F.concat(F.substr(host, n - s + 1), F.substr(path, F.lit(1), p)).alias("key"))
    return F.flatten(F.transform(hosts, lambda s: F.transform(paths, lambda p: key(s, p))))


def position(key: Column, level: int, probe: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(level * 64 + probe), key), F.lit(bits))


def passes(key: Column, level: int, bits: bytes, m: int, probes: int) -> Column:
    """Whether a level's Bloom filter holds the key."""
    out = F.lit(True)
    for i in range(probes):
        p = position(key, level, i, m)
        byte = F.conv(F.hex(F.substr(F.lit(bits), F.shiftright(p, 3).cast("int") + 1, F.lit(1))), 16, 10)
        out = out & (F.getbit(byte.cast("long"), (p % 8).cast("int")) == 1)
    return out


def member(key: Column, levels: Levels) -> Column:
    """Whether the cascade lists the key: a miss at an odd level says no, at an even one yes."""
    out = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels), 0, -1):
        out = F.when(passes(key, i, *levels[i - 1]), out).otherwise(F.lit(i % 2 == 0))
    return out


def build_level(keys: DataFrame, level: int, m: int, probes: int) -> bytes:
    """The bits of one level: 4 KB bitmaps by block, at most m / BLOCK_BITS of them."""
    p = keys.select(F.explode(F.array(*[position(F.col("key"), level, i, m) for i in range(probes)])).alias("p"))
    blocks = p.groupBy(F.bitmap_bucket_number(F.col("p") + 1).alias("b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("p") + 1)).alias("bits"))
    bits = bytearray(m // 8)
    for r in blocks.collect():
        at = (r["b"] - 1) * BLOCK_BITS // 8
        bits[at : at + len(r["bits"])] = r["bits"]
    return bytes(bits[: m // 8])  # a level of less than a block ends inside it


def build_cascade(universe: DataFrame, least_bits: int = BLOCK_BITS) -> Levels:
    """The levels that tell listed from other keys of ``universe`` (key, listed), a stored table.

    Level 1 is sized to pass about as many others as there are listed keys, later ones pass half."""
    levels: Levels = []
    inside, outside = universe.where("listed"), universe.where(~F.col("listed"))
    n_in, n_out = inside.count(), outside.count()
    while n_in:
        level = len(levels) + 1
        if level > MOST_LEVELS:
            raise RuntimeError(f"keys that {MOST_LEVELS} seeds of the hash do not tell apart")
        probes = max(1, min(16, math.ceil(math.log2(max(n_out, 1) / n_in)))) if n_out > n_in else 1
        m = max(least_bits, math.ceil(n_in * probes / math.log(2) / 8) * 8)
        levels.append((build_level(inside, level, m, probes), m, probes))
        wrong = stored(outside.where(passes(F.col("key"), level, *levels[-1])), "cascade-level")
        inside, outside, n_in, n_out = wrong, inside, wrong.count(), n_in
    return levels


def shards_of(n_listed: int, most_bits: int = LEVEL_BITS) -> int:
    """Shards so that no level of one passes ``most_bits`` (level 1 takes up to 16 probes)."""
    return max(1, math.ceil(n_listed * 16 / math.log(2) / most_bits))


def cascades(universe: DataFrame, most_bits: int = LEVEL_BITS, least_bits: int = BLOCK_BITS) -> list[Levels]:
    """A cascade per shard of the keys; ``universe``: key, listed."""
    n = shards_of(universe.where("listed").count(), most_bits)
    return [build_cascade(universe.where(shard(F.col("key"), n) == i), least_bits) for i in range(n)]


def shard(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(n))


def listed_in(key: Column, parts: list[Levels]) -> Column:
    out = member(key, parts[0])
    for i in range(1, len(parts)):
        out = F.when(shard(key, len(parts)) == i, member(key, parts[i])).otherwise(out)
    return out


def filter_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url",
                most_bits: int = LEVEL_BITS, least_bits: int = BLOCK_BITS) -> DataFrame:
    """Per row of ``pages``: key, host, path, rule (the longest that fits, or null), verdict.

    ``rules``: host, path, verdict (allow or block)."""
    host, path = host_path(F.col(url))
    low = F.translate("host", string.ascii_uppercase, string.ascii_lowercase)
    fits = F.col("host").rlike(r"^[^/?#]*$") & F.col("path").rlike(r"^(/[^?#]*)?$") & F.col("verdict").isNotNull()
    listed = rules.where(fits).select(
        low.alias("host"), "path", (F.col("verdict") == "block").alias("block"))
    judged = pages.select(F.col(key).alias(key), host.alias("host"), path.alias("path"))
    lengths = [sorted(r[0] for r in listed.select(F.length(c)).distinct().collect()) for c in ("host", "path")]
    if not lengths[0]:
        return judged.select(key, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    keys = offered(F.col("host"), F.col("path"), *lengths)
    of_corpus = judged.select(F.explode(keys.getField("key")).alias("key"), F.lit(0).alias("mark"))
    of_rules = listed.select(F.concat("host", "path").alias("key"), F.when(F.col("block"), 2).otherwise(1).alias("mark"))
    # 0 in the corpus, 1 allowed, 2 blocked; listed keys that no url offers need no bits
    marks = of_corpus.unionByName(of_rules).groupBy("key").agg(F.max("mark").alias("mark"), F.min("mark").alias("least"))
    universe = stored(marks.where("least = 0").select("key", "mark"), "cascade-keys")
    is_listed = cascades(universe.select("key", (F.col("mark") > 0).alias("listed")), most_bits, least_bits)
    is_blocked = cascades(universe.where("mark > 0").select("key", (F.col("mark") == 2).alias("listed")), most_bits, least_bits)
    fit = F.array_max(F.filter(keys, lambda k: listed_in(k["key"], is_listed)))["key"]
    out = judged.withColumn("rule", fit)
    blocked = F.col("rule").isNotNull() & listed_in(F.col("rule"), is_blocked)
    return out.select(key, "host", "path", "rule", F.when(blocked, "block").otherwise("allow").alias("verdict"))


@query(
    "op11_url_filter",
    """
    WITH r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
    a AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    b AS (SELECT n, page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h0 FROM a),
    u AS (SELECT n, page_id, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(substr(rest, length(h0) + 1), '^[^?#]*') AS path FROM b),
    f AS (SELECT n, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
          FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n)
    SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN f USING (n)
    """,
)
def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of the four rules for every page."""
    cells = F.array(*[F.struct(*[F.lit(x).alias(c) for x, c in zip(r, ("host", "path", "verdict"), strict=True)]) for r in RULES])
    rules = spark.range(1).select(F.inline(cells))
    return filter_urls(table(spark, sf_dir, "pages"), rules)
