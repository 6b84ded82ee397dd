"""URL judging by rules and a Bloom filter cascade, in DataFrame functions only.

A cascade holds a set of listed keys exactly, relative to a universe that holds every key ever
asked: level 1 encodes the listed keys, level 2 the unlisted keys that level 1 lets through,
level 3 the listed keys that level 2 lets through, and so on until nothing slips through. A key
is listed if the first level that misses it has an even number (or, where none does, if the
number of levels is odd).

Each level is one array of 64-bit words that the rows' expression reads by a scalar subquery, so
rows are judged in their scan, without a join, at any size. The keys are dealt by hash over passes
of about ``PASS_KEYS`` listed keys, each with a cascade of its own of a few MB; with several passes,
each reads the rows and judges those that are its own, so a task never holds more than one pass.

Nulls: a null url, or one without ``://``, has an empty host and path, and the key ``''``.
Repeated urls are judged alike. A very long url is one key like any other. Empty tables give no rows.
Extra columns pass by: only page_id and url are read, and ``with_membership`` keeps all of them but
one that bears the new column's name, which it replaces.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: (action, host, path): a rule fits its host and subdomains where the path starts with its path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Of a filter whose false positives are no more than its keys; see ``shape``.
BITS_PER_KEY, HASHES = 6, 4
#: Listed keys that one pass is meant for (12 MB in level 1, less in all others).
PASS_KEYS = 16_000_000
#: Words are packed into arrays in two steps, of so many at first.
CHUNK = 4_096


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its action; null where none does."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, action = F.when(fits, h + p).otherwise(name), F.when(fits, act).otherwise(action)
    return name, action


@dataclass(frozen=True)
class Level:
    """One Bloom filter of ``bits`` bits, asked at ``hashes`` places; ``words``: one row, an array of 64-bit words."""

    number: int
    bits: int
    hashes: int
    words: DataFrame


def shape(inside: int, outside: int) -> tuple[int, int]:
    """Bits and hashes a key, for about as many false positives as keys at most: more where far more keys are outside."""
    needed = math.log2(max(2.0, outside / max(1, inside)))
    hashes = max(HASHES, math.ceil(needed))
    return max(BITS_PER_KEY, math.ceil(needed / math.log(2))), hashes


def _positions(key: Column, number: int, bits: int, hashes: int) -> list[Column]:
    a = F.pmod(F.xxhash64(F.lit(2 * number), key), F.lit(bits))
    b = F.pmod(F.xxhash64(F.lit(2 * number + 1), key), F.lit(bits))
    return [F.pmod(a + b * i + i * i, F.lit(bits)) for i in range(hashes)]


def _hit(key: Column, level: Level) -> Column:
    """Whether the level lets ``key`` through."""
    words = level.words.scalar()

    def bit(pos):
        word = F.element_at(words, F.expr("1") + F.floor(pos / 64).cast("int"))
        return F.getbit(word, (pos % 64).cast("int")) == 1

    return reduce(lambda x, y: x & y, [bit(p) for p in _positions(key, level.number, level.bits, level.hashes)])


def _encode(keys: DataFrame, number: int, n_keys: int, n_outside: int) -> Level:
    """The Bloom filter of column ``key``: bits are set by a distributed ``bit_or``, words packed chunk by chunk."""
    each, hashes = shape(n_keys, n_outside)
    bits = 64 * max(1, -(-n_keys * each // 64))
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), number, bits, hashes))).alias("pos"))
    set_bits = at.select(F.floor(F.col("pos") / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("pos") % 64).cast("int")).alias("bit"))
    blank = keys.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bit"))
    words = set_bits.unionByName(blank).groupBy("word").agg(F.bit_or("bit").alias("bit"))

    def packed(rows, by, name, value):
        ordered = F.array_sort(F.collect_list(F.struct(by, value)))
        return (rows.groupBy(name) if name else rows).agg(F.transform(ordered, lambda x: x[value]).alias("words"))

    chunks = packed(words.withColumn("chunk", F.expr(f"word div {CHUNK}")), "word", "chunk", "bit")
    whole = packed(chunks, "chunk", None, "words").select(F.flatten("words").alias("words"))
    return Level(number, bits, hashes, materialize(whole, "level"))


def _pass_of(key: Column, passes: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(passes)).cast("int")


def build_cascade(universe: DataFrame) -> list[Level]:
    """Levels for ``universe(key, listed)``, whose keys are distinct. Each level is a small job over ever fewer keys."""
    keys = materialize(universe, "keys")
    inside, outside = keys.filter("listed").select("key"), keys.filter("not listed").select("key")
    counts = {r["listed"]: r["count"] for r in keys.groupBy("listed").count().collect()}
    levels, n, n_outside = [], counts.get(True, 0), counts.get(False, 0)
    while n:
        level = _encode(inside, len(levels) + 1, n, n_outside)
        levels.append(level)
        slipped = materialize(outside.filter(_hit(F.col("key"), level)), "slipped")
        inside, outside, n, n_outside = slipped, inside, slipped.count(), n
    return levels


def build_cascades(universe: DataFrame, pass_keys: int = PASS_KEYS) -> list[list[Level]]:
    """A cascade for each pass over the keys of ``universe(key, listed)``."""
    passes = max(1, -(-universe.filter("listed").count() // pass_keys))
    if passes == 1:
        return [build_cascade(universe)]
    keys = materialize(universe, "universe")
    return [build_cascade(keys.filter(_pass_of(F.col("key"), passes) == p)) for p in range(passes)]


def with_membership(rows: DataFrame, key: str, cascades: list[list[Level]], name: str = "listed") -> DataFrame:
    """``rows`` plus the boolean ``name``: exact for every key of the universe."""
    judged = []
    for p, levels in enumerate(cascades):
        verdict = F.lit(len(levels) % 2 == 1)
        for level in reversed(levels):
            verdict = F.when(~_hit(F.col(key), level), F.lit(level.number % 2 == 0)).otherwise(verdict)
        own = rows if len(cascades) == 1 else rows.filter(_pass_of(F.col(key), len(cascades)) == p)
        judged.append(own.withColumn(name, verdict))
    return reduce(DataFrame.unionByName, judged)


def op8_url_cascade(pages: DataFrame) -> DataFrame:
    """Judge every page. There is no published block list in the tables: the keys (host and path)
    whose md5 begins with 0 or 1 stand in for one, so that exactness can be checked."""
    url = F.col("url")
    parsed = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    keyed = parsed.withColumn("_key", F.concat("host", "path"))
    universe = keyed.select(F.col("_key").alias("key")).distinct().withColumn("listed", F.substring(F.md5(F.col("key").cast("binary")), 1, 1).isin("0", "1"))
    judged = with_membership(keyed, "_key", build_cascades(universe), "_listed")
    rule, action = rule_columns(F.col("host"), F.col("path"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, F.when(F.col("_listed"), "block").otherwise("allow")).alias("verdict"))


ORACLE_OP8 = """
WITH p AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)
), r AS (
  SELECT *, CASE
      WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/en/1%' THEN 'example.org/en/1'
      WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/es/%' THEN 'example.org/es/'
      WHEN ('.' || host) LIKE '%.com' AND path LIKE '/de/%' THEN 'com/de/'
      WHEN ('.' || host) LIKE '%.com' AND path LIKE '/fr/%' THEN 'com/fr/'
      WHEN ('.' || host) LIKE '%.org' AND path LIKE '/%' THEN 'org/' END AS rule
  FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block'
            WHEN rule IS NOT NULL THEN 'allow'
            WHEN substr(md5(host || path), 1, 1) IN ('0', '1') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
